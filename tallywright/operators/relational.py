"""Relational queries over the driver's tables: joins, aggregates, windows, sorts, sets, scalar functions.

Each entry of ``SQL`` is one statement that Spark and DuckDB both read;
``PAIRS`` holds (Spark, DuckDB) where the dialects differ.  Statements with
joins leave strategy and order to Catalyst: no hints, equi-keys where the
semantics have them, filters written where they prune the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.session import load, views

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()

SQL: dict[str, str] = {
    "inner_join": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 1000",
    "left_join": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F'",
    "right_join": "SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_totalprice > 5000",
    "outer_join": "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL OUTER JOIN supplier s ON c.c_custkey = s.s_suppkey * 2",
    "cross_join": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n WHERE r.r_regionkey <> n.n_regionkey",
    "using_join": "SELECT l_suppkey AS k, count(*) AS n FROM lineitem JOIN (SELECT s_suppkey AS l_suppkey FROM supplier) USING (l_suppkey) GROUP BY l_suppkey",
    "self_theta_join": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey",
    "arithmetic_join": "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_totalprice < b.o_totalprice",
    "range_join": "SELECT n.n_nationkey, r.r_regionkey FROM nation n JOIN region r ON n.n_regionkey < r.r_regionkey",
    "exists_semi": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 3000)",
    "in_semi": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')",
    "not_exists_anti": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "not_in_null": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey = 1 THEN NULL ELSE o_custkey END FROM orders)",
    "not_in_nonnull": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "scalar_sub": "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)",
    "scalar_sub_empty": "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT o_totalprice FROM orders WHERE o_orderkey < 0)",
    "cte_join": "WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT c.c_name, t.n FROM t JOIN customer c ON c.c_custkey = t.o_custkey WHERE t.n > 5",
    "derived_table": "SELECT d.c_mktsegment, d.n FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment) d WHERE d.n > 1",
    "having_agg": "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey HAVING count(*) > 8",
    "distinct_users": "SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'",
    "facet_topk": "SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, value LIMIT 11",
    "facet_users": "SELECT user_id AS value, count(DISTINCT event_id) AS n FROM events GROUP BY user_id ORDER BY n DESC, value LIMIT 11",
    "count_distinct_filter": "SELECT count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (WHERE event_type = 'error') AS error_users, count(*) FILTER (WHERE value > 50) AS high FROM events",
    "bool_and_agg": "SELECT o_custkey, bool_and(o_totalprice > 1000) AS all_large, bool_or(o_orderstatus = 'F') AS any_f FROM orders GROUP BY o_custkey",
    "group_by_ordinal": "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1",
    "case_levels": "SELECT CASE WHEN value >= 90 THEN 'error' WHEN value >= 60 THEN 'warn' WHEN value >= 30 THEN 'info' ELSE 'debug' END AS level, count(*) AS records FROM events GROUP BY CASE WHEN value >= 90 THEN 'error' WHEN value >= 60 THEN 'warn' WHEN value >= 30 THEN 'info' ELSE 'debug' END",
    "union_all": "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, CAST(NULL AS VARCHAR(10)) FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect_ops": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all_ops": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except_ops": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "except_all_ops": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "recursive_cte": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n FROM t",
    "half_open_range": "SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts < TIMESTAMP '2024-01-05 00:00:00'",
    "predicates": "SELECT event_id FROM events WHERE (event_type IN ('click', 'view') OR event_type LIKE 'sig%') AND NOT value BETWEEN 20 AND 80 AND user_id IS NOT NULL AND event_type <> 'error'",
    "conditional_funcs": "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'open') AS s, greatest(o_totalprice, 1000.0) AS g, least(o_totalprice, 1000.0) AS l FROM orders",
    "hash_funcs": "SELECT p_partkey, md5(p_name) AS m FROM part",
    "decimal_sum": "SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(38, 2))) AS DECIMAL(38, 2)) AS total FROM orders GROUP BY o_orderstatus",
}

PAIRS: dict[str, tuple[str, str]] = {
    "string_funcs": (
        "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, substr(p_name, 2, 5) AS s, replace(p_type, ' ', '_') AS r, concat(p_brand, '-', p_type) AS c, lpad(p_brand, 12, '*') AS lp, reverse(p_name) AS rv, trim(p_type) AS t, repeat(p_brand, 2) AS rp, split_part(p_type, ' ', 1) AS sp, startswith(p_name, 'a') AS st, CAST(length(p_name) AS BIGINT) AS n FROM part",
        "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, substr(p_name, 2, 5) AS s, replace(p_type, ' ', '_') AS r, concat(p_brand, '-', p_type) AS c, lpad(p_brand, 12, '*') AS lp, reverse(p_name) AS rv, trim(p_type) AS t, repeat(p_brand, 2) AS rp, split_part(p_type, ' ', 1) AS sp, starts_with(p_name, 'a') AS st, CAST(length(p_name) AS BIGINT) AS n FROM part",
    ),
    "grouped_aggregates": (
        "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS qty, round(avg(l_discount), 9) AS disc, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS qty, round(avg(l_discount), 9) AS disc, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus",
    ),
    "corr_scalar_sub": (
        "SELECT c_custkey, (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) FROM orders o WHERE o.o_custkey = c.c_custkey) AS total FROM customer c",
        "SELECT c_custkey, (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) FROM orders o WHERE o.o_custkey = c.c_custkey) AS total FROM customer c",
    ),
    "lateral_max": (
        "SELECT c.c_custkey, m.top FROM customer c, LATERAL (SELECT max(o_totalprice) AS top FROM orders o WHERE o.o_custkey = c.c_custkey) m",
        "SELECT c.c_custkey, m.top FROM customer c, LATERAL (SELECT max(o_totalprice) AS top FROM orders o WHERE o.o_custkey = c.c_custkey) m",
    ),
    "percentiles": (
        "SELECT event_type, percentile(value, 0.95) AS p95, percentile(value, 0.5) AS p50 FROM events GROUP BY event_type",
        "SELECT event_type, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.5) AS p50 FROM events GROUP BY event_type",
    ),
    "ordered_last": (
        "SELECT event_type, max_by(value, struct(ts, event_id)) AS last FROM events GROUP BY event_type",
        "SELECT event_type, last(value ORDER BY ts, event_id) AS last FROM events GROUP BY event_type",
    ),
    "ordered_collect": (
        "SELECT user_id, concat_ws(',', transform(array_sort(collect_list(struct(ts, event_id))), e -> CAST(e.event_id AS STRING))) AS ids FROM events WHERE event_type = 'purchase' GROUP BY user_id",
        "SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids FROM events WHERE event_type = 'purchase' GROUP BY user_id",
    ),
    "cube_agg": (
        "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
        "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    ),
    "rollup_agg": (
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    ),
    "grouping_sets": (
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    ),
    "stats_agg": (
        "SELECT o_orderstatus, round(stddev_samp(o_totalprice), 6) AS sd, round(var_pop(o_totalprice) / 1000, 4) AS vp, round(corr(o_totalprice, o_custkey), 9) AS c, median(o_totalprice) AS med FROM orders GROUP BY o_orderstatus",
        "SELECT o_orderstatus, round(stddev_samp(o_totalprice), 6) AS sd, round(var_pop(o_totalprice) / 1000, 4) AS vp, round(corr(o_totalprice, o_custkey), 9) AS c, median(o_totalprice) AS med FROM orders GROUP BY o_orderstatus",
    ),
    "string_agg": (
        "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    ),
    "bit_aggs": (
        "SELECT o_orderstatus, bit_and(o_custkey) AS a, bit_or(o_custkey) AS o, bit_xor(o_custkey) AS x FROM orders GROUP BY o_orderstatus",
        "SELECT o_orderstatus, bit_and(o_custkey) AS a, bit_or(o_custkey) AS o, bit_xor(o_custkey) AS x FROM orders GROUP BY o_orderstatus",
    ),
    "sequence_join": (
        "SELECT i, r.r_name FROM (SELECT explode(sequence(0, 9)) AS i) JOIN region r ON r.r_regionkey = i",
        "SELECT CAST(i AS INTEGER) AS i, r.r_name FROM (SELECT unnest(generate_series(0, 9)) AS i) JOIN region r ON r.r_regionkey = i",
    ),
    "explode_zip": (
        "SELECT vec_id, p + 1 AS i, CAST(x AS DOUBLE) AS x FROM embeddings LATERAL VIEW posexplode(slice(embedding, 1, 4)) AS p, x",
        "SELECT vec_id, CAST(unnest(generate_series(1, 4)) AS INTEGER) AS i, CAST(unnest(embedding[1:4]) AS DOUBLE) AS x FROM embeddings",
    ),
    "array_funcs": (
        "SELECT vec_id, size(embedding) AS n, CAST(try_element_at(embedding, 2) AS DOUBLE) AS second, CAST(try_element_at(embedding, 100000) AS DOUBLE) AS beyond, CAST(array_max(embedding) AS DOUBLE) AS hi, array_contains(array(label, 3), 3) AS has3 FROM embeddings",
        "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, CAST(embedding[2] AS DOUBLE) AS second, CAST(embedding[100000] AS DOUBLE) AS beyond, CAST(list_max(embedding) AS DOUBLE) AS hi, list_contains([label, 3], 3) AS has3 FROM embeddings",
    ),
    "map_funcs": (
        "SELECT user_id, m['click'] AS clicks, m['purchase'] AS purchases, map_contains_key(m, 'error') AS has_error FROM (SELECT user_id, map_from_entries(array_sort(collect_list(struct(event_type, n)))) AS m FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id)",
        "SELECT user_id, max(n) FILTER (WHERE event_type = 'click') AS clicks, max(n) FILTER (WHERE event_type = 'purchase') AS purchases, bool_or(event_type = 'error') AS has_error FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id",
    ),
    "hex_roundtrip": (
        "SELECT p_partkey, lower(hex(p_name)) AS h, CAST(unhex(hex(p_name)) AS STRING) = p_name AS same FROM part",
        "SELECT p_partkey, lower(hex(encode(p_name))) AS h, decode(unhex(hex(encode(p_name)))) = p_name AS same FROM part",
    ),
    "date_parts": (
        "SELECT o_orderkey, date_part('year', o_orderdate) AS y, date_part('month', o_orderdate) AS m, date_part('hour', o_orderdate) AS h, date_format(o_orderdate, 'HH:mm') AS hm, unix_micros(CAST(o_orderdate AS TIMESTAMP)) AS us, date_format(o_orderdate, 'yyyy-MM') AS month FROM orders",
        "SELECT o_orderkey, CAST(date_part('year', o_orderdate) AS INTEGER) AS y, CAST(date_part('month', o_orderdate) AS INTEGER) AS m, CAST(date_part('hour', o_orderdate) AS INTEGER) AS h, strftime(o_orderdate, '%H:%M') AS hm, epoch_us(o_orderdate) AS us, strftime(o_orderdate, '%Y-%m') AS month FROM orders",
    ),
    "math_funcs": (
        "SELECT l_orderkey, l_linenumber, floor(l_extendedprice) AS f, ceil(l_extendedprice) AS c, abs(l_tax - l_discount) AS a, round(sqrt(l_extendedprice), 9) AS s, round(ln(l_extendedprice), 9) AS l, round(power(l_quantity, 2), 6) AS p, l_orderkey div 7 AS d, l_orderkey % 7 AS m, sign(l_tax - l_discount) AS g FROM lineitem",
        "SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(ceil(l_extendedprice) AS BIGINT) AS c, abs(l_tax - l_discount) AS a, round(sqrt(l_extendedprice), 9) AS s, round(ln(l_extendedprice), 9) AS l, round(power(l_quantity, 2), 6) AS p, l_orderkey // 7 AS d, l_orderkey % 7 AS m, CAST(sign(l_tax - l_discount) AS DOUBLE) AS g FROM lineitem",
    ),
    "regex_funcs": (
        "SELECT p_partkey, p_name rlike '^[a-m]' AS early, regexp_replace(p_type, '[aeiou]', '#') AS masked, regexp_extract(p_brand, '([0-9]+)', 1) AS digits FROM part",
        "SELECT p_partkey, regexp_matches(p_name, '^[a-m]') AS early, regexp_replace(p_type, '[aeiou]', '#', 'g') AS masked, regexp_extract(p_brand, '([0-9]+)', 1) AS digits FROM part",
    ),
    "variant_path": (
        "SELECT event_id, try_variant_get(parse_json(props), '$.k', 'bigint') AS k, try_variant_get(parse_json(props), '$.nope', 'string') AS nope, CAST(try_variant_get(parse_json(props), '$.k', 'variant') AS STRING) AS text FROM events",
        "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.nope') AS nope, json_extract_string(props, '$.k') AS text FROM events",
    ),
    "variant_group": (
        "SELECT try_variant_get(parse_json(props), '$.k', 'bigint') AS k, count(*) AS n FROM events GROUP BY 1",
        "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
    ),
    "jsonpath_rule": (
        "SELECT event_id, get_json_object(props, '$.k') IS NOT NULL AS found, CAST(get_json_object(props, '$.k') AS BIGINT) > 50 AS passed FROM events",
        "SELECT event_id, json_extract(props, '$.k') IS NOT NULL AS found, CAST(json_extract(props, '$.k') AS BIGINT) > 50 AS passed FROM events",
    ),
    "time_bin_counts": (
        "SELECT window(ts, '15 minutes').start AS at, count(*) AS n FROM events GROUP BY 1",
        "SELECT time_bucket(INTERVAL '15 minutes', ts) AS at, count(*) AS n FROM events GROUP BY 1",
    ),
    "time_bin_errors": (
        "SELECT window(ts, '1 hour').start AS at, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1",
        "SELECT time_bucket(INTERVAL '1 hour', ts) AS at, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1",
    ),
    "time_bin_percentiles": (
        "SELECT window(ts, '1 day').start AS at, percentile(value, 0.95) AS p95, percentile(value, 0.5) AS p50 FROM events GROUP BY 1",
        "SELECT time_bucket(INTERVAL '1 day', ts) AS at, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.5) AS p50 FROM events GROUP BY 1",
    ),
    "integer_division": ("SELECT o_orderkey, o_orderkey div 3 AS q FROM orders", "SELECT o_orderkey, o_orderkey // 3 AS q FROM orders"),
    "multi_row_keys": (
        "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20",
        "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20",
    ),
}


def _windows() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    """Window queries, by the DataFrame API; each partitions by a key unless the semantics are global."""

    def orders(s, d):
        return load(s, d, "orders")

    def by_cust():
        return W.partitionBy("o_custkey").orderBy(F.col("o_orderdate").asc_nulls_first(), "o_orderkey")

    def full():
        return W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)

    def price():
        return W.partitionBy("o_orderpriority").orderBy(F.col("o_totalprice").desc_nulls_last())

    sql = "PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey"

    def topk(s, d):
        """The 20 users with the largest summed value, every bin of theirs, and how many users there are."""
        ev = load(s, d, "events").groupBy("user_id", F.window("ts", "1 day").start.alias("day")).agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("v"))
        total = ev.groupBy("user_id").agg(F.sum("v").alias("measure"))
        best = total.orderBy(F.desc_nulls_last("measure"), "user_id").limit(20)
        groups = total.agg(F.count("*").alias("groups"))
        return ev.join(F.broadcast(best.select("user_id")), "user_id").crossJoin(F.broadcast(groups)).select("user_id", "day", F.col("v").cast("double").alias("v"), "groups")

    return {
        "rank": (lambda s, d: orders(s, d).select("o_orderkey", F.rank().over(price()).cast("long").alias("r")), "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC NULLS LAST) AS r FROM orders"),
        "dense_rank": (lambda s, d: orders(s, d).select("o_orderkey", F.dense_rank().over(W.partitionBy("o_custkey").orderBy(F.desc_nulls_last("o_orderpriority"), F.asc_nulls_last("o_orderstatus"))).cast("long").alias("r")), "SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC NULLS LAST, o_orderstatus ASC NULLS LAST) AS r FROM orders"),
        "lag_delta": (lambda s, d: orders(s, d).select("o_orderkey", F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(by_cust()), 4).alias("delta")), f"SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER ({sql}), 4) AS delta FROM orders"),
        "running_sum": (lambda s, d: orders(s, d).select("o_orderkey", F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(by_cust().rowsBetween(W.unboundedPreceding, 0)).cast("double").alias("run")), f"SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER ({sql} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS run FROM orders"),
        "last_value_full": (lambda s, d: orders(s, d).select("o_orderkey", F.last_value("o_totalprice").over(full()).alias("last"), F.first_value("o_orderkey").over(full()).alias("first")), "SELECT o_orderkey, last_value(o_totalprice) OVER w AS last, first_value(o_orderkey) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
        "window_functions": (lambda s, d: orders(s, d).select("o_orderkey", F.row_number().over(by_cust()).cast("long").alias("rn"), F.lead("o_orderkey").over(by_cust()).alias("nxt"), F.round(F.percent_rank().over(by_cust()), 9).alias("pr"), F.round(F.cume_dist().over(by_cust()), 9).alias("cd"), F.nth_value("o_orderkey", 2).over(full()).alias("second")), f"SELECT o_orderkey, row_number() OVER ({sql}) AS rn, lead(o_orderkey) OVER ({sql}) AS nxt, round(percent_rank() OVER ({sql}), 9) AS pr, round(cume_dist() OVER ({sql}), 9) AS cd, nth_value(o_orderkey, 2) OVER ({sql} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM orders"),
        "ntile_rows": (lambda s, d: orders(s, d).select("o_orderkey", F.ntile(3).over(by_cust()).cast("long").alias("t")), f"SELECT o_orderkey, ntile(3) OVER ({sql}) AS t FROM orders"),
        "partition_stats": (lambda s, d: orders(s, d).select("o_orderkey", F.count("*").over(W.partitionBy("o_custkey")).alias("n"), F.max("o_totalprice").over(W.partitionBy("o_custkey")).alias("top")), "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders"),
        "range_frame": (lambda s, d: orders(s, d).select("o_orderkey", F.count("*").over(W.partitionBy("o_orderpriority").orderBy("o_custkey").rangeBetween(-5, 5)).alias("near")), "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM orders"),
        "topk_groups": (topk, "WITH e AS (SELECT user_id, time_bucket(INTERVAL '1 day', ts) AS day, sum(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY 1, 2), t AS (SELECT user_id, sum(v) AS m FROM e GROUP BY 1), b AS (SELECT user_id FROM t ORDER BY m DESC NULLS LAST, user_id LIMIT 20) SELECT user_id, day, CAST(v AS DOUBLE) AS v, (SELECT count(*) FROM t) AS groups FROM e WHERE user_id IN (SELECT user_id FROM b)"),
        "proj_filter_topk": (lambda s, d: orders(s, d).where("o_totalprice >= 1000").select("o_orderkey", F.col("o_totalprice").alias("price")).orderBy(F.desc_nulls_last("price"), "o_orderkey").limit(10), "SELECT o_orderkey, o_totalprice AS price FROM orders WHERE o_totalprice >= 1000 ORDER BY price DESC NULLS LAST, o_orderkey LIMIT 10"),
    }


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *TABLES)
        return spark.sql(text)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{k: _sql(v) for k, v in SQL.items()},
    **{k: _sql(v[0]) for k, v in PAIRS.items()},
    **{k: v[0] for k, v in _windows().items()},
}
ORACLE_SQL: dict[str, str] = {**SQL, **{k: v[1] for k, v in PAIRS.items()}, **{k: v[1] for k, v in _windows().items()}}
