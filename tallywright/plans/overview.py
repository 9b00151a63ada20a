"""The flagship query and dashboard statements, written in the warehouse's dialect and run through it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallywright.plans import dialect, gate
from tallywright.session import load

EVENTS = "tally.traces.events"

STATEMENTS: dict[str, tuple[str, list, str]] = {
    "time_overview": (
        f"SELECT date_bin($1::interval, ts) AS bin, count(*) AS spans, count(*) FILTER (WHERE event_type = 'error') AS errors, approx_percentile_cont(value, 0.95) AS p95, approx_percentile_cont(value, 0.5) AS p50 FROM {EVENTS} GROUP BY date_bin($1::interval, ts) ORDER BY bin",
        ["15 minutes"],
        "SELECT time_bucket(INTERVAL '15 minutes', ts) AS bin, count(*) AS spans, count(*) FILTER (WHERE event_type = 'error') AS errors, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.5) AS p50 FROM events GROUP BY 1",
    ),
    "dialect_variant": (
        f"SELECT event_id, v ->> 'k' AS text, encode(CAST(event_type AS BINARY), 'hex') AS h, to_char(ts, '%Y-%m-%d %H:%M') AS at_minute FROM \"{EVENTS}\" WHERE ts >= $1::timestamptz AND ts < $2::timestamptz",
        ["2024-01-02 00:00:00", "2024-01-03 00:00:00"],
        "SELECT event_id, json_extract_string(props, '$.k') AS text, lower(hex(encode(event_type))) AS h, strftime(ts, '%Y-%m-%d %H:%M') AS at_minute FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-03'",
    ),
    "dialect_totals": (
        f"SELECT count(*) AS spans, count(DISTINCT user_id) AS traces, count(DISTINCT user_id) FILTER (WHERE event_type = $1) AS error_traces, approx_percentile_cont(value, 0.95) / 1e3 AS p95 FROM {EVENTS}",
        ["error"],
        "SELECT count(*) AS spans, count(DISTINCT user_id) AS traces, count(DISTINCT user_id) FILTER (WHERE event_type = 'error') AS error_traces, quantile_cont(value, 0.95) / 1e3 AS p95 FROM events",
    ),
    "dialect_last": (
        f"SELECT user_id, last_value(event_id ORDER BY event_id) AS last, cardinality(array_agg(event_id ORDER BY event_id)) AS n FROM {EVENTS} GROUP BY user_id",
        [],
        "SELECT user_id, max(event_id) AS last, CAST(count(*) AS INTEGER) AS n FROM events GROUP BY user_id",
    ),
    "struct_fields": (
        f"SELECT event_id, p['f']['i'] AS i, p.name AS name FROM {EVENTS} WHERE p['f']['i'] > $1",
        [50.0],
        "SELECT event_id, value AS i, event_type AS name FROM events WHERE value > 50",
    ),
    "binary_literal": (
        f"SELECT event_id FROM {EVENTS} WHERE CAST(event_type AS BINARY) = X'636C69636B'",
        [],
        "SELECT event_id FROM events WHERE event_type = 'click'",
    ),
    "raw_instants": (
        f"SELECT event_id, to_timestamp_micros(event_id * 1000003) AS a, to_timestamp_nanos(event_id * 1000 - 500001) AS b, CAST(e.ts AS BIGINT) AS us, CAST(event_id AS BIGINT) AS n FROM {EVENTS} e",
        [],
        "SELECT event_id, make_timestamp(event_id * 1000003) AS a, make_timestamp(CAST(floor((event_id * 1000 - 500001) / 1000.0) AS BIGINT)) AS b, epoch_us(ts) AS us, event_id AS n FROM events",
    ),
    "integer_quotients": (
        f"SELECT e.event_id, e.event_id / 7 AS q, 3 * event_id / (user_id + 1) AS r, value / 2 AS half, -event_id / 7 AS s, event_id % 7 / 2 AS t FROM {EVENTS} e",
        [],
        "SELECT event_id, event_id // 7 AS q, 3 * event_id // (user_id + 1) AS r, value / 2 AS half, -(event_id // 7) AS s, event_id % 7 // 2 AS t FROM events",
    ),
    "integer_means": (
        f"SELECT user_id, sum(event_id) / count(*) AS m FROM {EVENTS} GROUP BY user_id",
        [],
        "SELECT user_id, CAST(sum(event_id) // count(*) AS BIGINT) AS m FROM events GROUP BY user_id",
    ),
    "raw_instant_bounds": (
        f"SELECT user_id, CAST(max(ts) AS BIGINT) - CAST(min(ts) AS BIGINT) AS width FROM {EVENTS} GROUP BY user_id",
        [],
        "SELECT user_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS width FROM events GROUP BY user_id",
    ),
    "zipped_unnest": (
        f"SELECT event_id, unnest(array(user_id, event_id)) AS x, event_type, unnest(array('a', 'b', 'c')) AS y FROM {EVENTS}",
        [],
        "SELECT event_id, event_type, unnest([user_id, event_id, NULL]) AS x, unnest(['a', 'b', 'c']) AS y FROM events",
    ),
    "list_cast": (
        f"SELECT event_id, array_element(CAST(array(CAST(user_id AS VARCHAR), '7') AS BIGINT[]), 1) AS first, array_element(CAST(array('1') AS BIGINT[]), 2) AS none, cardinality(CAST(array('1', '2') AS BIGINT[])) AS n FROM {EVENTS}",
        [],
        "SELECT event_id, user_id AS first, CAST(NULL AS BIGINT) AS none, 2 AS n FROM events",
    ),
    "variant_json": (
        f"SELECT event_id, to_json(v) AS j FROM {EVENTS}",
        [],
        "SELECT event_id, CAST(json(props) AS VARCHAR) AS j FROM events",
    ),
    "nth_values": (
        f"SELECT event_id, nth_value(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM {EVENTS}",
        [],
        "SELECT event_id, nth_value(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM events",
    ),
    "scalar_subquery_rows": (
        f"SELECT event_id, value - (SELECT avg(value) FROM {EVENTS}) AS gap FROM {EVENTS} WHERE user_id = (SELECT min(user_id) FROM {EVENTS}) AND value > (SELECT value FROM {EVENTS} WHERE event_id = -1 UNION ALL SELECT 10)",
        [],
        "SELECT event_id, value - (SELECT avg(value) FROM events) AS gap FROM events WHERE user_id = (SELECT min(user_id) FROM events) AND value > 10",
    ),
    "comma_join": (
        f"WITH busy AS (SELECT user_id, count(*) AS n FROM {EVENTS} GROUP BY user_id HAVING count(*) > 12) SELECT e.event_id, b.n FROM {EVENTS} e, busy b WHERE e.user_id = b.user_id",
        [],
        "WITH busy AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 12) SELECT e.event_id, b.n FROM events e, busy b WHERE e.user_id = b.user_id",
    ),
    "trace_list": (
        f"SELECT event_id, ts, value FROM {EVENTS} WHERE event_type IN ($1, $2) ORDER BY ts DESC NULLS LAST, event_id ASC NULLS LAST LIMIT 51",
        ["error", "click"],
        "SELECT event_id, ts, value FROM events WHERE event_type IN ('error', 'click') ORDER BY ts DESC NULLS LAST, event_id ASC NULLS LAST LIMIT 51",
    ),
}


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    sql, params, _ = STATEMENTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        gate.check_statement(sql, spark)
        load(spark, sf_dir, "events").selectExpr("*", "parse_json(props) AS v", "named_struct('f', named_struct('i', value), 'name', event_type) AS p").createOrReplaceTempView("tally_events")
        return dialect.query(spark, sql, params, {EVENTS: "tally_events"})

    return run


QUERIES = {k: _run(k) for k in STATEMENTS}
ORACLE_SQL = {k: v[2] for k, v in STATEMENTS.items()}
time_overview = QUERIES["time_overview"]
