"""Golden relational corpus, dialect, statement gate and result limits."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallywright.plans import dialect, gate


@pytest.fixture(scope="module")
def corpus(spark):
    spark.createDataFrame([(1, "ada", "east"), (2, "bo", "west"), (3, "cy", None), (4, "di", "east")], "customer_id long, name string, region string").createOrReplaceTempView("c")
    spark.createDataFrame([(10, 1, 50), (11, 1, 30), (12, 2, 70), (13, None, 20), (14, 5, 40), (15, 2, 30)], "order_id long, customer_id long, amount long").createOrReplaceTempView("o")
    return spark


GOLDEN = {
    "SELECT order_id, amount FROM o WHERE amount >= 20 ORDER BY amount DESC, order_id LIMIT 3": [(12, 70), (10, 50), (14, 40)],
    "SELECT customer_id, sum(amount), count(*) FROM o WHERE customer_id IS NOT NULL GROUP BY customer_id HAVING sum(amount) > 45 ORDER BY 1": [(1, 80, 2), (2, 100, 2)],
    "SELECT order_id, name FROM o JOIN c ON o.customer_id = c.customer_id ORDER BY 1": [(10, "ada"), (11, "ada"), (12, "bo"), (15, "bo")],
    "SELECT order_id, name FROM o LEFT JOIN c ON o.customer_id = c.customer_id WHERE name IS NULL ORDER BY 1": [(13, None), (14, None)],
    "SELECT order_id FROM o WHERE amount = (SELECT max(amount) FROM o)": [(12,)],
    "SELECT order_id FROM o WHERE amount = (SELECT amount FROM o WHERE order_id = 11) ORDER BY 1": [(11,), (15,)],
    "SELECT order_id FROM o WHERE amount = (SELECT amount FROM o WHERE order_id = 0)": [],
    "SELECT name, (SELECT sum(amount) FROM o WHERE o.customer_id = c.customer_id) FROM c ORDER BY 1": [("ada", 80), ("bo", 100), ("cy", None), ("di", None)],
    "SELECT name FROM c WHERE customer_id IN (SELECT customer_id FROM o) ORDER BY 1": [("ada",), ("bo",)],
    "SELECT name FROM c WHERE customer_id NOT IN (SELECT customer_id FROM o)": [],
    "SELECT name FROM c WHERE customer_id NOT IN (SELECT customer_id FROM o WHERE customer_id IS NOT NULL) ORDER BY 1": [("cy",), ("di",)],
    "SELECT name FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.customer_id = c.customer_id) ORDER BY 1": [("cy",), ("di",)],
    "WITH t AS (SELECT customer_id, sum(amount) AS s FROM o GROUP BY customer_id) SELECT name, s FROM t JOIN c ON t.customer_id = c.customer_id ORDER BY 1": [("ada", 80), ("bo", 100)],
    "SELECT order_id, RANK() OVER (ORDER BY amount DESC) FROM o ORDER BY 1": [(10, 2), (11, 4), (12, 1), (13, 6), (14, 3), (15, 4)],
}


@pytest.mark.parametrize("sql", GOLDEN)
def test_golden(corpus, sql):
    assert [tuple(r) for r in dialect.query(corpus, sql).collect()] == GOLDEN[sql]


@pytest.mark.parametrize("sql", ["SELECT order_id FROM o WHERE amount = (SELECT amount FROM o WHERE order_id IN (11, 15))", "SELECT (SELECT amount FROM o WHERE order_id IN (11, 15))", "SELECT order_id FROM o WHERE order_id < 0 AND amount = (SELECT amount FROM o WHERE order_id IN (11, 15))"])
def test_scalar_subquery_with_two_rows_fails(corpus, sql):
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        corpus.sql(sql).collect()


def test_dialect(spark):
    def one(sql, *params):
        return tuple(dialect.query(spark, sql, list(params)).first())

    assert one("SELECT date_bin(INTERVAL '15 minutes', timestamp'1969-12-31 23:59:01')") == (dt.datetime(1969, 12, 31, 23, 45),)
    assert one("SELECT date_bin($1::interval, $2::timestamptz)", "1 hour", "2026-11-18T12:34:56Z") == (dt.datetime(2026, 11, 18, 12),)
    assert one("SELECT encode(decode('0aff', 'hex'), 'hex'), X'0AFF' = decode('0aff', 'hex')") == ("0aff", True)
    assert one("SELECT parse_json('{\"a\": {\"b\": [1, 2]}}') -> 'a' -> 'b' ->> 1") == ("2",)
    assert one("SELECT $1, $2, $3, $4", "x'; DROP TABLE t --", 3, 1.5, None) == ("x'; DROP TABLE t --", 3, 1.5, None)
    assert one("SELECT array_element(array(1, 2), 3), cardinality(array(1, 2)), CAST(array(1) AS BIGINT[])") == (None, 2, [1])
    assert one("SELECT to_char(timestamp'2026-01-02 03:04:05', '%Y-%m-%d %H:%M:%S')") == ("2026-01-02 03:04:05",)
    assert one("SELECT to_timestamp_micros(1000001), '$1 -> -- /* ' AS \"odd name\"")[1] == "$1 -> -- /* "
    assert one("SELECT approx_percentile_cont(v, 0.25) FROM (SELECT unnest(generate_series(1, 8)) AS v)") == (2.75,)
    assert one("SELECT last_value(x ORDER BY t), array_agg(x ORDER BY t) FROM (VALUES (1, 2), (5, 1)) AS v(x, t)") == (1, [5, 1])
    with pytest.raises(dialect.DialectError):
        dialect.rewrite("SELECT 'open")


def test_both_spellings_of_a_table_name(spark):
    spark.range(3).createOrReplaceTempView("v3")
    for name in ("tally.datasets.t", '"tally.datasets.t"'):
        assert dialect.query(spark, f"SELECT count(*) FROM {name}", names={"tally.datasets.t": "v3"}).first()[0] == 3


def test_statement_gate(spark):
    assert gate.check_statement("WITH a AS (SELECT 1 FROM x.y) SELECT * FROM a JOIN \"p.q\" ON true;").tables == ("x.y", "p.q")
    for bad in ("", "  ", "SELECT 1; SELECT 2", "INSERT INTO t VALUES (1)", "DROP TABLE t", "DELETE FROM t", "EXPLAIN SELECT 1", "SELECT '" + "x" * 70_000 + "'"):
        with pytest.raises(gate.Refused):
            gate.check_statement(bad)


def test_predicate_validator(spark):
    schema = spark.createDataFrame([], "id long, value string, p struct<x: double>").schema
    assert gate.check_predicate(spark, schema, "  ") == ""
    assert gate.check_predicate(spark, schema, "id>3   AND value='a -- b'") == "id > 3 AND value = 'a -- b'"
    assert gate.check_predicate(spark, schema, "p['x'] > 0.5")
    for bad in ("id > 1; SELECT 1", "id IN (SELECT 1)", "id = $1", "nope = 1", "id -- x", "id", "value + id > 3", "id = 1 AND value = '" + "x" * 9000 + "'"):
        with pytest.raises((gate.Refused, dialect.DialectError)):
            gate.check_predicate(spark, schema, bad)


def test_analysis_errors(corpus):
    for sql in ("SELECT nope FROM c", "SELECT customer_id FROM c JOIN o ON true"):
        with pytest.raises(AnalysisException):
            corpus.sql(sql)


def test_result_limits_and_terminal(spark):
    df = spark.range(100)
    assert gate.collect_bounded(df, 100).num_rows == 100
    with pytest.raises(gate.Refused):
        gate.collect_bounded(df, 99)
    with pytest.raises(gate.Refused):
        gate.collect_bounded(df, 100, 10)
    run = gate.Running(spark)
    got, end = run.collect(df.groupBy((F.col("id") % 3).alias("k")).count())
    assert got.num_rows == 3 and end.outcome == "success" and not run.active
    got, end = run.collect(df.select(F.raise_error(F.lit("boom"))))
    assert got is None and end.outcome == "failed"
    assert gate.clamp_deadline(None) == gate.clamp_deadline(0) == 7200 and gate.clamp_deadline(5) == 5 and gate.clamp_deadline(1e9) == 7200


def test_authorization(spark):
    s = gate.check_statement("SELECT * FROM a.b")
    gate.authorize(gate.Caller("t"), s, {"a.b": 1})
    for caller, known in ((gate.Caller("t", frozenset()), {"a.b": 1}), (gate.Caller("t"), {})):
        with pytest.raises(PermissionError, match="^table not found or not allowed$"):
            gate.authorize(caller, s, known)
