"""Drift statistics, derived metrics, verification operators, metadata queries."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallywright.operators import drift, metadata, metrics, verify

INF = float("inf")


def column(spark, values):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "v double")


def test_edges(spark):
    e = drift.edges_equal_width(column(spark, range(100)), "v", 10)
    assert len(e) == 11 and e[1] == pytest.approx(9.9) and e[0] == -INF and e[-1] == INF
    assert drift.edges_equal_width(column(spark, [5] * 50), "v", 10) == [-INF, INF]
    assert drift.edges_quantile(column(spark, range(1, 9)), "v", 4) == [-INF, 2.75, 4.5, 6.25, INF]
    assert len(drift.edges_quantile(column(spark, [0] * 95 + [1, 2, 3, 4, 5]), "v", 5)) < 6
    for bad in ([], [None, 1], [math.nan, 1], [INF]):
        with pytest.raises(drift.DriftError):
            drift.edges_equal_width(column(spark, bad), "v", 3)
    assert drift.edges_from_json(drift.edge_json(e)) == e and drift.edges_from_json("null") is None


def test_windows_that_cannot_be_judged(spark):
    base, edges = column(spark, range(200)), [-INF, 50, 100, INF]
    cases = {"no_drift": range(200), "drift": [5] * 200}
    for verdict, values in cases.items():
        assert drift.psi_report(base, column(spark, values), "v", edges, 0.25).first()["verdict"] == verdict
    for values, missing in (([], 0), (range(99), 0), ([*range(150), *[None] * 75], 75), ([*range(150), math.nan, INF], 2)):
        r = drift.psi_report(base, column(spark, values), "v", edges, 0.25).first()
        assert (r["verdict"], r["psi"], r["missing"]) == ("inconclusive", None, missing)
    assert drift.psi_counts(*(spark.createDataFrame([], "bin int, n long"),) * 2).first()[:] == (0, 0, None)
    assert drift.judge_window(base, column(spark, range(200)), "v", edges, 0.25)[0] == "passed"
    assert drift.judge_window(base, column(spark, [5] * 200), "v", edges, 0.25)[0] == "failed"
    assert drift.judge_window(base, column(spark, []), "v", edges, 0.25) == ("inconclusive", "0 samples, 100 are needed")
    assert drift.judge_window(None, base, "v", None, 0.25)[0] == "inconclusive"
    for bins in (0, -1):
        with pytest.raises(drift.DriftError):
            drift.edges_equal_width(base, "v", bins)
    assert drift.edges_equal_width(column(spark, [0.1, 0.1 + 1e-17, 0.1 + 2e-17]), "v", 3) == [-INF, INF]
    with pytest.raises(Exception, match="not finite"):
        drift.project_features(column(spark, [1, INF]).select("v", F.lit(1).alias("i"), F.current_timestamp().alias("t")), "i", [], ["v"], "t").collect()


def test_bins_are_open_below(spark):
    df = column(spark, [-5, 10, 15, 20, 30, 30.0001, -INF, math.nan, None])
    assert [r[0] for r in df.select(drift.bin_of(F.col("v"), [-INF, 10, 20, 30, INF])).collect()] == [0, 0, 1, 1, 2, 3, 3, 3, 3]


def test_psi(spark):
    assert drift.psi([0.5, 0.5], [0.5, 0.5]) == 0 and drift.psi([0.9, 0.1], [0.5, 0.5]) > 0.1
    assert 0 < drift.psi([1, 0], [0.5, 0.5]) < INF and math.isnan(drift.psi([1], [0.5, 0.5]))
    a, b = (spark.createDataFrame(x, "bin int, n long") for x in ([(0, 90), (1, 10)], [(0, 50), (2, 50)]))
    assert drift.psi_counts(a, b).first()["psi"] == pytest.approx(drift.psi([0.9, 0.1, 0], [0.5, 0, 0.5]), rel=1e-9)
    got = {r["bin"]: r["n"] for r in drift.categories(spark.createDataFrame([("a",), ("z",), (None,)], "c string"), "c", ["a", "b"]).collect()}
    assert got == {"a": 1, "other": 2}
    assert drift.psi_threshold("fixed", 0.25) == 0.25
    assert drift.psi_threshold("chi_square", 0.05, 10, 100) == pytest.approx(16.918977604620448 / 100)
    assert drift.psi_threshold("normal", 0.05, 10, 100) == pytest.approx(0.09 + 1.6448536269514722 * math.sqrt(18) / 100)
    with pytest.raises(drift.DriftError):
        drift.psi_threshold("normal", 0.05, 1, 100)


def test_control_charts(spark):
    for n, want in ((2, math.sqrt(2 / math.pi)), (3, math.sqrt(math.pi) / 2), (5, 0.9400), (10, 0.9727), (25, 0.9896)):
        assert drift.c4(n) == pytest.approx(want, abs=5e-5)
    g = drift.subgroups(column(spark, [1, 2, 3, 4, 3, 4, 5, 6, 9]).withColumn("i", F.monotonically_increasing_id()), "v", 4, ("i",)).orderBy("subgroup").collect()
    assert [r["mean"] for r in g] == [2.5, 4.5] and g[0]["sd"] == pytest.approx(math.sqrt(5 / 3))
    x, s = drift.control_limits(3.5, math.sqrt(5 / 3), 4, 20)
    assert x.center == 3.5 and x.upper - 3.5 == pytest.approx(3 * math.sqrt(5 / 3) / (0.9213177 * 2), rel=1e-6)
    assert not x.signals(x.upper) and x.signals(x.upper + 1e-9) and s.lower == 0
    with pytest.raises(drift.DriftError):
        drift.control_limits(1, 1, 1, 20)
    with pytest.raises(drift.DriftError, match="20 subgroups"):
        drift.control_limits(1, 1, 4, 19)
    whole = drift.subgroups(spark.range(100).select(F.col("id").alias("v")), "v", 30, ("v",)).orderBy("subgroup").collect()
    assert [r["mean"] for r in whole] == [14.5, 44.5, 74.5]


def test_custom_and_roll_up(spark):
    def custom(values, *limits):
        r = drift.score_custom(column(spark, values), "v", *limits).first()
        return r["verdict"], r["gap"]

    assert custom([100, 102, 98, 101], 100, 5) == ("no_drift", 0.25)
    assert custom([200, 210, 220], 100, 50) == ("drift", 110)
    assert custom([105], 100, 5)[0] == "no_drift"
    assert custom([1, None], 1, 5)[0] == custom([], 1, 5)[0] == "inconclusive"
    assert drift.roll_up(["no_drift", "drift", "inconclusive"]) == "failed" and drift.roll_up([]) == "inconclusive" and drift.roll_up(["no_drift"]) == "passed"
    assert drift.complete(column(spark, [1, 2]), ["v"]) and not drift.complete(column(spark, [1, None]), ["v"])
    rows = drift.project_features(spark.createDataFrame([("r", "x", 82000.0, 3)], "id string, c string, f double, n long").withColumn("t", F.current_timestamp()), "id", ["c"], ["f", "n"], "t").collect()
    assert {(r.series, r.num_value, r.str_value) for r in rows} == {("c", None, "x"), ("f", 82000.0, "82000.0"), ("n", 3.0, "3")}


def test_counter_increments(spark):
    pts = spark.createDataFrame([("a", 1, 0, 10), ("a", 2, 0, 15), ("a", 3, 0, 4), ("a", 4, 3, 6), ("b", 5, 5, 7)], "series string, t long, started long, value long")
    got = {(r.series, r.t): r.step for r in metrics.increments(pts, F.lit(1)).collect()}
    assert got == {("a", 1): 0, ("a", 2): 5, ("a", 3): 4, ("a", 4): 6, ("b", 5): 7}


def test_assertions():
    assert verify.assert_value(3, "greater_than", 2).verdict == "passed" and verify.assert_value([1, 2], "is_superset", [2]).verdict == "passed"
    assert verify.assert_value("abc", "contains", "b").verdict == "passed" and verify.assert_value(True, "equals", 1).verdict == "failed"
    assert verify.assert_value(None, "is_not_null").verdict == "failed" and verify.assert_value("", "is_non_empty").verdict == "failed"
    for bad in (("x", "greater_than", 2), (1, "contains", 1), (1, "is_superset", [1]), (1, "nope", 1), (1, "in", 1)):
        with pytest.raises(verify.CheckError):
            verify.assert_value(*bad)
    assert verify.assert_each([1, 5, 9], "greater_than", 4).message == "1/3 items failed operator greater_than"
    assert verify.assert_each([], "equals", 1).verdict == "inconclusive"
    with pytest.raises(verify.CheckError):
        verify.assert_each("x", "equals", 1)
    assert verify.capture('{"a":1}', "hash") == "015abd7f5cc57a2dd94b7590f04ad8084273905ee33ec5cebeae62276a97f862" and verify.capture("x", "redact") is None


def test_json_path(spark):
    doc = {"a": {"b": [1, 2, {"c": "x"}]}, "spans": [{"name": "p", "ok": True, "n": 1}, {"name": "q", "n": 5}], "k.v": 3}
    cases = {"$.a.b[0]": 1, "$.a.b[2].c": "x", "$.nope": None, "$.spans[*].name": ["p", "q"], "$..name": ["p", "q"], "$.spans[?(@.n > 2)].name": "q", "$.spans[?(@.ok)].name": "p", "$['k.v']": 3, "$.a.b[-1].c": "x", "$.a.b[0:2]": [1, 2]}
    import json

    for path, want in cases.items():
        assert verify.extract(doc, path) == want, path
        got = spark.createDataFrame([(json.dumps(doc),), (None,)], "d string").select(verify.json_path(F.col("d"), path)).collect()
        assert (None if got[0][0] is None else json.loads(got[0][0])) == want and got[1][0] is None, path
    for bad in ("a.b", "$.", "$[", "$.a[?(x)]"):
        with pytest.raises(verify.CheckError):
            verify.parse_path(bad)


def test_plans():
    assert verify.plan_stages({"c": ["a", "b"], "b": ["a"], "a": [], "d": []}) == [["a", "d"], ["b"], ["c"]]
    for steps, text in (({"a": ["x"]}, "missing"), ({"a": ["a"]}, "itself"), ({"a": ["b"], "b": ["c"], "c": ["b"]}, "b -> c -> b")):
        with pytest.raises(verify.CheckError, match=text):
            verify.plan_stages(steps)
    led = verify.Ledger()
    for s, v in (("a", 1), ("b", 2), ("a", 3)):
        led.record(s, v)
    assert list(led.entries.items()) == [("a", 3), ("b", 2)]
    assert verify.repeat_until(1, lambda x: x * 2, lambda x: x > 10, 9) == (16, 4, True) and verify.repeat_until(1, lambda x: x, lambda x: False, 2) == (1, 2, False)
    schema = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "object", "properties": {"b": {}}, "additionalProperties": False}}}, "additionalProperties": False}
    assert verify.schema_has_path(schema, "$.a[0].b") and not verify.schema_has_path(schema, "$.a[0].c") and not verify.schema_has_path(schema, "$.z")


def test_traces_and_decisions(spark):
    link = "array<struct<trace_id: string>>"
    spans = spark.createDataFrame([("t1", "s2", 2, "b", None, []), ("t1", "s1", 1, "a", None, []), ("t2", "s3", 3, "c", None, [("t1",)]), ("t2", "s3", 3, "c", None, [("t1",)]), ("t3", "s4", 4, "d", None, [("t2",)])], f"trace_id string, span_id string, start long, name string, attributes string, links {link}")
    assert [r.span_id for r in verify.timeline(spans, "t1").collect()] == ["s1", "s2", "s3"]
    doc = {r.trace_id: r.document for r in verify.trace_document(spans).collect()}
    import json

    assert verify.extract(json.loads(doc["t1"]), "$.spans[*].name") == ["a", "b"]
    req = spark.createDataFrame([(s, r) for s in "wxyz" for r in "pq"], "subject string, requirement string")
    res = spark.createDataFrame([("w", "p", "passed"), ("w", "q", "passed"), ("x", "p", "passed"), ("y", "p", "failed"), ("z", "p", "skipped"), ("z", "q", "skipped")], "subject string, requirement string, verdict string")
    got = {r.subject: (r.verdict, r.pass_rate) for r in verify.decide(req, res).collect()}
    assert got == {"w": ("passed", 1.0), "x": ("inconclusive", 0.5), "y": ("failed", 0.0), "z": ("inconclusive", 0.0)}
    items = verify.for_each(spark.createDataFrame([([5, 6],)], "xs array<int>"), "xs", 2).collect()
    assert [(r["index"], r["item"]) for r in items] == [(0, 5), (1, 6)]


KEY = st.from_regex(r"[A-Za-z_][A-Za-z0-9_-]{0,8}", fullmatch=True) | st.text(min_size=1, max_size=6)
LITERAL = st.text(max_size=8) | st.integers(-999, 999) | st.booleans() | st.floats(-1e6, 1e6).filter(lambda x: "e" not in repr(x)) | st.integers(0, 10**6).map(lambda n: metadata.Duration(n))
PRED = st.builds(lambda k, op, v: metadata.Predicate(metadata.Field("labels", k), op, v), KEY, st.sampled_from(["=", "!=", ">", "<="]), LITERAL) | st.builds(lambda k, v: metadata.Predicate(metadata.Field(None, "status"), "not in", tuple(v)), KEY, st.lists(LITERAL, min_size=1, max_size=3)) | st.builds(lambda k: metadata.Predicate(metadata.Field("annotations", k), "not exists"), KEY)
TREE = st.recursive(PRED, lambda inner: st.builds(metadata.Not, inner) | st.builds(lambda a, b: metadata.Group("and", (a, b)), PRED, inner.filter(lambda x: not (isinstance(x, metadata.Group) and x.op == "and"))), max_leaves=5)


@settings(max_examples=150, deadline=None)
@given(TREE)
def test_print_then_parse_is_identity(tree):
    assert metadata.parse(metadata.show(tree)) == tree


def test_metadata_semantics(spark):
    df = spark.createDataFrame([(1, {"env": "prod"}, "active", 10), (2, {"env": "dev"}, "inactive", 5), (3, {}, None, None), (4, {"env": "prod"}, "active", None)], "id long, labels map<string,string>, status string, score long")
    resolve = metadata.resolver({"status": "status", "score": "score"}, {"labels": "labels"})
    cases = {'labels.env != "prod"': [2, 3], 'status != "active"': [2, 3], "score not in [10]": [2, 3, 4], "score in [5, 10]": [1, 2], "not score > 6": [2, 3, 4], 'labels.env exists and status = "active" or score = 5': [1, 2, 4], 'labels.env =~ "^p" ': [1, 4], "labels.env not exists": [3]}
    for text, want in cases.items():
        assert sorted(r.id for r in metadata.search(df, text, resolve).collect()) == want, text
    assert metadata.parse("labels.x > 5m").value.ns == 300 * 10**9
    assert metadata.parse("a = 1 or b = 2 and not c = 3") == metadata.Group("or", (metadata.parse("a = 1"), metadata.Group("and", (metadata.parse("b = 2"), metadata.Not(metadata.parse("c = 3"))))))
    for bad in ("", "()", "a =", "a ~ 1", "labels = 1", " and ".join(["a = 1"] * 65), "not " * 10 + "a = 1", "a = 1 b = 2", "a =~ 3"):
        with pytest.raises(metadata.QueryError):
            metadata.parse(bad)
    with pytest.raises(metadata.QueryError):
        metadata.search(df, "nope = 1", resolve)
    page, following = metadata.keyset_page(df, ("id",), (1,), 2)
    assert [r.id for r in page.collect()] == [2, 3] and following() == (3,)
    assert metadata.keyset_page(df, ("id",), (3,), 2)[1]() is None
