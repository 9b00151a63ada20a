"""Drift statistics: PSI, X-bar/S control charts and custom means.

Executors aggregate (edges, bin counts, subgroup statistics); the thresholds
need a few numbers and are computed on the driver.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.session import load
from tallywright.sources.datasets import with_index

EPSILON = 1e-10
MACHINE_EPSILON = 2.220446049250313e-16
MIN_TARGET_SAMPLE = 100
MIN_SUBGROUPS = 20
INF = float("inf")


class DriftError(ValueError):
    """The baseline or target cannot be used."""


# --- edges and bins --------------------------------------------------------
def required(df: DataFrame, column: str) -> dict:
    """Rows, minimum and maximum of a baseline column; refuses NULL, non-finite or no values."""
    c = F.col(column).cast("double")
    bad = F.count_if(c.isNull() | F.isnan(c) | c.isin(INF, -INF))
    r = df.agg(F.count("*").alias("n"), bad.alias("bad"), F.min(c).alias("lo"), F.max(c).alias("hi")).first()
    if not r["n"] or r["bad"]:
        raise DriftError(f"column {column!r} has no rows, or NULL or non-finite values")
    return r.asDict()


def edges_equal_width(df: DataFrame, column: str, bins: int) -> list[float]:
    """-inf, inner edges at equal steps, inf; a constant column has one bin."""
    if bins < 1:
        raise DriftError("equal-width edges need a bin")
    r = required(df, column)
    if abs(r["hi"] - r["lo"]) <= MACHINE_EPSILON:
        return [-INF, INF]
    step = (r["hi"] - r["lo"]) / bins
    return [-INF, *(r["lo"] + step * i for i in range(1, bins)), INF]


def edges_quantile(df: DataFrame, column: str, bins: int) -> list[float]:
    """-inf, R-7 quantiles with equal neighbours dropped, inf."""
    required(df, column)
    if bins < 2:
        raise DriftError("quantile edges need two bins")
    q = df.agg(F.percentile(F.col(column).cast("double"), F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("q")).first()["q"]
    inner: list[float] = []
    for x in q:
        if not inner or abs(x - inner[-1]) > MACHINE_EPSILON:
            inner.append(x)
    return [-INF, *inner, INF]


def bin_of(column: Column, edges: list[float]) -> Column:
    """The 0-based bin (lo, hi] of a value; values that no bin holds go to the last."""
    arr = F.array(*[F.lit(e) for e in edges])
    k = F.size(F.filter(arr, lambda e: e < column)) - 1
    last = len(edges) - 2
    return F.when((k < 0) | (k > last) | column.isNull(), last).otherwise(k)


def edge_json(edges: list[float] | None) -> str:
    if edges is None:
        return "null"
    return json.dumps(["-inf" if e == -INF else "inf" if e == INF else e for e in edges])


def edges_from_json(text: str) -> list[float] | None:
    got = json.loads(text)
    return None if got is None else [float(e) for e in got]


# --- PSI -------------------------------------------------------------------
def psi(p: list[float], q: list[float]) -> float:
    """Sum of (p - q) ln(p / q) with both lifted by EPSILON; NaN for unequal lengths."""
    if len(p) != len(q):
        return math.nan
    return sum((a - b) * math.log((a + EPSILON) / (b + EPSILON)) for a, b in zip(p, q))


def psi_counts(base: DataFrame, target: DataFrame) -> DataFrame:
    """PSI from two (bin, n) tables: one row with psi, base_n, target_n; psi is NULL if a side has no rows."""
    both = base.select("bin", F.col("n").alias("bn")).join(target.select("bin", F.col("n").alias("tn")), "bin", "outer").fillna(0, ["bn", "tn"])
    total = both.agg(F.coalesce(F.sum("bn"), F.lit(0)).alias("base_n"), F.coalesce(F.sum("tn"), F.lit(0)).alias("target_n"))
    p, q = F.try_divide("bn", "base_n") + EPSILON, F.try_divide("tn", "target_n") + EPSILON
    # the left side is the one row of totals, so that there is a row without any bin
    return total.join(both, F.lit(True), "left").groupBy("base_n", "target_n").agg(F.sum((p - q) * F.log(p / q)).alias("psi"))


def binned(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """(bin, n) of a numeric column."""
    return df.groupBy(bin_of(F.col(column).cast("double"), edges).alias("bin")).agg(F.count("*").alias("n"))


def categories(df: DataFrame, column: str, labels: list[str], other: str = "other") -> DataFrame:
    """(bin, n) of a label column; labels that the baseline did not have are ``other``."""
    known = df.sparkSession.createDataFrame([(x,) for x in labels], "bin string")
    joined = df.select(F.col(column).alias("label")).join(F.broadcast(known), F.col("label") == F.col("bin"), "left")
    return joined.groupBy(F.coalesce("bin", F.lit(other)).alias("bin")).agg(F.count("*").alias("n"))


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return 1 - h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_inverse(p: float, k: int) -> float:
    """The quantile of the chi-squared distribution, by bisection."""
    lo, hi = 0.0, max(1.0, float(k))
    while gamma_p(k / 2, hi / 2) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_p(k / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2


def psi_threshold(kind: str, value: float, bins: int = 0, samples: int = 0) -> float:
    """fixed: the value; chi_square and normal: from alpha, bins and the sample size."""
    if kind == "fixed":
        return value
    if bins < 2 or samples <= 0:
        raise DriftError("a statistical threshold needs two bins and a sample")
    if kind == "chi_square":
        return chi2_inverse(1 - value, bins - 1) / samples
    if kind == "normal":
        return (bins - 1) / samples + NormalDist().inv_cdf(1 - value) * math.sqrt(2 * (bins - 1)) / samples
    raise DriftError(f"unknown threshold {kind!r}")


# --- X-bar/S ---------------------------------------------------------------
def c4(n: int) -> float:
    return math.exp(0.5 * math.log(2 / (n - 1)) + math.lgamma(n / 2) - math.lgamma((n - 1) / 2))


@dataclass(frozen=True)
class Limits:
    lower: float
    center: float
    upper: float

    def signals(self, v: float) -> bool:
        return v < self.lower or v > self.upper


def control_limits(mean: float, sd: float, n: int, groups: int) -> tuple[Limits, Limits]:
    """X-bar and S limits from the mean of the means and of the deviations of so many subgroups of n rows."""
    if groups < MIN_SUBGROUPS:
        raise DriftError(f"control limits need {MIN_SUBGROUPS} subgroups")
    if n < 2 or mean is None or sd is None or not (math.isfinite(mean) and math.isfinite(sd)):
        raise DriftError("control limits need subgroups of two finite values or more")
    k = c4(n)
    half = 3 * sd / (k * math.sqrt(n))
    spread = 3 * math.sqrt(1 - k * k) / k
    return Limits(mean - half, mean, mean + half), Limits(max(0.0, sd * (1 - spread)), sd, sd * (1 + spread))


def subgroups(df: DataFrame, value: str, n: int, order: tuple[str, ...], series: tuple[str, ...] = ()) -> DataFrame:
    """Mean and deviation of consecutive groups of exactly n rows; a partial last group goes."""
    if series:
        place = F.row_number().over(W.partitionBy(*series).orderBy(*order)) - 1
        g = df.withColumn("subgroup", F.floor(place / n))
    else:
        g = with_index(df, order).withColumn("subgroup", F.floor(F.col("index") / n))
    out = g.groupBy(*series, "subgroup").agg(F.count("*").alias("rows"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return out.where(F.col("rows") == n).drop("rows")


# --- custom and roll-up ----------------------------------------------------
def unusable(df: DataFrame, column: str) -> Column:
    """Whether a feature's value is missing or not finite."""
    c = F.col(column)
    return c.isNull() | F.isnan(c) | c.isin(INF, -INF) if dict(df.dtypes)[column] in ("double", "float") else c.isNull()


def score_custom(df: DataFrame, metric: str, baseline: float, alert: float, by: tuple[str, ...] = ()) -> DataFrame:
    """gap = |mean - baseline| and verdict, a row for each group (one without ``by``).

    A gap above the alert is drift, an equal one is not; no rows or a NULL or
    non-finite value leave it unscored.
    """
    c = F.col(metric).cast("double")
    bad = F.count_if(c.isNull() | F.isnan(c) | c.isin(INF, -INF)) > 0
    gap = F.when(~bad, F.abs(F.avg(c) - baseline))
    verdict = F.when(gap.isNull(), "inconclusive").when(gap > alert, "drift").otherwise("no_drift")
    return df.groupBy(*by).agg(gap.alias("gap"), verdict.alias("verdict"))


def complete(df: DataFrame, columns: list[str]) -> bool:
    """Whether there are rows and every one has every configured feature, finite."""
    r = df.agg(F.count("*").alias("n"), *[F.count_if(unusable(df, c)).alias(f"bad{k}") for k, c in enumerate(columns)]).first()
    return bool(r["n"]) and not any(r[f"bad{k}"] for k in range(len(columns)))


ORDINAL = {"no_drift": 0, "inconclusive": 1, "drift": 2}
VERDICT = {"no_drift": "passed", "inconclusive": "inconclusive", "drift": "failed"}


def roll_up(features: list[str]) -> str:
    """Drift over inconclusive over no drift, as a verdict; no feature at all is inconclusive."""
    return VERDICT[max(features, key=ORDINAL.__getitem__, default="inconclusive")]


def project_features(df: DataFrame, record_id: str, categorical: list[str], numeric: list[str], created_at: str) -> DataFrame:
    """One row for each feature of a record: text for labels and booleans, text and number for numbers."""
    for c in numeric:
        if dict(df.dtypes)[c] in ("bigint", "int", "smallint"):
            df = df.withColumn(c, F.when(F.abs(F.col(c)) > 2**53, F.raise_error(F.lit(f"{c} is beyond 2^53"))).otherwise(F.col(c)))
        elif dict(df.dtypes)[c] in ("double", "float"):
            df = df.withColumn(c, F.when(F.isnan(c) | F.col(c).isin(INF, -INF), F.raise_error(F.lit(f"{c} is not finite"))).otherwise(F.col(c)))
    rows = [F.struct(F.lit(c).alias("series"), F.lit(None).cast("double").alias("num_value"), F.col(c).cast("string").alias("str_value")) for c in categorical]
    rows += [F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("num_value"), F.col(c).cast("string").alias("str_value")) for c in numeric]
    flat = df.select(F.col(record_id).alias("record_id"), F.col(created_at).alias("created_at"), F.explode(F.array(*rows)).alias("f"))
    return flat.select("record_id", "f.series", "f.num_value", "f.str_value", "created_at")


def psi_report(base: DataFrame, target: DataFrame, column: str, edges: list[float], threshold: float) -> DataFrame:
    """One row: psi, target_n, missing and verdict.

    Fewer than MIN_TARGET_SAMPLE target rows, or any that is NULL or not
    finite, are inconclusive and unscored.
    """
    scored = psi_counts(binned(base, column, edges), binned(target, column, edges))
    missing = target.agg(F.count_if(unusable(target, column)).alias("missing"))
    scored = scored.crossJoin(F.broadcast(missing))
    usable = (F.col("target_n") >= MIN_TARGET_SAMPLE) & (F.col("missing") == 0)
    verdict = F.when(~usable | F.col("psi").isNull(), "inconclusive").when(F.col("psi") > threshold, "drift").otherwise("no_drift")
    return scored.select(F.when(usable, F.round("psi", 9)).alias("psi"), "target_n", "missing", verdict.alias("verdict"))


def observed(observations: DataFrame, subject: str, series: str, begin, end, subject_column: str = "card_uid", time: str = "created_at") -> DataFrame:
    """The observation window of exactly one subject and series, [begin, end); score and completeness read this one frame."""
    c = F.col
    return observations.where((c(subject_column) == F.lit(subject)) & (c("series") == F.lit(series)) & (c(time) >= F.lit(begin)) & (c(time) < F.lit(end)))


def judge_window(base: DataFrame | None, window: DataFrame, column: str, edges: list[float] | None, threshold: float) -> tuple[str, str]:
    """(verdict, reason) of a drift check: passed, failed, or inconclusive without baseline or samples."""
    if base is None or edges is None:
        return "inconclusive", "the baseline is not ready"
    r = psi_report(base, window, column, edges, threshold).first()
    if r["verdict"] == "inconclusive":
        return "inconclusive", f"{r['missing']} of {r['target_n']} samples cannot be used" if r["missing"] else f"{r['target_n']} samples, {MIN_TARGET_SAMPLE} are needed"
    return VERDICT[r["verdict"]], f"psi {r['psi']} against {threshold}"


# --- queries ---------------------------------------------------------------
SPLIT = "2024-01-10 00:00:00"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = load(spark, sf_dir, "events")
    return ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1")


def psi_equal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, target = _halves(spark, sf_dir)
    return psi_report(base, target, "value", edges_equal_width(base, "value", 10), 0.25)


def psi_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, target = _halves(spark, sf_dir)
    return psi_report(base, target, "value", edges_quantile(base, "value", 4), 0.25)


def psi_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, target = _halves(spark, sf_dir)
    labels = ["click", "error", "purchase"]
    return psi_counts(categories(base, "event_type", labels), categories(target, "event_type", labels)).select(F.round("psi", 9).alias("psi"), "base_n", "target_n")


def psi_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of a whole window, an empty one, one of too few rows and one with missing values."""
    base, target = _halves(spark, sf_dir)
    edges = edges_equal_width(base, "value", 10)
    gaps = target.withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    windows = {"whole": target, "empty": target.where("event_id < 0"), "few": target.where("event_id < 99"), "gaps": gaps}
    out = None
    for name, w in windows.items():
        here = psi_report(base, w, "value", edges, 0.25).select(F.lit(name).alias("name"), "psi", "target_n", "missing", "verdict")
        out = here if out is None else out.unionByName(here)
    return out


def observation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of one subject and series in a half-open window."""
    ev = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("card_uid"), F.col("event_type").alias("series"), "event_id", "value", F.col("ts").alias("created_at"))
    return observed(ev, "7", "click", SPLIT, "2024-01-25 00:00:00").select("event_id", "value")


def psi_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSI of each event type's values against all, by the three kinds of threshold."""
    ev = load(spark, sf_dir, "events")
    edges = edges_equal_width(ev, "value", 5)
    out = None
    for kind, value in (("fixed", 0.25), ("chi_square", 0.05), ("normal", 0.05)):
        limit = psi_threshold(kind, value, 5, 400)
        here = spark.createDataFrame([(kind, round(limit, 9), edge_json([edges[0], 1.0, edges[-1]]))], "kind string, threshold double, edges string")
        out = here if out is None else out.unionByName(here)
    return out


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each priority's custom-mean verdict over order prices, and the roll-up of all."""
    scored = score_custom(load(spark, sf_dir, "orders"), "o_totalprice", 250_000.0, 1_000.0, ("o_orderpriority",))
    rows = scored.select("o_orderpriority", "verdict")
    return rows.unionByName(spark.createDataFrame([("all", roll_up([r["verdict"] for r in rows.collect()]))], "o_orderpriority string, verdict string"))


def spc_subgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subgroups of five of each user's values with the signals against limits fitted over all subgroups."""
    g = subgroups(load(spark, sf_dir, "events"), "value", 5, ("ts", "event_id"), ("user_id",))
    m = g.agg(F.avg("mean").alias("m"), F.avg("sd").alias("s"), F.count("*").alias("n")).first()
    x, s = control_limits(m["m"], m["s"], 5, m["n"])
    out = (F.col("mean") < x.lower) | (F.col("mean") > x.upper)
    return g.select("user_id", "subgroup", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), out.alias("mean_signal"), ((F.col("sd") < s.lower) | (F.col("sd") > s.upper)).alias("sd_signal"))


def spc_one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subgroups of fifty over all events in order."""
    g = subgroups(load(spark, sf_dir, "events").select("event_id", "ts", "value"), "value", 50, ("ts", "event_id"))
    return g.select("subgroup", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def custom_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of each event type's mean against 50 with alert 1."""
    return score_custom(load(spark, sf_dir, "events"), "value", 50.0, 1.0, ("event_type",)).select("event_type", F.round("gap", 9).alias("gap"), "verdict")


def custom_mean_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where some types have a NULL."""
    ev = load(spark, sf_dir, "events").withColumn("value", F.when((F.col("event_type") != "click") | (F.col("event_id") % 50 != 3), F.col("value")))
    return score_custom(ev, "value", 50.0, 1.0, ("event_type",)).select("event_type", F.round("gap", 9).alias("gap"), "verdict")


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_features(load(spark, sf_dir, "events"), "event_id", ["event_type"], ["user_id"], "ts")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (psi_equal_width, psi_quantile, psi_categorical, psi_windows, psi_thresholds, observation_window, verdicts, spc_subgroups, spc_one_series, custom_mean, custom_mean_gaps, feature_rows)}

_PSI = "SELECT round(sum((bn / bt + 1e-10 - tn / tt - 1e-10) * ln((bn / bt + 1e-10) / (tn / tt + 1e-10))), 9) AS psi"
_BIN = "WITH b AS (SELECT event_id % 2 AS h, {bin} AS bin FROM events{extra}), c AS (SELECT bin, count(*) FILTER (WHERE h = 0) AS bn, count(*) FILTER (WHERE h = 1) AS tn FROM b GROUP BY bin), t AS (SELECT *, sum(bn) OVER () AS bt, sum(tn) OVER () AS tt FROM c) "
_VERDICT = ", CAST(any_value(tt) AS BIGINT) AS target_n, CAST(0 AS BIGINT) AS missing, CASE WHEN any_value(tt) < 100 THEN 'inconclusive' WHEN sum((bn / bt - tn / tt) * ln((bn / bt + 1e-10) / (tn / tt + 1e-10))) > 0.25 THEN 'drift' ELSE 'no_drift' END AS verdict FROM t"
_C4 = c4(5)
ORACLE_SQL: dict[str, str] = {
    "psi_equal_width": _BIN.format(bin="len(list_filter(range(1, 10), lambda i: m.lo + (m.hi - m.lo) / 10 * i < value))", extra=", (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE event_id % 2 = 0) m") + _PSI + _VERDICT,
    "psi_quantile": _BIN.format(bin="len(list_filter(m.q, lambda e: e < value))", extra=", (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM events WHERE event_id % 2 = 0) m") + _PSI + _VERDICT,
    "psi_categorical": _BIN.format(bin="CASE WHEN event_type IN ('click', 'error', 'purchase') THEN event_type ELSE 'other' END", extra="") + _PSI + ", CAST(any_value(bt) AS BIGINT) AS base_n, CAST(any_value(tt) AS BIGINT) AS target_n FROM t",
    "spc_subgroups": f"WITH r AS (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 5 AS subgroup FROM events), g AS (SELECT user_id, subgroup, avg(value) AS mean, stddev_samp(value) AS sd FROM r GROUP BY 1, 2 HAVING count(*) = 5), l AS (SELECT avg(mean) AS m, avg(sd) AS s FROM g) SELECT user_id, subgroup, round(mean, 6) AS mean, round(sd, 6) AS sd, abs(mean - m) > 3 * s / ({_C4} * sqrt(5)) AS mean_signal, sd < greatest(0, s * (1 - 3 * sqrt(1 - {_C4} * {_C4}) / {_C4})) OR sd > s * (1 + 3 * sqrt(1 - {_C4} * {_C4}) / {_C4}) AS sd_signal FROM g, l",
    "psi_windows": "WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE event_id % 2 = 0), e AS (SELECT 'base' AS name, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'whole', value FROM events WHERE event_id % 2 = 1 UNION ALL SELECT 'few', value FROM events WHERE event_id % 2 = 1 AND event_id < 99 UNION ALL SELECT 'gaps', CASE WHEN event_id % 7 <> 0 THEN value END FROM events WHERE event_id % 2 = 1), n AS (SELECT * FROM (VALUES ('whole'), ('empty'), ('few'), ('gaps')) v(name)), s AS (SELECT n.name, count(e.name) AS target_n, count(e.name) - count(value) AS missing FROM n LEFT JOIN e ON e.name = n.name GROUP BY n.name), c AS (SELECT name, coalesce(len(list_filter(range(1, 10), lambda i: m.lo + (m.hi - m.lo) / 10 * i < value)), 9) AS bin, count(*) AS n FROM e, m GROUP BY 1, 2), b AS (SELECT bin, n / sum(n) OVER () + 1e-10 AS p FROM c WHERE name = 'base'), w AS (SELECT bin, n / sum(n) OVER () + 1e-10 AS q FROM c WHERE name = 'whole'), x AS (SELECT round(sum((coalesce(p, 1e-10) - coalesce(q, 1e-10)) * ln(coalesce(p, 1e-10) / coalesce(q, 1e-10))), 9) AS psi FROM b FULL JOIN w USING (bin)) SELECT name, CASE WHEN name = 'whole' THEN psi END AS psi, target_n, missing, CASE WHEN name <> 'whole' THEN 'inconclusive' WHEN psi > 0.25 THEN 'drift' ELSE 'no_drift' END AS verdict FROM s, x",
    "psi_thresholds": "SELECT * FROM (VALUES ('fixed', 0.25::DOUBLE, '[\"-inf\", 1.0, \"inf\"]'), ('chi_square', round(9.487729036781154 / 400, 9), '[\"-inf\", 1.0, \"inf\"]'), ('normal', round(4 / 400 + 1.6448536269514722 * sqrt(8) / 400, 9), '[\"-inf\", 1.0, \"inf\"]')) v(kind, threshold, edges)",
    "observation_window": "SELECT event_id, value FROM events WHERE user_id = 7 AND event_type = 'click' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-25'",
    "verdicts": "WITH v AS (SELECT o_orderpriority, CASE WHEN abs(avg(o_totalprice) - 250000) > 1000 THEN 'drift' ELSE 'no_drift' END AS verdict FROM orders GROUP BY 1) SELECT * FROM v UNION ALL SELECT 'all', CASE WHEN bool_or(verdict = 'drift') THEN 'failed' ELSE 'passed' END FROM v",
    "spc_one_series": "WITH r AS (SELECT value, (row_number() OVER (ORDER BY ts, event_id) - 1) // 50 AS subgroup FROM events) SELECT subgroup, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM r GROUP BY 1 HAVING count(*) = 50",
    "custom_mean_gaps": "WITH e AS (SELECT event_type, CASE WHEN event_type <> 'click' OR event_id % 50 <> 3 THEN value END AS value FROM events) SELECT event_type, CASE WHEN count(*) = count(value) THEN round(abs(avg(value) - 50), 9) END AS gap, CASE WHEN count(*) <> count(value) THEN 'inconclusive' WHEN abs(avg(value) - 50) > 1 THEN 'drift' ELSE 'no_drift' END AS verdict FROM e GROUP BY event_type",
    "custom_mean": "SELECT event_type, round(abs(avg(value) - 50), 9) AS gap, CASE WHEN count(*) <> count(value) THEN 'inconclusive' WHEN abs(avg(value) - 50) > 1 THEN 'drift' ELSE 'no_drift' END AS verdict FROM events GROUP BY event_type",
    "feature_rows": "SELECT event_id AS record_id, 'event_type' AS series, CAST(NULL AS DOUBLE) AS num_value, event_type AS str_value, ts AS created_at FROM events UNION ALL SELECT event_id, 'user_id', CAST(user_id AS DOUBLE), CAST(user_id AS VARCHAR), ts FROM events",
}
