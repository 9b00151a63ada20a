"""Derived telemetry: rates of cumulative counters and differences of histograms.

Points have a series, a time, a start time and a value.  Of cumulative points
the first in the queried range counts nothing if its series began before the
range, else its value; later ones count the difference to the point before,
and a reset (another start, or a smaller value) counts the whole value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.session import load

DELTA, CUMULATIVE = 1, 2


def increments(points: DataFrame, begin) -> DataFrame:
    """``points`` (series, t, started, value) with ``step``, the increase that each contributes."""
    w = W.partitionBy("series").orderBy("t")
    prev, prev_start = F.lag("value").over(w), F.lag("started").over(w)
    head = F.lag("t").over(w).isNull()
    first = F.when(F.col("started") < begin, F.col("value") * 0).otherwise(F.col("value"))
    later = F.when((F.col("started") == prev_start) & (F.col("value") >= prev), F.col("value") - prev).otherwise(F.col("value"))
    return points.withColumn("step", F.when(head, first).otherwise(later))


def rate(points: DataFrame, begin, width: str, seconds: int) -> DataFrame:
    """Per bin and series the increase and the rate; delta points add up, cumulative ones are differenced."""
    stepped = increments(points, begin)
    part = F.when(F.col("temporality") == DELTA, F.col("value")).otherwise(F.col("step"))
    out = stepped.groupBy(F.window("t", width).start.alias("bin"), "series").agg(F.sum(part).alias("increase"))
    return out.withColumn("rate", F.col("increase") / seconds)


def histogram_increase(points: DataFrame, begin, width: str) -> DataFrame:
    """Per bin and bucket the increase of counts (series, t, started, n, buckets, temporality); empty bins go."""
    w = W.partitionBy("series").orderBy("t")
    cumulative = points.where(F.col("temporality") == CUMULATIVE)
    head = F.lag("t").over(w).isNull()
    grown = (F.lag("started").over(w) == F.col("started")) & (F.col("n") >= F.lag("n").over(w))
    base = F.when(head, F.when(F.col("started") < begin, F.col("buckets"))).when(grown, F.lag("buckets").over(w))
    stepped = cumulative.withColumn("base", base)
    rest = points.where(F.col("temporality") != CUMULATIVE).withColumn("base", F.lit(None).cast(points.schema["buckets"].dataType))
    flat = stepped.unionByName(rest).select(F.window("t", width).start.alias("bin"), "base", F.posexplode("buckets").alias("p", "c"))
    value = F.col("c") - F.coalesce(F.try_element_at("base", F.col("p") + 1), F.lit(0))
    per = flat.groupBy("bin", (F.col("p") + 1).alias("bucket")).agg(F.sum(value).alias("count"))
    alive = per.groupBy("bin").agg(F.sum("count").alias("total")).where("total > 0").select("bin")
    return per.join(alive, "bin", "left_semi")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as cumulative points: a counter of whole values for each user, reset at the start of a day."""
    ev = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.floor("value").cast("long").alias("v"))
    day = F.date_trunc("day", "ts")
    w = W.partitionBy("user_id", day).orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return ev.select(F.col("user_id").alias("series"), (F.col("ts").cast("timestamp") + F.expr("make_dt_interval(0, 0, 0, event_id / 1000000)")).alias("t"), day.cast("timestamp").alias("started"), F.sum("v").over(w).alias("value"), F.lit(CUMULATIVE).alias("temporality"))


BEGIN = "2024-01-03 00:00:00"


def metric_rate_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin = F.lit(BEGIN).cast("timestamp")
    pts = event_points(spark, sf_dir).where(F.col("t") >= begin)
    return rate(pts, begin, "6 hours", 21_600).select("series", F.col("bin").cast("timestamp_ntz").alias("bin"), "increase", F.round("rate", 9).alias("rate"))


def histogram_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative histograms of each event type's values in four buckets, differenced per day."""
    ev = load(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("t"), "event_id", "value")
    w = W.partitionBy("event_type").orderBy("t", "event_id").rowsBetween(W.unboundedPreceding, 0)
    edges = [25, 50, 75]
    cond = [F.col("value") <= edges[0], (F.col("value") > edges[0]) & (F.col("value") <= edges[1]), (F.col("value") > edges[1]) & (F.col("value") <= edges[2]), F.col("value") > edges[2]]
    t = F.col("t") + F.expr("make_dt_interval(0, 0, 0, event_id / 1000000)")
    pts = ev.select(F.col("event_type").alias("series"), t.alias("t"), F.lit("2023-01-01").cast("timestamp").alias("started"), F.count("*").over(w).alias("n"), F.array(*[F.count_if(c).over(w) for c in cond]).alias("buckets"), F.lit(CUMULATIVE).alias("temporality"))
    begin = F.lit("2022-01-01").cast("timestamp")
    return histogram_increase(pts, begin, "1 day").select(F.col("bin").cast("timestamp_ntz").alias("bin"), "bucket", "count")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"metric_rate_cumulative": metric_rate_cumulative, "histogram_delta": histogram_delta}
ORACLE_SQL: dict[str, str] = {
    "metric_rate_cumulative": f"""
        WITH p AS (SELECT user_id AS series, ts + to_microseconds(event_id) AS t, date_trunc('day', ts) AS started,
            sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value FROM events),
        q AS (SELECT * FROM p WHERE t >= TIMESTAMP '{BEGIN}'),
        s AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL THEN CASE WHEN started < TIMESTAMP '{BEGIN}' THEN 0 ELSE value END
            WHEN started = lag(started) OVER w AND value >= lag(value) OVER w THEN value - lag(value) OVER w ELSE value END AS step
            FROM q WINDOW w AS (PARTITION BY series ORDER BY t))
        SELECT series, time_bucket(INTERVAL '6 hours', t) AS bin, CAST(sum(step) AS BIGINT) AS increase, round(sum(step) / 21600, 9) AS rate FROM s GROUP BY 1, 2""",
    "histogram_delta": """
        SELECT time_bucket(INTERVAL '1 day', ts + to_microseconds(event_id)) AS bin, b.bucket,
            count(*) FILTER (WHERE CASE WHEN value <= 25 THEN 1 WHEN value <= 50 THEN 2 WHEN value <= 75 THEN 3 ELSE 4 END = b.bucket) AS count
        FROM events CROSS JOIN (SELECT CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS bucket) b GROUP BY 1, 2""",
}
