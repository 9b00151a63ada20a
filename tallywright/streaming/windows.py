"""Streaming: idempotent ingest, tumbling slots, sessions, late evidence; each also runs on a static frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.session import load


def deduplicated(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each key once; state is kept for the delay only."""
    if stream.isStreaming:
        return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    w = W.partitionBy(key).orderBy(time)
    return stream.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def tumbling(stream: DataFrame, time: str, width: str, aggregates: list, delay: str = "0 seconds", by: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates per half-open slot [start, end)."""
    src = stream.withWatermark(time, delay) if stream.isStreaming else stream
    g = src.groupBy(F.window(time, width).alias("w"), *by).agg(*aggregates)
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in g.columns if c != "w"])


def slots(spark: SparkSession, begin: str, end: str, width: str) -> DataFrame:
    """The calendar of slots, so that an empty one is seen."""
    return spark.sql(f"SELECT explode(sequence(TIMESTAMP_NTZ '{begin}', TIMESTAMP_NTZ '{end}' - INTERVAL {width}, INTERVAL {width})) AS start")


def judged(calendar: DataFrame, scored: DataFrame, verdict) -> DataFrame:
    """A verdict for every slot; a slot without rows is inconclusive, never a pass."""
    return calendar.join(scored, "start", "left").select("start", F.coalesce(verdict, F.lit("inconclusive")).alias("verdict"))


def scheduled(calendar: DataFrame, runs: DataFrame, at: str, seconds: int) -> DataFrame:
    """Which slots of the calendar are judged: a run takes the last slot that has ended, slots that no run took are skipped for good."""
    begun = F.timestamp_seconds((F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / seconds) - 1) * seconds).cast("timestamp_ntz")
    taken = runs.select(begun.alias("start")).distinct().withColumn("outcome", F.lit("judged"))
    return calendar.join(taken, "start", "left").select("start", F.coalesce("outcome", F.lit("skipped")).alias("outcome"))


def differing_ties(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Key groups in which two results differ as sets: under a declared order, rows that tie on its keys may stand in any order."""
    hashed = [d.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(d.columns)).cast("decimal(38,0)")).alias("h")) for d in (a, b)]
    same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.h").eqNullSafe(F.col("b.h"))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return hashed[0].alias("a").join(hashed[1].alias("b"), on, "outer").where(~same).select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], F.col("a.n").alias("left_rows"), F.col("b.n").alias("right_rows"))


def sessions(stream: DataFrame, key: str, time: str, gap: str, aggregates: list, delay: str = "0 seconds") -> DataFrame:
    """Groups that end once nothing new came for ``gap``."""
    src = stream.withWatermark(time, delay) if stream.isStreaming else stream
    g = src.groupBy(F.session_window(time, gap).alias("w"), key).agg(*aggregates)
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in g.columns if c != "w"])


def ordered_group(df: DataFrame, key: str, order: tuple[str, ...], value: str) -> DataFrame:
    """Each group's values in declared order, then record time, then id."""
    one = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], F.col(value).alias("v"))
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(one)), lambda e: e.v).alias("items"))


def ingest(stream: DataFrame, warehouse, table, checkpoint: str, batch_prefix: str = "stream"):
    """Append a stream to a warehouse table; a replayed micro-batch keeps its id and so changes nothing."""

    def commit(rows: DataFrame, epoch: int) -> None:
        if not rows.isEmpty():
            warehouse.write(table, rows, f"{batch_prefix}-{epoch:012d}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- queries ---------------------------------------------------------------
def dedup_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events").select("event_id", "ts", "value")
    return deduplicated(ev.unionByName(ev.where("event_id % 3 = 0")), "event_id", "ts", "1 hour")


def session_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(load(spark, sf_dir, "events"), "user_id", "ts", "2 hours", [F.count("*").alias("n")]).select("user_id", "start", "n")


def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = tumbling(load(spark, sf_dir, "events"), "ts", "6 hours", [F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")])
    return judged(slots(spark, "2024-01-01 00:00:00", "2024-02-10 00:00:00", "'6' HOUR"), agg, F.when(F.col("errors") * 3 > F.col("n"), "failed").when(F.col("n") > 0, "passed"))


def scheduled_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a six-hour schedule at the times of some users' events."""
    runs = load(spark, sf_dir, "events").where("user_id % 3 = 0").select("ts")
    return scheduled(slots(spark, "2024-01-01 00:00:00", "2024-02-10 00:00:00", "'6' HOUR"), runs, "ts", 6 * 3600)


def declared_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types in which the events' users, taken as a set, differ from those of events that are worth something."""
    ev = load(spark, sf_dir, "events").select("event_type", "user_id", "event_id")
    return differing_ties(ev.orderBy("event_type", "event_id"), ev.where("event_type <> 'click' or event_id % 2 = 0").orderBy("event_type", F.desc("event_id")), ("event_type",))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (dedup_batches, session_groups, tumbling_windows, scheduled_slots, declared_order)}
ORACLE_SQL: dict[str, str] = {
    "dedup_batches": "SELECT event_id, ts, value FROM events",
    "session_groups": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS brk FROM events), s AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k",
    "tumbling_windows": "WITH c AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-09 18:00:00', INTERVAL '6 hours')) AS start), a AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1) SELECT start, CASE WHEN errors * 3 > n THEN 'failed' WHEN n > 0 THEN 'passed' ELSE 'inconclusive' END AS verdict FROM c LEFT JOIN a USING (start)",
    "scheduled_slots": "WITH c AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-09 18:00:00', INTERVAL '6 hours')) AS start), r AS (SELECT DISTINCT time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours' AS start FROM events WHERE user_id % 3 = 0) SELECT c.start, CASE WHEN r.start IS NULL THEN 'skipped' ELSE 'judged' END AS outcome FROM c LEFT JOIN r ON c.start = r.start",
    "declared_order": "SELECT event_type, count(*) AS left_rows, count(*) FILTER (WHERE event_id % 2 = 0) AS right_rows FROM events WHERE event_type = 'click' GROUP BY event_type",
}
