"""Connected components of an edge table, in DataFrame operations with checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import frames

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every end of an edge (a, b); comp is the smallest node reachable.

    Alternates large-star and small-star steps: each links neighbours to the
    smallest node seen, so paths shrink geometrically, and both pre-aggregate
    with ``min`` (no list of a hot node's neighbours is ever built).  Ends when
    a round leaves the edges as they are; each round is checkpointed.
    """
    e = frames.checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = frames.checkpointed(small.where("a <> b").distinct())
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
