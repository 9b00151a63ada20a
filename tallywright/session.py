"""Sessions with the settings that the engine's semantics rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.legacy.parquet.nanosAsLong": "true",
    "spark.scheduler.mode": "FAIR",
}


def session(name: str = "tallywright", master: str | None = None, **more: str) -> SparkSession:
    """A session in UTC with AQE; ``more`` overrides any setting (dots as in Spark)."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    return b.config(map={**SETTINGS, **more}).getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register tables as views of their own names, replacing earlier ones."""
    for n in names:
        load(spark, sf_dir, n).createOrReplaceTempView(n)


_own_folder: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The folder that every node sees: spark.checkpoint.dir; on a single machine, where it is unset, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every node sees")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = f"file://{tempfile.mkdtemp(prefix='tallywright-')}"
    return _own_folder[app]


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as they are now, in the shared folder; evaluated once."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint(eager=True)
