"""Small helpers around Spark frames: shared storage, Arrow mapping, unclashing columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every node sees: spark.checkpoint.dir; on a single machine, where it is unset, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that every node sees")
        app = spark.sparkContext.applicationId
        if app not in _own_dir:
            _own_dir[app] = f"file://{tempfile.mkdtemp(prefix='tallywright-')}"
        folder = _own_dir[app]
    return folder.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tallywright/{what}-{uuid.uuid4().hex[:12]}"


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files and checkpoints that nothing refers to any more.

    The cleaner acts when the JVM collects its garbage, which an idle driver
    puts off; large intermediate shuffles would stay on the executors' disks.
    """
    trim()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, folder: str) -> DataFrame:
    """Write a table in the shared folder and read it again (column-prunable, unlike a checkpoint)."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def trim() -> None:
    """Give freed memory of this process back to the machine."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass batches on; at the task's end give freed memory back, as a reused worker would keep it."""
    try:
        yield from batches
    finally:
        trim()


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch that returns a batch, several or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tidy(each(batches))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b)
            if out is None:
                continue
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def map_partitions(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of a partition's batches."""
    return df.mapInArrow(lambda batches: tidy(fn(batches)), schema)


def bitmap_split(df: DataFrame, column: str, wanted: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose value may be in ``wanted``, rows whose value is not there or null), all columns; no shuffle of ``df``.

    The wanted values' hashes fall into a map of ``bits`` places, kept as a
    table of its 64-bit words: bits / 64 rows at most, whatever the input.
    """
    word, map_of = free_name(df, "word"), free_name(df, "map")
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    words = wanted.where(F.col(column).isNotNull()).select(place.alias("b")).groupBy(F.expr("b div 64").alias(word)).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias(map_of))
    words = F.broadcast(checkpointed(words))
    bit = F.call_function("getbit", F.col(map_of), (place % 64).cast("int"))
    there = df[column].isNotNull() & (F.floor(place / 64) == F.col(word)) & (bit == 1)
    return df.join(words, there, "left_semi"), df.join(words, there, "left_anti")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a Spark path, and the path within it."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:"):
            return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def put_file(path: str, data: bytes) -> None:
    """Write a whole file under a temporary name, then move it there: a retried task replaces it."""
    fs, p = file_system(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    tmp = f"{p}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp) as out:
        out.write(data)
    fs.move(tmp, p)


def held_out(doc_id):
    """The contract's split: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1, F.lit(False))
