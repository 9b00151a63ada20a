"""Dataset artifacts: save and load by interface, statistics, splits, document extraction."""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallywright.session import checkpointed, load, scratch
from tallywright.sources import office

#: Bytes of rows after which a task begins another Arrow or NumPy file.
FILE_BYTES = 32 << 20
#: How such a file ends: Arrow's mark; the comment of an archive; a byte after the array, which readers leave alone.
ENDS = {"arrow": "ARROW1", "npz": "\n", "npy": "\n"}
CODECS = {"none": "uncompressed", "snappy": "snappy", "gzip": "gzip", "zstd": "zstd", "lz4": "lz4"}


def save(df: DataFrame, path: str, interface: str, compression: str = "none", rows_per_file: int | None = None, row_group_bytes: int | None = None) -> None:
    """parquet, jsonl, csv, text, and Arrow IPC or NumPy files; ``rows_per_file`` bounds the rows of each file.

    Arrow files (``arrow``) and arrays (``npy``, one numeric column, or ``npz``,
    an array for each) are written by the tasks through Spark's committer,
    files of about ``FILE_BYTES``; the driver only gives them their names.
    """
    if interface in ("arrow", "npy", "npz"):
        _save_parts(df, path, interface)
        return
    w = df.write.mode("overwrite")
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    if interface in ("parquet", "pandas"):
        if row_group_bytes:
            w = w.option("parquet.block.size", row_group_bytes)
        w.option("compression", CODECS[compression]).parquet(path)
    elif interface == "jsonl":
        w.option("compression", compression).json(path)
    elif interface == "csv":
        w.option("compression", compression).csv(path, header=True)
    elif interface == "text":
        w.option("compression", compression).text(path)
    else:
        raise ValueError(f"unknown interface {interface!r}")


def _file(batches: list[pa.RecordBatch], names: list[str], interface: str) -> bytes:
    """The bytes of one file but for its last ones, which are ``ENDS[interface]``."""
    out = io.BytesIO()
    if interface == "arrow":
        with pa.ipc.new_file(out, batches[0].schema) as sink:
            for b in batches:
                sink.write_batch(b)
        return out.getvalue().removesuffix(ENDS["arrow"].encode())
    arrays = {c: pa.chunked_array([b.column(i) for b in batches]).to_numpy() for i, c in enumerate(names)}
    if interface == "npy":
        np.save(out, arrays[names[0]])
        return out.getvalue()
    np.savez(out, **arrays)
    # the archive ends with the length of its comment: one character, the end that follows
    return out.getvalue()[:-2] + b"\x01\x00"


def _save_parts(df: DataFrame, path: str, interface: str) -> None:
    names = df.columns
    if interface == "npy" and len(names) != 1:
        raise ValueError("npy holds one column")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if held and size + b.nbytes > FILE_BYTES:
                yield whole(held)
                held, size = [], 0
            if b.num_rows:
                held.append(b)
                size += b.nbytes
        if held:
            yield whole(held)

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_file(held, names, interface)], pa.binary())], ["content"])

    # Spark's text writer passes bytes on as they are, in any of its file systems: a row is a file, the line end its last bytes
    files = df.mapInArrow(write, "content binary").select(F.col("content").cast("string").alias("value"))
    files.write.mode("overwrite").option("maxRecordsPerFile", 1).option("lineSep", ENDS[interface]).option("compression", "none").text(path)
    spark = df.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(folder):
        name = f.getPath().getName()
        if name.endswith(".txt"):
            if f.getLen():
                to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"{name.removesuffix('.txt')}.{interface}")
                if not fs.rename(f.getPath(), to):
                    raise OSError(f"cannot rename {name} in {path}")
            else:
                fs.delete(f.getPath(), False)


def _open_parts(spark: SparkSession, path: str, interface: str, schema) -> DataFrame:
    if schema is None:
        raise ValueError(f"{interface} files need a schema")
    wanted = spark.createDataFrame([], schema).schema
    target = to_arrow_schema(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                data = io.BytesIO(content.as_buffer().to_pybytes())
                if interface == "arrow":
                    file = pa.ipc.open_file(data)
                    for part in (file.get_batch(k) for k in range(file.num_record_batches)):
                        yield part.select(target.names).cast(target)
                else:
                    got = np.load(data, allow_pickle=False)
                    arrays = [got] if interface == "npy" else [got[n] for n in target.names]
                    yield pa.RecordBatch.from_arrays([pa.array(a).cast(f.type) for a, f in zip(arrays, target)], schema=target)

    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{interface}").load(path).select("content").mapInArrow(read, wanted)


def open_dataset(spark: SparkSession, path: str, interface: str, schema=None) -> DataFrame:
    read = spark.read.schema(schema) if schema is not None else spark.read
    if interface in ("arrow", "npy", "npz"):
        return _open_parts(spark, path, interface, schema)
    if interface in ("parquet", "pandas"):
        return read.parquet(path)
    if interface == "jsonl":
        return read.json(path)
    if interface == "csv":
        return read.csv(path, header=True)
    if interface == "text":
        return spark.read.text(path)
    if interface in ("image", "bytes"):
        return spark.read.format("binaryFile").load(path)
    raise ValueError(f"unknown interface {interface!r}")


def stats(df: DataFrame) -> DataFrame:
    """Rows, columns, bytes of the rows as compact JSON, and a SHA-256 of them that ignores their order.

    Every row's SHA-256 is a number; the digest is the SHA-256 of the sum of
    these numbers modulo 2^256 (kept as eight sums of 32-bit words) and the
    row count, so equal rows do not cancel out.
    """
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    hashed = df.select(F.octet_length(row).cast("long").alias("b"), F.sha2(row, 256).alias("h"))
    words = [F.coalesce(F.sum(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for k in range(8)]
    n = F.count("*")
    return hashed.agg(n.alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"), F.sha2(F.concat_ws(" ", n.cast("string"), *words), 256).alias("digest"))


# --- splits ----------------------------------------------------------------
COMPARE: dict[str, Callable[[Column, object], Column]] = {"==": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "in": lambda c, v: c.isin(list(v))}


def split_by_column(df: DataFrame, column: str, op: str, value) -> DataFrame:
    return df.where(COMPARE[op](F.col(column), value))


def with_index(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """A 0-based row index in the given total order.

    Rows are range-partitioned once, kept in the shared folder, counted per
    range, and numbered within it, so no single task sees all rows.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = checkpointed(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    local = F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn("_r", local).join(F.broadcast(counts), "_p").withColumn("index", F.col("_base") + F.col("_r")).drop("_p", "_r", "_base")


def split_by_range(df: DataFrame, order: tuple[str, ...], start: int, end: int) -> DataFrame:
    return with_index(df, order).where((F.col("index") >= start) & (F.col("index") < end)).drop("index")


def split_by_indices(df: DataFrame, order: tuple[str, ...], indices: list[int]) -> DataFrame:
    return with_index(df, order).where(F.col("index").isin(indices)).drop("index")


# --- extraction ------------------------------------------------------------
def extract(files: DataFrame) -> DataFrame:
    """One JSON document for each file (path, content): CSV rows as text with the header kept, JSON values, text unchanged, Office files by block, slide and cell.

    Anything that cannot be read is inconclusive, with the reason; PDF files
    need a parser that is not installed.
    """

    @F.pandas_udf("document string, status string, reason string")
    def run(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_extract(p, bytes(c)) for p, c in zip(paths, contents)], columns=["document", "status", "reason"])

    return files.select("path", run("path", "content").alias("e")).select("path", "e.*")


def _extract(path: str, content: bytes) -> tuple[str | None, str, str | None]:
    kind = path.rsplit(".", 1)[-1].lower()
    try:
        if kind in office.READERS:
            return json.dumps(office.READERS[kind](content), ensure_ascii=False, separators=(",", ":")), "ok", None
        text = content.decode("utf-8")
        if kind == "csv":
            body = {"format": "csv", "rows": [list(r) for r in csv.reader(io.StringIO(text))]}
        elif kind == "json":
            body = {"format": "json", "value": json.loads(text)}
        elif kind in ("txt", "md", "html", "htm"):
            body = {"format": {"txt": "text", "md": "markdown"}.get(kind, "html"), "text": text}
        else:
            return None, "inconclusive", f"no parser for {kind}"
    except (LookupError, NotImplementedError, RuntimeError, ValueError) as e:
        return None, "inconclusive", str(e)
    return json.dumps(body, ensure_ascii=False, separators=(",", ":")), "ok", None


# --- queries ---------------------------------------------------------------
def split_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_by_range(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ("o_orderkey",), 100, 250)


def split_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_by_column(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "in", ["O", "P"])


def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"))


def dataset_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written and read again through every interface; rows that came back as they were."""
    src = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    out = None
    for kind in ("parquet", "jsonl", "csv", "arrow", "npz"):
        path = f"{scratch(spark)}/dataset-{uuid.uuid4().hex[:12]}"
        save(src, path, kind)
        here = open_dataset(spark, path, kind, src.schema).join(src, ["o_orderkey", "o_totalprice"], "left_semi").agg(F.count("*").alias("rows")).select(F.lit(kind).alias("interface"), "rows")
        out = here if out is None else out.unionByName(here)
    return out


def extract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as HTML evidence files."""
    p = load(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("content"))
    return extract(p).select("path", "status", F.get_json_object("document", "$.format").alias("format"), F.length(F.get_json_object("document", "$.text")).cast("long").alias("chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (split_indices, split_column, dataset_stats, dataset_round_trip, extract_documents)}
ORACLE_SQL: dict[str, str] = {
    "split_indices": "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i >= 100 AND i < 250",
    "split_column": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P')",
    "dataset_stats": "WITH j AS (SELECT '{\"doc_id\":' || doc_id || ',\"lang\":' || coalesce(to_json(lang)::VARCHAR, 'null') || ',\"source\":' || coalesce(to_json(source)::VARCHAR, 'null') || ',\"n_chars\":' || coalesce(n_chars::VARCHAR, 'null') || '}' AS r FROM documents), h AS (SELECT octet_length(encode(r)) AS b, sha256(r) AS h FROM j) SELECT count(*) AS rows, (SELECT count(*) FROM (DESCRIBE SELECT doc_id, lang, source, n_chars FROM documents)) AS columns, CAST(sum(b) AS BIGINT) AS bytes, sha256(concat_ws(' ', count(*), "
    + ", ".join(f"sum(CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT))" for k in range(8))
    + ")) AS digest FROM h",
    "dataset_round_trip": "SELECT unnest(['parquet', 'jsonl', 'csv', 'arrow', 'npz']) AS interface, (SELECT count(*) FROM orders) AS rows",
    "extract_documents": "SELECT CAST(page_id AS VARCHAR) || '.html' AS path, 'ok' AS status, 'html' AS format, length(html) AS chars FROM pages",
}
