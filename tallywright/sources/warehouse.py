"""An append-only warehouse on Parquet: catalog, idempotent writes, manifest, live rows, pruning, compaction.

Every committed batch is a directory of files plus one row in the manifest; a
reader takes one listing of the manifest and nothing else, so a query sees
each batch once or not at all.  An acknowledged batch is on storage before
:meth:`Warehouse.acknowledge` returns, in the staging folder, and is live from
then on; a read unites both and leaves out staged batches that the same
manifest already has.  A staged batch goes only after its manifest row is
there, so a failed publish loses nothing.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.plans import dialect, gate
from tallywright.session import load, scratch
from tallywright.sources.schema import BUILT_IN, CATALOG, NAMESPACES, OWNED_BY_CALLERS, SchemaError, Table, alter, check_columns, check_name, ddl, fingerprint, stamp

MANIFEST = ddl("batch_id string, path string, rows bigint, bytes bigint, files bigint, min_us bigint, max_us bigint, partitions array<string>, replaces array<string>, committed_us bigint")
MAX_PARTITIONS = 32
MAX_NESTING = 8
MAX_REQUEST_BYTES = 16 << 20
SMALL_FILES = 2
#: Rows and stored bytes that one task of a commit sorts and writes, about; larger batches get more tasks.
RANGE_ROWS, RANGE_BYTES = 1_000_000, 32 << 20


def depth(t: T.DataType) -> int:
    if isinstance(t, T.StructType):
        return 1 + max((depth(f.dataType) for f in t.fields), default=0)
    if isinstance(t, T.ArrayType):
        return 1 + depth(t.elementType)
    if isinstance(t, T.MapType):
        return 1 + depth(t.valueType)
    return 0


@dataclass
class Pinned:
    """What one read sees: committed batches, staged ones that are not among them, and what could not be listed."""

    committed: list[dict]
    staged: list[str]
    warnings: list[str] = field(default_factory=list)


class Warehouse:
    """Tables of one tenant under one root; the path is the tenant's proof."""

    def __init__(self, spark: SparkSession, root: str, tenant: str):
        self.spark, self.tenant = spark, check_name(tenant)
        self.root = f"{root.rstrip('/')}/{self.tenant}"
        self.tables: dict[str, Table] = dict(BUILT_IN)

    # --- catalog
    def register(self, name: str, schema: T.StructType, **layout) -> Table:
        """A caller's table; the same schema again is refused as existing, another one as different."""
        check_name(name)
        check_columns(schema)
        if depth(schema) - 1 > MAX_NESTING:
            raise SchemaError(f"nested deeper than {MAX_NESTING}")
        table = Table(OWNED_BY_CALLERS, name, schema)
        if layout:
            table = alter(table, 1, layout=type(table.layout)(**layout))
        have = self.tables.get(table.full_name)
        if have is not None:
            same = fingerprint(have.schema, True) == fingerprint(schema, True)
            raise SchemaError("already exists" if same else "already exists with another schema")
        self.tables[table.full_name] = table
        return table

    def list_tables(self) -> list[str]:
        return sorted(self.tables)

    def describe(self, namespace: str, name: str) -> Table:
        if namespace not in NAMESPACES or f"{CATALOG}.{namespace}.{name}" not in self.tables:
            raise SchemaError("no such table")
        return self.tables[f"{CATALOG}.{namespace}.{name}"]

    def alter_table(self, table: Table, expected_version: int, **change) -> Table:
        self.tables[table.full_name] = new = alter(self.tables[table.full_name], expected_version, **change)
        return new

    # --- writes
    def _dir(self, table: Table) -> str:
        return f"{self.root}/{table.namespace}/{table.name}"

    def _path(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _delete(self, path: str) -> None:
        fs, p = self._path(path)
        fs.delete(p, True)

    def manifest(self, table: Table) -> list[dict]:
        """One listing of committed batches, each once; those that a compaction replaced are left out."""
        rows = self._manifest_rows(table)
        gone = {b for r in rows for b in r["replaces"] or []}
        return sorted((r for r in rows if r["batch_id"] not in gone), key=lambda r: r["batch_id"])

    def _manifest_rows(self, table: Table) -> list[dict]:
        try:
            rows = [r.asDict() for r in self.spark.read.schema(MANIFEST).json(f"{self._dir(table)}/manifest").collect()]
        except AnalysisException:
            return []
        return list({r["batch_id"]: r for r in rows}.values())

    def staged(self, table: Table) -> list[str]:
        """Ids of the batches that were wholly written to the staging folder and are still there."""
        fs, p = self._path(f"{self._dir(table)}/staged")
        if not fs.exists(p):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return sorted(unquote(n.removeprefix("batch=")) for n in names if fs.exists(self._path(f"{self._dir(table)}/staged/{n}/_SUCCESS")[1]))

    def file_list(self, table: Table) -> DataFrame:
        """The inventory: path, size, rows, bounds of event time, partitions and batch of every committed batch."""
        return self.spark.createDataFrame([tuple(r[f.name] for f in MANIFEST.fields) for r in self.manifest(table)], MANIFEST)

    def conform(self, table: Table, df: DataFrame) -> DataFrame:
        """The rows in the table's columns; undeclared columns are refused, missing nullable ones are NULL."""
        extra = [c for c in df.columns if c not in table.schema.names]
        if extra:
            raise SchemaError(f"undeclared column {extra[0]!r}")
        cols = []
        for f in table.schema.fields:
            if f.name in df.columns:
                cols.append(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name))
            elif f.nullable:
                cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            else:
                raise SchemaError(f"column {f.name!r} is missing")
        return df.select(*cols)

    def acknowledge(self, table: Table, df: DataFrame, batch_id: str | None = None, principal: str = "local") -> str:
        """Take a batch in, on storage: it is live until :meth:`publish`; a batch_id that is known changes nothing."""
        batch_id = batch_id or uuid.uuid4().hex
        known = {r["batch_id"] for r in self._manifest_rows(table)} | set(self.staged(table))
        if batch_id not in known:
            rows = stamp(self.conform(table, df), principal, principal, batch_id)
            path = self._staged_path(table, batch_id)
            rows.write.mode("overwrite").parquet(path)
            parts = self._read([path], table.stored).select(table.layout.partition()).distinct().limit(MAX_PARTITIONS + 1).count()
            if parts > MAX_PARTITIONS:
                self._delete(path)
                raise SchemaError(f"more than {MAX_PARTITIONS} time partitions in one batch")
        return batch_id

    def _staged_path(self, table: Table, batch_id: str) -> str:
        return f"{self._dir(table)}/staged/batch={quote(batch_id, safe='')}"

    def publish(self, table: Table) -> int:
        """Commit the staged batches; each becomes visible as published with its manifest row, and leaves staging after it."""
        done = 0
        known = {r["batch_id"] for r in self._manifest_rows(table)}
        for batch_id in self.staged(table):
            path = self._staged_path(table, batch_id)
            if batch_id not in known:
                self._commit(table, [path], batch_id, [])
                done += 1
            self._delete(path)
        return done

    def insert(self, table: Table, rows: Iterable[dict], batch_id: str | None = None) -> str:
        data = list(rows)
        if len(json.dumps(data, default=str)) > MAX_REQUEST_BYTES:
            raise SchemaError(f"the request is larger than {MAX_REQUEST_BYTES} bytes")
        if any(set(r) - set(table.schema.names) for r in data):
            raise SchemaError("undeclared column")
        return self.acknowledge(table, self.spark.createDataFrame([tuple(r.get(n) for n in table.schema.names) for r in data], T.StructType([T.StructField(f.name, f.dataType, True) for f in table.schema.fields])), batch_id)

    def write(self, table: Table, df: DataFrame, batch_id: str | None = None) -> str:
        batch_id = self.acknowledge(table, df, batch_id)
        self.publish(table)
        return batch_id

    def _ranges(self, rows: DataFrame, paths: list[str]) -> int:
        """Tasks that a commit of these stored rows needs: their number follows the rows, not the time partitions."""
        size = sum(fs.getContentSummary(p).getLength() for fs, p in map(self._path, paths))
        return max(1, -(-rows.count() // RANGE_ROWS), -(-size // RANGE_BYTES))

    def _commit(self, table: Table, paths: list[str], batch_id: str, replaces: list[str]) -> None:
        """The rows of stored batches as one published batch, in ranges of time partition and sort keys."""
        lay = table.layout
        path = f"{self._dir(table)}/data/batch={quote(batch_id, safe='')}"
        rows = self._read(paths, table.stored)
        out = rows.withColumn("_part", lay.partition())
        if lay.sort_keys:
            # the row's place divides rows of equal keys too
            out = out.repartitionByRange(self._ranges(rows, paths), "_part", *lay.sort_keys, F.monotonically_increasing_id()).sortWithinPartitions("_part", *lay.sort_keys)
        writer = out.write.mode("overwrite").partitionBy("_part")
        for c in lay.bloom_columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(path)
        made = self._read([path], table.stored, True)
        t = F.unix_micros(F.col(lay.time_column).cast("timestamp"))
        s = made.agg(F.count("*").alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi"), F.sort_array(F.collect_set("_part")).alias("p")).first()
        if not s["n"]:
            return
        fs, p = self._path(path)
        size = fs.getContentSummary(p)
        row = json.dumps({"batch_id": batch_id, "path": path, "rows": s["n"], "bytes": size.getLength(), "files": size.getFileCount(), "min_us": s["lo"], "max_us": s["hi"], "partitions": s["p"], "replaces": replaces, "committed_us": time.time_ns() // 1000})
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("append").text(f"{self._dir(table)}/manifest")

    def _read(self, paths: list[str], schema: T.StructType, parts: bool = False) -> DataFrame:
        """One reader of all batch directories, which are partitions of their common parent."""
        full = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields] + ([T.StructField("_part", T.StringType())] if parts else []))
        return self.spark.read.schema(full).option("basePath", paths[0].rsplit("/", 1)[0]).parquet(*paths).select(*[F.col(f"`{c}`") for c in full.names])

    # --- reads
    def pin(self, table: Table) -> Pinned:
        """What a read sees from now on, whatever is published, compacted or acknowledged meanwhile."""
        # staged batches first: one that is published in between is then in the manifest
        warnings, staged = [], []
        try:
            staged = self.staged(table)
        except Exception as e:  # a source that is missing at listing degrades the result
            warnings.append(f"live rows of {table.full_name} are missing: {str(e).splitlines()[0]}")
        committed = self.manifest(table)
        published = {r["batch_id"] for r in committed} | {b for r in committed for b in r["replaces"] or []}
        return Pinned(committed, [b for b in staged if b not in published], warnings)

    def scan(self, table: Table, begin_us: int | None = None, end_us: int | None = None, pinned: Pinned | None = None) -> DataFrame:
        """Published and live rows, each once; files whose bounds exclude [begin, end) are not opened."""
        pinned = pinned or self.pin(table)
        paths = [r["path"] for r in pinned.committed if may_hold(r["min_us"], r["max_us"], begin_us, end_us)]
        nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in table.stored.fields])
        out = self._read(paths, table.stored) if paths else self.spark.createDataFrame([], nullable)
        if pinned.staged:
            out = out.unionByName(self._read([self._staged_path(table, b) for b in pinned.staged], table.stored))
        t = F.col(table.layout.time_column)
        if begin_us is not None:
            out = out.where(t >= _instant(begin_us))
        return out if end_us is None else out.where(t < _instant(end_us))

    def compact(self, table: Table, least: int = SMALL_FILES, kind: str = "auto") -> list[str]:
        """Rewrite batches; the new ids.  Replaced ones stay for running readers until :meth:`expire`.

        ``small-files`` (also ``auto``) rewrites, for each time partition that
        ``least`` or more batches share, the batches of that partition
        together; ``full`` rewrites all batches as one, however few.
        """
        if kind not in ("auto", "small-files", "full"):
            raise SchemaError(f"no compaction {kind!r}")
        batches = {r["batch_id"]: r for r in self.manifest(table)}
        if kind == "full":
            groups = [set(batches)] if batches else []
        else:
            groups = []
            for part in sorted({p for r in batches.values() for p in r["partitions"] or []}):
                own = {b for b, r in batches.items() if part in (r["partitions"] or [])}
                if len(own) >= least:
                    # batches that share any partition with a group go with it, whole
                    joined = [g for g in groups if g & own]
                    groups = [g for g in groups if not g & own] + [own.union(*joined)]
        made = []
        for group in groups:
            new = f"compact-{uuid.uuid4().hex}"
            replaced = group | {b for i in group for b in batches[i]["replaces"] or []}
            self._commit(table, [batches[i]["path"] for i in sorted(group)], new, sorted(replaced))
            made.append(new)
        return made

    def expire(self, table: Table, older_than_us: int) -> int:
        """Delete the files of batches that a compaction replaced before that time; how many."""
        rows = self._manifest_rows(table)
        replaced = {b for r in rows for b in r["replaces"] or [] if (r["committed_us"] or 0) < older_than_us}
        fs, done = self._path(self._dir(table))[0], 0
        for r in rows:
            if r["batch_id"] in replaced and fs.exists(self._path(r["path"])[1]):
                self._delete(r["path"])
                done += 1
        return done

    def rewrite_manifest(self, table: Table) -> int:
        """One file instead of one for each commit; the rows are doubled for a moment, which readers ignore."""
        folder = f"{self._dir(table)}/manifest"
        fs, p = self._path(folder)
        if not fs.exists(p):
            return 0
        old = [f.getPath() for f in fs.listStatus(p)]
        rows = self._manifest_rows(table)
        self.spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").coalesce(1).write.mode("append").text(folder)
        for f in old:
            if f.getName() != "_SUCCESS":
                fs.delete(f, False)
        return len(rows)

    def sql(self, statement: str, params: list | None = None, caller: gate.Caller | None = None, warnings: list[str] | None = None) -> DataFrame:
        """Gate, authorize, pin, and plan one statement over this tenant's tables."""
        checked = gate.check_statement(statement, self.spark)
        caller = caller or gate.Caller(self.tenant, sensitive=True)
        if caller.tenant != self.tenant:
            raise PermissionError("table not found or not allowed")
        gate.authorize(caller, checked, self.tables)
        names = {}
        for full in checked.tables:
            view = "v_" + full.replace(".", "_").replace("-", "_") + "_" + uuid.uuid4().hex[:8]
            table = self.tables[full]
            pinned = self.pin(table)
            if warnings is not None:
                warnings += pinned.warnings
            gate.visible(self.scan(table, pinned=pinned), table.sensitive, caller).createOrReplaceTempView(view)
            names[full] = view
        return dialect.query(self.spark, statement, params, names)

    def collect(self, statement: str, params: list | None = None, caller: gate.Caller | None = None, deadline: float | None = None, **limits):
        """The result and its terminal: degraded if live rows were missing at listing, failed if a source went after it."""
        warnings: list[str] = []
        df = self.sql(statement, params, caller, warnings)
        got, end = gate.Running(self.spark).collect(df, deadline, **limits)
        if warnings and end.outcome == "success":
            end.outcome = "degraded"
        end.warnings = warnings + end.warnings
        return got, end


def _instant(us: int) -> Column:
    """A timestamp literal, which a comparison with the stored column pushes to the files."""
    return F.lit(dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=us))


def may_hold(lo: int | None, hi: int | None, begin: int | None, end: int | None) -> bool:
    """Whether a file can hold times in [begin, end); missing or reversed bounds keep it."""
    if lo is None or hi is None or lo > hi:
        return True
    return (begin is None or hi >= begin) and (end is None or lo < end)


# --- queries ---------------------------------------------------------------
EVENTS = ddl("event_id long NOT NULL, user_id long, event_type string, ts timestamp NOT NULL, value double")
COLUMNS = EVENTS.names


def _store(spark: SparkSession, sf_dir: str) -> tuple[Warehouse, Table, DataFrame]:
    """A new warehouse with an empty table of events, and the driver's events."""
    w = Warehouse(spark, f"{scratch(spark)}/warehouse-{uuid.uuid4().hex[:12]}", "acme")
    t = w.register("events", EVENTS, time_column="ts", partition_by="month", sort_keys=("ts", "event_id"), bloom_columns=("event_id",))
    return w, t, load(spark, sf_dir, "events").select(*COLUMNS)


def warehouse_live_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published, compacted and live batches, each sent twice, read as one table by SQL."""
    w, t, ev = _store(spark, sf_dir)
    for k in (0, 1, 0):
        w.write(t, ev.where(F.col("event_id") % 4 == k), f"b{k}")
    w.compact(t, kind="full")
    for k in (2, 3, 2, 1):
        w.acknowledge(t, ev.where(F.col("event_id") % 4 == k), f"b{k}")
    return w.sql(f"SELECT event_id, user_id, value FROM {t.full_name}")


def warehouse_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A half-open window of event time, pruned by the manifest and pushed to the files."""
    w, t, ev = _store(spark, sf_dir)
    cut = F.lit("2024-01-12").cast("timestamp")
    w.write(t, ev.where(F.col("ts") < cut), "early")
    w.write(t, ev.where(F.col("ts") >= cut), "late")
    us = [int(dt.datetime(2024, 1, day, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000 for day in (3, 9)]
    return w.scan(t, *us).select("event_id", "ts")


def warehouse_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pinned snapshot, read after later evidence came in and was published."""
    w, t, ev = _store(spark, sf_dir)
    w.write(t, ev.where("event_id % 3 = 0"), "b0")
    pinned = w.pin(t)
    w.acknowledge(t, ev.where("event_id % 3 = 1"), "b1")
    w.write(t, ev.where("event_id % 3 = 2"), "b2")
    return w.scan(t, pinned=pinned).select("event_id")


def warehouse_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest's rows and bounds after small batches were compacted and the old files expired."""
    w, t, ev = _store(spark, sf_dir)
    for k in range(3):
        w.write(t, ev.where(F.col("event_id") % 3 == k), f"b{k}")
    w.compact(t, kind="full")
    w.expire(t, time.time_ns() // 1000 + 1)
    w.rewrite_manifest(t)
    return w.file_list(t).select("rows", "min_us", "max_us")


def warehouse_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, t, _ = _store(spark, sf_dir)
    return w.sql(f"SELECT (SELECT count(*) FROM {t.full_name}) AS own, (SELECT count(*) FROM {CATALOG}.traces.spans) AS spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (warehouse_live_union, warehouse_window, warehouse_pinned, warehouse_inventory, warehouse_empty)}
ORACLE_SQL: dict[str, str] = {
    "warehouse_live_union": "SELECT event_id, user_id, value FROM events",
    "warehouse_window": "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-09'",
    "warehouse_pinned": "SELECT event_id FROM events WHERE event_id % 3 = 0",
    "warehouse_inventory": "SELECT count(*) AS rows, epoch_us(min(ts)) AS min_us, epoch_us(max(ts)) AS max_us FROM events",
    "warehouse_empty": "SELECT CAST(0 AS BIGINT) AS own, CAST(0 AS BIGINT) AS spans",
}
