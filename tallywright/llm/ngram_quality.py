"""Quality by an interpolated modified Kneser-Ney language model (operator 1).

The model's n-grams are ``ORDER`` bytes of the UTF-8 text (A-Z lowered, white
space runs as one space, none at the ends, each text padded on the left), so
a gram is one 64-bit integer.  The counts are those of all trusted rows but
one in ``HELD_OUT``; these others set the thresholds.

Documents work in *blocks*, one for each file of a copy that the scan writes.
A block's distinct grams and its trusted counts go, sorted and packed, to the
``SHARDS`` of the model.  A shard holds all grams that agree on a hash of the
two bytes before the last one, hence also all their lower-order suffixes and
contexts down to order 3, so counts, continuation counts and contexts of a
shard are joined without any other shard; orders 2 and 1 are tables of at
most 65,536 and 256 entries, which every task gets.  The answers, a log
probability for each gram asked for, return to the block, which sums them
over each whole text.  A document is kept if its perplexity (by byte) is at
most its language's threshold: the quantile of the held-out trusted rows.

Defined results: null and empty texts (and white space alone) have perplexity
null and are not kept; a null lang is a language of its own; a language with
fewer than ``LEAST_TRUSTED`` held-out rows uses the threshold over all of
them; without trusted rows everything with a perplexity is kept; a null
doc_id is never trusted; if no trusted row is held out, or all are, every
trusted row is counted and sets the threshold too; repeated rows are each
scored; an empty table gives an empty result; other columns are ignored
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import frames, textbatch as tb

#: Bytes of a gram; from 3 to 7.
ORDER = 6
#: A language's threshold: this quantile of its held-out trusted rows' perplexities.
QUANTILE = 0.98
#: One trusted row in so many (by a hash of doc_id) is held out of the counts.
HELD_OUT = 8
LEAST_TRUSTED = 30
SHARDS = 512
#: Blocks whose counts one task merges, and whose requests one copy of a shard answers.
FAN_IN = 256
#: Held grams after which they are merged.
MERGE = 4_000_000
PAD = 2
UNSEEN, COUNTED, HELD = 0, 1, 2
SCHEMA = "doc_id long, lang string, trusted int, n_grams long, perplexity double"
PACK = pa.Codec("zstd", compression_level=1)
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as zstd of their byte planes; sorted 64-bit ones as differences."""
    if values.dtype == np.uint64:
        values = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return len(values).to_bytes(8, "little") + PACK.compress(planes.tobytes(), asbytes=True)


def unpack(data, kind=np.uint64) -> np.ndarray:
    data = memoryview(data)
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = np.frombuffer(PACK.decompress(data[8:], n * width, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    values = np.ascontiguousarray(raw.reshape(width, n).T).view(kind).reshape(-1)
    return np.cumsum(values, dtype=np.uint64) if np.dtype(kind) == np.uint64 else values


class Grams:
    """The grams of a chunk's texts: distinct ones (in no order), their index by place, bounds of texts."""

    def __init__(self, ch: tb.Chunk, order: int = ORDER):
        starts, ends = ch.spans(tb.SPACE)
        words = ch.word_offsets(starts)
        size = ends - starts
        lead = np.ones(len(starts), np.int64)
        lead[words[:-1][np.diff(words) > 0]] = order - 1
        inside = ~tb.SPACE[ch.buf]
        out = np.full(int(lead.sum() + size.sum()), 32, np.uint64)
        pad = np.zeros(len(out), bool)
        at = np.cumsum(lead + size) - size - lead
        for j in range(order - 1):
            k = at[lead > 1] + j
            out[k], pad[k] = PAD, True
        out[np.arange(int(size.sum())) + np.repeat(np.cumsum(lead), size)] = LOWERED[ch.buf[inside]]
        n = max(0, len(out) - order + 1)
        g = np.zeros(n, np.uint64)
        for j in range(order):
            g = (g << np.uint64(8)) | out[j : j + n]
        g = g[~pad[order - 1 :]]
        every = np.concatenate([[0], np.cumsum(size + np.where(lead > 1, 0, 1))])
        self.offs = every[words]
        self.inverse, self.distinct = pd.factorize(g)


def shard_of(grams: np.ndarray) -> np.ndarray:
    return (tb.mix((grams >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(SHARDS)).astype(np.int64)


def merge(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, sorted, and their summed counts."""
    g, c = np.concatenate([*grams, np.zeros(0, np.uint64)]), np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64)
    order = np.argsort(g, kind="stable")
    g, c = g[order], c[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    return g[first], np.add.reduceat(c, first) if len(g) else c


class Merger:
    """Gathers grams and counts; memory follows the distinct grams."""

    def __init__(self):
        self.grams, self.counts, self.held = [], [], 0

    def add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.grams.append(grams)
        self.counts.append(counts)
        self.held += len(grams)
        if self.held > MERGE and len(grams) < self.held // 2:
            self.grams, self.counts = ([x] for x in merge(self.grams, self.counts))
            self.held = len(self.grams[0])

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        return merge(self.grams, self.counts)


# --- blocks ----------------------------------------------------------------
def write_blocks(docs: DataFrame, folder: str) -> DataFrame | None:
    """Copy doc_id, lang and text in files, one block each, with a stored row key; block, part and path of each."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").withColumn("row", F.monotonically_increasing_id())
    src.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(folder)
    spark = docs.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(n for n in (f.getPath().getName() for f in files) if n.endswith(".parquet"))
    # the key's upper bits and the file's name both have the number of the task
    rows = [(k, int(n.split("-")[1]), f"{folder}/{n}") for k, n in enumerate(names)]
    return spark.createDataFrame(rows, "block int, part int, path string") if rows else None


def read_block(path: str) -> Iterator[pa.RecordBatch]:
    fs, p = frames.file_system(path)
    with fs.open_input_file(p) as src:
        yield from pq.ParquetFile(src).iter_batches(batch_size=512)


def trusted_rows(folder: str, trusted: DataFrame) -> DataFrame:
    """row and flag (``COUNTED`` or ``HELD``) of the blocks' trusted rows."""
    spark = trusted.sparkSession
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("flag", F.when(held, HELD).otherwise(COUNTED))
    rows = frames.checkpointed(spark.read.parquet(folder).select("doc_id", "row").join(ids, "doc_id").select("row", "flag"))
    kinds = {r["flag"] for r in rows.select("flag").distinct().collect()}
    return rows if len(kinds) == 2 else rows.withColumn("flag", F.lit(COUNTED))


def block_flags(part: pa.RecordBatch, rows: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The flags of a batch's rows; ``rows`` is sorted."""
    own = np.asarray(part.column(3))
    if not len(rows):
        return np.zeros(len(own), np.uint8)
    at = np.minimum(np.searchsorted(rows, own), len(rows) - 1)
    return np.where(rows[at] == own, flags[at], 0).astype(np.uint8)


def count_grams(files: DataFrame, order: int) -> DataFrame:
    """For each block and shard: all distinct grams asked for, those of counted rows, and their counts."""

    def run(b: pa.RecordBatch):
        for block, path, rows, flags in zip(*(b.column(i).to_pylist() for i in range(4))):
            rows, flags = np.frombuffer(rows, np.int64), np.frombuffer(flags, np.uint8)
            asked, model = Merger(), Merger()
            for part in read_block(path):
                flag = block_flags(part, rows, flags)
                for ch in tb.chunks(part.column(2)):
                    g = Grams(ch, order)
                    asked.add(g.distinct, np.ones(len(g.distinct), np.int64))
                    good = flag[ch.first : ch.first + ch.n] == COUNTED
                    if good.any():
                        c = np.bincount(g.inverse[good[tb.owner(g.offs)]], minlength=len(g.distinct))
                        at = np.flatnonzero(c)
                        model.add(g.distinct[at], c[at])
            every, _ = asked.done()
            held, n = model.done()
            s, t = shard_of(every), shard_of(held)
            o, p = np.argsort(s, kind="stable"), np.argsort(t, kind="stable")
            every, held, n = every[o], held[p], n[p]
            cut, cut2 = np.searchsorted(s[o], np.arange(SHARDS + 1)), np.searchsorted(t[p], np.arange(SHARDS + 1))
            ids = np.flatnonzero(np.diff(cut))
            made = [(block, k, pack(every[cut[k] : cut[k + 1]]), pack(held[cut2[k] : cut2[k + 1]]) if cut2[k + 1] > cut2[k] else None, pack(n[cut2[k] : cut2[k + 1]].astype(np.uint32)) if cut2[k + 1] > cut2[k] else None) for k in ids.tolist()]
            for a in range(0, len(made), 64):
                cols = list(zip(*made[a : a + 64]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], ["block", "shard", "asked", "held", "n"])

    return frames.map_arrow(files.select("block", "path", "rows", "flags"), run, "block int, shard int, asked binary, held binary, n binary")


# --- the model -------------------------------------------------------------
def merged(rows: DataFrame, last: bool, order: int, parallel: int) -> DataFrame:
    """Counts of rows (shard, part, held, n) summed by shard and part.

    The last step also puts out kind 1, how many grams of an order have a
    count (key = 8 * order + count, counts 1 to 4), and kind 2, how many
    distinct order-3 grams of the shard end in a bigram (key).
    """
    names = ["kind", "shard", "part", "held", "n", "key", "many"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, Merger()
        for b in batches:
            for s, p, g, n in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (s, p) != at:
                    yield from flush(at, held)
                    at, held = (s, p), Merger()
                held.add(unpack(g), unpack(n, np.uint32))
        yield from flush(at, held)

    def flush(at, held) -> Iterator[pa.RecordBatch]:
        if at is None:
            return
        grams, counts = held.done()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([pack(grams)], pa.binary()), pa.array([pack(np.minimum(counts, 2**32 - 1).astype(np.uint32))], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names)
        if last:
            tables = lower_orders(grams, counts, order)
            keys = [8 * k + c for k in tables for c in (1, 2, 3, 4)]
            many = [int((tables[k][1] == c).sum()) for k in tables for c in (1, 2, 3, 4)]
            ends, n = np.unique(tables[3][0] & np.uint64(0xFFFF), return_counts=True)
            for kind, key, value in ((1, np.array(keys), np.array(many)), (2, ends, n)):
                k = len(key)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int32)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array(key.astype(np.int64)), pa.array(value.astype(np.int64))], names)

    dealt = rows.select("shard", "part", "held", "n").repartition(parallel, "shard", "part").sortWithinPartitions("shard", "part")
    return frames.map_partitions(dealt, run, "kind int, shard int, part int, held binary, n binary, key long, many long")


def lower_orders(grams: np.ndarray, counts: np.ndarray, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sorted grams and (continuation) counts of every order from the top down to 3."""
    tables = {order: (grams, counts.astype(np.int64))}
    for k in range(order - 1, 2, -1):
        tables[k] = np.unique(tables[k + 1][0] & np.uint64((1 << 8 * k) - 1), return_counts=True)
    return tables


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the numbers of grams with counts 1 to 4."""
    if not n1 or not n2:
        return (0.5, 0.75, 0.9)
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * (n3 / n2), 3 - 4 * y * (n4 / n3) if n3 else 0.9]
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d))


def cut_of(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(n <= 0, 0.0, np.array(d)[np.clip(n, 1, 3).astype(np.int64) - 1])


def bigram_probabilities(ends: np.ndarray) -> np.ndarray:
    """p of the second byte after the first for all 65,536 pairs, from their continuation counts."""
    n = ends.reshape(256, 256).astype(np.float64)
    one = (n > 0).sum(0).astype(np.float64)
    low = np.full(256, 1 / 256)
    if one.sum():
        cut = cut_of(one, discounts(*((one == c).sum() for c in (1, 2, 3, 4))))
        low = np.maximum(one - cut, 0) / one.sum() + cut.sum() / one.sum() * low
    cut = cut_of(n, discounts(*((n == c).sum() for c in (1, 2, 3, 4))))
    total = n.sum(1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        p = np.maximum(n - cut, 0) / total + cut.sum(1, keepdims=True) / total * low
    return np.where(total > 0, p, low).reshape(-1)


class Shard:
    """The part of the model with one hash of the two bytes before the last."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int, cuts: dict[int, tuple], bigrams: np.ndarray):
        self.order, self.bigrams = order, bigrams
        self.tables = {}
        for k, (keys, n) in lower_orders(grams, counts, order).items():
            held = cut_of(n, cuts[k])
            context = keys >> np.uint64(8)
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.zeros(0, np.int64)
            total = np.add.reduceat(n, first) if len(keys) else n
            left = np.add.reduceat(held, first) if len(keys) else held
            self.tables[k] = (keys, np.maximum(n - held, 0.0), context[first], total.astype(np.float64), left)

    def log_probabilities(self, asked: np.ndarray) -> np.ndarray:
        p = self.bigrams[(asked & np.uint64(0xFFFF)).astype(np.int64)]
        for k in range(3, self.order + 1):
            keys, own, context, total, left = self.tables[k]
            if not len(keys):
                continue
            g = asked & np.uint64((1 << 8 * k) - 1)
            at = np.minimum(np.searchsorted(context, g >> np.uint64(8)), len(context) - 1)
            known = context[at] == g >> np.uint64(8)
            to = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            mine = np.where(keys[to] == g, own[to], 0.0)
            p = np.where(known, (mine + left[at] * p) / total[at], p)
        return np.log(p).astype(np.float32)


def answers(model: DataFrame, requests: DataFrame, order: int, cuts: dict[int, tuple], bigrams: np.ndarray, copies: int, parallel: int) -> DataFrame:
    """block, grams asked for and their log probabilities; each copy of a shard serves ``FAN_IN`` blocks."""
    none = F.lit(None).cast("binary")
    rows = model.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select("shard", "copy", F.lit(-1).alias("block"), "held", "n", none.alias("asked"))
    rows = rows.unionByName(requests.select("shard", F.expr(f"cast(block div {FAN_IN} as int)").alias("copy"), "block", none.alias("held"), none.alias("n"), "asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at, shard = None, None
        for b in batches:
            out: list[tuple] = []
            for s, c, block, held, n, asked in zip(*(b.column(i).to_pylist() for i in range(6))):
                if (s, c) != at:
                    at = (s, c)
                    shard = Shard(unpack(held), unpack(n, np.uint32), order, cuts, bigrams) if block < 0 else Shard(*empty, order, cuts, bigrams)
                if block >= 0:
                    out.append((block, asked, shard.log_probabilities(unpack(asked)).tobytes()))
            cols = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["block", "asked", "logp"])

    dealt = rows.repartition(parallel, "shard", "copy").sortWithinPartitions("shard", "copy", "block")
    return frames.map_partitions(dealt, run, "block int, asked binary, logp binary")


def perplexities(docs: DataFrame, trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """Perplexity of every row under the model of the counted trusted rows; trusted is its flag."""
    spark = docs.sparkSession
    folder = frames.new_folder(spark, "blocks")
    files = write_blocks(docs, folder)
    if files is None:
        return spark.createDataFrame([], SCHEMA)
    blocks = files.count()
    copies = -(-blocks // FAN_IN)
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions")) + 64 * (copies - 1)
    flags = trusted_rows(folder, trusted).withColumn("part", F.shiftright("row", 33).cast("int"))
    # a block's rows at most
    flags = flags.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("row", "flag"))).alias("f"))
    flags = frames.map_arrow(flags, _packed_flags, "part int, rows binary, flags binary")
    empty = F.lit(b"")
    files = files.join(flags, "part", "left").select("block", "path", F.coalesce("rows", empty).alias("rows"), F.coalesce("flags", empty).alias("flags"))
    files = frames.checkpointed(files.repartitionById(blocks, F.col("block")))
    counted = frames.written(count_grams(files, order), f"{folder}-counts")
    rows, parts = counted.where("held is not null").select("shard", F.expr(f"cast(block div {FAN_IN} as int)").alias("part"), "held", "n"), copies
    while parts > 1:
        rows = frames.checkpointed(merged(rows, False, order, parallel)).select("shard", F.expr(f"cast(part div {FAN_IN} as int)").alias("part"), "held", "n")
        parts = -(-parts // FAN_IN)
    model = frames.checkpointed(merged(rows, True, order, parallel))
    # at most 4 counts of each order and 65,536 bigrams
    sums = {(r["kind"], r["key"]): r["many"] for r in model.where("kind > 0").groupBy("kind", "key").agg(F.sum("many").alias("many")).collect()}
    cuts = {k: discounts(*(float(sums.get((1, 8 * k + c), 0)) for c in (1, 2, 3, 4))) for k in range(3, order + 1)}
    ends = np.zeros(1 << 16, np.int64)
    for (kind, key), n in sums.items():
        if kind == 2:
            ends[key] = n
    got = answers(model.where("kind = 0").select("shard", "held", "n"), counted.select("block", "shard", "asked"), order, cuts, bigram_probabilities(ends), copies, parallel)
    none = F.lit(None).cast("binary")
    every = got.select("block", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("path"), none.alias("rows"), none.alias("flags"), "asked", "logp")
    every = every.unionByName(files.select("block", F.lit(0).alias("kind"), "path", "rows", "flags", none.alias("asked"), none.alias("logp")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, keys, values = None, None, [], []
        for b in batches:
            for k, kind, path, rows, flags, asked, logp in zip(*(b.column(i).to_pylist() for i in range(7))):
                if k != block:
                    yield from finish(held, keys, values)
                    block, held, keys, values = k, None, [], []
                if kind == 0:
                    held = path, np.frombuffer(rows, np.int64), np.frombuffer(flags, np.uint8)
                else:
                    keys.append(unpack(asked))
                    values.append(np.frombuffer(logp, np.float32))
        yield from finish(held, keys, values)

    def finish(held, keys, values) -> Iterator[pa.RecordBatch]:
        if held is None:
            return
        path, rows, flags = held
        k, v = np.concatenate([*keys, np.zeros(0, np.uint64)]), np.concatenate([*values, np.zeros(0, np.float32)]).astype(np.float64)
        o = np.argsort(k)
        k, v = k[o], v[o]
        for part in read_block(path):
            flag = block_flags(part, rows, flags)
            for ch in tb.chunks(part.column(2)):
                g = Grams(ch, order)
                logp = v[np.searchsorted(k, g.distinct)] if len(k) else np.zeros(len(g.distinct))
                total, n = tb.sum_between(logp[g.inverse], g.offs), np.diff(g.offs)
                ppl = np.exp(-total / np.maximum(n, 1))
                own = part.slice(ch.first, ch.n)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(flag[ch.first : ch.first + ch.n].astype(np.int32)), pa.array(n), pa.array(ppl, mask=n == 0)], ["doc_id", "lang", "trusted", "n_grams", "perplexity"])

    out = frames.map_partitions(every.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind"), score, SCHEMA)
    out = frames.checkpointed(out)
    for done in (folder, f"{folder}-counts"):
        frames.drop_folder(spark, done)
    return out


def _packed_flags(b: pa.RecordBatch) -> pa.RecordBatch:
    rows, flags = [], []
    for pairs in b.column(1).to_pylist():
        rows.append(np.array([p["row"] for p in pairs], np.int64).tobytes())
        flags.append(np.array([p["flag"] for p in pairs], np.uint8).tobytes())
    return pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary()), pa.array(flags, pa.binary())], ["part", "rows", "flags"])


def ngram_quality(docs: DataFrame, trusted: DataFrame, order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, n_grams, perplexity, threshold, kept of every row; ``trusted`` holds doc_ids."""
    scored = perplexities(docs, trusted, order)
    judges = scored.where(F.col("trusted") == HELD)
    if not judges.limit(1).count():
        judges = scored.where(F.col("trusted") == COUNTED)
    judges = judges.where("perplexity is not null")
    q = F.percentile_approx("perplexity", quantile, 10_000)
    every = judges.agg(q.alias("every"))
    own = judges.groupBy("lang").agg(q.alias("own"), F.count("*").alias("n")).where(F.col("n") >= LEAST_TRUSTED).select(F.col("lang").alias("l"), "own")
    joined = scored.join(own, F.col("lang").eqNullSafe(F.col("l")), "left").crossJoin(F.broadcast(every))
    limit = F.coalesce("own", "every", F.lit(float("inf")))
    return joined.select("doc_id", "n_grams", "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("kept"))
