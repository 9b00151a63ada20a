"""Best-fit packing with certified bin counts (operator 9).

Documents become token pieces of at most ``capacity`` ids (the first piece
takes the remainder).  Full pieces are sequences of their own.  The others
are dealt to partitions of bounded size, each packed by best-fit decreasing;
a dual-feasible-function bound on the partition's length histogram tells how
few bins any packing needs.  Partitions that meet their bound are certified
and stay as they are; those with a gap keep their full bins and send the
documents of their other bins to be dealt anew with those of the other gapped
partitions, which are packed again, until none has a gap or one partition
holds all that is left, or for ``MAX_ROUNDS`` rounds; ``certificate`` tells
how far the result is from the bound over all pieces.

Defined results: a null or empty text is one piece of the end id; rows with
equal doc_id are packed each; ties of length go by row key; a null doc_id
passes through; an empty table gives an empty result; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import frames, tokens

CAPACITY = 1024
#: Pieces in one packing partition, about.
PARTITION_ROWS = 200_000
MAX_ROUNDS = 6
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SCHEMA = PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, extra: tuple[str, ...] = ()) -> DataFrame:
    """The token pieces of every row; ``extra`` columns pass through to each piece."""

    def run(b: pa.RecordBatch):
        enc = tokens.encoder(tokenizer, added=True)
        for first, part in tokens.slices(b.column(1)):
            ids, offs = enc.encode(part)
            raw = ids.astype("<u4")
            n = np.diff(offs)
            count = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), count)
            no = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            head = n - (count - 1) * capacity
            start = np.where(no == 0, 0, head[row] + (no - 1) * capacity)
            length = np.where(no == 0, head[row], capacity)
            at = offs[row] + start
            crc = [zlib.crc32(raw[s : s + k]) for s, k in zip(at.tolist(), length.tolist())]
            take = pa.array(row + first)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(no.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), *(b.column(2 + i).take(take) for i in range(len(extra)))], ["doc_id", "piece", "start", "length", "ids_crc32", *extra])

    tail = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    return frames.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra), run, PIECES + tail)


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each of the (descending) lengths, and every bin's free space.

    Bins with equal free space share a stack; a bit mask over free spaces
    finds the tightest one that fits.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, free, bins, offsets = 0, [], [], []
    for size in lengths:
        fit = mask >> size
        if fit:
            space = size + (fit & -fit).bit_length() - 1
            stack = stacks[space]
            k = stack.pop()
            if not stack:
                mask &= ~(1 << space)
        else:
            space, k = capacity, len(free)
            free.append(capacity)
        bins.append(k)
        offsets.append(capacity - space)
        free[k] = rest = space - size
        if rest:
            stacks[rest].append(k)
            mask |= 1 << rest
    return bins, offsets, free


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual feasible functions on the length histogram.

    The identity gives the volume bound.  For each threshold t up to half the
    capacity, the function that rounds lengths above capacity - t up to a
    whole bin, drops those below t and keeps the rest gives another; the
    k-step functions floor((k+1)x/C)/k (x kept where (k+1)x/C is whole) a third.
    """
    hist = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    if not hist.sum():
        return 0
    x = np.arange(capacity + 1, dtype=np.int64)
    best = math.ceil(int((hist * x).sum()) / capacity)
    count, volume = np.cumsum(hist), np.cumsum(hist * x)
    for t in range(1, capacity // 2 + 1):
        big = count[-1] - count[capacity - t]
        mid = volume[capacity - t] - volume[t - 1]
        best = max(best, int(big + -(-int(mid) // capacity)))
    for k in range(1, 33):
        whole = (k + 1) * x % capacity == 0
        num = np.where(whole, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((hist * num).sum()) // (capacity * k)))
    return best


@dataclass
class Certificate:
    """What the last packing proved: bins used and bins that any packing of all pieces needs."""

    bins: int
    bound: int


def _pack_partition(round_no: int, capacity: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        size = t["length"].to_numpy()
        order = np.lexsort((t["key"].to_numpy(), -size))
        bins, offsets, free = best_fit_decreasing(size[order].tolist(), capacity)
        bound = lower_bound(size, capacity)
        certified = len(free) == bound
        pid = int(t["pid"][0].as_py())
        bins = np.array(bins, np.int64)
        done = np.full(len(bins), True) if certified or last else (np.array(free) == 0)[bins]
        seq = ((round_no + 1) << 56) + (pid << 32) + bins
        keys = t["key"].to_numpy()[order]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(size[order]), pa.array(seq), pa.array(np.array(offsets, np.int64)), pa.array(done)], ["key", "length", "sequence_id", "offset", "done"])

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, partition_rows: int = PARTITION_ROWS, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Place (key, length) rows with lengths below the capacity: key, sequence_id, offset."""
    placed: DataFrame | None = None
    todo, before = items, None
    for round_no in range(max_rounds):
        n = todo.count()
        if not n:
            break
        parts = max(1, math.ceil(n / partition_rows))
        last = parts == 1 or round_no == max_rounds - 1 or (before is not None and n > 0.98 * before)
        before = n
        dealt = todo.select("key", "length", F.pmod(F.xxhash64("key", F.lit(round_no)), F.lit(parts)).cast("int").alias("pid")).repartitionById(parts, F.col("pid"))
        out = frames.checkpointed(dealt.mapInArrow(_pack_partition(round_no, capacity, last), "key long, length long, sequence_id long, offset long, done boolean"))
        here = out.where("done").select("key", "sequence_id", "offset")
        placed = here if placed is None else placed.unionByName(here)
        if last:
            break
        todo = out.where("not done").select("key", "length")
    if placed is None:
        return items.sparkSession.createDataFrame([], "key long, sequence_id long, offset long")
    return placed


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, partition_rows: int = PARTITION_ROWS, extra: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of all rows with their sequence and offset (and ``extra`` columns)."""
    spark = docs.sparkSession
    # the key is stored with the pieces: numbered again for each scan, it could change with the scan's splits
    table = frames.written(pieces(docs, tokenizer, capacity, extra).withColumn("key", F.monotonically_increasing_id()), frames.new_folder(spark, "pieces"))
    full = table.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("key"), "offset": F.lit(0).cast("long")})
    rest = table.where(F.col("length") < capacity)
    placed = pack(rest.select("key", "length"), capacity, partition_rows)
    both = full.unionByName(rest.join(placed, "key"))
    return both.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *extra)


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> Certificate:
    """Bins used against the bound over all pieces, from the histogram of lengths (at most ``capacity`` rows)."""
    hist = {r["length"]: r["count"] for r in packed.groupBy("length").count().collect()}
    bins = packed.agg(F.count_distinct("sequence_id").alias("n")).first()["n"]
    lengths = np.repeat(np.array(sorted(hist), np.int64), [hist[k] for k in sorted(hist)]) if hist else np.zeros(0, np.int64)
    return Certificate(bins, lower_bound(lengths, capacity))
