"""Exact n-gram Jaccard self-join with count-vector R-trees (operator 3).

A document's set holds its distinct 5-word shingles (64-bit hashes).  Equal
sets are one *node*.  Two nodes link when 100 * |A & B| >= 75 * |A | B|.

1. ``signatures``: every document's set size, set digest and *point*: the
   shingles hashed into groups, about four to a group, and the counts of the
   groups.  Each batch also reports shingles that it has seen in several
   sets; the most frequent ones become a bounded list that the order of step
   2 puts last.
2. ``neighbours``: linked sets must share one of their first
   n - ceil(3n/4) + 1 shingles in any common order.  A shingle's nodes are
   represented by the smallest of them: all nodes that share a first shingle
   with the same smallest node form its *neighbourhood*, a row for each
   member, so a group of copies that has a hundred shingles in common travels
   once and not a hundred times.
3. ``screen``: a neighbourhood's points form an R-tree.  The overlap of two
   sets is at most the sum over groups of the smaller count, that of two tree
   nodes at most the sum of the smaller upper bounds; with the sizes this
   prunes tree nodes and then pairs.  Pairs that are left are not put out:
   members that they connect form a *cluster*, again a row for each.
4. ``verify``: a cluster's whole sets meet in one task, which puts out the
   links that connect them: at most one for each member.

Neighbourhoods of more than ``TREE`` members (or of many shingles) are dealt
in blocks.  Each block elects the member nearest to its mean point; those meet
again, level by level, so that the blocks of one group of copies come together.
Then only members outside the neighbourhood's largest component are compared
across blocks.  The work on a group therefore grows with its members times
those that the group's largest component leaves out, not with its square.

Defined results: null and empty texts (no words) have an empty set, link with
nothing and are their own component; rows with equal doc_id are scored each,
and belong together in components only if their sets link; a null doc_id
gives a null component unless linked to a smaller id; ties in the order go by
hash; an empty table gives an empty result; other columns are ignored
whatever their names.  64-bit digests stand for sets and shingles.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import frames, textbatch as tb
from tallywright.llm.components import connected_components

SHINGLE = 5
NUM, DEN = 75, 100
#: Groups of a tree's points; a set's own point has a power of two of them, about a group for ``PER_GROUP`` shingles.
DIMS = 64
LEAST_DIMS, MOST_DIMS, PER_GROUP = 128, 16384, 4
#: A group's count that is this high or higher is kept as this and bounds nothing.
FULL = 255
#: Frequent shingles that go last in the order, at most (8 bytes each in every task).
HOT_SHINGLES = 200_000
HOT_COUNT = 16
#: Postings in one bucket, about.
BUCKET = 1_000_000
#: Members of one R-tree and shingles of their sets, about; a larger neighbourhood is dealt in blocks.
TREE = 1024
TREE_SHINGLES = 4_000_000
LEAF = 16
#: Bits of the map of documents that a verification needs (1 MB).
BITMAP = 1 << 23
MEMBERS = "key long, low long, node long, n long, comp long, side int, cross boolean, point binary"


def prefix_length(n: np.ndarray | int):
    """How many first shingles two linked sets cannot both miss: n - ceil(0.75 n) + 1."""
    return n - (NUM * n + DEN - 1) // DEN + 1


def needed(n: np.ndarray) -> np.ndarray:
    """The least overlap of linked sets whose sizes sum to ``n``: ceil(75 n / 175)."""
    return -(-(NUM * n) // (NUM + DEN))


def text_sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each text)."""
    for ch in tb.chunks(column):
        s, e = ch.spans(tb.SPACE)
        off = ch.word_offsets(s)
        h, woff = tb.shingles(ch.range_hash(s, e, tb.LOWER_VALUE), off, SHINGLE)
        yield ch.first, [np.unique(h[a:b]) for a, b in zip(woff[:-1].tolist(), woff[1:].tolist())]


def digest(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def point(shingles: np.ndarray) -> np.ndarray:
    """Counts of the shingles by group; the groups of a larger point fold into those of a smaller one."""
    dims = LEAST_DIMS
    while dims < MOST_DIMS and dims * PER_GROUP < len(shingles):
        dims *= 2
    return np.minimum(np.bincount((shingles >> np.uint64(40)).astype(np.int64) % dims, minlength=dims), FULL).astype(np.uint8)


class Distinct:
    """Skips sets that the task has passed on already."""

    def __init__(self, most: int = 1_000_000):
        self.seen: set[int] = set()
        self.most = most

    def new(self, node: int) -> bool:
        if node in self.seen:
            return False
        if len(self.seen) >= self.most:
            self.seen.clear()
        self.seen.add(node)
        return True


def signatures(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, node, n of every row, and the point if the task has not given the node's yet; kind 1: node (a shingle) seen in n sets of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = Distinct()
        names = ["kind", "doc_id", "node", "n", "point"]
        for b in batches:
            held: list[np.ndarray] = []
            size = 0
            for first, sets in text_sets(b.column(1)):
                node = [digest(s) for s in sets]
                fresh = [len(s) > 0 and once.new(k) for s, k in zip(sets, node)]
                points = [point(s).tobytes() if f else None for s, f in zip(sets, fresh)]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), b.column(0).slice(first, len(sets)), pa.array(node, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(points, pa.binary())], names)
                held += [s for s, f in zip(sets, fresh) if f]
                size += sum(len(s) for s, f in zip(sets, fresh) if f)
                if size > 4_000_000:
                    yield from repeated(held, names)
                    held, size = [], 0
            yield from repeated(held, names)

    def repeated(held: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
        if held:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            u, c = u[c > 1], c[c > 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(u), np.int32)), pa.nulls(len(u), pa.int64()), pa.array(u.view(np.int64)), pa.array(c), pa.nulls(len(u), pa.binary())], names)

    return frames.map_partitions(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "kind int, doc_id long, node long, n long, point binary")


# --- neighbourhoods --------------------------------------------------------
def postings(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, packed shingles, nodes, sizes): first shingles of every distinct set, frequent shingles last.

    A frequent shingle's postings are dealt by shingle and node, so that no bucket gets them all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = Distinct()
        for b in batches:
            made: list[tuple[np.ndarray, int, int]] = []
            for _, sets in text_sets(b.column(0)):
                for s in sets:
                    if not len(s):
                        continue
                    node = digest(s)
                    if not once.new(node):
                        continue
                    late = is_hot(s, hot)
                    first = np.concatenate([s[~late], s[late]]) if late.any() else s
                    made.append((first[: prefix_length(len(s))], node, len(s)))
            if not made:
                continue
            size = [len(f) for f, _, _ in made]
            h = np.concatenate([f for f, _, _ in made])
            node = np.repeat(np.array([k for _, k, _ in made], np.int64), size)
            n = np.repeat(np.array([k for _, _, k in made], np.uint32), size)
            by = np.where(is_hot(h, hot), tb.mix(h ^ node.view(np.uint64)), h)
            bucket = (by % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            h, node, n = h[order], node[order], n[order]
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            ids = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), *(pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in ids], pa.binary()) for x in (h, node, n))], ["bucket", "h", "node", "n"])

    return frames.map_partitions(docs.select("text"), run, "bucket int, h binary, node binary, n binary")


def is_hot(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(h), bool)
    at = np.searchsorted(hot, h)
    at[at == len(hot)] = 0
    return hot[at] == h


def shared_postings(packed: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """kind 0: by = smallest node, node, n for nodes that share a shingle; kind 1: by = shingle, node, n of frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.frombuffer(x.as_buffer(), t) for x in col] for b in batches for col, t in ((b.column(1), "<u8"), (b.column(2), "<i8"), (b.column(3), "<u4"))]
        if not parts:
            return
        h, node, n = (np.concatenate([x for p in parts[i::3] for x in p]) for i in range(3))
        order = np.lexsort((node, h))
        h, node, n = h[order], node[order], n[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        h, node, n = h[new], node[new], n[new]
        late = is_hot(h, hot)
        yield from rows(1, h[late].view(np.int64), node[late], n[late])
        h, node, n = h[~late], node[~late], n[~late]
        if not len(h):
            return
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(start, len(h)))
        low, many = np.repeat(node[start], size), np.repeat(size > 1, size)
        low, node, n = low[many], node[many], n[many]
        order = np.lexsort((node, low))
        low, node, n = low[order], node[order], n[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (node[1:] != node[:-1])
        yield from rows(0, low[new], node[new], n[new])

    def rows(kind: int, by: np.ndarray, node: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(by), 50_000):
            part = by[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part), pa.array(node[a : a + 50_000]), pa.array(n[a : a + 50_000].astype(np.int64))], ["kind", "by", "node", "n"])

    return frames.map_partitions(packed.repartitionById(buckets, F.col("bucket")), run, "kind int, by long, node long, n long")


def neighbours(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """Distinct (low, node, n): the members of every neighbourhood, the smallest node included."""
    shared = frames.checkpointed(shared_postings(postings(docs, hot, buckets), hot, buckets))
    frequent = shared.where("kind = 1")
    # one row for each shingle of the bounded list
    lows = F.broadcast(frequent.groupBy("by").agg(F.min("node").alias("low"), F.count("*").alias("size")).where("size > 1").drop("size"))
    more = frequent.join(lows, "by").select("low", "node", "n")
    return shared.where("kind = 0").select(F.col("by").alias("low"), "node", "n").unionByName(more).distinct()


# --- the tree --------------------------------------------------------------
class Points:
    """Points of a task's members: folded to ``DIMS`` groups for trees, and whole for pairs."""

    def __init__(self, raw: list[bytes]):
        dims = np.array([len(x) for x in raw], np.int64)
        self.dims = dims
        self.coarse = np.zeros((len(raw), DIMS), np.int64)
        self.cut = np.zeros(len(raw), bool)
        self.place = np.zeros(len(raw), np.int64)
        self.whole: dict[int, np.ndarray] = {}
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            m = np.frombuffer(b"".join(raw[i] for i in at.tolist()), np.uint8).reshape(-1, d)
            self.whole[d], self.place[at] = m, np.arange(len(at))
            full = (m == FULL).any(1)
            # a cut count bounds nothing
            fold = m.reshape(len(at), d // DIMS, DIMS)
            self.coarse[at] = fold.sum(1, dtype=np.int64) + (fold == FULL).any(1) * (1 << 40)
            self.cut[at] = full

    def _at(self, rows: np.ndarray, dims: int) -> np.ndarray:
        out = np.zeros((len(rows), dims), np.uint16)
        for d in np.unique(self.dims[rows]).tolist():
            k = np.flatnonzero(self.dims[rows] == d)
            m = self.whole[d][self.place[rows[k]]]
            out[k] = m.reshape(len(k), d // dims, dims).sum(1, dtype=np.uint16) if d > dims else m
        return out

    def may_overlap(self, x: np.ndarray, y: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Whether the summed minima of each index pair reach ``need``."""
        keep = np.zeros(len(x), bool)
        for a in range(0, len(x), 20_000):
            s = slice(a, a + 20_000)
            keep[s] = np.minimum(self.coarse[x[s]], self.coarse[y[s]]).sum(1) >= need[s]
        low = np.minimum(self.dims[x], self.dims[y])
        for d in np.unique(low[keep]).tolist():
            if d == DIMS:
                continue
            at = np.flatnonzero(keep & (low == d) & ~self.cut[x] & ~self.cut[y])
            step = max(1, 2_000_000 // d)
            for a in range(0, len(at), step):
                c = at[a : a + step]
                keep[c] = np.minimum(self._at(x[c], d), self._at(y[c], d)).sum(1, dtype=np.int64) >= need[c]
        return keep


class CountTree:
    """A packed R-tree over count vectors: leaves of ``LEAF`` entries, levels of the same fan-out.

    Entries are sorted by component, size and point, so copies lie together.  A
    node keeps the largest count of each group, its smallest and largest set
    and, if it has just one, its component.
    """

    def __init__(self, n: np.ndarray, pts: np.ndarray, comp: np.ndarray, side: np.ndarray):
        self.order = np.lexsort((*pts[:, :4].T, n, comp, side))
        self.levels = []
        hi, lo_n, hi_n, c_lo, c_hi, s_lo, s_hi = (a[self.order] for a in (pts, n, n, comp, comp, side, side))
        while True:
            at = np.arange(0, len(hi_n), LEAF)
            hi, lo_n, hi_n = np.maximum.reduceat(hi, at), np.minimum.reduceat(lo_n, at), np.maximum.reduceat(hi_n, at)
            c_lo, c_hi, s_lo, s_hi = np.minimum.reduceat(c_lo, at), np.maximum.reduceat(c_hi, at), np.minimum.reduceat(s_lo, at), np.maximum.reduceat(s_hi, at)
            self.levels.append((hi, lo_n, hi_n, c_lo, c_hi, s_lo, s_hi))
            if len(at) == 1:
                break

    def _may(self, level: int, a: np.ndarray, b: np.ndarray, across: bool) -> np.ndarray:
        hi, lo_n, hi_n, c_lo, c_hi, s_lo, s_hi = self.levels[level]
        need = needed(np.maximum(lo_n[a], -(-NUM * lo_n[b] // DEN)) + np.maximum(lo_n[b], -(-NUM * lo_n[a] // DEN)))
        ok = (DEN * hi_n[a] >= NUM * lo_n[b]) & (DEN * hi_n[b] >= NUM * lo_n[a])
        ok &= ~((c_lo[a] == c_hi[a]) & (c_lo[b] == c_hi[b]) & (c_lo[a] == c_lo[b]))
        if across:
            ok &= ~((s_lo[a] == s_hi[a]) & (s_lo[b] == s_hi[b]) & (s_lo[a] == s_lo[b]))
        k = np.flatnonzero(ok)
        out = np.zeros(len(a), bool)
        for i in range(0, len(k), 20_000):
            c = k[i : i + 20_000]
            out[c] = np.minimum(hi[a[c]], hi[b[c]]).sum(1) >= need[c]
        return out

    def leaf_pairs(self, across: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Entry index pairs of leaves that can hold a link."""
        top = len(self.levels) - 1
        a = b = np.zeros(1, np.int64)
        for level in range(top, -1, -1):
            ok = self._may(level, a, b, across)
            a, b = a[ok], b[ok]
            size = len(self.levels[level - 1][1]) if level else len(self.order)
            if level:
                a, b = self._children(a, b, size)
        for i in range(0, len(a), 512):
            x, y = self._children(a[i : i + 512], b[i : i + 512], len(self.order), True)
            yield self.order[x], self.order[y]

    @staticmethod
    def _children(a: np.ndarray, b: np.ndarray, size: int, strict: bool = False) -> tuple[np.ndarray, np.ndarray]:
        i = (a[:, None, None] * LEAF + np.arange(LEAF)[None, :, None] + np.zeros((1, 1, LEAF), np.int64)).reshape(-1)
        j = (b[:, None, None] * LEAF + np.arange(LEAF)[None, None, :] + np.zeros((1, LEAF, 1), np.int64)).reshape(-1)
        ok = (i < size) & (j < size) & ((i < j) if strict else (i <= j))
        return i[ok], j[ok]


def unite(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (the smallest index of each component) after joining the index pairs."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return label
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def candidate_labels(start: np.ndarray, n: np.ndarray, pts: Points, comp: np.ndarray, side: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Components of the pairs that the trees cannot rule out; ``start`` has the (g+1) bounds of groups.

    A group of at most ``LEAF`` members is one leaf; those are compared entry
    by entry, all groups at once.
    """
    label = np.arange(len(n))

    def screened(x: np.ndarray, y: np.ndarray, crossing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (comp[x] != comp[y]) & (label[x] != label[y]) & ((side[x] != side[y]) | ~crossing)
        x, y = x[ok], y[ok]
        need = needed(n[x] + n[y])
        ok = np.minimum(n[x], n[y]) >= need
        x, y, need = x[ok], y[ok], need[ok]
        ok = pts.may_overlap(x, y, need)
        return x[ok], y[ok]

    sizes = np.diff(start)
    end, cross = np.repeat(start[1:], sizes), np.repeat(across, sizes)
    at = np.flatnonzero(np.repeat(sizes <= LEAF, sizes))
    for d in range(1, LEAF):
        at = at[at + d < end[at]]
        if not len(at):
            break
        label = unite(label, *screened(at, at + d, cross[at]))
    for g in np.flatnonzero(sizes > LEAF).tolist():
        a, z = int(start[g]), int(start[g + 1])
        tree = CountTree(n[a:z], pts.coarse[a:z], comp[a:z], side[a:z])
        for x, y in tree.leaf_pairs(bool(across[g])):
            label = unite(label, *screened(a + x, a + y, np.full(len(x), across[g])))
    return label


def screen(members: DataFrame, points: DataFrame, parallel: int) -> DataFrame:
    """Members (``MEMBERS`` but for point) in, rows out.

    elected: false for a member of a cluster, whose key it has; true for the
    representative of a block (a key whose low is not null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        key, node = t["key"].to_numpy(), t["node"].to_numpy()
        order = np.lexsort((node, key))
        t = t.take(pa.array(order))
        key, node, n, comp = (t[c].to_numpy() for c in ("key", "node", "n", "comp"))
        side, cross = t["side"].to_numpy().astype(np.int64), np.asarray(t["cross"])
        low, blocked = t["low"].fill_null(0).to_numpy(), np.asarray(t["low"].is_valid())
        pts = Points(t["point"].to_pylist())
        start = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        label = candidate_labels(start, n, pts, comp, side, cross[start[:-1]])
        count = np.bincount(label, minlength=len(label))
        # members are sorted by node: a component's first one has its smallest node
        name = np.where(cross, tb.mix(key.view(np.uint64) ^ tb.mix(node[label].view(np.uint64))).view(np.int64), node[label])
        at = np.flatnonzero(count[label] > 1)
        yield from out(False, at, name[at], low, node, n, comp, side, cross)
        chosen = []
        for a, z in zip(start[:-1].tolist(), start[1:].tolist()):
            if blocked[a] and not cross[a]:
                own = a + np.flatnonzero(label[a:z] == a + np.argmax(count[a:z]))
                far = np.abs(pts.coarse[own] - pts.coarse[own].mean(0)).sum(1)
                chosen.append(int(own[np.argmin(far)]))
        at = np.array(chosen, np.int64)
        yield from out(True, at, key[at], low, node, n, comp, side, cross)

    def out(elected: bool, at: np.ndarray, key: np.ndarray, low, node, n, comp, side, cross) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(at), 50_000):
            k = at[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), elected)), pa.array(key[a : a + 50_000]), pa.array(low[k]), pa.array(node[k]), pa.array(n[k]), pa.array(comp[k]), pa.array(side[k].astype(np.int32)), pa.array(cross[k])], ["elected", "key", "low", "node", "n", "comp", "side", "cross"])

    dealt = members.join(points, "node").repartition(parallel, "key").select("key", "low", "node", "n", "comp", "side", "cross", "point")
    return frames.map_partitions(dealt, run, "elected boolean, key long, low long, node long, n long, comp long, side int, cross boolean")


def blocked(members: DataFrame, level: int) -> DataFrame:
    """Members (low, node, n) with their block of the neighbourhood: blocks, key, and low only where there are several."""
    size = members.groupBy("low").agg(F.greatest(F.ceil(F.count("*") / F.lit(TREE)), F.ceil(F.sum("n") / F.lit(TREE_SHINGLES))).alias("blocks")).where("blocks > 1")
    m = members.join(size, "low", "left").withColumn("i", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))))
    key = F.when(F.col("blocks").isNull() & F.lit(level == 0), F.col("low")).otherwise(F.xxhash64("low", "i", F.lit(level)))
    return m.select(key.alias("key"), F.when(F.col("blocks").isNotNull(), F.col("low")).alias("low"), "node", "n", F.col("node").alias("comp"), F.lit(0).alias("side"), F.lit(False).alias("cross"), "blocks", "i")


def across_blocks(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of blocks against those of the same neighbourhood that its largest component leaves out.

    ``members``: low, node, n, i, blocks.  The left-out members are dealt in
    groups of about ``TREE``; each group meets each block under a key.
    """
    m = frames.checkpointed(members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    per = m.groupBy("low", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    per = per.groupBy("low").agg(F.max(F.struct("c", "comp")).alias("main"), F.sum("c").alias("size"), F.sum("s").alias("s")).where("size > main.c")
    groups = F.greatest(F.ceil((F.col("size") - F.col("main.c")) / F.lit(TREE)), F.ceil(F.col("s") * (F.col("size") - F.col("main.c")) / F.col("size") / F.lit(TREE_SHINGLES)))
    m = m.join(per.select("low", F.col("main.comp").alias("main"), groups.alias("groups")), "low")
    m = m.withColumn("g", F.pmod(F.xxhash64("node", F.lit(1)), F.col("groups")))
    own = m.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).withColumn("side", F.lit(0))
    left = m.where("comp <> main").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("side", F.lit(1))
    return own.unionByName(left).select(F.xxhash64("low", "i", "g", F.lit("across")).alias("key"), "low", "node", "n", "comp", "side", F.lit(True).alias("cross"))


# --- verification ----------------------------------------------------------
def cluster_links(sets: list[np.ndarray], comp: list[int], side: list[int], cross: bool) -> list[tuple[int, int]]:
    """Links that connect a cluster's components, by index: a spanning forest of all its links."""
    size = np.array([len(s) for s in sets])
    label = np.unique(np.array(comp, np.int64), return_inverse=True)[1]
    side = np.array(side)
    links: list[tuple[int, int]] = []
    ids = offs = None
    for x in range(len(sets)):
        ok = label != label[x]
        if cross:
            ok &= side != side[x]
        if not ok.any():
            continue
        ok &= np.minimum(size, size[x]) >= needed(size + size[x])
        ok[:x] = False
        near = np.flatnonzero(ok)
        if not len(near):
            continue
        if len(near) <= 4:
            both = np.array([np.intersect1d(sets[x], sets[y], assume_unique=True).size for y in near.tolist()])
        else:
            if ids is None:
                ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
                offs = np.concatenate([[0], np.cumsum(size)])
                mark = np.zeros(int(ids.max()) + 1, bool)
            mine = ids[offs[x] : offs[x + 1]]
            mark[mine] = True
            both = np.add.reduceat(mark[ids], offs[:-1], dtype=np.int64)[near]
            mark[mine] = False
        for y in near[DEN * both >= NUM * (size[x] + size[near] - both)].tolist():
            if label[y] != label[x]:
                links.append((x, y))
                label[label == label[y]] = label[x]
    return links


def verify(clusters: DataFrame, docs: DataFrame, reps: DataFrame, parallel: int) -> DataFrame:
    """Links (a, b) that connect the members of every cluster, on whole sets.

    ``clusters``: key, node, comp, side, cross; ``reps``: node and the doc_id of one row that has it.
    """
    wanted = frames.checkpointed(clusters.join(reps, "node").select("doc_id", "node", "key", "comp", "side", "cross"))
    named = wanted.where("doc_id is not null")
    rows = frames.bitmap_split(docs, "doc_id", named, BITMAP)[0].join(named, "doc_id").select("key", "node", "comp", "side", "cross", "text")
    rows = rows.unionByName(_unnamed(docs, wanted.where("doc_id is null")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, sets, comp, side, cross = None, [], [], [], [], False
        for b in batches:
            own = [s for _, part in text_sets(b.column(5)) for s in part]
            hit_a, hit_b = [], []
            for s, k, x, c, d, z in zip(own, *(b.column(i).to_pylist() for i in range(5))):
                if k != key:
                    flush(node, sets, comp, side, cross, hit_a, hit_b)
                    key, node, sets, comp, side = k, [], [], [], []
                # an id may have other texts; a set may come from several rows
                if digest(s) == x:
                    node.append(x)
                    sets.append(s)
                    comp.append(c)
                    side.append(d)
                    cross = z
            yield pa.RecordBatch.from_arrays([pa.array(hit_a, pa.int64()), pa.array(hit_b, pa.int64())], ["a", "b"])
        hit_a, hit_b = [], []
        flush(node, sets, comp, side, cross, hit_a, hit_b)
        yield pa.RecordBatch.from_arrays([pa.array(hit_a, pa.int64()), pa.array(hit_b, pa.int64())], ["a", "b"])

    def flush(node, sets, comp, side, cross, hit_a, hit_b) -> None:
        if len(node) > 1:
            for x, y in cluster_links(sets, comp, side, cross):
                hit_a.append(min(node[x], node[y]))
                hit_b.append(max(node[x], node[y]))

    return frames.map_partitions(rows.repartition(parallel, "key").sortWithinPartitions("key", "side", "node"), check, "a long, b long")


def _unnamed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same rows for wanted nodes that only rows with a null doc_id have, found by the set digest."""
    held = with_nodes(docs.where("doc_id is null").select("text"), "node")
    texts = held.join(wanted.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    return texts.join(wanted, "node").select("key", "node", "comp", "side", "cross", "text")


def with_nodes(docs: DataFrame, name: str) -> DataFrame:
    """All columns and, as ``name``, the digest of the text's set."""
    place = docs.columns.index("text")

    def run(b: pa.RecordBatch):
        for first, sets in text_sets(b.column(place)):
            part = b.slice(first, len(sets))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([digest(s) for s in sets], pa.int64())], [*part.schema.names, name])

    return frames.map_arrow(docs, run, docs.withColumn(name, F.lit(0).cast("long")).schema)


# --- the join --------------------------------------------------------------
def node_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n of every row; node, comp of every linked node)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = frames.written(signatures(docs), frames.new_folder(spark, "signatures"))
    rows = sig.where("kind = 0").select("doc_id", "node", "n")
    hot = sig.where("kind = 1").groupBy("node").agg(F.sum("n").alias("c")).where(F.col("c") >= HOT_COUNT)
    hot = np.sort(np.array([r["node"] for r in hot.orderBy(F.desc("c"), "node").limit(HOT_SHINGLES).collect()], np.int64).view(np.uint64))
    total = rows.agg(F.sum(F.expr(f"n - (({NUM} * n + {DEN - 1}) div {DEN}) + 1")).alias("p")).first()["p"] or 0
    members = frames.checkpointed(neighbours(docs, hot, max(1, math.ceil(total / BUCKET))))
    frames.release(spark)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = members.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    parallel = max(least, math.ceil(size["rows"] / 50_000), math.ceil((size["n"] or 0) / (4 * TREE_SHINGLES)))
    # points and representatives of nodes
    reps = sig.where("kind = 0 and n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    points = sig.where("kind = 0 and point is not null").groupBy("node").agg(F.first("point").alias("point"))

    def checked(clusters: DataFrame) -> DataFrame:
        n = clusters.agg(F.sum("n")).first()[0] or 0
        return frames.checkpointed(verify(clusters.drop("n"), docs, reps, max(least, math.ceil(n / TREE_SHINGLES))))

    found = ["key", "node", "n", "comp", "side", "cross"]
    clusters, dealt, level = None, members, 0
    large = None
    while dealt is not None:
        placed = frames.checkpointed(blocked(dealt, level))
        out = frames.checkpointed(screen(placed.drop("blocks", "i"), points, parallel))
        here = out.where("not elected").select(*found)
        clusters = here if clusters is None else clusters.unionByName(here)
        elected = out.where("elected").select("low", "node", "n")
        if level == 0:
            large = placed.where("low is not null").select("low", "node", "n", "i", "blocks")
        dealt, level = (elected, level + 1) if elected.limit(1).count() else (None, level + 1)
    frames.release(spark)
    links = checked(frames.checkpointed(clusters.distinct()))
    comp = connected_components(links)
    if level > 1:
        out = screen(across_blocks(large, comp), points, parallel)
        more = checked(frames.checkpointed(out.select(*found).distinct()))
        frames.release(spark)
        comp = connected_components(links.unionByName(more))
    return rows, comp


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows, comp = node_components(docs)
    ids = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    ids = frames.checkpointed(ids)
    smallest = ids.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    per_node = ids.join(smallest, "comp").select("node", "component_id")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    full = rows.where("n > 0").join(per_node, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(empty)


def first_documents(docs: DataFrame) -> DataFrame:
    """Of every component one row, all columns: that with the smallest doc_id, then digest, then values of the columns.

    Rows without words link with nothing, only exact repeats of one (id and
    text) go; rows with a null doc_id stay.  Rows go by doc_id and set digest,
    so an unlinked text whose id another row's copy has is kept.
    """
    rows, comp = node_components(docs)
    named = frames.checkpointed(rows.where("doc_id is not null").groupBy("doc_id", "node").agg(F.max("n").alias("n"), F.count("*").alias("c")))
    sets = named.where("n > 0").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    keeper = sets.groupBy("comp").agg(F.min(F.struct("doc_id", "node")).alias("k"), F.count("*").alias("of")).where("of > 1")
    dropped = frames.checkpointed(sets.join(keeper, "comp").where("doc_id <> k.doc_id or node <> k.node").select(F.col("doc_id").alias("d"), F.col("node").alias("s")))
    touched = dropped.select(F.col("d").alias("doc_id")).unionByName(named.where("c > 1").select("doc_id"))
    # texts are read again only for rows that may go
    some, rest = frames.bitmap_split(docs, "doc_id", touched, BITMAP)
    node = frames.free_name(docs, "node")
    some = with_nodes(some, node)
    kept = some.join(dropped, (F.col("doc_id") == F.col("d")) & (F.col(node) == F.col("s")), "left_anti")
    words = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", "")) > 0
    first = kept.groupBy("doc_id", F.col(node), F.when(words, F.lit(0)).otherwise(F.xxhash64("text"))).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("row"))
    return rest.unionByName(first.select("row.*"))
