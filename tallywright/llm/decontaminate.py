"""Benchmark decontamination by template canonicalisation (operator 5).

Numbers, units and names become typed placeholders, so a question with other
parameters has the same template.  A name is a capitalised word, or one in
capitals whose neighbours are not, in a text that is not mostly in capitals,
wherever it stands in its sentence, unless it is one of the ``COMMON`` words
that often open sentences.  Windows
of ``WINDOW`` template tokens, ``LEAST_IN_WINDOW`` of them literal, form a hash
table of the benchmark; a document's windows are looked up in it, hits are
grouped by item and by alignments that lie within ``DRIFT`` tokens of the next
(words put in or left out), and a group counts as a leak if it covers at least
``COVER`` of the item's tokens and its slots are consistent: equal values of
the item stand against equal values of the document and different ones
against different ones, within each slot type.

The benchmark is taken in blocks of about ``BLOCK_BYTES`` of text, one index in
memory at a time; a larger benchmark takes several passes over the documents,
with whole results.

Defined results: null and empty texts have no leaks; an item with fewer than
``WINDOW`` tokens is one window of all its tokens, and items with fewer than
``LEAST_LITERALS`` literal tokens match nothing; a null item_id or doc_id is
carried through; repeated documents each get their rows, repeated items
theirs; of groups with equal cover the first counts; empty tables give an
empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import frames, textbatch as tb
from tallywright.llm.toxicity import Lookup, folded

WINDOW = 8
COVER = 0.5
LEAST_LITERALS = 4
LEAST_IN_WINDOW = 3
DRIFT = 8
BLOCK_BYTES = 32 << 20
NOWHERE = -(1 << 62)
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
SLOT_HASH = tb.mix(np.array([0, 11, 22, 33], np.uint64) + tb.U64(0x5107))
SCHEMA = "doc_id long, item_id long, covered int, tokens int, cover double, slots int, exact boolean"
#: Number words and units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams ton tons lb lbs pound pounds ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years hz khz mhz ghz w kw watt watts v volt volts a amp amps j joule joules n newton newtons pa bar celsius fahrenheit degree degrees percent dollar dollars euro euros cent cents usd eur gbp mph kmh kb mb gb tb"

#: Words that open sentences and are no names.
COMMON = "a about after all also although an and another any are as at because before both but by can could did do does during each either every few find first for from given had has have he her here his how however i if in into is it its let many may more most much my no not now of on one only or other our out over she should since so some such suppose than that the their them then there these they this those though through to two under until up was we were what when where whether which while who whose why will with within without would you your"
DIGIT = tb.byte_class((48, 57))
UPPER = tb.byte_class((65, 90))
LOWER = tb.byte_class((97, 122), (0x80, 0xFF))
SMALL = tb.byte_class((97, 122))


class Template:
    """Words of a chunk with value hashes, slot types and canonical hashes."""

    units: Lookup | None = None
    numbers: Lookup | None = None
    common: Lookup | None = None

    def __init__(self, ch: tb.Chunk):
        if Template.units is None:
            Template.units, Template.numbers, Template.common = (Lookup({tb.stable_hash(w, False): 1.0 for w in words.split()}) for words in (UNITS, NUMBER_WORDS, COMMON))
        low = folded(ch)
        self.starts, self.ends = low.spans(tb.NON_ALNUM)
        self.offs = low.word_offsets(self.starts)
        n = len(self.starts)
        self.value = low.range_hash(self.starts, self.ends, tb.BYTE_VALUE)
        kind = np.zeros(n, np.int8)
        if n:
            raw = ch.buf
            small, large = SMALL[raw], UPPER[raw]
            latin = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)  # letters of Latin-1
            small[1:] |= latin & (raw[1:] >= 0x9F)
            large[1:] |= latin & (raw[1:] < 0x9F) & (raw[1:] >= 0x80)
            digits, smalls, larges = (self._in_words(x) for x in (DIGIT[raw], small, large))
            first = np.zeros(n, bool)
            first[self.offs[:-1][np.diff(self.offs) > 0]] = True
            size = self.ends - self.starts
            second = raw[np.minimum(self.starts + 1, len(raw) - 1)]
            opens = UPPER[raw[self.starts]] & (size > 1)
            # a word in capitals is a name, unless the next words or most of the text are too
            shout = (larges > 0) & (smalls == 0) & (size > 1)
            beside = np.zeros(n, bool)
            beside[1:] |= shout[:-1] & ~first[1:]
            beside[:-1] |= shout[1:] & ~first[1:]
            doc = tb.owner(self.offs)
            loud = 2 * np.bincount(doc[shout], minlength=ch.n) > np.bincount(doc[larges + smalls > 0], minlength=ch.n)
            name = opens & (LOWER[second] & ~shout | shout & ~beside & ~loud[doc])
            name[Template.common.find(self.value)[0]] = False
            kind[name] = NAME
            number = digits == size
            number[Template.numbers.find(self.value)[0]] = True
            kind[number] = NUMBER
            unit = np.zeros(n, bool)
            unit[Template.units.find(self.value)[0]] = True
            unit[1:] &= number[:-1] & ~first[1:]
            unit[0] = False
            kind[unit] = UNIT
        self.kind = kind
        self.canonical = np.where(kind == LITERAL, self.value, SLOT_HASH[kind])


    def _in_words(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each word are set."""
        c = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[self.ends] - c[self.starts]


class BenchmarkIndex:
    """Template windows of a block of items."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.items = [i for i, _ in items]
        self.kind, self.value, self.window_of = [], [], []
        keys, owner, place = [], [], []
        for ch in tb.chunks(pa.array([t for _, t in items], pa.string())):
            t = Template(ch)
            for k in range(ch.n):
                a, z = int(t.offs[k]), int(t.offs[k + 1])
                kind, value = t.kind[a:z], t.value[a:z]
                no = len(self.kind)
                self.kind.append(kind)
                self.value.append(value)
                size = min(window, z - a)
                self.window_of.append(size)
                if int((kind == LITERAL).sum()) < min(LEAST_LITERALS, max(1, z - a)) or z - a < LEAST_LITERALS:
                    continue
                h, _ = tb.shingles(t.canonical[a:z], np.array([0, z - a]), size, False)
                literal = np.convolve(kind == LITERAL, np.ones(size, np.int64), "valid")
                at = np.flatnonzero(literal >= min(LEAST_IN_WINDOW, size))
                keys.append(tb.mix(h[at] + tb.U64(size)))
                owner.append(np.full(len(at), no))
                place.append(at)
        self.keys = np.concatenate([*keys, np.zeros(0, np.uint64)])
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.owner = np.concatenate([*owner, np.zeros(0, np.int64)])[order].astype(np.int64)
        self.place = np.concatenate([*place, np.zeros(0, np.int64)])[order].astype(np.int64)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys & tb.U64(0xFFFFF)).astype(np.int64)] = True
        self.sizes = sorted({w for w in self.window_of if w})

    def leaks(self, ch: tb.Chunk, cover: float) -> list[tuple[int, int, int, int, int, bool]]:
        """(text, item, covered tokens, tokens, slots, exact) of a chunk's leaks."""
        if not len(self.keys):
            return []
        t = Template(ch)
        at, own, place, span = [], [], [], []
        for size in self.sizes:
            h, woff = tb.shingles(t.canonical, t.offs, size, False)
            h = tb.mix(h + tb.U64(size))
            hit = np.flatnonzero(self.bits[(h & tb.U64(0xFFFFF)).astype(np.int64)])
            lo, hi = np.searchsorted(self.keys, h[hit], "left"), np.searchsorted(self.keys, h[hit], "right")
            hit, lo, n = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if not len(hit):
                continue
            doc = tb.owner(woff)[hit]
            pos = t.offs[doc] + hit - woff[doc]
            each = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            at.append(np.repeat(pos, n))
            own.append(self.owner[each])
            place.append(self.place[each])
            span.append(np.full(len(each), size))
        if not at:
            return []
        at, own, place, span = (np.concatenate(x) for x in (at, own, place, span))
        doc = np.searchsorted(t.offs, at, "right") - 1
        start = at - place
        order = np.lexsort((place, start, own, doc))
        at, own, place, span, doc, start = (x[order] for x in (at, own, place, span, doc, start))
        new = np.ones(len(at), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (own[1:] != own[:-1]) | (start[1:] > start[:-1] + DRIFT)
        cut = np.append(np.flatnonzero(new), len(at))
        best: dict[tuple[int, int], tuple] = {}
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
            d, item = int(doc[a]), int(own[a])
            size = len(self.kind[item])
            where = np.full(size, NOWHERE)
            for s, p, w in zip(start[a:z].tolist(), place[a:z].tolist(), span[a:z].tolist()):
                part = where[p : p + w]
                part[part == NOWHERE] = s  # the first alignment that covers a place
            mark = np.flatnonzero(where != NOWHERE)
            covered = len(mark)
            if covered < cover * size or covered <= best.get((d, item), (0,))[0]:
                continue
            mine, theirs, kind = self.value[item][mark], t.value[where[mark] + mark], self.kind[item][mark]
            slot = kind != LITERAL
            if consistent(mine[slot], theirs[slot], kind[slot]):
                best[d, item] = (covered, size, int(slot.sum()), bool((mine == theirs).all()))
        return [(d, i, *v) for (d, i), v in sorted(best.items())]


def consistent(mine: np.ndarray, theirs: np.ndarray, kind: np.ndarray) -> bool:
    """Whether slot values correspond one to one within each type."""
    forward, back = {}, {}
    for m, t, k in zip(mine.tolist(), theirs.tolist(), kind.tolist()):
        if forward.setdefault((k, m), t) != t or back.setdefault((k, t), m) != m:
            return False
    return True


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[Broadcast, bool]]:
    """Indexes of the benchmark's blocks, each broadcast when its turn comes, and whether it is the only one."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(size / block_bytes))
    for k in range(count):
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) if count > 1 else bench
        items = [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]
        yield benchmark.sparkSession.sparkContext.broadcast(BenchmarkIndex(items)), count == 1


def leaks(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and benchmark item that it leaks."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index, only in blocks(benchmark, block_bytes):
        here = _against(src, index, cover)
        if not only:
            here = frames.checkpointed(here)
            index.unpersist()
        out = here if out is None else out.unionByName(here)
    return out


def _against(src: DataFrame, index, cover: float) -> DataFrame:
    def run(b: pa.RecordBatch):
        ix = index.value
        doc_id = b.column(0)
        for ch in tb.chunks(b.column(1)):
            got = ix.leaks(ch, cover)
            if got:
                d, i, covered, size, slots, exact = zip(*got)
                yield pa.RecordBatch.from_arrays([doc_id.take(pa.array([ch.first + k for k in d])), pa.array([ix.items[k] for k in i], pa.int64()), pa.array(covered, pa.int32()), pa.array(size, pa.int32()), pa.array([c / s for c, s in zip(covered, size)]), pa.array(slots, pa.int32()), pa.array(exact)], ["doc_id", "item_id", "covered", "tokens", "cover", "slots", "exact"])

    return frames.map_arrow(src, run, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without a leak, all columns; rows are dropped where they are read, without a shuffle."""
    place, folder = docs.columns.index("text"), None
    for index, only in blocks(benchmark, block_bytes):

        def keep(b: pa.RecordBatch, index=index):
            ok = np.ones(b.num_rows, bool)
            for ch in tb.chunks(b.column(place)):
                ok[[ch.first + k for k, *_ in index.value.leaks(ch, cover)]] = False
            return b.filter(pa.array(ok))

        docs = frames.map_arrow(docs, keep, docs.schema)
        if not only:
            before, folder = folder, frames.new_folder(docs.sparkSession, "clean")
            docs = frames.written(docs, folder)
            index.unpersist()
            if before:
                frames.drop_folder(docs.sparkSession, before)
    return docs
