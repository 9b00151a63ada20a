"""Operators 1, 2, 3, 5 and the pipeline against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallywright.llm import components, decontaminate, frames, jaccard_join, ngram_quality, warc
from tests.llm import helpers


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = helpers.SPACE.findall((t or "").translate(helpers.LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    low = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        r = find(k)
        if i is not None and (low[r] is None or i < low[r]):
            low[r] = i
    return Counter((i, len(sets[k]), low[find(k)]) for k, (i, _) in enumerate(rows))


def near(base, r, edits):
    w = list(base)
    for _ in range(edits):
        w[r.randrange(len(w))] = f"e{r.randrange(10_000)}"
    return " ".join(w)


@pytest.fixture
def clusters():
    r = random.Random(11)
    rows, i = [], 0
    passage = helpers.words(500, 60)
    for c in range(12):
        base = helpers.words(c, r.randrange(30, 200), 3000)
        for k in range(r.choice([1, 2, 3, 70])):
            rows.append((i, near(base, r, r.randrange(0, 3)) if k else " ".join(base).upper()))
            i += 1
    for c in range(40):
        rows.append((i, " ".join(helpers.words(900 + c, r.randrange(5, 60), 3000) + passage)))
        i += 1
    rows += [(i, "a b c"), (i + 1, "A b  c"), (i + 2, "a b c d e"), (i + 3, "a b c d e f"), (i + 4, None), (i + 5, "")]
    return rows


def test_jaccard_components(spark, clusters, monkeypatch):
    rows = clusters + helpers.odd_rows()
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(helpers.documents(spark, rows)).collect())
    assert got == brute_components(rows)


def test_jaccard_components_with_split_groups(spark, clusters, monkeypatch):
    """The same with tiny bounds, so that blocks, elections over several levels and comparisons across blocks all take part."""
    monkeypatch.setattr(jaccard_join, "TREE", 3)
    monkeypatch.setattr(jaccard_join, "TREE_SHINGLES", 2000)
    monkeypatch.setattr(jaccard_join, "BUCKET", 500)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(helpers.documents(spark, clusters)).collect())
    assert got == brute_components(clusters)


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_components(helpers.documents(spark, [(1, "x")]).limit(0)).count() == 0
    assert [tuple(r) for r in jaccard_join.jaccard_components(helpers.documents(spark, [(1, None)])).collect()] == [(1, 0, 1)]


def test_tree_keeps_every_link():
    r = np.random.default_rng(5)
    sets = []
    for _ in range(40):
        base = r.integers(0, 2**63, r.integers(20, 200)).astype(np.uint64)
        sets += [np.unique(np.where(r.random(len(base)) < 0.08, r.integers(0, 2**63, len(base)).astype(np.uint64), base)) for _ in range(6)]
    n = np.array([len(s) for s in sets])
    pts = jaccard_join.Points([jaccard_join.point(s).tobytes() for s in sets])
    comp, side = np.arange(len(sets)), np.zeros(len(sets), np.int64)
    links = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))]
    x, y = np.array(links).T
    assert pts.may_overlap(x, y, jaccard_join.needed(n[x] + n[y])).all()
    tree = jaccard_join.CountTree(n, pts.coarse, comp, side)
    assert set(links) <= {tuple(sorted(p)) for x, y in tree.leaf_pairs(False) for p in zip(x.tolist(), y.tolist())}
    for start in ([0, len(sets)], [0, 6, 12, len(sets)]):
        label = jaccard_join.candidate_labels(np.array(start), n, pts, comp, side, np.zeros(len(start) - 1, bool))
        of = np.searchsorted(start, np.arange(len(sets)), "right")
        assert all(label[a] == label[b] for a, b in links if of[a] == of[b])
        assert len(np.unique(label)) >= 40


def test_cluster_links_are_a_spanning_forest():
    r = np.random.default_rng(6)
    base = np.unique(r.integers(0, 2**63, 120).astype(np.uint64))
    sets = [np.unique(np.where(r.random(len(base)) < p, r.integers(0, 2**63, len(base)).astype(np.uint64), base)) for p in [0.0] + [0.05, 0.1, 0.15, 0.2, 0.5] * 8]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))]
    for members in (range(len(sets)), range(0, len(sets), 12)):
        k = {m: i for i, m in enumerate(members)}
        want = jaccard_join.unite(np.arange(len(k)), *np.array([(k[a], k[b]) for a, b in links if a in k and b in k]).reshape(-1, 2).T.astype(np.int64))
        made = jaccard_join.cluster_links([sets[m] for m in members], list(members), [0] * len(k), False)
        assert len(made) == len(k) - len(np.unique(want))
        assert (jaccard_join.unite(np.arange(len(k)), *np.array(made, np.int64).reshape(-1, 2).T) == want).all()
    assert jaccard_join.cluster_links(sets, [0] * len(sets), [0] * len(sets), False) == []
    assert jaccard_join.cluster_links(sets, list(range(len(sets))), [0] * len(sets), True) == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 140)}}


def test_warc_round_trip(spark):
    big, other = "<p>é</p>" * 300, "x" * 1000
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (9, None, big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", other), (7, "u", other), (8, "u", other), (8, "u", other), (None, "u", big), (None, "u", "z" * 2000), (11, "u", "Content-Length: 5\r\n\r\nWARC/1.0\r\n\r\n" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = Counter(tuple(r)[:5] for r in warc.warc_round_trip(pages, frames.new_folder(spark, "warc"), 3000).collect())
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        ids = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        keeper = max(ids) if len(data) >= 1000 and ids and sum((g or "") == (h or "") for _, _, g in rows) > 1 else i
        want[i, len(data), hashlib.sha1(data).hexdigest(), "response" if keeper == i else "revisit", None if keeper == i else keeper] += 1
    assert got == want
    assert warc.warc_round_trip(pages.limit(0), frames.new_folder(spark, "warc")).count() == 0


def test_warc_normaliser_gives_members(tmp_path):
    import gzip
    import json

    raw = [warc.record(k, "http://x", b"payload" * k, hashlib.sha1(b"payload" * k).hexdigest(), None) for k in range(50)]
    mono = tmp_path / "mono.warc.gz"
    mono.write_bytes(gzip.compress(b"".join(raw[:20])) + gzip.compress(b"".join(raw[20:])))
    out = str(tmp_path / "n.warc.gz")
    assert warc.normalise_file(str(mono), out) == 50
    index = [json.loads(x) for x in (tmp_path / "n.warc.gz.idx").read_text().splitlines()]
    for k in (0, 17, 49):
        fields, block = warc.read_record(out, index[k]["offset"], index[k]["length"])
        assert fields["warc-record-id"] == f"<urn:page:{k}>" and block.endswith(b"payload" * k)
    assert gzip.decompress((tmp_path / "n.warc.gz").read_bytes()) == b"".join(raw)


def test_decontamination(spark):
    item = "a train leaves the station at 30 km per hour and after 45 minutes it meets Anna who walks at 5 km per hour how far did the train go"
    other = " ".join(helpers.words(77, 40))
    bench = spark.createDataFrame([(1, item), (2, other), (3, "too short"), (4, None), (5, "five words of plain text")], "item_id long, text string")
    changed = item.replace("30", "80").replace("45", "20").replace("Anna", "Peter").replace(" 5 ", " 7 ")
    torn = item.replace("30 km", "80 km").replace("5 km", "80 km")
    rows = [(1, "intro words here. " + item), (2, changed.capitalize() + " and more"), (3, torn), (4, " ".join(helpers.words(5, 200))), (5, " ".join(other.split()[:10])), (6, other.upper()), (7, "so five words of plain text it is"), (8, " ".join(other.split()[:30]))]
    docs = helpers.documents(spark, rows + helpers.odd_rows())
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (6, 2), (7, 5), (8, 2)}
    assert got[1, 1].slots >= 5 and not got[2, 1].exact
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} >= {3, 4, 5, None, 10_000, 10_004}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} & {1, 2, 6, 7, 8} == set()
    small = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, block_bytes=60).collect()}
    assert small == set(got)
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def brute_kn(texts, order):
    """Byte grams of a text, and the interpolated modified Kneser-Ney probability of one, in plain dictionaries."""

    def grams(t):
        low = " ".join(helpers.SPACE.findall(t.translate(helpers.LOW))).encode()
        full = b"\x02" * (order - 1) + low if low else b""
        return [full[k : k + order] for k in range(len(full) - order + 1)]

    tables = {order: Counter(g for t in texts for g in grams(t))}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    cuts = {k: ngram_quality.discounts(*(sum(n == c for n in t.values()) for c in (1, 2, 3, 4))) for k, t in tables.items()}
    followers = {k: defaultdict(list) for k in tables}
    for k, t in tables.items():
        for g, n in t.items():
            followers[k][g[:-1]].append(n)

    def p(g):
        low = p(g[1:]) if len(g) > 1 else 1 / 256
        seen, cut = followers[len(g)].get(g[:-1]), cuts[len(g)]
        if not seen:
            return low
        n = tables[len(g)].get(g, 0)
        held = sum(cut[min(x, 3) - 1] for x in seen)
        return (max(n - cut[min(n, 3) - 1], 0) if n else 0) / sum(seen) + held / sum(seen) * low

    return grams, p


def counted_ids(spark, ids):
    """Trusted ids that the model counts, and those that it holds out."""
    from pyspark.sql import functions as F

    held = {r.i for r in spark.createDataFrame([(i,) for i in ids], "i long").where(F.pmod(F.xxhash64("i"), F.lit(ngram_quality.HELD_OUT)) == 0).collect()}
    return set(ids) - held, held


@pytest.mark.parametrize("order, fan", [(4, 256), (6, 2)])
def test_kneser_ney_against_brute_force(spark, monkeypatch, order, fan):
    """Also with so low a fan-in that counts are merged in several steps and shards are copied."""
    monkeypatch.setattr(ngram_quality, "FAN_IN", fan)
    rows = [(i, " ".join(helpers.words(i, 30, 40))) for i in range(40)] + [(100, "zzz qqq xxx" * 5), (101, "Ünïcode 中文 tests")] + helpers.odd_rows()[:3] + [(7, "again with the same id"), (8, " led\tby \n spaces\x02 ")]
    ids = list(range(0, 40, 2))
    counted, held = counted_ids(spark, ids)
    assert counted and held
    got = ngram_quality.perplexities(helpers.documents(spark, rows).repartition(5), spark.createDataFrame([(i,) for i in [*ids, None]], "doc_id long"), order).collect()
    grams, p = brute_kn([t or "" for i, t in rows if i in counted], order)
    want = Counter()
    for i, t in rows:
        g = grams(t or "")
        ppl = math.exp(-sum(math.log(p(x)) for x in g) / len(g)) if g else None
        want[i, len(g), 1 if i in counted else 2 if i in held else 0, ppl and round(ppl, 2)] += 1
    assert Counter((r.doc_id, r.n_grams, r.trusted, r.perplexity and round(r.perplexity, 2)) for r in got) == want


def test_quality_thresholds_by_language(spark):
    good = [(i, " ".join(helpers.words(i, 40, 60)), "en" if i % 2 else None) for i in range(100)]
    bad = [(200 + i, " ".join(w[::-1].upper() + "#%&" for w in helpers.words(i, 40, 60)), "en") for i in range(5)]
    docs = helpers.documents(spark, good + bad + helpers.odd_rows()[:3])
    trusted = spark.createDataFrame([(i,) for i in range(0, 100, 1) if i % 3], "doc_id long")
    got = {r.doc_id: r for r in ngram_quality.ngram_quality(docs, trusted).collect()}
    assert sum(got[i].kept for i in range(100)) >= 97 and not any(got[200 + i].kept for i in range(5))
    assert got[10_000].perplexity is None and not got[10_000].kept
    none = spark.createDataFrame([], "doc_id long")
    assert ngram_quality.ngram_quality(docs, none).where("doc_id < 100 and kept").count() == 100
    assert ngram_quality.ngram_quality(docs.limit(0), trusted).count() == 0
