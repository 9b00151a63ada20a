"""Operators 6 and 9: exact round trips, order, packing bounds."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallywright.llm import frames, packing, token_files, tokens
from tests.llm import helpers

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", FILES)
def test_encoder_is_the_library(name):
    r = random.Random(3)
    bits = ["a", "B", " ", "  ", "\n", "\t", "'s", "don't", "é", "É", "中", "1234", "<|endoftext|>", "\x00", "#!", "\r\n", "Σ", "İ", "̸", "\xa0", "x.\ny", ".\n\n"]
    texts = ["".join(r.choice(bits) for _ in range(r.choice([0, 1, 3, 12, 40]))) for _ in range(1500)] + [None, "", " ", "a ", "  a", *helpers.words(1, 5)]
    ids, off = tokens.encoder(public_tokenizers.path(name)).encode(pa.array(texts))
    t = library(name)
    for k, x in enumerate(texts):
        assert ids[off[k] : off[k + 1]].tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 2], repr(x)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_bit_packing_round_trip(bits, values):
    ids = np.array([v % (1 << bits) for v in values], np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert token_files.unpack(data, len(ids), bits).tolist() == ids.tolist()


def test_file_random_access(tmp_path):
    r = np.random.default_rng(1)
    parts = [r.integers(0, 49_408, n).astype(np.uint32) for n in (0, 5, 3000, 1, 700)]
    for bits, block in ((17, 64), (16, 8), (17, 8192), (3, 5)):
        mine = [p % (1 << bits) for p in parts]
        path = str(tmp_path / f"x{bits}-{block}.tok")
        frames.put_file(path, token_files.encode_file([1, None, 3, 4, 5], mine, bits, block))
        f = token_files.TokenFile(path)
        assert f.doc_ids == [1, None, 3, 4, 5]
        every = np.concatenate(mine)
        assert all(f.document(k).tolist() == mine[k].tolist() for k in range(5))
        for a, z in ((0, 0), (1, 9), (60, 130), (2999, 3706)):
            assert f.ids(a, z).tolist() == every[a:z].tolist()


def test_token_files(spark):
    rows = [(i, " ".join(helpers.words(i, 20 + i))) for i in random.Random(4).sample(range(200), 200)] + helpers.odd_rows()
    t = library(FILES[1])
    folder = frames.new_folder(spark, "tokens")
    files = token_files.write_token_files(helpers.documents(spark, rows), public_tokenizers.path(FILES[1]), folder, 49_408, shard_rows=30, file_bytes=5000)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, files).collect())
    want = sorted(((i, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x in rows), key=lambda p: (p[0] is not None, p[0] or 0))
    start = 0
    for g, (i, ids) in zip(got, want, strict=True):
        assert g == (start, i, len(ids), crc(ids))
        start += len(ids)
    assert len(files) > 5
    assert token_files.write_token_files(helpers.documents(spark, rows).limit(0), public_tokenizers.path(FILES[1]), folder, 49_408) == []


def test_many_rows_without_an_id(spark):
    """They fill several shards, first of all, in the order of their checksums."""
    rows = [(None, " ".join(helpers.words(i, 5 + i % 40))) for i in range(150)] + [(i, "a b c") for i in range(40)]
    t = library(FILES[1])
    files = token_files.write_token_files(helpers.documents(spark, rows).repartition(5), public_tokenizers.path(FILES[1]), frames.new_folder(spark, "tokens"), 49_408, shard_rows=20)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, files).collect())
    ids = [(i, [*t.encode(x, add_special_tokens=False).ids, 2]) for i, x in rows]
    want = sorted(((i, crc(x), len(x)) for i, x in ids), key=lambda p: (p[0] is not None, p[0] or 0, p[1], p[2]))
    start = 0
    for g, (i, c, n) in zip(got, want, strict=True):
        assert g == (start, i, n, c)
        start += n
    assert len(files) > 8


def test_words_that_go_straight_to_the_model():
    words = [" über", "Straße", " ÀÉÎÕÜ", "naïve", "ſ", " x", "É", "Ångström", " ÿ", "ſtop", "don", " ªº", "WORD"]
    for name in FILES:
        t = library(name)
        enc = tokens.Encoder(public_tokenizers.path(name), added=True)
        assert enc.direct
        ids, offs = enc.encode(pa.array([" ".join(words), *words, "l'été d'Émile", "A\nB"]))
        for k, text in enumerate([" ".join(words), *words, "l'été d'Émile", "A\nB"]):
            assert ids[offs[k] : offs[k + 1]].tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]


def check_packing(rows, got, capacity):
    t = library(FILES[0])
    want = defaultdict(int)
    total = 0
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        count = -(-len(ids) // capacity)
        at = 0
        for k in range(count):
            size = len(ids) - (count - 1) * capacity if k == 0 else capacity
            want[i, k, at, size, crc(ids[at : at + size])] += 1
            at += size
    seen = defaultdict(int)
    for r in got:
        seen[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    assert seen == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins), -(-total // capacity)


@pytest.mark.parametrize("partition_rows", [200_000, 60])
def test_packing(spark, partition_rows):
    rows = [(i, " ".join(helpers.words(i, random.Random(i).randrange(1, 150)))) for i in range(250)] + helpers.odd_rows()
    docs = helpers.documents(spark, rows)
    out = packing.best_fit_packing(docs, public_tokenizers.path(FILES[0]), 256, partition_rows)
    bins, least = check_packing(rows, out.collect(), 256)
    sure = packing.certificate(out, 256)
    assert sure.bins == bins and least <= sure.bound <= bins <= 1.05 * sure.bound + 2


def test_bounds_hold_for_small_cases():
    r = random.Random(7)
    for _ in range(200):
        cap = r.randrange(5, 40)
        sizes = sorted((r.randrange(1, cap + 1) for _ in range(r.randrange(1, 9))), reverse=True)
        bins, offsets, free = packing.best_fit_decreasing(sizes, cap)
        best = optimum(sizes, cap)
        assert packing.lower_bound(np.array(sizes), cap) <= best <= len(free)
        assert all(0 <= o and o + s <= cap for o, s in zip(offsets, sizes))


def optimum(sizes, cap):
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for j, b in enumerate(bins):
            if b + sizes[k] <= cap:
                place(k + 1, [*bins[:j], b + sizes[k], *bins[j + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


def test_packing_empty_table(spark):
    docs = helpers.documents(spark, [(1, "x")]).limit(0)
    assert packing.best_fit_packing(docs, public_tokenizers.path(FILES[0])).count() == 0
