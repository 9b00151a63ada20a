"""Operators 6 and 9: added tokens inside a text are one id, as the library has them by default."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallywright.llm import frames, packing, token_files, tokens
from tests.llm import helpers

FILES = {"byte_bpe_50k.json": 50256, "word_bpe_49k.json": 49407}
TEXTS = ["First page.<|endoftext|>Second page.", "<|endoftext|>", "a <|endoftext|> b", "x<|startoftext|>y", "<|ENDOFTEXT|> <|endoftext", "plain", None, "\x00<|endoftext|>", "  <|endoftext|>\n<|endoftext|>  z"]


@pytest.mark.parametrize("name", FILES)
def test_encoder_with_added_tokens(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    ids, off = tokens.encoder(public_tokenizers.path(name), added=True).encode(pa.array(TEXTS))
    for k, x in enumerate(TEXTS):
        assert ids[off[k] : off[k + 1]].tolist() == [*t.encode(x or "", add_special_tokens=False).ids, tokens.END_ID], repr(x)
    assert off[1] == 8 and FILES[name] in ids[:7].tolist()


def test_operators_with_added_tokens(spark):
    docs = helpers.documents(spark, list(enumerate(TEXTS)))
    want = {}
    for name in FILES:
        t = Tokenizer.from_file(public_tokenizers.path(name))
        want[name] = [np.array([*t.encode(x or "", add_special_tokens=False).ids, tokens.END_ID], "<u4") for x in TEXTS]
    files = token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), frames.new_folder(spark, "tokens"), 49_408)
    start = 0
    for r, ids in zip(sorted(token_files.read_token_files(spark, files).collect(), key=lambda r: r.doc_id), want["word_bpe_49k.json"], strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert got == {k: (len(ids), zlib.crc32(ids.tobytes())) for k, ids in enumerate(want["byte_bpe_50k.json"])}
