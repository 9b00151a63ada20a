"""Token ids in bit-packed files with random access (operator 6).

File format, little-endian: ``TWTOKEN1``; u32 bits per id, u32 ids per block,
u64 documents, u64 ids, u64 blocks; i64 doc_id and u8 is-null for each
document; u64 document bounds (n+1, in ids); u64 block bounds (n+1, in bytes
of the payload); payload.  Every id takes the minimum bits of the vocabulary,
lowest bit first, and each block starts on a byte, so any id is found with a
division and any range of blocks unpacks in one numpy pass.

Rows are dealt to shards by ranges of doc_id, each shard is written in order
by one task (files of at most ``FILE_BYTES`` of payload plus one document),
under a temporary name and then moved, so a lost executor's retry replaces it.

Defined results: null texts are empty (the end id only); null doc_ids come
first, in the order of the checksums of their ids, which deal them to as many
shards as they need; rows with equal doc_id are ordered by the checksum of their ids, and a
doc_id that fills several ranges is spread over them; an empty table writes no
file; other columns are ignored whatever their names.
"""

from __future__ import annotations

import io
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import frames, textbatch as tb, tokens

MAGIC = b"TWTOKEN1"
HEAD = struct.Struct("<8sIIQQQ")
BLOCK = 8192
FILE_BYTES = 64 << 20
SHARD_ROWS = 8000
MAX_SHARDS = 20_000


def bits_for(vocabulary: int) -> int:
    """The minimum bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of one block, ``bits`` each, lowest bit first, padded to a byte."""
    ids = np.asarray(ids, np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {ids.max()} needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    b = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(b.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of a packed block."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    b = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, :bits] = b
    return np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(-1).astype(np.uint32)


def encode_file(doc_ids: list[int | None], parts: list[np.ndarray], bits: int, block: int = BLOCK) -> bytes:
    """The bytes of one file."""
    ids = np.concatenate([*parts, np.zeros(0, np.uint32)]).astype(np.uint32)
    blocks = [pack(ids[a : a + block], bits) for a in range(0, len(ids), block)]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype("<u8")
    at = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    out = io.BytesIO()
    out.write(HEAD.pack(MAGIC, bits, block, len(parts), len(ids), len(blocks)))
    out.write(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes())
    out.write(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    out.write(bounds.tobytes())
    out.write(at.tobytes())
    for b in blocks:
        out.write(b)
    return out.getvalue()


class TokenFile:
    """Random access to one file: only the header, the tables and the blocks asked for are read."""

    def __init__(self, path: str):
        fs, p = frames.file_system(path)
        self.src = fs.open_input_file(p)
        magic, self.bits, self.block, n, self.n_ids, blocks = HEAD.unpack(self.src.read_at(HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        raw = self.src.read_at(n * 9 + 8 * (n + 1) + 8 * (blocks + 1), HEAD.size)
        ids = np.frombuffer(raw, "<i8", n)
        null = np.frombuffer(raw, np.uint8, n, n * 8)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null)]
        self.bounds = np.frombuffer(raw, "<u8", n + 1, n * 9).astype(np.int64)
        self.at = np.frombuffer(raw, "<u8", blocks + 1, n * 9 + 8 * (n + 1)).astype(np.int64)
        self.payload = HEAD.size + len(raw)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids [start, end) of the file."""
        if end <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (end - 1) // self.block + 1
        data = self.src.read_at(int(self.at[b] - self.at[a]), self.payload + int(self.at[a]))
        last = min(self.n_ids, b * self.block) - a * self.block
        if self.block * self.bits % 8 == 0:
            out = unpack(data, last, self.bits)
        else:
            cut = self.at[a : b + 1] - self.at[a]
            out = np.concatenate([unpack(data[cut[k] : cut[k + 1]], min(self.block, last - k * self.block), self.bits) for k in range(b - a)])
        return out[start - a * self.block : end - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.bounds[k]), int(self.bounds[k + 1]))

    def close(self) -> None:
        self.src.close()


def range_bounds(df: DataFrame, key: str, shards: int) -> np.ndarray:
    """Approximate quantiles of a long column, ``shards - 1`` of them."""
    if shards <= 1:
        return np.zeros(0, np.int64)
    got = df.where(F.col(key).isNotNull()).select(F.percentile_approx(key, [i / shards for i in range(1, shards)], max(10_000, 4 * shards)).alias("q")).first()["q"]
    return np.array(sorted(got or []), np.int64)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, vocabulary: int, shard_rows: int = SHARD_ROWS, file_bytes: int = FILE_BYTES) -> list[tuple[str, int, int]]:
    """Write every row's ids in ascending doc_id order; returns (path, documents, ids) of the files in order."""
    bits = bits_for(max(vocabulary, tokens.END_ID + 1))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = src.agg(F.count("*").alias("rows"), F.count("doc_id").alias("named")).first()
    if not size["rows"]:
        return []
    ranges = max(1, min(MAX_SHARDS, math.ceil(size["named"] / shard_rows)))
    unnamed = min(MAX_SHARDS, math.ceil((size["rows"] - size["named"]) / shard_rows))
    shards = unnamed + ranges
    bounds = range_bounds(src, "doc_id", ranges)

    def tokenise(b: pa.RecordBatch):
        enc = tokens.encoder(tokenizer, added=True)
        for first, part in tokens.slices(b.column(1)):
            ids, offs = enc.encode(part)
            doc = b.column(0).slice(first, len(part))
            key = np.asarray(doc.fill_null(0), np.int64)
            crc = np.array([zlib.crc32(ids[offs[k] : offs[k + 1]].tobytes()) for k in range(len(part))], np.int64)
            lo, hi = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
            shard = lo + (tb.mix(crc.astype(np.uint64) + np.arange(len(crc), dtype=np.uint64)) % (hi - lo + 1).astype(np.uint64)).astype(np.int64)
            shard = np.where(np.asarray(doc.is_null()), crc * unnamed >> 32, unnamed + shard)
            data = [pack(ids[offs[k] : offs[k + 1]], bits) for k in range(len(part))]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), doc, pa.array(crc), pa.array(np.diff(offs)), pa.array(data, pa.binary())], ["shard", "doc_id", "crc", "n", "data"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        parts: list = []
        held = 0
        shard, k = -1, 0
        made = []

        def flush():
            nonlocal held, k
            if ids:
                path = f"{folder}/{shard:06d}-{k:04d}.tok"
                frames.put_file(path, encode_file(ids, parts, bits))
                made.append((shard, k, path, len(ids), int(sum(map(len, parts)))))
                ids.clear()
                parts.clear()
                held, k = 0, k + 1

        for b in batches:
            for s, d, n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4)):
                if s != shard:
                    flush()
                    shard, k = s, 0
                ids.append(d)
                parts.append(unpack(data.as_buffer(), n, bits))
                held += len(data.as_buffer())
                if held >= file_bytes:
                    flush()
        flush()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], ["shard", "k", "path", "docs", "ids"])

    dealt = frames.map_arrow(src, tokenise, "shard int, doc_id long, crc long, n long, data binary")
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "crc", "n")
    made = dealt.mapInArrow(write, "shard long, k long, path string, docs long, ids long").collect()
    return [(r["path"], r["docs"], r["ids"]) for r in sorted(made, key=lambda r: (r["shard"], r["k"]))]


def read_token_files(spark, files: list[tuple[str, int, int]]) -> DataFrame:
    """Every document of the files: doc_id, start among all ids, n_tokens, ids_crc32."""
    rows, base = [], 0
    for path, _, n in files:
        rows.append((path, base))
        base += n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)
    src = spark.createDataFrame(rows, "path string, base long").repartitionByRange(len(rows), "base")

    def read(b: pa.RecordBatch):
        for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            f = TokenFile(path)
            n = len(f.doc_ids)
            crc = np.zeros(n, np.int64)
            a = 0
            while a < n:
                z = max(a + 1, int(np.searchsorted(f.bounds, f.bounds[a] + (1 << 20), "right")) - 1)
                z = min(z, n)
                ids = f.ids(int(f.bounds[a]), int(f.bounds[z])).astype("<u4")
                off = f.bounds[a : z + 1] - f.bounds[a]
                for k in range(a, z):
                    crc[k] = zlib.crc32(ids[off[k - a] : off[k - a + 1]])
                a = z
            f.close()
            yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, pa.int64()), pa.array(f.bounds[:-1] + start), pa.array(np.diff(f.bounds)), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return frames.map_arrow(src, read, schema)
