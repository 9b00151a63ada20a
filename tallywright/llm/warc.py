"""WARC archives: deduplicated records, and a normaliser for monolithic gzip files (operator 2).

``write_monolithic`` writes records into archives that are one gzip stream
each, as some crawlers leave them.  ``normalise`` inflates such a stream once,
rewrites every record as a gzip member of its own and writes a sidecar index
(JSON lines: offset and length of the member, record id, type), after which
any record can be read alone.  ``read_archives`` reads records through the
index.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one
with the largest page_id is a response, the others revisit it.  Tasks write
under temporary names and move files, so a retry replaces them.

Defined results: a null html is an empty payload; a null url has no target
header, line breaks in a url are percent-encoded; rows with a null page_id
keep it and refer to the largest one of their group, if there is one; rows
that repeat the largest page_id of their group are responses too; an empty
table writes no file; other columns are ignored whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import frames

REVISIT_BYTES = 1000
#: Uncompressed bytes after which an archive is closed.
FILE_BYTES = 64 << 20
#: Bits of the map of payload digests that several rows have (1 MB).
BITMAP = 1 << 23
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_field(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def page_of(uri: str) -> int | None:
    tail = uri.strip("<>").rsplit(":", 1)[1]
    return None if tail == "none" else int(tail)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload and names the record that has it."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: {sha1_field(digest)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(digest, keeper) for payloads of at least ``least`` bytes that several rows have."""
    return pages.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("rows")).where("rows > 1 and keeper is not null").select("digest", "keeper")


def with_types(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest, refers_to of every row."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html")})
    groups = frames.checkpointed(revisits(rows, least))
    # payloads are shuffled only for rows that may repeat one
    some, rest = frames.bitmap_split(rows, "digest", groups, BITMAP)
    refers = F.when(F.col("keeper").isNotNull() & (F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    names = ["page_id", "url", "html", "digest"]
    return some.join(groups, "digest", "left").select(*names, refers.alias("refers_to")).unionByName(rest.select(*names, F.lit(None).cast("long").alias("refers_to")))


def write_monolithic(typed: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> list[str]:
    """Archives of one gzip stream each; their paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, size = TaskContext.get().partitionId(), 0, 0
        stream, parts, made = zlib.compressobj(1, zlib.DEFLATED, 31), [], []

        def close():
            nonlocal stream, parts, size, k
            if size:
                parts.append(stream.flush())
                path = f"{folder}/mono-{task:06d}-{k:04d}.warc.gz"
                frames.put_file(path, b"".join(parts))
                made.append(path)
                stream, parts, size, k = zlib.compressobj(1, zlib.DEFLATED, 31), [], 0, k + 1

        for b in batches:
            html = b.column(2).cast(pa.binary())
            for page, url, payload, digest, refers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), html, b.column(3).to_pylist(), b.column(4).to_pylist()):
                raw = record(page, url, payload.as_buffer().to_pybytes(), digest, refers)
                parts.append(stream.compress(raw))
                size += len(raw)
                if size >= file_bytes:
                    close()
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(made)], ["path"])

    return sorted(r["path"] for r in typed.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "path string").collect())


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream that arrives in chunks; each byte is looked at once."""
    held = bytearray()
    need = None
    for c in chunks:
        held += c
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                size = next(int(x.split(b":", 1)[1]) for x in bytes(held[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                need = end + 4 + size + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("the archive ends within a record")


def inflate(path: str, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file, streamed; also of several members one after another."""
    fs, p = frames.file_system(path)
    with fs.open_input_stream(p, compression=None) as src:
        d = zlib.decompressobj(31)
        while chunk := src.read(size):
            while chunk:
                yield d.decompress(chunk)
                chunk = d.unused_data if d.eof else b""
                if d.eof:
                    d = zlib.decompressobj(31)


def normalise_file(path: str, out: str) -> int:
    """Rewrite one archive member by member, with the index beside it (.idx); the number of records."""
    members, index, at = [], [], 0
    for raw in records(inflate(path)):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = z.compress(raw) + z.flush()
        fields, _ = parse(raw)
        index.append(json.dumps({"offset": at, "length": len(member), "id": fields["warc-record-id"], "type": fields["warc-type"], "uri": fields.get("warc-target-uri")}))
        members.append(member)
        at += len(member)
    frames.put_file(out, b"".join(members))
    frames.put_file(out + ".idx", ("\n".join(index) + "\n").encode())
    return len(index)


def normalise(spark, paths: list[str], folder: str) -> list[str]:
    """Normalise archives, one task each; the new paths."""
    if not paths:
        return []

    def run(b: pa.RecordBatch):
        out = []
        for path in b.column(0).to_pylist():
            new = f"{folder}/{path.rsplit('/', 1)[1].replace('mono-', 'warc-')}"
            normalise_file(path, new)
            out.append(new)
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["path"])

    src = spark.createDataFrame([(p,) for p in paths], "path string").repartitionByRange(len(paths), "path")
    return sorted(r["path"] for r in frames.map_arrow(src, run, "path string").collect())


def read_record(path: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record, by its index entry."""
    fs, p = frames.file_system(path)
    with fs.open_input_file(p) as src:
        return parse(zlib.decompress(src.read_at(length, offset), 31))


def read_archives(spark, paths: list[str]) -> DataFrame:
    """Every record of normalised archives, read through their indexes."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string"
    if not paths:
        return spark.createDataFrame([], schema)

    def run(b: pa.RecordBatch):
        for path in b.column(0).to_pylist():
            fs, p = frames.file_system(path)
            with fs.open_input_stream(p + ".idx") as src:
                index = [json.loads(x) for x in src.read().decode().splitlines()]
            rows = []
            with fs.open_input_file(p) as src:
                for e in index:
                    fields, block = parse(zlib.decompress(src.read_at(e["length"], e["offset"]), 31))
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = next(int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if fields["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != stated or len(payload) != size):
                        raise ValueError(f"payload of {fields['warc-record-id']} in {path} is damaged")
                    refers = fields.get("warc-refers-to")
                    rows.append((page_of(fields["warc-record-id"]), size, stated, fields["warc-type"], page_of(refers) if refers else None, fields.get("warc-target-uri")))
                    if len(rows) == 5000:
                        yield batch(rows)
                        rows = []
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri"])

    src = spark.createDataFrame([(p,) for p in paths], "path string").repartitionByRange(len(paths), "path")
    return frames.map_arrow(src, run, schema)


def warc_round_trip(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write, normalise (then drop the monolithic files) and read back."""
    spark = pages.sparkSession
    mono = write_monolithic(with_types(pages), f"{folder}/mono", file_bytes)
    normal = normalise(spark, mono, f"{folder}/warc")
    if mono:
        frames.drop_folder(spark, f"{folder}/mono")
    return read_archives(spark, normal)
