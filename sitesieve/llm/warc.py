"""WARC archives compressed record by record with a zstandard dictionary: writer and reader.

An archive starts with a skippable frame that holds the dictionary; each record that follows is one frame of
its own. Tasks write archives into a shared folder under names no other attempt uses, and a manifest table
that Spark commits says which archives count, so a lost executor leaves files nobody reads. The reader
loads the dictionary, decodes one frame after the other from a stream, and refuses records whose version line,
header lines, content length, end or digest are not right.

Of records with equal payloads the one with the smallest page id is the response, the others revisit it.

Rules for odd rows: a null page is the empty payload; null ids are written as no id and read back as
null (never the response of others); rows that repeat id and payload are all responses; a null URL
has no target header; line ends in a URL are escaped; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_folder
from .base import bounded_sample, checked_broadcast, join_rows

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"

LEVEL = 3
DICTIONARY_BYTES = 65_536
SAMPLE_ROWS, SAMPLE_BYTES = 400, 65_536
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 16


class BadRecord(ValueError):
    """A record or archive that does not follow the format."""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC record; a revisit names the response and carries no payload."""
    name = lambda i: "<urn:page:>" if i is None else f"<urn:page:{i}>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {len(payload)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """The headers and the checked payload facts of one record."""
    head, found, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not found or version != VERSION:
        raise BadRecord(f"no {VERSION.decode()} record")
    headers = {}
    for line in lines:
        key, colon, value = line.decode().partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", key):
            raise BadRecord(f"not a header line: {line[:80]!r}")
        headers[key.lower()] = value.strip()
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if needed not in headers:
            raise BadRecord(f"no {needed}")
    length = headers["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise BadRecord("content length does not fit the block")
    payload = rest[:-4].partition(b"\r\n\r\n")[2]
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if headers["warc-type"] == "response" and (
        digest != base32_sha1(payload) or headers.get("x-payload-bytes") != str(len(payload))
    ):
        raise BadRecord("payload digest or length does not fit")
    number = lambda text: re.fullmatch(r"<urn:page:(.*)>", text)[1] or None
    target = headers.get("warc-target-uri")
    return {
        "page_id": number(headers["warc-record-id"]), "payload_bytes": int(headers["x-payload-bytes"]), "payload_digest": digest,
        "record_type": headers["warc-type"], "payload": payload,
        "refers_to": number(headers["warc-refers-to"]) if "warc-refers-to" in headers else None,
        "url": None if target is None else target.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
    }


def dictionary_frame(dictionary: bytes) -> bytes:
    return DICTIONARY_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary


def read_records(stream):
    """The records of an archive, one decoded frame at a time; `stream` has `read(n)`."""
    import zstandard

    head = stream.read(8)
    if len(head) < 8 or int.from_bytes(head[:4], "little") != DICTIONARY_MAGIC:
        raise BadRecord("no dictionary frame at the start")
    size = int.from_bytes(head[4:], "little")
    dictionary = stream.read(size)
    if len(dictionary) != size:
        raise BadRecord("the dictionary is cut off")
    if dictionary[:4] == (0xFD2FB528).to_bytes(4, "little"):
        dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
    machine = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    rest = stream.read(READ_BYTES)
    while rest:
        frame, parts = machine.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data or stream.read(READ_BYTES)
                break
            rest = stream.read(READ_BYTES)
            if not rest:
                raise BadRecord("the last frame is cut off")
        yield b"".join(parts)


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _write(folder: str, dictionary: bytes, archive_bytes: int):
    """Rows (page_id, url, payload, digest in hex, refers_to, revisit) into archives; yields the manifest."""
    def run(batches):
        import zstandard

        machine = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        out = None
        for batch in batches:
            for page_id, url, payload, digest, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, records = f"{uuid.uuid4().hex}.warc.zst", 0
                    out = fs.open_output_stream(f"{base}/{name}")
                    out.write(dictionary_frame(dictionary))
                text = base64.b32encode(bytes.fromhex(digest)).decode()
                out.write(machine.compress(make_record(page_id, url, payload, text, refers_to, revisit)))
                records += 1
                if out.tell() >= archive_bytes:
                    yield _entry(folder, name, records, out)
                    out = None
        if out is not None:
            yield _entry(folder, name, records, out)

    return run


def _entry(folder, name, records, out):
    size = out.tell()
    out.close()
    return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [records], "bytes": [size]})


def train_dictionary(pages: DataFrame) -> bytes:
    """From at most SAMPLE_ROWS pages of SAMPLE_BYTES at most."""
    import zstandard

    fitting = (F.octet_length("html") <= SAMPLE_BYTES) & (F.octet_length("html") > 0)
    # drawn by the hash of the id before any text moves
    drawn = bounded_sample(pages.filter(fitting).select("page_id").distinct(), F.col("page_id"), SAMPLE_ROWS)
    texts = pages.filter(fitting).select("page_id", "html").join(F.broadcast(drawn), "page_id").limit(SAMPLE_ROWS)
    rows = sorted(r["html"].encode("utf-8", "replace") for r in texts.collect())
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, rows)) // 8))
    try:
        return zstandard.train_dictionary(size, rows, k=64, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(rows)[-size:].ljust(16, b" ")


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, least_bytes: int = 0) -> DataFrame:
    """Write a record per row of `pages` (`page_id`, `url`, `html`); returns the committed manifest.

    Payloads of fewer than `least_bytes` bytes are responses even if they repeat.
    """
    folder = folder or f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    facts = rows.select("page_id", "digest", F.octet_length("payload").alias("n")).filter(F.col("n") >= least_bytes)
    firsts = facts.groupBy("digest", "n").agg(
        F.min("page_id").alias("refers_to"), F.count_distinct("page_id").alias("ids"), F.count(F.lit(1)).alias("rows"),
        F.count("page_id").alias("named"),
    ).filter("ids > 0 and (ids > 1 or named < rows)").select("digest", "refers_to")
    # rows that are no response: few, or else joined by id and digest so that no digest is a hot key
    again = cut_lineage(
        facts.join(checked_broadcast(firsts), "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select("page_id", "digest", "refers_to").distinct()
    )
    met = join_rows(rows, checked_broadcast(again), "left", ("page_id", "digest"))
    full = met.select("page_id", "url", "payload", "digest", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))
    return cut_lineage(full.mapInArrow(_write(folder, train_dictionary(pages), archive_bytes), "archive string, records bigint, bytes bigint"))


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the archives of a manifest: page_id, url, payload facts, type and reference."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads

    def run(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                fs, path = _open(archive)
                with fs.open_input_stream(path, buffer_size=1 << 20) as stream:
                    rows = []
                    for record in read_records(stream):
                        rows.append(parse_record(record))
                        if len(rows) == 1000:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    def _batch(rows):
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)

    schema = "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"
    n = max(1, manifest.count())
    return manifest.select("archive").repartition(n).mapInArrow(run, schema + ", payload binary" * payloads)
