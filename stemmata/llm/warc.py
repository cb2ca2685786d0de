"""WARC archives as seekable Zstandard bundles (operator 1).

Each row is a WARC record. Of the records with equal payloads of at least ``min_bytes`` bytes, the one with the
largest page id holds the payload (response) and the others refer to it (revisit). Records are grouped into frames of
about FRAME_BYTES that decompress independently; a bundle ends with a skippable frame that maps record identifiers to
(frame, offset in the frame, length) and with the seek table of the seekable format, so that one record costs a read
of the footer, the index and one frame.

Bundles are written under names of their own for each task attempt and renamed when whole; the index, which Spark
commits, names the bundles that count, so what a lost attempt leaves is never read. Null payloads are empty payloads.
Rows with a null id are responses only if all rows of their payload have none; rows that repeat the response's id and
payload are responses too. An empty table gives no bundles and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialise, scratch_path

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 25
SKIPPABLE, SEEK_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Tasks that read bundles at most, a few bundles each beyond that.
MAX_READERS = 50_000
INDEX = "page_id long, record_id string, bundle string, frame int, frame_offset long, record_bytes long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, payload_digest: str, place: str = "") -> str:
    """Of the page and its payload, so that whatever refers to it can tell it too; ``place`` sets rows apart that repeat
    both."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload_digest}:{place}')}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, place: str = "") -> tuple[str, bytes]:
    """The identifier of one WARC record and the record; a revisit has the response's headers only. It names the
    response's record unless ``place`` is given, since there are then several that it might name."""
    said = digest(payload)
    own = record_id(page_id, said, place)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {own}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{said}", f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    if revisit:
        lines += [] if place else [f"WARC-Refers-To: {record_id(refers_to, said)}"]
        lines += [f"X-Refers-To-Page-Id: {refers_to}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return own, "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: memoryview, at: int) -> tuple[dict[str, str], bytes, int]:
    """The headers and the block of the record at ``at``, and where the next begins."""
    size = 4096
    while (end := (raw := bytes(data[at : at + size])).find(b"\r\n\r\n")) < 0:  # addresses may be long
        if size > len(data):
            raise ValueError("a record without end of headers")
        size *= 4
    lines = raw[:end].decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    start = at + end + 4
    stop = start + int(headers["Content-Length"])
    return headers, bytes(data[start:stop]), stop + 4


def facts(headers: dict[str, str], block: bytes) -> tuple:
    """RECORD from a record that was read; a response's payload is checked against its digest."""
    revisit = headers["WARC-Type"] == "revisit"
    size, said = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit:
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if len(payload) != size or digest(payload) != said:
            raise ValueError(f"a payload doesn't match its digest: {headers['WARC-Record-ID']}")
    page, other = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
    return int(page) if page else None, size, said, headers["WARC-Type"], int(other) if other else None


class Bundle:
    """Collects records into frames and gives the bundle's bytes."""

    def __init__(self) -> None:
        self.frames: list[tuple[bytes, int]] = []
        self.open = bytearray()
        self.index: list[tuple[int | None, str, int, int, int]] = []
        self.size = 0

    def add(self, page_id: int | None, identifier: str, data: bytes) -> None:
        if self.open and len(self.open) + len(data) > FRAME_BYTES:
            self._close()
        self.index.append((page_id, identifier, len(self.frames), len(self.open), len(data)))
        self.open += data
        self.size += len(data)

    def _close(self) -> None:
        if self.open:
            self.frames.append((zstandard.ZstdCompressor(level=3).compress(bytes(self.open)), len(self.open)))
            self.open = bytearray()

    def close(self) -> bytes:
        self._close()
        ids = json.dumps([x for _, *x in self.index]).encode()
        packed = zstandard.ZstdCompressor(level=3).compress(ids)
        index = struct.pack("<II", SKIPPABLE, len(packed)) + packed
        entries = [(len(z), n) for z, n in self.frames] + [(len(index), 0)]
        table = b"".join(struct.pack("<II", *e) for e in entries) + struct.pack("<IBI", len(entries), 0, SEEKABLE)
        return b"".join(z for z, _ in self.frames) + index + struct.pack("<II", SEEK_TABLE, len(table)) + table


def seek_table(read, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame; ``read`` takes a start and a length."""
    n, _, magic = struct.unpack("<IBI", read(size - 9, 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    sizes = struct.iter_unpack("<II", read(size - 9 - 8 * n, 8 * n))
    out, at = [], 0
    for packed, plain in sizes:
        out.append((at, packed, plain))
        at += packed
    return out


def bundle_index(read, size: int) -> dict[str, tuple[int, int, int]]:
    """Record identifiers to (frame, offset in the frame, length)."""
    start, packed, _ = seek_table(read, size)[-1]
    return {k: tuple(x) for k, *x in json.loads(zstandard.ZstdDecompressor().decompress(read(start, packed)[8:]))}


def read_record(uri: str, identifier: str) -> tuple[dict[str, str], bytes]:
    """One record of a bundle, from its own frame alone."""
    store, path = _store(uri)
    with store.open_input_file(path) as f:
        read = lambda at, n: f.read_at(n, at)
        frame, offset, length = bundle_index(read, f.size())[identifier]
        start, packed, _ = seek_table(read, f.size())[frame]
        data = zstandard.ZstdDecompressor().decompress(read(start, packed))
    headers, block, _ = parse(memoryview(data)[offset : offset + length], 0)
    return headers, block


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def _save(uri: str, data: bytes) -> None:
    store, path = _store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(f"{path}.part") as f:
        f.write(data)
    store.move(f"{path}.part", path)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (binary), revisit, refers_to, repeats (whether rows with this payload repeat an id)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256))
    pairs = rows.groupBy("key", "page_id").agg(F.count("*").alias("rows"), F.max(F.octet_length("payload")).alias("n"))
    same = pairs.groupBy("key").agg(F.max("page_id").alias("holder"), F.sum("rows").alias("rows"), F.max("n").alias("n"), (F.max("rows") > 1).alias("repeats"))
    same = materialise(same, "payloads")
    total = same.agg(F.sum("rows")).first()[0] or 0
    joined = lookup(rows, same, "key", "rows", total)
    revisit = (F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return joined.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("holder")).alias("refers_to"), "repeats")


def write_bundles(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the bundles and returns their committed INDEX, one row per record."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = f"{TaskContext.get().taskAttemptId():08d}-{uuid.uuid4().hex[:8]}"
        made, bundle = 0, Bundle()

        def flush() -> pd.DataFrame:
            name = f"{folder}/{attempt}-{made:05d}.warc.zst"
            _save(name, bundle.close())
            out = [(page, own, name, *place) for page, own, *place in bundle.index]
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in INDEX.split(", ")])
            return frame.astype({"page_id": "Int64"})

        for batch in batches:
            ids, others = batch["page_id"].astype("Int64"), batch["refers_to"].astype("Int64")
            for page, url, payload, revisit, other, repeats in zip(ids, batch["url"], batch["payload"], batch["revisit"], others, batch["repeats"], strict=True):
                page, other = (None if x is pd.NA else int(x) for x in (page, other))
                place = f"{attempt}-{made}-{len(bundle.index)}" if repeats else ""
                bundle.add(page, *record(page, url, bytes(payload), other, bool(revisit), place))
                if bundle.size >= BUNDLE_BYTES:
                    yield flush()
                    made, bundle = made + 1, Bundle()
        if bundle.index:
            yield flush()

    return materialise(rows.mapInPandas(write, INDEX), "warc-index")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """``bundle``, addresses: RECORD for every record of theirs, a frame at a time."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["bundle"]:
                store, path = _store(uri)
                with store.open_input_file(path) as f:
                    for start, packed, plain in seek_table(lambda at, n: f.read_at(n, at), f.size())[:-1]:  # noqa: B023
                        data, at, out = memoryview(zstandard.ZstdDecompressor().decompress(f.read_at(packed, start), max_output_size=plain)), 0, []
                        while at < plain:
                            headers, block, at = parse(data, at)
                            out.append(facts(headers, block))
                        frame = pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")])
                        yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    # The list of addresses is short, and would otherwise be one task; a number that is asked for isn't coalesced.
    readers = min(MAX_READERS, max(1, bundles.count()))
    return bundles.repartitionByRange(readers, "bundle").mapInPandas(read, RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives ``pages`` in the shared folder and reads the archives back: RECORD, one row per row of ``pages``."""
    index = write_bundles(with_revisits(pages, min_bytes), scratch_path(pages.sparkSession, "warc"))
    return read_bundles(index.select("bundle").distinct())


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS holder FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + ((('0x' || substr(h, ((k // 4) * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (k % 4))::BIGINT) & 31))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM w
"""
