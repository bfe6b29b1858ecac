"""WARC archives in Zstandard: one frame a record, the dictionary in a leading skippable frame.

Writing: Spark decides which record of each payload is the response and which revisit it, then each partition
writes its archives, rolled at a size, to the shared folder; the list of finished archives is a written table, so
that files of lost or repeated tasks are never read. Reading: each archive of that list is read by one task, frame
by frame, and every header and length is validated. Archives of others are read too: records that are no response or
revisit of an HTTP exchange are validated and passed over, and a payload digest that is not given is computed.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, new_path, slices

#: Fixed values of the formats.
VERSION, VERSIONS = b"WARC/1.1", (b"WARC/1.0", b"WARC/1.1")
DATE = b"2024-01-01T00:00:00Z"
SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
IDENTICAL = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The dictionary is trained on so many pages at most, and so many bytes of each.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 20_000, 32_768
#: An archive is closed once it holds so many bytes.
ARCHIVE_BYTES = 32 << 20


class BadArchive(ValueError):
    """An archive that breaks the format, with the place."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few samples, their bytes as they are."""
    samples = [x[:SAMPLE_BYTES] for x in samples if x]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def head(dictionary: bytes) -> bytes:
    """The skippable frame that an archive begins with."""
    packed = zstandard.ZstdCompressor().compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def record_id(page_id: int | None, url: str | None, payload_digest: str) -> bytes:
    return b"<urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {payload_digest}")).encode()


def _uri(url: str) -> bytes:
    return url.encode("utf-8", "surrogatepass").replace(b"\r", b"%0D").replace(b"\n", b"%0A")


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: tuple[int | None, str | None] | None = None) -> bytes:
    """One record. A revisit (of the page with refers_to's id and url) has the HTTP header only, with the length of the payload that it leaves out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    lines = [VERSION, b"WARC-Type: " + (b"revisit" if refers_to else b"response"), b"WARC-Record-ID: " + record_id(page_id, url, payload_digest), b"WARC-Date: " + DATE]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + _uri(url))
    if page_id is not None:
        lines.append(b"WARC-X-Page-ID: %d" % page_id)
    if refers_to:
        lines += [b"WARC-Profile: " + IDENTICAL, b"WARC-Refers-To: " + record_id(*refers_to, payload_digest), b"WARC-Refers-To-Date: " + DATE]
        if refers_to[1] is not None:
            lines.append(b"WARC-Refers-To-Target-URI: " + _uri(refers_to[1]))
        if refers_to[0] is not None:
            lines.append(b"WARC-X-Refers-To-Page-ID: %d" % refers_to[0])
    lines += [b"WARC-Payload-Digest: sha1:" + payload_digest.encode(), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _exactly(source: BinaryIO, n: int) -> bytes:
    """So many bytes, or fewer at the end."""
    parts, left = [], n
    while left and (x := source.read(left)):
        parts.append(x)
        left -= len(x)
    return b"".join(parts)


def parse_head(source: BinaryIO) -> tuple[bytes, int]:
    """Dictionary of the leading skippable frame, packed or not, and where the records begin."""
    top = _exactly(source, 8)
    if len(top) < 8 or struct.unpack("<I", top[:4])[0] != SKIPPABLE:
        raise BadArchive("no dictionary frame at 0")
    size = struct.unpack("<I", top[4:])[0]
    body = _exactly(source, size)
    if len(body) < size:
        raise BadArchive("the dictionary frame is cut off")
    if body[:4] == FRAME:
        try:
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)  # its size need not be in the frame
        except zstandard.ZstdError as e:
            raise BadArchive(f"the dictionary can't be decoded: {e}") from e
    return body, 8 + size


def frames(source: BinaryIO, piece: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """Each frame's place and content, read piece by piece: only the frame at hand is held."""
    dictionary, at = parse_head(source)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    rest = source.read(piece)
    while rest:
        while len(rest) < 4 and (more := source.read(piece)):
            rest += more
        if rest[:4] != FRAME:
            raise BadArchive(f"no frame at {at}")
        begin, parts, one = at, [], reader.decompressobj()
        while not one.eof:
            if not rest:
                raise BadArchive(f"the frame at {begin} is cut off")
            try:
                parts.append(one.decompress(rest))
            except zstandard.ZstdError as e:
                raise BadArchive(f"the frame at {begin} can't be decoded: {e}") from e
            at += len(rest) - len(one.unused_data)
            rest = one.unused_data or source.read(piece)
        yield begin, b"".join(parts)


def parse_record(raw: bytes, at: int = 0) -> dict | None:
    """Headers and payload of a record, validated: version, needed headers, lengths, end, and the digest of a stored payload.

    None for records that are no response or revisit of HTTP (warcinfo, request, metadata and the like).
    """
    top, gap, rest = raw.partition(b"\r\n\r\n")
    first, *lines = top.split(b"\r\n")
    if not gap or first not in VERSIONS:
        raise BadArchive(f"no record at {at}")
    headers: dict[bytes, bytes] = {}
    last = b""
    for line in lines:
        name, colon, value = line.partition(b":")
        if line[:1] in (b" ", b"\t") and headers:  # a folded line goes on with the one before
            headers[last] += b" " + line.strip()
            continue
        if not colon:
            raise BadArchive(f"bad header at {at}: {line[:40]!r}")
        last = name.strip().lower()
        headers[last] = value.strip()
    for name in (b"warc-type", b"warc-record-id", b"warc-date", b"content-length"):
        if name not in headers:
            raise BadArchive(f"no {name.decode()} at {at}")
    size = _number(headers[b"content-length"], at)
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise BadArchive(f"the block at {at} has another length than {size}")
    kind = headers[b"warc-type"].decode("latin-1")
    if kind not in ("response", "revisit") or not headers.get(b"content-type", b"application/http").startswith(b"application/http"):
        return None
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    if not gap and kind == "response":
        raise BadArchive(f"no HTTP response at {at}")
    said = next((_number(x.partition(b":")[2], at) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), None)
    encoded = any(x.lower().startswith((b"transfer-encoding:", b"content-encoding:")) for x in http.split(b"\r\n")[1:])
    own, algorithm = headers.get(b"warc-payload-digest", b"").decode("latin-1"), "sha1:"
    if kind == "response":
        if said is not None and said != len(payload) and not encoded:
            raise BadArchive(f"the payload at {at} has another length than {said}")
        if own.startswith(algorithm) and not encoded and digest(payload) != own.removeprefix(algorithm).upper():
            raise BadArchive(f"the payload at {at} isn't what its digest says")
    elif payload:
        raise BadArchive(f"the revisit at {at} has a payload")
    number = lambda name: _number(headers[name], at) if name in headers else None
    return {
        "page_id": number(b"warc-x-page-id"),
        "url": headers[b"warc-target-uri"].decode("utf-8", "replace").strip("<>") if b"warc-target-uri" in headers else None,
        "payload_bytes": len(payload) if kind == "response" else said,
        "payload_digest": own.removeprefix(algorithm) or (digest(payload) if kind == "response" else None),
        "record_type": kind,
        "refers_to": number(b"warc-x-refers-to-page-id"),
        "payload": payload if kind == "response" else None,
    }


def _number(value: bytes, at: int) -> int:
    try:
        return int(value)
    except ValueError as e:
        raise BadArchive(f"no number at {at}: {value[:40]!r}") from e


def write_archives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row; returns the finished archives: path, records, bytes.

    Of the rows with one payload of min_bytes or more, that with the smallest id is the response (all of them, if rows
    repeat that id) and the others revisit it; null ids come last, and if all are null, all are responses. Smaller
    payloads are always responses. A null html is an empty payload, a null url has no header. An empty table gives no
    archive. Other columns are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    keyed = rows.withColumns({"sha": F.unhex(F.sha1(F.col("html").cast("binary"))), "size": F.octet_length("html")})
    own = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = keyed.groupBy("sha").agg(F.min(own).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = F.col("first").isNotNull() & (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    decided = keyed.join(first, "sha", "left").select("page_id", "url", "html", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"), again.alias("revisit"))
    # the sample is chosen by a hash: first its bound, from numbers alone, then its rows
    mark = F.xxhash64("page_id", "html")
    marks = [r[0] for r in rows.where("html != ''").select(mark.alias("h")).orderBy("h").limit(SAMPLE_ROWS).collect()]
    samples = [r[0] for r in rows.where("html != ''").where(mark <= F.lit(marks[-1] if marks else 0)).select(F.substring("html", 1, SAMPLE_BYTES)).limit(SAMPLE_ROWS).collect()]
    dictionary = train_dictionary([x.encode("utf-8", "surrogatepass") for x in samples])
    folder = new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        out = path = None
        done: list[tuple[str, int, int]] = []
        count = size = 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, count, size))
                out = None

        for batch in slices(batches):
            for page_id, url, html, first_id, first_url, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.zst"  # a repeated task writes other files
                    out, count, size = open_output(path), 0, out_head(dictionary)
                    out.write(head(dictionary))
                payload = html.encode("utf-8", "surrogatepass")
                frame = packer.compress(record(page_id, url, payload, digest(payload), (first_id, first_url) if revisit else None))
                out.write(frame)
                count, size = count + 1, size + len(frame)
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), x, strict=True)) for x in done], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return durable(decided.mapInArrow(run, "path string, records long, bytes long"), "archives")


def out_head(dictionary: bytes) -> int:
    return len(head(dictionary))


def open_output(path: str):
    store, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    store.create_dir(name.rpartition("/")[0], recursive=True)
    return store.open_output_stream(name, compression=None)  # by default, .zst would be packed once more


def open_input(path: str):
    store, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return store.open_input_stream(name, compression=None)  # by default, .zst would be decoded here


FIELDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(archives: DataFrame, *, payloads: bool = True) -> DataFrame:
    """A row for each HTTP response or revisit of the listed archives (path, records).

    Raises BadArchive where a file breaks the format or has another number of records; a null number is not checked. Of
    archives of others, page_id and refers_to are null. Archives are read piece by piece, so memory follows the longest record.
    """
    fields = FIELDS if payloads else FIELDS.remove(len(FIELDS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, held, seen = [], 0, 0
                with open_input(path) as source:
                    for at, raw in frames(source):
                        row = parse_record(raw, at)
                        seen += 1
                        if row is None:
                            continue
                        held += len(row["payload"] or b"") if payloads else 0
                        found.append(row)
                        if held > 8 << 20 or len(found) >= 5_000:
                            yield pa.RecordBatch.from_pylist(found, fields)
                            found, held = [], 0
                if records is not None and seen != records:
                    raise BadArchive(f"{path} has {seen} records, not {records}")
                if found:
                    yield pa.RecordBatch.from_pylist(found, fields)

    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return archives.select("path", "records").repartition(archives.sparkSession.sparkContext.defaultParallelism * 4, "path").mapInArrow(run, kind)
