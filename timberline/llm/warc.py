"""WARC archives in Zstandard: writer with deduplication, and a validating reader.

An archive starts with a skippable frame that holds a dictionary (trained on the
archive's own first records; raw content if they are too few), then has one frame
a record. The reader loads the dictionary, finds each frame's end from its block headers, decodes
frame by frame and checks each record: version line, mandatory fields, Content-Length against the
block, the closing line ends, the HTTP Content-Length and the payload digest. A frame that is damaged
costs its own record; reading goes on at the next frame.

Records of any type and id are read: ``record_id`` and ``refers_to_id`` are as written, and ``page_id`` and
``refers_to`` are set for the ids that this writer gives. The payload is the HTTP body of responses (chunks
joined) and requests, and the block of all other types; a digest is checked if it is MD5, SHA-1, SHA-256 or SHA-512,
of the payload with or without its chunk marks. ``payload_digest`` is the SHA-1 of the full payload: of a revisit
the one that the record tells, else null.

Records with equal payloads of at least ``min_revisit`` bytes: the one with the
largest id is a response, the others are revisits that refer to it. Only the
digests of repeated payloads are gathered; payloads are not shuffled.

Archives are rows (name, content) so that Spark's own writers put them in any store;
``read_archives`` takes such rows, or files by ``spark.read.format("binaryFile")``.

Defined results: a null payload is empty; a null URL is written as ``urn:page:`` and
its id; null ids stay null; rows that repeat the largest id are all responses; an
empty table gives no archive; a record that fails a check is a row with ``error`` and, where it can be read,
``record_id`` set and the rest null; bytes behind the last frame are such a row too. Ids of pages are cast to 64-bit numbers.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.cluster import BROADCAST_BYTES, broadcast_if, lean, materialize

# fixed values of the formats
_SKIPPABLE = 0x184D2A5D
_ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
_DICT_MAGIC = b"\x37\xa4\x30\xec"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
_PAGE = re.compile(r"<urn:page:(-?\d+|none)>")

#: For writing archives as Parquet: row groups of a few archives, so that neither writer nor reader holds many at once.
FILE_OPTIONS = {"parquet.block.size": str(8 << 20), "compression": "none"}
ARCHIVE = "name string, content binary"
RECORD = "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint, error string, record_id string, refers_to_id string"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, length: int, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit's block is the HTTP head alone."""
    name = "none" if page_id is None else page_id
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{name}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{'none' if refers_to is None else refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], *, dict_bytes: int = 16 << 10, samples: int = 100, level: int = 3) -> bytes:
    """The archive of some records: skippable frame with the dictionary, then a frame each."""
    import zstandard

    parts = [r[: 32 << 10] for r in records[:samples]]
    try:
        content = zstandard.train_dictionary(dict_bytes, parts).as_bytes()
    except zstandard.ZstdError:
        content = b"".join(parts)[:dict_bytes]
    kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == _DICT_MAGIC else zstandard.DICT_TYPE_RAWCONTENT
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind), write_checksum=True)
    stored = zstandard.compress(content)
    return b"".join([struct.pack("<II", _SKIPPABLE, len(stored)), stored, *map(packer.compress, records)])


def frame_end(view: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, from its block headers; raises ValueError if they make no sense."""
    if len(view) < at + 8:
        raise ValueError("a frame is cut off")
    if 0x184D2A50 <= struct.unpack_from("<I", view, at)[0] <= 0x184D2A5F:
        end = at + 8 + struct.unpack_from("<I", view, at + 4)[0]
    else:
        if bytes(view[at : at + 4]) != _ZSTD_MAGIC:
            raise ValueError("no frame begins here")
        told = view[at + 4]
        single, size = told >> 5 & 1, told >> 6
        end = at + 5 + (not single) + (0, 1, 2, 4)[told & 3] + ((1 if single else 0), 2, 4, 8)[size]
        last = False
        while not last:
            if len(view) < end + 3:
                raise ValueError("a frame is cut off")
            block = int.from_bytes(view[end : end + 3], "little")
            last, kind = block & 1, block >> 1 & 3
            if kind == 3:
                raise ValueError("a block of no known type")
            end += 3 + (1 if kind == 1 else block >> 3)
        end += 4 * (told >> 2 & 1)
    if end > len(view):
        raise ValueError("a frame is cut off")
    return end


def _next_frame(content: bytes, at: int) -> int:
    """The next place from ``at`` on where a whole frame begins, or the end."""
    view = memoryview(content)
    while True:
        at = content.find(_ZSTD_MAGIC, at)
        if at < 0:
            return len(content)
        try:
            frame_end(view, at)
            return at
        except ValueError:
            at += 1


def frames(content: bytes) -> Iterator[bytes | Exception]:
    """The decoded frames of an archive, one at a time; for one that cannot be decoded the error."""
    import zstandard

    view, at, held = memoryview(content), 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == _SKIPPABLE:
        try:
            end = frame_end(view, 0)
            raw = bytes(view[8:end])
            raw = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == _ZSTD_MAGIC else raw
            held, at = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if raw[:4] == _DICT_MAGIC else zstandard.DICT_TYPE_RAWCONTENT), end
        except (ValueError, zstandard.ZstdError) as e:
            yield ValueError(f"the dictionary frame is damaged: {e}")
            at = _next_frame(content, 8)
    unpacker = zstandard.ZstdDecompressor(dict_data=held) if held else zstandard.ZstdDecompressor()
    while at < len(view):
        try:
            end = frame_end(view, at)
            if bytes(view[at : at + 4]) == _ZSTD_MAGIC:
                one = unpacker.decompressobj()
                out = one.decompress(view[at:end])
                if not one.eof:
                    raise ValueError("a frame is cut off")
                yield out
            at = end
        except (ValueError, zstandard.ZstdError) as e:
            # damage can move a frame's end, so the next one is looked for within it
            yield e
            at = _next_frame(content, at + 1)


def unchunk(body: bytes) -> bytes:
    """An HTTP body in chunks as one; raises ValueError for what is not one."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _digest_hex(told: str, size: int) -> str | None:
    """A digest in hex, from hex or base 32; None if it is neither."""
    if len(told) == 2 * size:
        return told.lower()
    try:
        raw = base64.b32decode(told.upper() + "=" * (-len(told) % 8))
    except ValueError:
        return None
    return raw.hex() if len(raw) == size else None


def _check(told: str, bodies: list[bytes]) -> None:
    """Raises ValueError unless one of the bodies has the digest; an unknown algorithm says nothing."""
    algorithm, _, value = told.partition(":")
    make = {"md5": hashlib.md5, "sha1": hashlib.sha1, "sha-1": hashlib.sha1, "sha256": hashlib.sha256, "sha-256": hashlib.sha256, "sha512": hashlib.sha512, "sha-512": hashlib.sha512}.get(algorithm.strip().lower())
    if make is None:
        return
    want = _digest_hex(value.strip(), make().digest_size)
    if want is None or all(make(b).hexdigest() != want for b in bodies):
        raise ValueError("the payload does not have its digest")


def fields_of(raw: bytes) -> tuple[dict, bytes]:
    """The header fields of a record by lower-case name, and what follows on them."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line or no end of the header")
    fields, name = {}, None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"not a header line: {line[:80]}")
        name = name.strip().lower()
        fields[name] = value.strip()
    return fields, rest


def parse(raw: bytes) -> dict:
    """Fields of one record; raises ValueError, with the record's id as second argument if it is known, for what is not valid."""
    fields, rest = fields_of(raw)
    try:
        return _record_of(fields, rest)
    except (ValueError, KeyError, IndexError) as e:
        raise ValueError(str(e), fields.get("warc-record-id")) from e


def _record_of(fields: dict, rest: bytes) -> dict:
    for name in _MANDATORY:
        if name.lower() not in fields:
            raise ValueError(f"{name} is missing")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {length}, the block and its end have {len(rest)} bytes")
    kind, block = fields["warc-type"].lower(), rest[:length]
    told, cut = None, "warc-truncated" in fields
    payload = plain = block
    if "application/http" in fields.get("content-type", "").lower() or (kind == "revisit" and block):
        http, gap, plain = block.partition(b"\r\n\r\n")
        if not gap and not cut:
            raise ValueError("no end of the HTTP head")
        length_line = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
        told = int(length_line[1]) if length_line else None
        chunked = re.search(rb"(?i)\r\ntransfer-encoding:[^\r]*\bchunked\b", http) is not None
        payload = unchunk(plain) if chunked and not cut and kind != "revisit" else plain
        if told is not None and not chunked and not cut and kind == "response" and len(plain) != told:
            raise ValueError(f"HTTP Content-Length is {told}, the payload has {len(plain)} bytes")
    digest, refers = fields.get("warc-payload-digest"), fields.get("warc-refers-to")
    if kind == "revisit":
        algorithm, _, value = (digest or "").partition(":")
        sha1 = _digest_hex(value.strip(), 20) if algorithm.strip().lower() in ("sha1", "sha-1") else None
        if fields.get("warc-profile", "").endswith("/identical-payload-digest") and (payload or digest is None):
            raise ValueError("not a revisit of an identical payload")
        size = told
    else:
        if digest and not cut:
            _check(digest, [payload, plain] if kind in ("response", "request") else [payload, block])
        sha1, size = hashlib.sha1(payload).hexdigest(), len(payload)

    def page(name: str | None) -> int | None:
        found = _PAGE.fullmatch(name or "")
        return None if not found or found[1] == "none" else int(found[1])

    url = fields.get("warc-target-uri")
    url = url[1:-1] if url and url[0] == "<" and url[-1] == ">" else url
    return {
        "page_id": page(fields["warc-record-id"]), "url": None if url is None or url.startswith("urn:page:") else url, "record_type": kind, "payload": payload, "payload_bytes": size,
        "payload_digest": sha1, "refers_to": page(refers), "error": None, "record_id": fields["warc-record-id"], "refers_to_id": refers,
    }


def plan(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = 1000) -> DataFrame:
    """page_id, url, body, sha1, revisit and refers_to of each row to write."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    base = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), body.alias("body")).withColumn("sha1", F.unhex(F.sha1("body")))
    large = F.octet_length("body") >= min_revisit
    repeated = base.filter(large).groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1").select("sha1", "refers_to", F.lit(True).alias("repeated"))
    joined = base.join(broadcast_if(materialize(repeated, "warc-repeated"), BROADCAST_BYTES), "sha1", "left")
    revisit = F.coalesce(F.col("repeated"), F.lit(False)) & large & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return joined.select("page_id", "url", "body", "sha1", revisit.alias("revisit"), F.when(revisit, F.col("refers_to")).alias("refers_to"))


def write_archives(planned: DataFrame, *, archive_bytes: int = 8 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives (name, content) of about ``archive_bytes`` before compression."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{made:06d}.warc.zst"]), pa.array([archive(held)], pa.binary())], names=["name", "content"])

        for batch in batches:
            page, url, body, sha1, revisit, refers = batch.columns
            for i in range(batch.num_rows):
                data = body[i].as_py()
                again = revisit[i].as_py()
                held.append(record(page[i].as_py(), url[i].as_py(), b"" if again else data, sha1[i].as_py(), len(data), refers[i].as_py(), again, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    made, held, size = made + 1, [], 0
        if held:
            yield close()

    return planned.select("page_id", "url", "body", "sha1", "revisit", "refers_to").mapInArrow(lean(write), ARCHIVE)


def read_archives(archives: DataFrame, *, content: str = "content", payloads: bool = True) -> DataFrame:
    """The records of archives; ``payloads`` False leaves the payload null after checking it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"page_id": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
        names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to", "error", "record_id", "refers_to_id"]

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], types.get(n, pa.string())) for n in names], names=names)

        for got in batches:
            for value in got.column(0):
                rows, size = [], 0
                for raw in frames(value.as_py() or b""):
                    try:
                        if isinstance(raw, Exception):
                            raise raw
                        rows.append(parse(raw))
                    except Exception as e:  # noqa: BLE001  whatever is wrong with a record is its result
                        rows.append({"error": f"{type(e).__name__}: {e.args[0] if e.args else e}"[:300], "record_id": e.args[1] if len(e.args) > 1 else None})
                    size += len(rows[-1].get("payload") or b"")
                    if not payloads:
                        rows[-1].pop("payload", None)
                    if len(rows) >= 1000 or size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return archives.select(content).mapInArrow(lean(read), RECORD)
