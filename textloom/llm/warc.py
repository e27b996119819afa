"""WARC archives: writing pages, and reading them back with segment reassembly.

Writing: a page is an HTTP response in chunked transfer coding, in a ``response`` record, or a ``revisit`` record whose
``WARC-Refers-To`` is the identifier of the response of smallest page id with an equal payload (of at least ``LEAST_REVISIT`` bytes). Only payloads
that may be repeated are moved for that. A block longer than
``segment_bytes`` is split over a first record and ``continuation`` records. Each record is a gzip member. Archives are
rows (name, content) of about ``archive_bytes``, so that any store Spark can write to holds them.

Reading: records are parsed archive by archive. Those not segmented are decoded on the spot; segments are grouped by
the identifier of their origin record, put in order of their number, checked against the total length that the last
one tells, joined, and freed of the chunked framing. A record's group is its own segments, so a group is one payload.
Declared digests (SHA-256, SHA-1 or MD5, in hex or base 32) are compared with those of the payloads read. A revisit has no payload: its length, digest and page
are those of the response that it refers to, as that was read. Page ids are in a header of their own, ``X-Page-ID``; records of other writers have none.

Defined results: a null html is an empty payload; a null url leaves the target out; repeated rows are records of their
own (of several with the smallest page id, all are responses and one is referred to); a missing or surplus segment, broken framing, a digest that
disagrees, or a revisit whose response is not there or not complete gives complete = false; an empty table
gives no archives and no rows. Archives of other writers and damaged ones are read as far as they go: a record without a declared digest, or with one of another kind,
is judged by its length and framing; a cut record, or one without a length, is a row with complete = false; a stretch that
holds no readable record is one row of type ``damaged``; reading goes on at the next gzip member or record. Only responses, revisits and what is damaged
are told. A revisit of an identifier that several responses carry is a row for each of them. A null archive is an empty one.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shipped
from ._common import marked_by_ids, scratch_table

LEAST_REVISIT = 100
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
ARCHIVE_BYTES = 2 << 20
DATE = "2020-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_RECORD = "page_id long, url string, record_type string, record_id string, refers_id string, payload_bytes long, payload_digest string, complete boolean, declared string"
_PART = "origin string, number long, total long, kind string, page long, declared_part string, target string, block binary"
_GZIP, _DIGESTS = b"\x1f\x8b\x08", ("sha256", "sha1", "md5")


# ---- writing


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One gzip member."""
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + squeeze.flush()


def record_id(page_id: int | None, name: str) -> str:
    return f"<urn:page:{page_id}:{name}>"


def page_records(name: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of a page; name sets rows of equal id apart, refers_to is the identifier of the record that this one revisits."""
    url = None if url is None else "".join(url.split())
    own = record_id(page_id, name)
    base = [("X-Page-ID", page_id), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        more = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", refers_to)]
        yield record([*more, *base], _HTTP)
        return
    block = _HTTP + chunked(payload)
    kind = [("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment_bytes:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), *base, *kind], block)
        return
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Segment-Number", 1), *base, *kind], block[:segment_bytes])
    for k, at in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        total = len(block) if at + segment_bytes >= len(block) else None
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{page_id}:{name}:{k}>"), ("X-Page-ID", page_id), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total), ("WARC-Date", DATE), ("WARC-Target-URI", url)], block[at : at + segment_bytes])


def write_archives(pages: DataFrame, *, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(name, content) rows from (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("row")).withColumn("digest", F.sha2("payload", 256))
    # The row number tells rows of one page id and payload apart, and only those.
    per_page = rows.where(F.length("payload") >= LEAST_REVISIT).groupBy("digest", "page_id").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    same = per_page.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n", "row")).alias("first"), F.sum("n").alias("rows")).where("rows > 1")
    same = scratch_table(same.select("digest", F.col("first.page_id").alias("first"), F.col("first.n").alias("n_first"), F.col("first.row").alias("first_row")), "repeated-payloads")
    marked = marked_by_ids(rows, "digest", same, "digest")
    alone = marked.where("not _map_maybe").select(*rows.columns, *(F.lit(None).cast("long").alias(c) for c in ("first", "n_first", "first_row")))
    rows = alone.unionByName(marked.where("_map_maybe").drop("_map_maybe").join(same, "digest", "left").select(*alone.columns))
    repeated = F.col("n_first").isNotNull()
    rows = rows.withColumn("revisit", repeated & ~F.col("page_id").eqNullSafe(F.col("first")))
    # The response that others refer to has an identifier that they can tell: its page and payload.
    rows = rows.withColumn("named", repeated & ~F.col("revisit") & ((F.col("n_first") == 1) | (F.col("row") == F.col("first_row"))))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        part, held, n, k = 0, [], 0, 0
        head = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{task}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.0\r\n")

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:05d}-{part:05d}.warc.gz"]), pa.array([b"".join([head, *held])], pa.binary())], ["name", "content"])

        for batch in batches:
            for page_id, url, payload, digest, first, revisit, named in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first", "revisit", "named")), strict=True):
                k += 1
                for r in page_records(digest if named else f"{task}-{k}", page_id, url, payload, digest, record_id(first, digest) if revisit else None, segment_bytes):
                    held.append(r)
                    n += len(r)
                if n >= archive_bytes:
                    yield archive()
                    part, held, n = part + 1, [], 0
        if held:
            yield archive()

    return rows.select("page_id", "url", "payload", "digest", "first", "revisit", "named").transform(shipped).mapInArrow(packed, "name string, content binary")


# ---- reading


def members(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive, from its gzip members; an archive that isn't compressed is one piece. What can't be decompressed up to the next
    member that can is one piece as it stands; of a member that breaks off, what comes before."""
    if not content.startswith(_GZIP):
        yield content
        return
    at, lost, view = 0, None, memoryview(content)
    while at < len(content):
        begin, stream, out = at, zlib.decompressobj(31), []
        try:
            while not stream.eof and at < len(content):
                piece = view[at : at + step]
                out.append(stream.decompress(piece))
                at += len(piece) - len(stream.unused_data)
        except zlib.error:
            at = content.find(_GZIP, begin + 1)
            at = len(content) if at < 0 else at
        data = b"".join(out)
        if stream.eof or data.startswith(b"WARC/"):
            if lost is not None:
                yield content[lost:begin]
                lost = None
            yield data
        elif lost is None:
            lost = begin
    if lost is not None:
        yield content[lost:]


def _number(told: str | None) -> int | None:
    return int(told) if told is not None and told.isascii() and told.isdigit() and len(told) < 19 else None


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record; a block is shorter than its Content-Length where the archive ends before it. Without a
    length a block goes up to the next record. A stretch that is no record has no headers."""
    for data in members(content):
        at = 0
        while data[at:].strip() if len(data) - at < 1 << 10 else True:
            start = data.find(b"WARC/", at)
            end = data.find(b"\r\n\r\n", start) if start >= 0 else -1
            if end < 0:
                yield {}, data[at:]
                break
            if data[at:start].strip():
                yield {}, data[at:start]
            lines = data[start:end].decode("utf-8", "replace").split("\r\n")[1:]
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            size = _number(headers.get("content-length"))
            if size is None:
                after = data.find(b"\r\n\r\nWARC/", end + 2)
                size = max(0, (len(data) - 4 * data.endswith(b"\r\n\r\n") if after < 0 else after) - end - 4)
            yield headers, data[end + 4 : end + 4 + size]
            at = end + 4 + size


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        piece = body[end + 2 : end + 2 + size]
        if len(piece) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(piece)
        at = end + 4 + size


def payload_of(block: bytes) -> bytes:
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no HTTP header")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _declared(told: str | None) -> str | None:
    """A declared digest as kind:hex; None if there is none or its kind isn't known."""
    kind, _, value = (told or "").strip().partition(":")
    kind = kind.lower().replace("-", "")
    if kind not in _DIGESTS or not value.isascii():
        return None
    if len(value) != 2 * hashlib.new(kind).digest_size:
        try:
            value = base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
        except (binascii.Error, ValueError):
            pass
    return f"{kind}:{value.lower()}"


def _row(headers: dict[str, str], block: bytes, whole: bool) -> tuple:
    """A row of _RECORD for a record that is not segmented, or that has been joined."""
    page, own, url = headers.get("x-page-id", ""), headers.get("warc-record-id"), headers.get("warc-target-uri")
    page = -_number(page[1:]) if page[:1] == "-" and _number(page[1:]) is not None else _number(page)
    kind, declared = headers.get("warc-type", "damaged").lower(), _declared(headers.get("warc-payload-digest"))
    if kind in ("revisit", "damaged"):
        known = declared.partition(":")[2] if declared and declared.startswith("sha256:") else None
        return page, url, kind, own, headers.get("warc-refers-to"), None, known, whole and kind == "revisit", declared
    try:
        payload = payload_of(block) if headers.get("content-type", "application/http").lower().startswith("application/http") else block
    except ValueError:
        return page, url, kind, own, None, None, None, False, declared
    agrees = declared is None or hashlib.new(declared.partition(":")[0], payload).hexdigest() == declared.partition(":")[2]
    return page, url, kind, own, None, len(payload), hashlib.sha256(payload).hexdigest(), whole and agrees, declared


_NAMES = [x.split()[0] for x in _RECORD.split(", ")]
_TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _columns(rows: list[tuple], schema: str = _RECORD) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], _TYPES[x.split()[1]]) for k, x in enumerate(schema.split(", "))]


def read_archives(archives: DataFrame) -> DataFrame:
    """Page records from (name, content) rows: page_id, url, record_type, refers_to, payload_bytes, payload_digest, complete."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_row, no_part = (None,) * len(_RECORD.split(", ")), (None,) * len(_PART.split(", "))
        names = [f.split()[0] for f in f"{_RECORD}, {_PART}".split(", ")]
        for batch in batches:
            for content in batch.column("content"):
                rows, parts = [], []
                for headers, block in records(content.as_py() or b""):
                    kind = headers.get("warc-type", "damaged").lower()
                    whole = _number(headers.get("content-length")) == len(block)
                    number, origin = _number(headers.get("warc-segment-number")), headers.get("warc-segment-origin-id", headers.get("warc-record-id"))
                    if number is not None and origin is not None:
                        rows.append(no_row)
                        page = _row(headers | {"warc-type": "damaged"}, b"", False)[0]
                        # A segment that is cut off is as good as none.
                        parts.append((origin, number if whole else -number, _number(headers.get("warc-segment-total-length")), kind, page, headers.get("warc-payload-digest"), headers.get("warc-target-uri"), block))
                    elif kind in ("response", "revisit", "continuation", "damaged"):
                        rows.append(_row(headers, block, whole and "warc-segment-number" not in headers and kind != "continuation"))
                        parts.append(no_part)
                yield pa.RecordBatch.from_arrays([*_columns(rows), *_columns(parts, _PART)], names)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for origin, segments in zip(batch.column("origin").to_pylist(), batch.column("segments"), strict=True):
                parts = sorted(segments.as_py(), key=lambda s: abs(s["number"]))
                told = lambda name: next((s[name] for s in parts if s[name] is not None), None)  # noqa: B023, E731
                if any(s["kind"] not in ("response", "continuation") for s in parts):
                    continue
                block = b"".join(s["block"] for s in parts)
                whole = [s["number"] for s in parts] == list(range(1, len(parts) + 1)) and parts[-1]["total"] == len(block)
                headers = {"warc-record-id": origin, "warc-type": "response", "warc-payload-digest": told("declared_part"), "warc-target-uri": told("target"), "x-page-id": None if told("page") is None else str(told("page"))}
                rows.append(_row({k: v for k, v in headers.items() if v is not None}, block, whole))
            yield pa.RecordBatch.from_arrays(_columns(rows), _NAMES)

    found = scratch_table(archives.transform(shipped).mapInArrow(parsed, f"{_RECORD}, {_PART}"), "warc-records")
    segments = found.where("origin is not null").groupBy("origin").agg(F.collect_list(F.struct("number", "total", "kind", "page", "declared_part", "target", "block")).alias("segments"))
    pages = scratch_table(found.where("origin is null").select(*_NAMES).unionByName(segments.transform(shipped).mapInArrow(joined, _RECORD)), "warc-pages")
    response = pages.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("digest"), F.col("complete").alias("whole"), F.col("declared").alias("told"))
    revisits = pages.where("record_type = 'revisit'").join(response, "refers_id", "left")
    agrees = F.col("complete") & F.coalesce("whole", F.lit(False)) & (F.col("declared").isNull() | F.col("declared").eqNullSafe(F.concat(F.lit("sha256:"), "digest")) | F.col("declared").eqNullSafe(F.col("told")))
    revisits = revisits.select("page_id", "url", "record_type", "refers_to", F.col("n").alias("payload_bytes"), F.coalesce("digest", "payload_digest").alias("payload_digest"), agrees.alias("complete"))
    return pages.where("record_type <> 'revisit'").select("page_id", "url", "record_type", F.lit(None).cast("long").alias("refers_to"), "payload_bytes", "payload_digest", "complete").unionByName(revisits)
