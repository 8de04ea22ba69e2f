"""WARC archives with segmented records (operator 8).

Pages are written as HTTP responses with chunked transfer framing, equal payloads as revisits of one
response, and blocks over SEGMENT bytes as a first record and continuations. Reading parses the
archives file by file, groups continuations by their origin, orders them by segment number, checks
numbers and total length, and decodes the chunks.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.base import stage, staging_dir
from barloom.llm.filter_audit import possible_repeat

SEGMENT = 16 * 1024  # bytes of a record's block; longer blocks are continued
CHUNK = 4 * 1024  # bytes of a transfer chunk
FILE_RECORDS = 1000  # records of an archive file, so a file stays under 16 MB unpacked
CRLF = b"\r\n"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = "record_id string, warc_type string, url string, refers_to string, digest string, origin string, segment int, total long, block binary, payload_bytes long, complete boolean, payload binary"


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def framed(payload: bytes) -> bytes:
    parts = []
    for at in range(0, len(payload), CHUNK):
        piece = payload[at:at + CHUNK]
        parts += [b"%x" % len(piece), CRLF, piece, CRLF]
    return b"".join(parts) + b"0\r\n\r\n"


def unframed(body: bytes) -> bytes:
    """Payload of chunked transfer framing; raises ValueError where the framing is broken."""
    parts, at = [], 0
    while True:
        line = body.index(CRLF, at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            if body[at:] != CRLF:  # no trailers are written
                raise ValueError("bytes after the last chunk")
            return b"".join(parts)
        if body[at + size:at + size + 2] != CRLF:
            raise ValueError("chunk without end")
        parts.append(body[at:at + size])
        at += size + 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without its closing empty lines, which the writer puts between records."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block


def page_records(urn: str, url: str, payload: bytes, refers: str | None, segment: int = SEGMENT) -> Iterator[bytes]:
    digest = ("WARC-Payload-Digest", f"sha1:{sha1_32(payload)}")
    base = [("WARC-Record-ID", f"<{urn}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", "".join(url.split())), digest]
    if refers:
        yield record([("WARC-Type", "revisit"), *base, ("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{refers}>"), ("Content-Type", "application/http;msgtype=response")], HEAD)
        return
    block = HEAD + framed(payload)
    kind = ("Content-Type", "application/http;msgtype=response")
    if len(block) <= segment:
        yield record([("WARC-Type", "response"), *base, kind], block)
        return
    last = (len(block) - 1) // segment
    for k in range(last + 1):
        part = block[k * segment:(k + 1) * segment]
        number = ("WARC-Segment-Number", str(k + 1))
        if not k:
            yield record([("WARC-Type", "response"), *base, number, kind], part)
        else:
            end = [("WARC-Segment-Total-Length", str(len(block)))] if k == last else []
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{urn}:{k + 1}>"), base[1], ("WARC-Segment-Origin-ID", f"<{urn}>"), number, *end], part)


def records_of(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive that arrives piece by piece."""
    held = bytearray()
    more = True
    while True:
        while held[:2] == CRLF:
            del held[:2]
        cut = held.find(b"\r\n\r\n")
        size = None
        if cut >= 0:
            lines = bytes(held[:cut]).decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no record where one should begin: {lines[0][:40]!r}")
            fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(fields["content-length"])
        if size is None or len(held) < cut + 4 + size:
            if not more:
                if bytes(held).strip():
                    raise ValueError("archive ends inside a record")
                return
            piece = next(pieces, None)
            if piece is None:
                more = False
            else:
                held += piece
            continue
        yield fields, bytes(held[cut + 4:cut + 4 + size])
        del held[:cut + 4 + size]


def unpacked(raw: bytes) -> Iterator[bytes]:
    """Pieces of a gzip file with any number of members, or of a plain one."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    while raw:
        pack = zlib.decompressobj(31)
        out = pack.decompress(raw, 1 << 20)
        while out:
            yield out
            out = pack.decompress(pack.unconsumed_tail, 1 << 20)
        raw = pack.unused_data


def _built(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urns, refers, urls = b.column("wa_urn").to_pylist(), b.column("wa_refers").to_pylist(), b.column("url").to_pylist()
            held, size = [], 0
            for k, html in enumerate(b.column("html")):
                for r in page_records(urns[k], urls[k], html.as_buffer().to_pybytes(), refers[k], segment):
                    held.append(r)
                    size += len(r)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])

    return run


def payload_of(kind: str, block: bytes, digest: str | None) -> tuple[bool, bytes | None]:
    """Whether a whole block is sound, and the payload of a response."""
    if kind != "response":
        return True, None
    try:
        payload = unframed(block[block.index(b"\r\n\r\n") + 4:])
    except ValueError:
        return False, None
    return (True, payload) if sha1_32(payload) == digest else (False, None)


def _parsed(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bare = lambda v: v.strip("<>") if v else None
        for b in batches:
            for raw in b.column("content"):
                rows, size = [], 0

                def batch(rows):
                    kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.binary()]
                    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [x.split()[0] for x in PARSED.split(", ")])

                for f, block in records_of(unpacked(raw.as_buffer().to_pybytes())):
                    number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                    digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    ok = size_of = payload = None
                    if not number:  # a whole record is decoded here, only segments travel on
                        ok, payload = payload_of(f["warc-type"], block, digest)
                        size_of = None if payload is None else len(payload)
                    rows.append((bare(f["warc-record-id"]), f["warc-type"], f.get("warc-target-uri"), bare(f.get("warc-refers-to")), digest, bare(f.get("warc-segment-origin-id")), int(number) if number else None, int(total) if total else None, block if number else None, size_of, ok, payload if payloads else None))
                    size += len(block)
                    if size > 1 << 22:
                        yield batch(rows)
                        rows, size = [], 0
                yield batch(rows)

    return run


def _decoded(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, sizes, digests, whole, kept = b.column("total").to_pylist(), [], [], [], []
            kinds, said = b.column("warc_type").to_pylist(), b.column("digest").to_pylist()
            for k, (parts, numbers) in enumerate(zip(b.column("blocks"), b.column("numbers").to_pylist(), strict=True)):
                block = b"".join(p.as_buffer().to_pybytes() for p in parts.values)
                ok = numbers == list(range(1, len(numbers) + 1)) and total[k] == len(block)
                ok, payload = payload_of(kinds[k], block, said[k]) if ok else (False, None)
                whole.append(ok)
                sizes.append(len(payload) if ok and payload is not None else None)
                digests.append(said[k])
                kept.append(payload if payloads and ok else None)
            yield pa.RecordBatch.from_arrays([b.column("record_id"), b.column("warc_type"), b.column("url"), b.column("refers_to"), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(whole), pa.array(kept, pa.binary())],
                                             ["record_id", "warc_type", "url", "refers_to", "digest", "payload_bytes", "complete", "payload"])

    return run


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, least: int = 0) -> None:
    """Write a record per row of pages (page_id, url, html) as gzip-packed WARC files under `path`.

    Of equal payloads of at least `least` bytes the largest page_id (of repeated rows one, of rows
    without page_id only if there are no others) is the response and the rest are revisits. Null html
    is an empty payload, null url an empty target. Record ids hold page_id and a row number, or the
    payload's hash where a counting Bloom sketch of all hashes shows that no other page has it: such
    pages, most of a crawl, are neither shuffled nor written before their archive.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("hash", F.xxhash64("html"))
    maybe = possible_repeat(stage(rows.select("hash"), "op8-hashes"))
    urn = lambda page, row: F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), row)
    # a payload that is unique for certain goes straight from the scan into an archive
    single = rows.where(~maybe).select("url", "html", urn(F.col("page_id"), F.concat(F.lit("h"), F.hex("hash"))).alias("wa_urn"), F.lit(None).cast("string").alias("wa_refers"))
    rows = stage(rows.where(maybe).drop("hash").withColumns({"wa_print": F.unhex(F.sha2("html", 256)), "wa_row": F.monotonically_increasing_id(), "wa_bytes": F.octet_length("html").cast("long")}), "op8-pages")
    place = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "wa_row")
    first = rows.where(F.col("wa_bytes") >= least).groupBy("wa_print").agg(F.max(place).alias("top"), F.count("*").alias("n")).where("n > 1")
    own = urn(F.col("page_id"), F.col("wa_row").cast("string"))
    sent = rows.join(first.select("wa_print", F.col("top.wa_row").alias("top_row"), urn(F.col("top.page_id"), F.col("top.wa_row").cast("string")).alias("top_urn")), "wa_print", "left").select(
        "url", "html", own.alias("wa_urn"), F.when((F.col("top_row") != F.col("wa_row")) & (F.col("wa_bytes") >= least), F.col("top_urn")).alias("wa_refers"))
    single.unionByName(sent).mapInArrow(_built(segment), "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives under `path`, continuations put together: record_id, warc_type, url,
    refers_to, digest, payload_bytes, complete, payload (null without `payloads`).

    complete is false where a segment is missing, the total length differs, the framing is broken or
    the payload does not have its digest; such a record has no payload.
    """
    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parsed(payloads), PARSED)
    rows = stage(rows, "op8-records")
    single = rows.where("segment IS NULL").select("record_id", "warc_type", "url", "refers_to", "digest", "payload_bytes", "complete", "payload")
    parts = rows.where("segment IS NOT NULL").withColumn("record_id", F.coalesce("origin", "record_id")).groupBy("record_id").agg(
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("warc_type", "url", "refers_to", "digest")], F.coalesce(F.max("total"), F.lit(-1)).alias("total"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("list"))
    parts = parts.select("record_id", "warc_type", "url", "refers_to", "digest", F.col("total").cast("long"), F.col("list.block").alias("blocks"), F.col("list.segment").alias("numbers"))
    return single.unionByName(parts.mapInArrow(_decoded(payloads), "record_id string, warc_type string, url string, refers_to string, digest string, payload_bytes long, complete boolean, payload binary"))


def round_trip(pages: DataFrame, segment: int = SEGMENT, least: int = 0) -> DataFrame:
    """Pages written as archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, complete."""
    path = f"{staging_dir(pages.sparkSession).rstrip('/')}/op8-archives-{uuid.uuid4().hex}"
    write_archives(pages, path, segment, least)
    back = stage(read_archives(pages.sparkSession, path, payloads=False).drop("payload"), "op8-back")
    page = lambda c: F.split(c, ":")[2].try_cast("long")
    full = back.where("warc_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"), F.col("digest").alias("full_digest"), F.col("complete").alias("full_complete"))
    return back.join(full, "refers_to", "left").select(
        page(F.col("record_id")).alias("page_id"), F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("warc_type").alias("record_type"),
        page(F.col("refers_to")).alias("refers_to"), (F.col("complete") & F.coalesce((F.col("digest") == F.col("full_digest")) & F.col("full_complete"), F.col("warc_type") == "response")).alias("complete"))
