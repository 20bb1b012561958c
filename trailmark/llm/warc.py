"""WARC archives: writing of segmented records, and reading with segment reassembly.

Writing: a capture is a ``response`` record whose block is an HTTP message with a chunked body, or a
``revisit`` record that names an earlier record of equal payload and has HTTP headers only. Blocks beyond
``segment_bytes`` are cut: the first piece stays with the record as segment 1, the others become
``continuation`` records that name its id as origin; the last one gives the total length. Records are
written by the text sink with CRLF CRLF as line end, which is how WARC records end, so Spark's own commit
protocol makes the files; each file has at most ``records_per_file`` records of bounded size.

Reading: archive files are parsed by their Content-Length, segments are grouped by origin id and ordered by
number, the total length and the payload digest are verified, and chunked framing is decoded.

Defined results: a null payload is empty; a null id gives a record that nothing refers to; of equal
payloads of ``least_bytes`` or more the rows of the smallest id are responses, all others revisits, whatever
other payloads rows of their ids have; missing, contradicting or broken pieces give a row with a null payload
and the reason in ``status``, and so does an archive file that cannot be unpacked to its end; an empty table
gives none.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
#: Names of our own among the headers.
PAGE_HEADER, OK = "X-Page-Id", "ok"
#: Stands for the type of what is left of an archive file that cannot be unpacked.
UNREADABLE = "unreadable"
HEX_SIZE, WHOLE = re.compile(rb"[0-9A-Fa-f]{1,15}"), re.compile(r"-?[0-9]{1,18}")
PACKED_BYTES = 1 << 20


@dataclass(frozen=True)
class ArchiveRules:
    segment_bytes: int = 16384
    chunk_bytes: int = 4096
    records_per_file: int = 1024
    least_bytes: int = 100
    date: str = "2024-01-01T00:00:00Z"


def chunked(body: bytes, size: int) -> bytes:
    """HTTP chunked framing of a body."""
    parts = [b"%x\r\n%b\r\n" % (len(body[a : a + size]), body[a : a + size]) for a in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The body of chunked framing; ValueError if it is broken, or a size is not of hexadecimal digits only.
    Extensions and trailers are ignored."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        digits = data[at:end].split(b";")[0].strip()
        if not HEX_SIZE.fullmatch(digits):
            raise ValueError("chunk size is no number")
        size, at = int(digits, 16), end + 2
        if size == 0:
            return b"".join(out)
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        out.append(data[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the CRLF CRLF after its block."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + END + block


def capture_records(name: str, page: int | None, url: str | None, payload: bytes, refers: int | None, rules: ArchiveRules) -> Iterator[bytes]:
    """The records of one capture. name: unique among captures."""
    own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>"
    digest = hashlib.sha256(payload).hexdigest()
    headers = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", own), ("WARC-Date", rules.date)]
    headers += [("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", f"sha256:{digest}")]
    headers += [(PAGE_HEADER, str(page))] * (page is not None)
    headers.append(("Content-Type", "application/http; msgtype=response"))
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", str(refers))]
        yield record(headers, status + b"Content-Length: %d" % len(payload) + END)
        return
    block = status + b"Transfer-Encoding: chunked" + END + chunked(payload, rules.chunk_bytes)
    pieces = [block[a : a + rules.segment_bytes] for a in range(0, len(block), rules.segment_bytes)]
    if len(pieces) == 1:
        yield record(headers, block)
        return
    yield record([*headers, ("WARC-Segment-Number", "1")], pieces[0])
    for k, piece in enumerate(pieces[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{name}/{k}')}>"), ("WARC-Date", rules.date)]
        more += [("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(k))]
        more += [("WARC-Segment-Total-Length", str(len(block)))] * (k == len(pieces))
        yield record(more, piece)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", rules: ArchiveRules | None = None) -> None:
    """Write a capture for each row of pages into gzipped archive files below path."""
    rules = rules or ArchiveRules()
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= rules.least_bytes, F.sha2("payload", 256)))
    digests = rows.where("digest IS NOT NULL").select("page", "digest")
    first = digests.groupBy("digest").agg(F.min("page").alias("refers"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = digests.join(first, "digest").where("page <> refers").select("page", "digest", "refers").distinct()

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        for pdf in batches:
            out = []
            for page, url, payload, refers in zip(pdf["page"], pdf["url"], pdf["payload"], pdf["refers"], strict=True):
                page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                out += capture_records(f"{page}/{part}/{number}", page, url, bytes(payload), refers, rules)
                number += 1
            yield pd.DataFrame({"record": out}, dtype=object)

    made = rows.join(revisits, ["page", "digest"], "left").drop("digest").mapInPandas(records, "record binary")
    (
        made.select(F.col("record").cast("string"))
        .write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", rules.records_per_file)
        .text(path)
    )


def unpacked(data: bytes) -> tuple[bytes, bool]:
    """(the bytes of a file, whether that is all of it). Of a broken gzip file what comes before the break."""
    if data[:2] != b"\x1f\x8b":
        return data, True
    parts, rest = [], data
    try:
        while rest[:2] == b"\x1f\x8b":
            z = zlib.decompressobj(31)
            for at in range(0, len(rest), PACKED_BYTES):
                parts.append(z.decompress(rest[at : at + PACKED_BYTES]))
                if z.eof:
                    break
            rest = z.unused_data + rest[at + PACKED_BYTES :]
            if not z.eof:
                return b"".join(parts), False
    except zlib.error:
        return b"".join(parts), False
    return b"".join(parts), True


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers in lower case, block) of each record of an archive; block None where the file is cut off or
    its length is no number. A file that cannot be unpacked to its end gives a record of type UNREADABLE."""
    data, whole = unpacked(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(END, at)
        if end < 0:
            break
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = headers.get("content-length", "0")
        at = end + len(END)
        if not WHOLE.fullmatch(length) or length.startswith("-"):
            yield headers, None
            continue
        size = int(length)
        block = data[at : at + size]
        yield headers, block if len(block) == size else None
        at += size + len(END)
    if not whole:
        yield {"warc-type": UNREADABLE}, None


PARSED = "record_id string, record_type string, page long, url string, digest string, refers long, origin string, segment long, total long, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row (PARSED) for each record of the archive files below path."""

    def whole(x: str | None) -> int | None:
        return int(x) if x and WHOLE.fullmatch(x) else None

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                rows = []
                for h, block in parse_archive(bytes(data)):
                    own = h.get("warc-record-id")
                    digest = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    rows.append((own, h.get("warc-type"), whole(h.get(PAGE_HEADER.lower())), h.get("warc-target-uri"), digest, whole(h.get("x-refers-to-page-id")), h.get("warc-segment-origin-id", own), whole(h.get("warc-segment-number")), whole(h.get("warc-segment-total-length")), block))
                frame = pd.DataFrame(rows, columns=[x.split()[0] for x in PARSED.split(", ")])
                yield frame.astype({"page": "Int64", "refers": "Int64", "segment": "Int64", "total": "Int64"})

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInPandas(parsed, PARSED)


def decode_block(block: bytes | None, record_type: str, digest: str | None) -> tuple[int | None, bytes | None, str]:
    """(payload bytes, payload, status) of a whole block. Of a revisit only the length is known."""
    if record_type == UNREADABLE:
        return None, None, "unreadable archive"
    if block is None:
        return None, None, "missing segment"
    head, found, body = bytes(block).partition(END)
    if not found:
        return None, None, "bad http headers"
    headers = dict(x.split(": ", 1) for x in head.decode("latin-1").lower().split("\r\n")[1:] if ": " in x)
    if record_type == "revisit":
        size = headers.get("content-length", "")
        return (int(size), None, OK) if WHOLE.fullmatch(size) and not size.startswith("-") else (None, None, "bad http headers")
    if headers.get("transfer-encoding") == "chunked":
        try:
            body = unchunked(body)
        except ValueError:
            return None, None, "bad chunk"
    if digest and hashlib.sha256(body).hexdigest() != digest:
        return None, None, "digest mismatch"
    return len(body), body, OK


def decoded(block: Column, record_type: Column, digest: Column) -> Column:
    def decode(blocks: pd.Series, types: pd.Series, digests: pd.Series) -> pd.DataFrame:
        rows = [decode_block(b, t, d) for b, t, d in zip(blocks, types, digests, strict=True)]
        return pd.DataFrame(rows, columns=["payload_bytes", "payload", "status"]).astype({"payload_bytes": "Int64"})

    return F.pandas_udf(decode, "payload_bytes long, payload binary, status string")(block, record_type, digest)


def joined_segments(pieces: Column) -> Column:
    """The block of (segment, total, block) structs in any order; null unless all from 1 on are there, none
    differs from its repetition, and their length is the total that the last one gives."""

    def join(groups: pd.Series) -> pd.Series:
        out = []
        for group in groups:
            by_number: dict[int, set[bytes | None]] = {}
            for x in group:
                by_number.setdefault(int(x["segment"]), set()).add(None if x["block"] is None else bytes(x["block"]))
            totals = {int(x["total"]) for x in group if x["total"] is not None}
            blocks = [by_number.get(k, {None}) for k in range(1, len(by_number) + 1)]
            whole = len(totals) == 1 and blocks and all(len(x) == 1 and None not in x for x in blocks)
            block = b"".join(next(iter(x)) for x in blocks) if whole else None
            out.append(block if block is not None and len(block) in totals else None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(join, "binary")(pieces)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """(page, url, record_type, refers, digest, payload_bytes, payload, status) of each capture below path.
    Only records in segments are shuffled."""
    records = read_records(spark, path)
    columns = ["page", "url", "record_type", "refers", "digest"]
    single = records.where(f"segment IS NULL AND record_type IN ('response', 'revisit', '{UNREADABLE}')").select(*columns, "block")
    first = [F.max(F.when(F.col("record_type") != "continuation", F.col(c))).alias(c) for c in columns]
    pieces = records.where("segment IS NOT NULL").groupBy("origin").agg(*first, F.collect_list(F.struct("segment", "total", "block")).alias("pieces"))
    whole = pieces.select(*columns, joined_segments(F.col("pieces")).alias("block"))
    out = single.unionByName(whole).withColumn("found", decoded(F.col("block"), F.col("record_type"), F.col("digest")))
    return out.select(*columns, "found.payload_bytes", "found.payload", "found.status")
