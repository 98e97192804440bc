"""WARC archives: writing with continuation records, and reading with segment reassembly.

A page's record is a response, its block an HTTP message with a chunked body.  Of
pages with equal payloads of at least ``revisit_bytes`` bytes the one with the
smallest page_id is the response, the others are revisit records without a body
that refer to it.  A block above ``segment`` bytes is split: the first part stays in
the response, the others are continuation records that name their origin, their
number and, in the last, the total length.  Archives are series of gzip members, a
few MB each, in a table of binary rows, so any store Spark writes to will do.

Reading parses every archive in the executors.  Whole records are decoded where
they are; parts of segmented ones are grouped by origin identifier, ordered by
segment number, checked for gaps and against the total length, joined, and their
chunked framing decoded; digests are checked against the payload.

Payloads are equal if their SHA-1 digests are.  A page may be of any length; it is held
whole in a task, and its parts are joined in one.  Of pages with one payload and the
smallest page_id (ties) all are responses.

A null html counts as empty, a null url as none.  A null page_id is kept; it comes
after all others in the choice of the response, and can't be referred to, so where
all are null each is a response.  Rows with the response's own page_id and payload
are responses too.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow, per_batch, ready, stored

SEGMENT, CHUNK, ARCHIVE, DATE = 32_768, 8_192, 4_000_000, "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:page:"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """HTTP chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for i in range(0, len(body), size) if (c := body[i : i + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].partition(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(framed[end + 2 : end + 2 + size])
        if len(out[-1]) != size or framed[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunked body: a chunk is cut short")
        at = end + 4 + size


def record(kind: str, name: str, block: bytes, **more: object) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{name}>", "WARC-Date": DATE} | {k.replace("_", "-"): v for k, v in more.items() if v is not None} | {"Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def records(name: str, url: str | None, html: bytes, refers_to: int | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of a page: one, or a first and its continuations."""
    own = {"WARC_Target_URI": " ".join(url.split()) if url else None, "WARC_Payload_Digest": "sha1:" + digest(html), "Content_Type": "application/http; msgtype=response"}
    if refers_to is not None:
        yield record("revisit", name, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html), WARC_Profile=PROFILE, WARC_Refers_To=f"<{NAME}{refers_to}>", **own)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(html)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield record("response", name, parts[0], WARC_Segment_Number=1 if len(parts) > 1 else None, **own)
    for k, part in enumerate(parts[1:], 2):
        yield record("continuation", f"{name}:{k}", part, WARC_Segment_Origin_ID=f"<{name}>", WARC_Segment_Number=k, WARC_Segment_Total_Length=len(block) if k == len(parts) else None)


def packed(member: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(member) + z.flush()


def write(pages: DataFrame, segment: int = SEGMENT, archive: int = ARCHIVE, revisit_bytes: int = 0) -> DataFrame:
    """A table of archives (column warc), one row each, not yet stored."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("html")).withColumn("sha", F.unhex(F.sha1("html")))
    first = p.where(F.length("html") >= revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    # first the ids alone meet, whose hot payloads Spark can split; html is then dealt by page and payload
    later = F.coalesce(F.col("page_id") > F.col("first"), F.col("page_id").isNull())
    refers = p.select("page_id", "sha").distinct().join(first, "sha").where(later).select(F.col("page_id").alias("own"), F.col("sha").alias("own_sha"), F.col("first").alias("refers_to"))
    p = p.join(refers, F.col("page_id").eqNullSafe(F.col("own")) & (F.col("sha") == F.col("own_sha")), "left").select("page_id", "url", "html", "refers_to")

    def make():
        part = TaskContext.get().partitionId()
        count = [0]

        def step(rows):
            out, now, size = [], [], 0
            for page, url, html, refers in zip(rows["page_id"], rows["url"], rows["html"], rows["refers_to"], strict=True):
                count[0] += 1
                for r in records(f"{NAME}{'' if page is None else page}:{part}-{count[0]}", url, html, refers, segment):
                    now.append(packed(r))
                    size += len(r)
                if size >= archive:
                    out.append(b"".join(now))
                    now, size = [], 0
            return {"warc": [*out, b"".join(now)] if now else out}

        return step

    ready(pages.sparkSession)
    return per_batch(p, "warc binary", make)


def members(archive: bytes) -> Iterator[bytes]:
    while archive:
        z = zlib.decompressobj(31)
        yield z.decompress(archive) + z.flush()
        archive = z.unused_data


def parsed(member: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record."""
    at = 0
    while at < len(member):
        end = member.index(b"\r\n\r\n", at)
        version, *lines = member[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head["content-length"])
        block = member[end + 4 : end + 4 + size]
        if len(block) != size or member[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        yield head, block
        at = end + 8 + size


RESULT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def page_of(name: str) -> int | None:
    n = name.strip("<>").removeprefix(NAME).partition(":")[0]
    return int(n) if n else None


def decoded(head: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    """What RESULT names, of a whole record."""
    http, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
    told, page = head["warc-payload-digest"].removeprefix("sha1:"), page_of(head["warc-record-id"])
    if head["warc-type"] == "revisit":
        return page, head.get("warc-target-uri"), int(fields[b"content-length"]), told, "revisit", page_of(head["warc-refers-to"]), None
    payload = unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
    if digest(payload) != told:
        raise ValueError(f"the payload of {head['warc-record-id']} doesn't match its digest")
    return page, head.get("warc-target-uri"), len(payload), told, "response", None, payload if with_payload else None


def read(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row for each page of the archives."""
    parts = "origin string, number int, total long, head map<string,string>, block binary"
    whole_schema, part_schema = _arrow(archives.sparkSession, RESULT), _arrow(archives.sparkSession, parts)

    def walk(batches: Iterator[pa.RecordBatch], segmented: bool) -> Iterator[pa.RecordBatch]:
        schema = part_schema if segmented else whole_schema
        for batch in batches:
            for archive in batch.column("warc").to_pylist():
                rows = []
                for head, block in (r for m in members(archive) for r in parsed(m)):
                    number = head.get("warc-segment-number")
                    if (number is not None) != segmented:
                        continue
                    if segmented:
                        total = head.get("warc-segment-total-length")
                        rows.append((head.get("warc-segment-origin-id", head["warc-record-id"]), int(number), int(total) if total else None, list(head.items()), block))
                    else:
                        rows.append(decoded(head, block, with_payload))
                columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("number")
        block = b"".join(pdf["block"])
        total = pdf["total"].dropna()
        if list(pdf["number"]) != list(range(1, len(pdf) + 1)) or len(total) != 1 or int(total.iloc[0]) != len(block):
            raise ValueError(f"{pdf['origin'].iloc[0]}: segments are missing or don't add up")
        return pd.DataFrame([decoded(dict(pdf["head"].iloc[0]), block, with_payload)], columns=whole_schema.names)

    whole = archives.mapInArrow(lambda b: walk(b, False), RESULT)
    return whole.unionByName(archives.mapInArrow(lambda b: walk(b, True), parts).groupBy("origin").applyInPandas(join, RESULT))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    from .common import table

    archives = stored(write(table(spark, sf_dir, "pages")))
    return read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
