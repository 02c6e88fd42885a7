"""Web archives: pages written as WARC records, segmented where long, and read back.

A record holds an HTTP response with chunked transfer framing.  Records longer than ``segment_bytes`` are
split: the first segment is the response, continuation records name it as their origin and count on, the
last one states the total length.  Reading groups the continuations by origin, orders them by segment
number, verifies that none is missing and that the lengths add up, and decodes the framing.

Of pages with equal payloads of some size only one is stored; the others are revisit records that refer to it.

An archive is a text file whose lines end in the record separator, written and read by Spark's own text source, so it
can lie in any store that Spark reaches.  The line that opens a record never occurs inside one: the chunk framing
breaks it up.  Only digests are grouped to find equal payloads, and only segmented records are shuffled when read.

Defined results: null and empty payloads are records of length 0; of equal payloads all rows with the largest id are
responses (repeated rows too), rows without an id refer to it; ids are kept as whole numbers; an empty table
writes and reads nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.scratch import materialize, scratch_path

_OPEN = "WARC/1.1\r\n"
_CLOSE = "\r\n\r\n"


@dataclass(frozen=True)
class Settings:
    """Sizes in bytes; ``date`` is the capture time written into every record."""

    segment_bytes: int = 32_768
    chunk_bytes: int = 8_192
    revisit_from: int = 1_000
    records_per_file: int = 50_000
    date: str = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing; a chunk also ends inside every occurrence of the line that opens a record."""
    cuts = {*range(0, len(payload), size), *(m.start() + 5 for m in re.finditer(re.escape(_OPEN.encode()), payload)), len(payload)}
    # Chunks end between characters, so that every record is valid text.
    edges = sorted({_character_start(payload, c) for c in cuts})
    parts = [b"%x\r\n%b\r\n" % (b - a, payload[a:b]) for a, b in zip(edges, edges[1:])]
    return b"".join(parts) + b"0\r\n\r\n"


def _character_start(data: bytes, at: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def unchunked(body: bytes) -> bytes:
    """The payload behind chunked transfer framing; fails on a damaged frame."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        start = line + 2
        if body[start + size : start + size + 2] != b"\r\n":
            raise ValueError("chunk without end")
        parts.append(body[start : start + size])
        at = start + size + 2


def _record(fields: dict[str, object], block: bytes) -> str:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"{_OPEN}{lines}Content-Length: {len(block)}\r\n\r\n" + block.decode("utf-8")


def records(page_id, url: str | None, payload: bytes, digest: str, keeper, row: str, settings: Settings) -> list[str]:
    """The records of one page: a revisit, or a response and its continuations."""
    name = lambda i: f"<urn:page:{'none' if i is None else i}:{digest}>"
    common = {
        "WARC-Record-ID": name(page_id),
        "WARC-Date": settings.date,
        "WARC-Target-URI": quote(url or "", safe=":/?&=#%+,;@!$'()*~[]"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Page-Row": row,
    }
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if keeper is not None and keeper != page_id:
        block = f"{head}Content-Length: {len(payload)}\r\n\r\n".encode()
        fields = {"WARC-Type": "revisit", **common, "WARC-Refers-To": name(keeper)}
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [_record({**fields, "Content-Type": "application/http;msgtype=response"}, block)]
    block = f"{head}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload, settings.chunk_bytes)
    cuts = [0]
    while len(block) - cuts[-1] > settings.segment_bytes:
        cuts.append(_character_start(block, cuts[-1] + settings.segment_bytes))
    parts = [block[a:b] for a, b in zip(cuts, [*cuts[1:], len(block)])]
    fields = {"WARC-Type": "response", **common, "Content-Type": "application/http;msgtype=response"}
    if len(parts) == 1:
        return [_record(fields, block)]
    out = [_record({**fields, "WARC-Segment-Number": 1}, parts[0])]
    for k, part in enumerate(parts[1:], 2):
        out.append(
            _record(
                {
                    "WARC-Type": "continuation",
                    **common,
                    "WARC-Record-ID": f"<urn:segment:{row}:{k}>",
                    "WARC-Segment-Origin-ID": name(page_id),
                    "WARC-Segment-Number": k,
                    "WARC-Segment-Total-Length": len(block) if k == len(parts) else None,
                },
                part,
            )
        )
    return out


def keepers(payloads: DataFrame, settings: Settings) -> DataFrame:
    """Digest and largest id of every payload that several rows share: counted before the shuffle, ids and digests only."""
    large = payloads.filter(F.octet_length("payload") >= settings.revisit_from)
    counted = large.groupBy(F.col("digest").alias("shared")).agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    # Written, so that the join sees two shuffled sides and can split the rows of a hot payload.
    return materialize(counted.filter("n > 1 and keeper is not null").select("shared", "keeper"), "warc-keepers")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", settings: Settings = Settings()) -> None:
    """Write every row of ``pages`` as WARC records under ``path``."""
    text = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    payloads = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(text, "UTF-8").alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    joined = payloads.join(keepers(payloads, settings), F.col("digest") == F.col("shared"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for k in range(0, len(batch), 512):
                out = []
                for row in zip(*(c.to_pylist() for c in batch.slice(k, 512).columns)):
                    out.extend(records(*row, f"{part}-{n}", settings))
                    n += 1
                yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})

    made = joined.select("page_id", "url", "payload", "digest", "keeper").mapInArrow(run, "value string")
    made.write.option("lineSep", _CLOSE).option("compression", "gzip").option("maxRecordsPerFile", settings.records_per_file).text(path)


def _field(head: Column, name: str) -> Column:
    value = F.regexp_extract(head, rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(value != "", value)


_PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record under ``path``: its fields and its block; fails on a record shorter than it says."""
    raw = spark.read.option("lineSep", _OPEN).text(path).filter(F.col("value") != "")
    head = F.substring_index("value", _CLOSE, 1)
    split = raw.select(head.alias("head"), F.col("value").cast("binary").alias("bytes"))
    length = _field(F.col("head"), "Content-Length").cast("int")
    start = F.octet_length("head") + len(_CLOSE) + 1
    whole = F.octet_length("bytes") >= start + length - 1
    return split.select(
        *[_field(F.col("head"), n).alias(a) for n, a in _FIELDS.items()],
        F.when(whole, F.substring(F.col("bytes"), start, length)).otherwise(F.raise_error(F.lit("cut record")).cast("binary")).alias("block"),
    )


_FIELDS = {
    "WARC-Type": "type",
    "WARC-Record-ID": "record_id",
    "WARC-Refers-To": "refers",
    "WARC-Payload-Digest": "digest",
    "Page-Row": "row",
    "WARC-Segment-Origin-ID": "origin",
    "WARC-Segment-Number": "segment",
    "WARC-Segment-Total-Length": "total",
}


def reassemble(found: DataFrame) -> DataFrame:
    """One row per page: type, record_id, refers, digest and the blocks of its segments in order.

    Segments meet by origin and row; a segment missing or a wrong total length fails.
    """
    whole = found.filter("segment is null").select("type", "record_id", "refers", "digest", F.array("block").alias("blocks"))
    number = F.col("segment").cast("int")
    parts = (
        found.filter("segment is not null")
        .groupBy(F.coalesce("origin", "record_id").alias("record_id"), "row")
        .agg(
            F.max(F.when(number == 1, F.col("type"))).alias("type"),
            F.max(F.when(number == 1, F.col("digest"))).alias("digest"),
            F.max(F.col("total").cast("long")).alias("total"),
            F.max(number).alias("last"),
            F.sort_array(F.collect_list(F.struct(number.alias("number"), F.col("block").alias("block")))).alias("segments"),
        )
    )
    length = F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + F.octet_length(s["block"]))
    complete = (F.size("segments") == F.col("last")) & (length == F.col("total")) & F.col("type").isNotNull()
    blocks = F.when(complete, F.transform("segments", lambda s: s["block"])).otherwise(F.raise_error(F.lit("segments missing")).cast("array<binary>"))
    joined = parts.select("type", "record_id", F.lit(None).cast("string").alias("refers"), "digest", blocks.alias("blocks"))
    return whole.unionByName(joined)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to; payloads are checked against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda urn: int(m[1]) if (m := re.match(r"<urn:page:(-?\d+):", urn or "")) else None
        for batch in batches:
            rows = []
            for kind, name, refers, digest, blocks in zip(*(c.to_pylist() for c in batch.columns)):
                http, _, body = b"".join(blocks).partition(b"\r\n\r\n")
                digest = digest.removeprefix("sha1:")
                if kind == "revisit":
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                else:
                    payload = unchunked(body) if b"Transfer-Encoding: chunked" in http else body
                    size = len(payload)
                    if hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {name} differs from its digest")
                rows.append((number(name), size, digest, kind, number(refers)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return reassemble(read_records(spark, path)).mapInArrow(run, _PAGE)


def round_trip(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, settings=settings)
    return read_archives(pages.sparkSession, path)
