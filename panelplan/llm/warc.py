"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Each record is a gzip member of its own. A reader task gets a byte range, looks for the gzip magic,
takes a candidate for a member if its first bytes decode to a WARC header, and owns the records that
start inside the range; the last one is read on beyond it. Ranges of one file can thus be read by
different executors, and nothing but the ranges is known beforehand.

Rows: null pages are stored with an empty payload and a record id without number; payloads below
MIN_BYTES are always responses; of equal payloads, each row with the smallest page id is a response
(a repeated row too) and all others are revisits. Payloads of any length are stored whole and read in
pieces; tables without rows give no records. Other columns of pages are left out."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelplan.llm.common import replaced, shared_dir, written
from panelplan.llm.files import new_file, random_access

MIN_BYTES = 100
SPLIT_BYTES = 4 << 20
#: Bytes of equal payloads that one task takes, and of how many payloads the copies are spread.
SHARE_BYTES, WIDEST = 16 << 20, 10_000
MAGIC = b"\x1f\x8b\x08"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PIECE = 1 << 20
_HEADER_BYTES = 1 << 16
_OUT = "page_id long, record_type string, refers_to long, url string, stored_digest string, stored_bytes long, payload binary"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit has the headers of the payload, not the payload."""
    block = _HTTP + payload if kind == "response" else b""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n_bytes}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]' + chr(39))}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(folder: str, date: str):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = size = 0
        with new_file(folder, "pages", ".warc.gz") as (path, out):
            for batch in batches:
                for row in batch.to_pylist():
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = record(row["kind"], row["page_id"], row["url"], row["payload"], row["digest"], row["n_bytes"], row["refers_to"], date)
                    member = packer.compress(data) + packer.flush()
                    out.write(member)
                    size += len(member)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "n_bytes", "n_records"])

    return over


def _joined_in_shares(rows: DataFrame, first: DataFrame, widest: int = WIDEST) -> DataFrame:
    """rows with `first` of their key, null where there is none. Rows of a key with several shares are spread over them.

    Only the widest keys are spread: so many that what is broadcast has a bound, and a key that is
    not among them holds no more than one part in `widest` of all bytes."""
    wide = first.filter("shares > 1").orderBy(F.desc("shares"), "key").limit(widest).select("key", F.col("shares").alias("__wide"))
    spread = lambda df: df.join(F.broadcast(wide), "key", "left").withColumn("__wide", F.coalesce("__wide", F.lit(1).cast("long")))
    ours = spread(rows).withColumn("__share", F.pmod(F.xxhash64("page_id", "url"), "__wide")).drop("__wide")
    theirs = spread(first).select("key", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__wide") - 1)).alias("__share"))
    return ours.join(theirs, ["key", "__share"], "left")


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES, date: str = "2000-01-01T00:00:00Z", share_bytes: int = SHARE_BYTES) -> DataFrame:
    """Write pages as WARC files; returns their manifest (path, n_bytes, n_records).

    share_bytes: copies of one payload that take more than this together are dealt to as many tasks as they need."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    groups = rows.filter(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"), F.max("n_bytes").alias("size"))
    first = written(groups.filter("n > 1 and first is not null").select("digest", "first", F.ceil(F.col("n") * F.col("size") / share_bytes).alias("shares")), "warc-copies")
    # payloads too small for a revisit get keys of their own, so that all empty pages do not meet in one task
    key = F.when(F.col("n_bytes") >= min_bytes, F.col("digest")).otherwise(F.xxhash64("page_id", "url").cast("string"))
    joined = _joined_in_shares(rows.withColumn("key", key), first.withColumnRenamed("digest", "key"))
    original = F.col("first").isNull() | F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    out = joined.select(
        "page_id", "url", "n_bytes", "digest",
        F.when(original, "response").otherwise("revisit").alias("kind"),
        F.when(original, F.col("payload")).otherwise(F.lit(b"")).alias("payload"),
        F.when(~original, F.col("first")).alias("refers_to"),
    )
    return replaced(first, out.mapInArrow(_write(folder, date), "path string, n_bytes long, n_records long"), "warc-manifest")


class _Source:
    """Bytes of a file from any place on, read in pieces."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size, self.at, self.piece = file, size, 0, b""

    def read(self, at: int) -> bytes:
        """Some bytes from `at` on; empty at the end."""
        if not self.at <= at < self.at + len(self.piece):
            self.file.seek(at)
            self.at, self.piece = at, self.file.read(min(_PIECE, self.size - at)) if at < self.size else b""
        return self.piece[at - self.at :]


def _header_at(source: _Source, at: int) -> bool:
    """Whether a gzip member with a WARC header begins here."""
    unpack = zlib.decompressobj(31)
    try:
        got = b""
        while len(got) < 5 and not unpack.eof:
            data = source.read(at)[:4096]
            if not data:
                return False
            got += unpack.decompress(data, 4096)
            at += len(data)
        return got.startswith(b"WARC/")
    except zlib.error:
        return False


def _member(source: _Source, at: int) -> tuple[bytes, int] | None:
    """(content, where the next member begins); None if it is not a whole member."""
    unpack, parts = zlib.decompressobj(31), []
    try:
        while not unpack.eof:
            data = source.read(at)
            if not data:
                return None
            parts.append(unpack.decompress(data))
            at += len(data) - len(unpack.unused_data)
    except zlib.error:
        return None
    return b"".join(parts), at


def members(source: _Source, start: int, end: int) -> Iterator[bytes]:
    """The contents of the records that begin in [start, end)."""
    at, sure = start, False
    while at < end:
        if not sure:
            piece = source.read(at)
            if len(piece) < 3:
                more = source.read(at + len(piece))
                piece += more[:2]
            found = piece.find(MAGIC)
            if found < 0:
                at += max(1, len(piece) - 2)
                continue
            at += found
            if at >= end:
                return
        content = _member(source, at) if _header_at(source, at) else None
        followed = content and (content[1] >= source.size or sure or _header_at(source, content[1]))  # bytes that look like a member inside another one are not followed by a record
        if not followed:
            at, sure = at + 1, False
            continue
        yield content[0]
        at, sure = content[1], True


def _parsed(content: bytes) -> tuple:
    head, _, block = content.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    number = lambda v: int(v[10:-1]) if v and v[10:-1] else None  # noqa: E731  <urn:page:N>
    block = block[: int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2] if fields["warc-type"] == "response" else None
    return (
        number(fields["warc-record-id"]), fields["warc-type"], number(fields.get("warc-refers-to")), fields.get("warc-target-uri"),
        fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"]), payload,
    )


_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
_NAMES = [c.split(" ")[0] for c in _OUT.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], _NAMES)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for splits in batches:
        for s in splits.to_pylist():
            rows, size = [], 0
            source = _Source(random_access(s["path"]), s["n_bytes"])
            for content in members(source, s["start"], s["end"]):
                rows.append(_parsed(content))
                size += len(content)
                if size > 4 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of WARC files given as (path, n_bytes): page_id, record_type, refers_to, url,
    stored_digest and stored_bytes (the headers' word on the payload), payload (null in a revisit)."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    splits = files.filter("n_bytes > 0").select("path", "n_bytes", starts.alias("start")).withColumn("end", F.least(F.col("start") + split_bytes, F.col("n_bytes")))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return splits.repartition(n, "path", "start").mapInArrow(_read, _OUT)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages to WARC files in the shared folder, read them back, and describe each record by what was read."""
    found = read_warc(write_warc(pages, shared_dir(pages.sparkSession, "warc"), id_col, url_col, html_col))
    response = F.col("record_type") == "response"
    return found.select(
        F.col("page_id").alias(id_col),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("stored_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("stored_digest")).alias("payload_digest"),
        "record_type", "refers_to",
    )
