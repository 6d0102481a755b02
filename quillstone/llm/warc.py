"""WARC archives: write pages as records, and a splittable reader.

Each record is a gzip member of its own. A reading task takes a byte range, looks there for
the two magic bytes of gzip and the deflate method, decodes what follows, and takes it for a
record if a WARC version line and headers come out; it owns the records that start inside
its range and reads the last of them past the range's end. So one archive is read by many
tasks and none needs an index.

Of pages with equal payloads of at least `least_bytes`, the one with the largest page_id
is a response and the others are revisits that refer to it; smaller payloads are all responses.
A null html is an empty payload. A page without page_id counts as smaller than all others
and is never referred to by a page with one; rows that repeat a page_id and payload: one of
them is the response. No pages: no archive and no rows. A record may be longer than a range: the task
that owns its start reads it to its end. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm._io import cut, fresh_path, open_fs, read_range, write_file

MAGIC = b"\x1f\x8b\x08"
_DATE = "2024-01-01T00:00:00Z"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
MOST_TASKS = 100_000


def _member(head: list[str], body: bytes, level: int = 3) -> bytes:
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    text = "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(body)}", "", ""]).encode()
    return press.compress(text + body + b"\r\n\r\n") + press.flush()


def _record_id(page_id, payload_sha1: bytes) -> str:
    h = hashlib.sha1(f"{page_id}".encode() + payload_sha1).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    sha1 = bytes.fromhex(digest)
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, sha1)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {size}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to, sha1)}",
            f"X-Refers-To-Page: {'' if refers_to is None else refers_to}",
            "Content-Type: application/http; msgtype=response",
        ]
        return _member(head, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    head.append("Content-Type: application/http; msgtype=response")
    return _member(head, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload)


def mark_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to, revisit.

    Digests are counted before they are joined, and only repeated ones join; a page's html
    moves once, by page_id and digest, which no group of copies shares.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    digests = cut(
        rows.select(
            "page_id",
            F.length(html).cast("long").alias("payload_bytes"),
            F.sha1(html).alias("payload_digest"),
        ).filter(F.col("payload_bytes") >= least_bytes),
        "digests",
    )
    repeated = digests.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    # One decision for each page_id and digest, and whether the response is among rows that repeat it.
    decided = digests.join(repeated, ["payload_digest", "payload_bytes"]).select("page_id", "payload_digest", "refers_to").distinct()
    found = rows.withColumn("payload_bytes", F.length(html).cast("long")).withColumn("payload_digest", F.sha1(html))
    # Hashed at every size, so that rows that repeat a page and its payload meet in one partition.
    joined = found.join(
        decided.withColumnRenamed("page_id", "p").withColumnRenamed("payload_digest", "d").hint("shuffle_hash"),
        F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d")),
        "left",
    ).drop("p", "d")
    return joined.withColumn(
        "repeated",
        F.col("payload_digest").isNotNull() & (F.col("payload_bytes") >= least_bytes) & F.col("refers_to").isNotNull(),
    )


def write_archives(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Write one archive a partition, in page_id order within it. Returns (path, size, n_records), one row an archive."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    rows = mark_revisits(pages, least_bytes).sortWithinPartitions("page_id", "payload_digest", "url")

    def archive(batches):
        count = 0

        def members():
            nonlocal count
            last = None
            for batch in batches:
                for k in range(0, batch.num_rows, 64):
                    for r in batch.slice(k, 64).to_pylist():
                        count += 1
                        first = last != (r["page_id"], r["payload_digest"])
                        last = (r["page_id"], r["payload_digest"])
                        revisit = r["repeated"] and not (first and r["page_id"] == r["refers_to"])
                        yield record(
                            r["page_id"],
                            r["url"],
                            (r["html"] or "").encode("utf-8", "surrogatepass"),
                            r["payload_bytes"],
                            r["payload_digest"],
                            r["refers_to"],
                            revisit,
                        )

        some = members()
        one = next(some, None)
        if one is None:
            return
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        size = write_file(path, (x for part in ([one], some) for x in part))
        yield pa.RecordBatch.from_pydict({"path": [path], "size": [size], "n_records": [count]})

    return cut(rows.mapInArrow(archive, "path string, size long, n_records long"), "archives")


class _Stream:
    """Bytes of an archive from `start` on, read in steps."""

    def __init__(self, uri: str, start: int, size: int, step: int):
        self.uri, self.at, self.size, self.step = uri, start, size, step

    def more(self) -> bytes:
        data = read_range(self.uri, self.at, min(self.step, self.size - self.at)) if self.at < self.size else b""
        self.at += len(data)
        return data


def parse_record(data: bytes) -> dict | None:
    """Headers (lower-case names) and body of a decoded member; None if it is no WARC record."""
    if not data.startswith(b"WARC/1."):
        return None
    head, sep, body = data.partition(b"\r\n\r\n")
    if not sep:
        return None
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        out[name.strip().lower()] = value.strip()
    length = out.get("content-length", "")
    if "warc-type" not in out or not length.isdigit() or len(body) < int(length):
        return None
    out["body"] = body[: int(length)]
    return out


def read_split(uri: str, start: int, end: int, size: int, step: int = 1 << 18):
    """Records of the archive whose gzip member starts in [start, end)."""
    stream = _Stream(uri, start, size, step)
    data, base = bytearray(stream.more()), start  # grows and shrinks in place: a long record is copied once
    at = 0
    while base + at < end:
        found = data.find(MAGIC, at)
        if found < 0:
            keep = max(at, len(data) - 2)
            base, at = base + keep, 0
            del data[:keep]
            fresh = stream.more()
            if not fresh:
                return
            data += fresh
            continue
        if base + found >= end:
            return
        if found > step:
            base += found
            del data[:found]
            found = 0
        # Decode from here; a chance match fails at once, at the version line, or at the checksum.
        expand, pieces, fed, good = zlib.decompressobj(31), [], found, True
        try:
            while not expand.eof:
                if fed >= len(data):
                    fresh = stream.more()
                    if not fresh:
                        break
                    data += fresh
                pieces.append(expand.decompress(data[fed : fed + step]))
                fed = min(len(data), fed + step)
                if len(pieces) == 1 and not pieces[0].startswith(b"WARC/1."[: len(pieces[0])]):
                    good = False
                    break
        except zlib.error:
            good = False
        parsed = parse_record(b"".join(pieces)) if good and expand.eof else None
        if parsed is None:
            at = found + 1
            continue
        yield parsed
        at = fed - len(expand.unused_data)


def read_archives(archives: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the listed archives.

    A response's figures are those of the decoded payload; a revisit's are told by its headers.
    """
    ranges = archives.select(
        "path",
        "size",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"),
    )
    # As many tasks as ranges, up to a number a driver can schedule; then tasks take several.
    many = archives.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0]
    if not many:
        return archives.sparkSession.createDataFrame([], RECORDS)
    ranges = ranges.repartition(int(min(many, MOST_TASKS)))

    def scan(frames):
        for frame in frames:
            for path, size, start in zip(frame["path"], frame["size"], frame["start"]):
                rows = []
                for r in read_split(path, int(start), int(min(size, start + split_bytes)), int(size)):
                    number = lambda name: int(r[name]) if r.get(name) else None  # noqa: B023, E731
                    if r["warc-type"] == "response":
                        payload = r["body"].partition(b"\r\n\r\n")[2]
                        rows.append((number("x-page-id"), len(payload), hashlib.sha1(payload).hexdigest(), "response", None))
                    else:
                        digest = base64.b32decode(r["warc-payload-digest"].removeprefix("sha1:")).hex()
                        rows.append((number("x-page-id"), int(r["x-payload-length"]), digest, "revisit", number("x-refers-to-page")))
                    if len(rows) == 5000:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    return ranges.mapInPandas(scan, RECORDS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    kinds = {"page_id": "Int64", "payload_bytes": "int64", "payload_digest": object, "record_type": object, "refers_to": "Int64"}
    return pd.DataFrame({k: pd.Series([r[i] for r in rows], dtype=t) for i, (k, t) in enumerate(kinds.items())})


def archive_size(uri: str) -> int:
    filesystem, path = open_fs(uri)
    return filesystem.get_file_info(path).size
