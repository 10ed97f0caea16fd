"""WARC archives of pages, read back through a capture index that is merged from sorted runs.

Writing. Every page becomes one record of a gzip-compressed archive, written by Spark's text writer with CRLF as line end, so
archives can lie in any store Spark writes to. The first page of a group of equal payloads by largest page_id is a ``response``
record; the others are ``revisit`` records that refer to it and repeat its HTTP head, but not its payload.

Reading. A gzip file is read as one stream of lines by one task, which puts records together by their Content-Length and
checks payload digests. The captures of each reading task, sorted by URL key and timestamp, are a *run*.

Index merge. The runs are cut into ranges of (URL key, timestamp, record), so that one URL captured very often spreads over
several ranges; in each range a loser tree merges the slices of all runs. Ranges in order and rows in order
within them are the capture histories of all URLs in global order.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.llm.common import small, whole_text
from edgetide.plans.ordered import PART, POS
from edgetide.session import scratch_folder, stored

HEX_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RANGE_ROWS = 50_000  # captures of a range, on average
CENTURY = 36_525 * 86_400
CAPTURE = ("url_key string, captured string, record string, page_id long, url string, record_type string, refers_to long, "
           "payload_bytes long, payload_digest string, digest_ok boolean, archive string, at long, length long")
NAMES = [c.split()[0] for c in CAPTURE.split(", ")]
KEY = ["url_key", "captured", "record"]


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of the payload's bytes."""
    digest = F.sha1(payload.cast("binary"))
    groups = [F.lpad(F.conv(digest.substr(5 * n + 1, 5), 16, 32), 4, "0") for n in range(8)]  # 20 bits are four digits
    return F.translate(F.concat(*groups), HEX_DIGITS, BASE32_DIGITS)


def capture_time(page_id: Column) -> Column:
    """Pages carry no time; ids count the seconds since 2000, and a page without id is as old as page 0."""
    seconds = F.pmod(F.coalesce(page_id, F.lit(0)).cast("long"), F.lit(CENTURY)) + 946_684_800
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def clean_header(value: Column) -> Column:
    """A header ends at its line's end: line ends inside a value are percent-encoded."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(rid, page_id, url, payload, bytes, digest, head): ``head`` is the row that a revisit refers to, null for responses.

    Equal payloads of at least ``least_bytes`` have one response, the row of the largest page_id (null ids are smallest; of rows
    with one id the one read last). Only groups of two rows and more are joined back, as a table of digests.
    """
    payload = whole_text("html")
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("equal", F.sha2(F.col("payload").cast("binary"), 256))
    groups = rows.where(F.col("bytes") >= least_bytes).groupBy("equal").agg(
        F.count("*").alias("copies"), F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("order"), "rid", "page_id", "url")).alias("head"))
    repeated = stored(groups.where("copies > 1").select("equal", "head"))
    joined = rows.join(small(repeated), "equal", "left")
    head = F.when(F.col("head").isNotNull() & (F.col("head.rid") != F.col("rid")), F.col("head"))
    return joined.select("rid", "page_id", "url", "payload", "bytes", payload_digest(F.col("payload")).alias("digest"), head.alias("head"))


def record_id(page_id: Column, rid: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), rid.cast("string"), F.lit(">"))


def _lines(*fields: Column) -> Column:
    return F.concat(*[F.concat(f, F.lit("\r\n")) for f in fields])


def record() -> Column:
    """The text of a record, from the columns of ``with_originals``, up to the last CRLF, which the writer adds."""
    text = lambda name, value: F.concat(F.lit(name + ": "), value)
    optional = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + ": "), clean_header(value), F.lit("\r\n"))).otherwise(F.lit(""))
    head, revisit = F.col("head"), F.col("head").isNotNull()
    http = _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), text("Content-Length", F.col("bytes").cast("string")), F.lit(""))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    refers = F.concat(
        _lines(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
               text("WARC-Refers-To", record_id(head["page_id"], head["rid"])), text("WARC-Refers-To-Date", capture_time(head["page_id"]))),
        optional("WARC-Refers-To-Target-URI", head["url"]))
    return F.concat(
        _lines(F.lit("WARC/1.1"), text("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
               text("WARC-Record-ID", record_id(F.col("page_id"), F.col("rid"))), text("WARC-Date", capture_time(F.col("page_id")))),
        optional("WARC-Target-URI", F.col("url")), F.when(revisit, refers).otherwise(F.lit("")),
        _lines(text("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), F.lit("Content-Type: application/http; msgtype=response"),
               text("Content-Length", F.octet_length(block).cast("string")), F.lit("")),
        block, F.lit("\r\n"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """One gzip-compressed archive per partition of ``pages`` in ``folder``; other columns are not written."""
    records = with_originals(pages, least_bytes).select(record().alias("record"))
    records.write.option("lineSep", "\r\n").option("compression", "gzip").text(folder)


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host labels from the right, port, then path and query; scheme and fragment left out."""
    try:
        parts = urlsplit(url or "")
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url or ""
    labels = host.split(".")[1:] if host.startswith("www.") else host.split(".")
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return (",".join(reversed(labels)) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + rest) if host else url or ""


class RecordReader:
    """Puts the lines of an archive together to records, holding one record at a time."""

    def __init__(self, archive: str):
        self.archive, self.at, self.headers, self.start, self.block, self.need = archive, 0, None, 0, [], -1

    def line(self, line: bytes) -> tuple | None:
        """Takes the next line (without CRLF); returns a capture when it completes a record."""
        begin, self.at = self.at, self.at + len(line) + 2
        if self.headers is None:
            if line == b"WARC/1.1":
                self.headers, self.start, self.block, self.need = {}, begin, [], -1
            elif line:
                raise ValueError(f"{self.archive}: no record at {begin}")
            return None
        if self.need < 0:  # still in the header
            if line:
                name, _, value = line.partition(b": ")
                self.headers[name.decode()] = value.decode()
            else:
                self.need = int(self.headers["Content-Length"])
            return None
        self.block.append(line)
        self.need -= len(line)
        if self.need > 0:
            self.need -= 2  # the CRLF that split the block
            return None
        if self.need < 0:
            raise ValueError(f"{self.archive}: the record at {self.start} does not end where it says")
        found = self.capture(b"\r\n".join(self.block))
        self.headers = None
        return found

    def capture(self, block: bytes) -> tuple:
        h = self.headers
        http, _, payload = block.partition(b"\r\n\r\n")
        size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        whole = h["WARC-Type"] == "revisit" or (own == digest and len(payload) == size)
        url, refers = h.get("WARC-Target-URI"), h.get("WARC-Refers-To")
        return (url_key(url), h["WARC-Date"], h["WARC-Record-ID"], _page(h["WARC-Record-ID"]), url, h["WARC-Type"], _page(refers) if refers else None,
                size, digest, whole, self.archive, self.start, self.at + 2 - self.start)


def _page(record: str) -> int | None:
    number = record.removeprefix("<urn:page:").split(":")[0]
    return int(number) if number else None


def _read(batches: Iterator) -> Iterator:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in CAPTURE.split(", ")])
    reader, found = None, []
    for batch in batches:
        for archive, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if reader is None or reader.archive != archive:
                if reader is not None and reader.headers is not None:
                    raise ValueError(f"{reader.archive} ends inside a record")
                reader = RecordReader(archive)
            capture = reader.line(line)
            if capture:
                found.append(capture)
        if found:
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, c)) for c in found], schema)
            found = []
    if reader is not None and reader.headers is not None:
        raise ValueError(f"{reader.archive} ends inside a record")


def read_archives(spark, folder: str) -> DataFrame:
    """One row per record of the archives in ``folder``, see CAPTURE; ``at`` and ``length`` count decompressed bytes.

    A damaged record raises. ``digest_ok`` says whether a response's payload has the size and digest its headers name.
    """
    lines = spark.read.option("lineSep", "\r\n").text(folder).select("_metadata.file_name", F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(_read, CAPTURE)


class LoserTree:
    """Merges sorted sequences: the inner nodes keep the losers, so each step replays one path to the root."""

    def __init__(self, sequences: list[list]):
        self.sequences, self.next = sequences, [0] * len(sequences)
        self.size = max(1, len(sequences))
        self.losers = [None] * self.size
        winners = [None] * self.size + [n if n < len(sequences) else None for n in range(self.size)]
        for node in range(self.size - 1, 0, -1):
            winners[node], self.losers[node] = self._match(winners[2 * node], winners[2 * node + 1])
        self.winner = winners[1] if self.size > 1 else winners[-1]

    def _head(self, n: int):
        at = self.next[n]
        return self.sequences[n][at] if at < len(self.sequences[n]) else None

    def _match(self, a: int | None, b: int | None) -> tuple:
        """(winner, loser); an exhausted sequence loses, equal heads go to the earlier sequence."""
        x, y = (None if n is None else self._head(n) for n in (a, b))
        first = y is None or (x is not None and (x, a) <= (y, b))
        return (a, b) if first else (b, a)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(sequence, place) in merged order."""
        while self.winner is not None and self._head(self.winner) is not None:
            n = self.winner
            yield n, self.next[n]
            self.next[n] += 1
            node = (n + self.size) // 2
            while node >= 1:
                if self.size > 1:
                    n, self.losers[node] = self._match(n, self.losers[node])
                node //= 2
            self.winner = n


def merge_slices(frame: pd.DataFrame) -> pd.DataFrame:
    """The rows of one range, which holds a sorted slice of every run, in merged order."""
    frame = frame.sort_values([PART, POS], kind="stable", ignore_index=True)
    keys = list(zip(*(frame[c] for c in KEY)))
    starts = [g.index[0] for _, g in frame.groupby(PART, sort=True)]
    ends = [*starts[1:], len(frame)]
    tree = LoserTree([keys[a:b] for a, b in zip(starts, ends)])
    return frame.iloc[[starts[n] + place for n, place in tree]]


def capture_index(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures with ``range`` and ``place``: sorted by both, they are in global order of URL key, time and record.

    ``runs`` are the captures as read, sorted in each reading task and stored. Ranges of the key are drawn by Spark's
    range partitioning; a range holds about ``range_rows`` rows whatever the URLs are, as the key ends with the unique record.
    """
    mask = (1 << 33) - 1
    runs = stored(captures.sortWithinPartitions(*KEY).select(
        "*", F.spark_partition_id().alias(PART), F.monotonically_increasing_id().bitwiseAND(F.lit(mask)).alias(POS)))
    ranges = max(1, -(-runs.count() // range_rows))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [batch for batch in batches if len(batch)]
        if rows:
            merged = merge_slices(pd.concat(rows, ignore_index=True))
            yield merged[[*NAMES, "range"]].assign(place=range(len(merged)))

    cut = runs.repartitionByRange(ranges, *KEY).withColumn("range", F.spark_partition_id())
    whole = {"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")}  # pandas has no null integers
    texts = CAPTURE.replace("page_id long", "page_id string").replace("refers_to long", "refers_to string")
    merged = cut.withColumns(whole).mapInPandas(merge, f"{texts}, range int, place long")
    return merged.withColumns({name: F.col(name).cast("long") for name in whole})


def archived_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured): pages written and read back.

    One row per page, repeated rows and ids included; a null html is an empty payload, a null url has no target URI and an
    empty key, and a page without id has null there. Other columns are not archived. The rows come from the merged index.
    """
    spark = pages.sparkSession
    folder = f"{scratch_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, least_bytes)
    index = capture_index(read_archives(spark, folder))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "digest_ok")


# The same columns in SQL, for tables that one process can hold; the archive's own columns are left out.
WARC_SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
h as (select page_id, strlen(body) as payload_bytes, sha1(body) as hex, max(page_id) over (partition by body) as head from p)
select page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (5 * i + 1)::int, 5))::bigint >> s::int) & 31) + 1)::int, 1)), 'string_agg', '')), 'string_agg', '') as payload_digest,
  case when page_id = head then 'response' else 'revisit' end as record_type,
  case when page_id <> head then head end as refers_to from h
"""
