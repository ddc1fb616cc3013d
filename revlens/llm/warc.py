"""WARC archives with an externally merged capture index (dealt operator 10).

``write_archive`` writes a record for every page with Spark's text writer (a record is the value, the
empty lines after it are the line separator), gzip-compressed, in files of bounded size.  Pages of
equal payload (SHA-256, at least ``min_bytes``) become revisits of the one with the smallest number;
only (number, digest) pairs meet by digest, the pages themselves are joined by their own number.

``read_archive`` reads every file in pieces of bounded size and yields its captures.  ``build_index``
writes the captures of each task as a run sorted by URL key, timestamp and number; ranges of these
keys are dealt out, and each range merges its runs with a loser tree, so that the index is in order
within and across partitions: the capture history of every URL.

Defined cases: a null html is an empty payload; a null url has an empty key and no target line; a
null page number is never a revisit nor referred to; rows that share the smallest number of a payload
are all responses; an empty table gives an archive without records; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import blocks as B
from revlens.session import scratch_path

MIN_BYTES = 100
RECORDS_PER_FILE = 10_000
END = "\r\n\r\n"
#: Captures are dated by page number from this second on where no time is given.
FIRST_SECOND = 1_577_836_800
CAPTURE = "urlkey string, ts string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, file string, offset long, length long"
FIELDS = [c.split()[0] for c in CAPTURE.split(", ")]


def records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(value): one WARC record for every page, without the empty lines that end it."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page = B.chosen(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    page = page.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    slim = page.where((F.col("bytes") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    firsts = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("last > first")
    again = slim.join(firsts, "digest").where("page_id > first").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "first").distinct()
    page = page.join(again, (F.col("page_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")

    revisit = F.col("first").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    line = lambda name, c: F.coalesce(F.concat(F.lit(f"{name}: "), c, F.lit("\r\n")), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    when = F.date_format(F.timestamp_seconds(F.lit(FIRST_SECOND) + F.col("page_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", when),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", "")),
        line("WARC-Refers-To", urn(F.col("first"))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return page.select(F.concat(head, block).alias("value"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    out = records(pages, min_bytes).write.option("lineSep", END).option("compression", "gzip")
    out.option("maxRecordsPerFile", records_per_file).text(path)


class _Pieces:
    """Reads lines and bytes from a compressed value, inflating a piece at a time."""

    def __init__(self, data: bytes, piece: int = 1 << 20):
        self.data, self.at, self.piece, self.buf, self.seen = memoryview(data), 0, piece, bytearray(), 0
        self.z = zlib.decompressobj(wbits=31)

    def _more(self) -> bool:
        while self.at < len(self.data) or self.z.unused_data:
            if self.z.eof:
                self.at -= len(self.z.unused_data)
                self.z = zlib.decompressobj(wbits=31)
                if self.at >= len(self.data):
                    return False
            got = self.z.decompress(self.data[self.at : self.at + self.piece])
            self.at = min(self.at + self.piece, len(self.data))
            if got:
                self.buf += got
                return True
        return False

    def take(self, n: int) -> bytes:
        while len(self.buf) < n:
            if not self._more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.buf[:n])
        del self.buf[:n]
        self.seen += n
        return out

    def head(self) -> bytes | None:
        while (i := self.buf.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.buf.strip():
                    raise ValueError("the archive ends within a header")
                return None
        return self.take(i + 4)


def captures_in(data: bytes, name: str) -> Iterator[tuple]:
    """The captures of one archive file; offsets are those of the uncompressed records."""
    read = _Pieces(data)
    while True:
        begin = read.seen
        head = read.head()
        if head is None:
            return
        lines = head.decode("utf-8").split("\r\n")
        field = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:] if ": " in x)}
        block = read.take(int(field["content-length"]))
        read.take(len(END))
        inner, _, payload = block.partition(b"\r\n\r\n")
        kind, digest = field["warc-type"], field["warc-payload-digest"].removeprefix("sha256:")
        size = len(payload)
        if kind == "revisit":
            size = int(re.search(rb"(?mi)^Content-Length: (\d+)", inner)[1])
        elif hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"{name}: the payload at {begin} does not have its digest")
        number = lambda k: int(field[k][10:-1]) if field.get(k) else None
        url = field.get("warc-target-uri")
        yield url_key(url), field.get("warc-date"), number("warc-record-id"), kind, size, digest, number("warc-refers-to"), url, name, begin, read.seen - begin


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, in lower case, without scheme, www, port 80 / 443 and fragment."""
    m = re.match(r"(?i)(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)", url or "")
    host, port, rest = m[1].lower(), m[2], m[3].lower()
    labels = host.removeprefix("www.").split(".")[::-1]
    return (",".join(labels) + (f":{port}" if port not in (None, "80", "443") else "") + ")" + (rest or "/")) if host or rest else ""


def _table(rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "string": pa.string()}
    cols = list(zip(*rows)) if rows else [()] * len(FIELDS)
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip((x.split() for x in CAPTURE.split(", ")), cols)})


def _order(row: tuple) -> tuple:
    return row[0], row[1] or "", row[2] is not None, row[2] or 0


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all files, each file's sorted by URL key, timestamp and number: one run a file."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                yield from _table(sorted(captures_in(data.as_py(), name), key=_order)).to_batches()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(run, CAPTURE)


def merge(runs: list[list[tuple]]) -> Iterator[tuple]:
    """k sorted runs in one order, by a loser tree: each inner node keeps the loser of its match, so
    that a row costs one match per level."""
    k = len(runs)
    at = [0] * k
    key = [(_order(r[0]), i) if r else None for i, r in enumerate(runs)]
    beats = lambda a, b: key[b] is None or (key[a] is not None and key[a] <= key[b])
    tree = [-1] * k
    top = -1
    for i in range(k):  # play every run up; the first to reach an empty node waits there
        w, node = i, (i + k) // 2
        while node > 0 and tree[node] >= 0:
            if not beats(w, tree[node]):
                w, tree[node] = tree[node], w
            node //= 2
        if node > 0:
            tree[node] = w
        else:
            top = w
    while k and key[top] is not None:
        yield runs[top][at[top]]
        at[top] += 1
        key[top] = (_order(runs[top][at[top]]), top) if at[top] < len(runs[top]) else None
        w, node = top, (top + k) // 2
        while node > 0:
            if not beats(w, tree[node]):
                w, tree[node] = tree[node], w
            node //= 2
        top = w


def merged(runs: DataFrame) -> DataFrame:
    """The index in order: ranges of (key, time, number), each merged from its pieces of the runs."""

    def run(batches):
        pieces: dict[str, list[tuple]] = {}
        for b in batches:
            for row in zip(*(b.column(b.schema.get_field_index(f)).to_pylist() for f in FIELDS)):
                pieces.setdefault(row[8], []).append(row)
        held = []
        for r in pieces.values():  # a run's rows may arrive in pieces
            r.sort(key=_order)
            held.append(r)
        out = []
        for row in merge(held):
            out.append(row)
            if len(out) == 10_000:
                yield from _table(out).to_batches()
                out = []
        yield from _table(out).to_batches()

    n = B.parts(runs.sparkSession)
    return runs.repartitionByRange(n, "urlkey", "ts", "page_id").mapInArrow(run, CAPTURE)


def build_index(spark: SparkSession, archive: str, runs: str) -> DataFrame:
    """Writes the archive's sorted runs to ``runs`` and returns their merge."""
    read_archive(spark, archive).write.parquet(runs)
    return merged(spark.read.schema(CAPTURE).parquet(runs))


def digest(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes the pages' archive to the shared scratch folder, reads it back and returns the merged
    index: page_id, payload_bytes, payload_digest, record_type, refers_to, and urlkey and ts."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, f"{path}/archive", min_bytes)
    index = build_index(spark, f"{path}/archive", f"{path}/runs")
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts")
