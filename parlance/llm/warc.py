"""WARC archives, and their capture index by external merge.

Pages are written as WARC/1.1 records (a later page with an equal payload becomes a
revisit), the archives are read back record by record, and every archive gives one run of
index rows sorted by URL key and time.  The runs are written, cut into ranges of that key
with a bounded number of rows, and each range merges its pieces of all runs with a loser
tree, so the ranges, in order, are the capture histories in global order.

An archive is one gzip stream of at most RECORDS_PER_ARCHIVE records: large payloads are
written apart, fewer to an archive.  Reading inflates it a piece at a time and holds one
record.  ``offset`` counts bytes of the inflated archive.

Defined cases: null html is an empty payload; a null URL has the empty URL key; of the
records with equal payloads all rows with the smallest page id are responses (rows without
an id are revisits of it, and responses if no row has one); repeated rows give repeated
records; payloads may hold any text, WARC headers included; no pages give no archive
and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import arrow_stream
from parlance.plans.scratch import materialise, scratch_dir

CRLF = "\r\n"
#: Record ids carry the page id in their last 16 digits; the second form has none.
ID_OF_PAGE, ID_OF_NONE = "77617263-7061-4765-", "77617263-6e75-4c6c-0000-000000000000"
#: Records in one archive if no payload is larger than LARGE bytes; with twice that, half of them, and so on.
RECORDS_PER_ARCHIVE, LARGE = 1_500, 1 << 17
#: Payloads from this many bytes on become revisits.
REVISIT_FROM = 0
#: Repeated payloads up to which their digests are broadcast; index rows in a range of the merge, about.
BROADCAST_PAYLOADS, MERGE_ROWS = 200_000, 100_000
RUN = "urlkey string, captured_at string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, archive string, offset long"
KEYS = ("urlkey", "captured_at", "page_id")


def base32_digest(h: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hexadecimal: five hexadecimal digits make four letters."""
    digits = F.concat(*(F.lpad(F.conv(F.substring(h, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column) -> Column:
    h = F.lpad(F.hex(page_id), 16, "0")
    return F.concat(F.lit("<urn:uuid:"), F.coalesce(F.concat(F.lit(ID_OF_PAGE), F.substring(h, 1, 4), F.lit("-"), F.substring(h, 5, 12)), F.lit(ID_OF_NONE)), F.lit(">"))


def records(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """One WARC record per page: ``value`` is its text (without its closing two line ends), ``bytes`` the size of its payload."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", " ").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumns({"sha": F.sha1(F.encode("html", "UTF-8")), "bytes": F.octet_length("html")})
    again = materialise(p.groupBy("sha", "bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "bytes", "first", F.lit(True).alias("again")))
    p = p.join(F.broadcast(again) if again.count() <= BROADCAST_PAYLOADS else again, ["sha", "bytes"], "left")
    revisit = (F.col("bytes") >= revisit_from) & F.coalesce(F.col("again") & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html;charset=utf-8{CRLF}Content-Length: "), F.col("bytes"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    when = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(31_536_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", _record_id(F.col("page_id"))),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Date", when),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_digest(F.col("sha")))),
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", F.octet_length(block)),
    ]
    lines = [F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)) for k, v in head]
    about = F.when(revisit, F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), _record_id(F.col("first")), F.lit(CRLF))).otherwise("")
    return p.select(F.concat(F.lit(f"WARC/1.1{CRLF}"), *lines, about, F.lit(CRLF), block).alias("value"), "bytes")


def write_archives(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM) -> None:
    """Gzipped archives below ``path``, one folder for each class of size; the line separator is what ends a record."""
    r = records(pages, revisit_from)
    most = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    classes = 1 + max(0, math.ceil(math.log2(max(1, most) / LARGE)))
    for k in range(classes):
        own = r if classes == 1 else r.where((F.col("bytes") > (LARGE << k - 1 if k else -1)) & (F.col("bytes") <= LARGE << k))
        own.select("value").write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", max(1, RECORDS_PER_ARCHIVE >> k)).text(f"{path}/size={k}")


def _inflated(packed: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The content of gzip members, in pieces."""
    z = zlib.decompressobj(31)
    for i in range(0, len(packed), 1 << 16):
        data = packed[i : i + (1 << 16)]
        while data:
            if part := z.decompress(data, piece):
                yield part
            data = z.unconsumed_tail
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)


def parse_archive(packed: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``(offset, headers, block)`` of each record of a gzipped archive, by its Content-Length."""
    source, held, at = _inflated(packed), bytearray(), 0

    def fill(size: int) -> bool:
        while len(held) < size:
            part = next(source, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while fill(1):
        seen = 0
        while (end := held.find(CRLF.encode() * 2, max(0, seen - 3))) < 0:
            seen = len(held)
            if not fill(seen + 1):
                raise ValueError(f"no record at byte {at}")
        version, *lines = held[:end].decode("utf-8").split(CRLF)
        if version != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        stop = end + 4 + int(head["Content-Length"])
        if not fill(stop + 4):
            raise ValueError(f"the record at byte {at} is cut off")
        yield at, head, bytes(held[end + 4 : stop])
        del held[: stop + 4]
        at += stop + 4


def url_key(url: str) -> str:
    """Sort key of a URL: reversed host labels, then the rest."""
    host, slash, rest = url.partition("://")[2].partition("/")
    return ",".join(reversed(host.lower().split("."))) + ")" + slash + rest if host else ""


def _page_of(record_id: str | None) -> int | None:
    if not record_id or ID_OF_PAGE not in record_id:
        return None
    n = int(record_id.split(ID_OF_PAGE)[1].rstrip(">").replace("-", ""), 16)
    return n - 2**64 if n >= 2**63 else n


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of all archives below ``path``: one run per archive, each sorted by URL key and time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") > 0)

    def index(batches):
        for b in batches:
            for archive, packed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                run = []
                for offset, head, block in parse_archive(packed.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    if head["WARC-Type"] == "response":
                        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if found != digest or len(payload) != size:
                            raise ValueError(f"{archive}: payload at {offset} does not match its digest")
                    run.append((url_key(head["WARC-Target-URI"]), head["WARC-Date"], _page_of(head["WARC-Record-ID"]), head["WARC-Type"], digest, size, _page_of(head.get("WARC-Refers-To")), archive, offset))
                run.sort(key=lambda r: (r[0], r[1], -(2**64) if r[2] is None else r[2]))
                yield dict(zip((x.split()[0] for x in RUN.split(", ")), map(list, zip(*run, strict=True)), strict=True)) if run else {x.split()[0]: [] for x in RUN.split(", ")}

    return arrow_stream(files, RUN, index, F.col("path"), F.col("content"))


class LoserTree:
    """Merges k sorted iterators: every inner node keeps the loser of its match, the winner moves up."""

    def __init__(self, runs: list, key):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, len(runs)
        self.head = [self._pull(i) for i in range(self.k)]
        self.loser = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _pull(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), i, row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or x is not None and x[:2] < y[:2]

    def _play(self, i: int) -> None:
        """Send run i up from its leaf; it swaps with whoever beats it, and the last winner goes to the root."""
        node = (i + self.k) // 2
        while node > 0:
            if self.loser[node] == -1:  # while building: wait for an opponent
                self.loser[node] = i
                return
            if self._beats(self.loser[node], i):
                self.loser[node], i = i, self.loser[node]
            node //= 2
        self.loser[0] = i

    def __iter__(self):
        while self.k:
            i = self.loser[0]
            if self.head[i] is None:
                return
            yield self.head[i][2]
            self.head[i] = self._pull(i)
            self._play(i)


def pieces_of_runs(parts: Iterator[pa.RecordBatch]) -> dict[str, list[pa.RecordBatch]]:
    """The rows of each archive's run, as they came, by archive; parts are sorted by archive."""
    by: dict[str, list[pa.RecordBatch]] = {}
    for b in parts:
        which = b.column("archive").dictionary_encode()
        cuts = [0, *(np.flatnonzero(np.diff(which.indices.to_numpy())) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            by.setdefault(which[i].as_py(), []).append(b.slice(i, j - i))
    return by


def _rows(pieces: list[pa.RecordBatch]) -> Iterator[tuple]:
    for p in pieces:
        for i in range(0, p.num_rows, 64):
            yield from zip(*(c.to_pylist() for c in p.slice(i, 64).columns), strict=True)


def merge_runs(runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """All index rows in global order of URL key and time.

    A range holds about MERGE_ROWS rows at most, as Arrow columns; the tree holds one row of each run.
    """
    n = ranges or max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(runs.count() / MERGE_ROWS))
    names = [x.split()[0] for x in RUN.split(", ")]
    dealt = runs.repartitionByRange(n, *KEYS).sortWithinPartitions("archive", *KEYS)

    def merge(parts):
        out = []
        for row in LoserTree([_rows(p) for p in pieces_of_runs(parts).values()], lambda r: (r[0], r[1], -(2**64) if r[2] is None else r[2])):
            out.append(row)
            if len(out) >= 4096:
                yield dict(zip(names, map(list, zip(*out, strict=True)), strict=True))
                out = []
        yield dict(zip(names, map(list, zip(*out, strict=True)), strict=True)) if out else {x: [] for x in names}

    return arrow_stream(dealt, RUN, merge, *names)


def warc_table(pages: DataFrame) -> DataFrame:
    """The query's columns: written, read back and taken from the merged index."""
    spark = pages.sparkSession
    path = scratch_dir(spark)
    write_archives(pages, path)
    merged = merge_runs(materialise(capture_runs(spark, path)))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured_at")


SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p),
e AS (SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(h, CAST(5 * k + 1 AS INTEGER), 5))::BIGINT) AS v FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v[CAST(i // 4 + 1 AS INTEGER)] >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to,
       CASE WHEN position('://' IN url) = 0 OR split_part(split_part(url, '://', 2), '/', 1) = '' THEN '' ELSE
         array_to_string(list_reverse(string_split(lower(regexp_extract(substr(url, position('://' IN url) + 3), '^[^/]*')), '.')), ',') || ')' ||
         regexp_extract(substr(url, position('://' IN url) + 3), '^[^/]*(.*)$', 1) END AS urlkey,
       strftime(make_timestamp((1704067200 + page_id % 31536000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at
FROM e
"""
