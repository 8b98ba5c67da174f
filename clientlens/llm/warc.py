"""WARC archives of pages, and one capture index merged from their sorted runs."""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import io
import re
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientlens.llm import files
from clientlens.llm.common import shared_dir, stored

ARCHIVE_BYTES, FIRST_DATE = 16 << 20, dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
RUN_ROWS_PER_RANGE = 20_000
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed values of base32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RUN = "run string, seq bigint, urlkey string, stamp string, page_id bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, offset bigint, length bigint"
INDEX = RUN + ", nth bigint"


def base32_sha1(c: Column) -> Column:
    """Upper-case base32 of the SHA-1, from its hex digits, 20 bits at a time."""
    hexed = F.sha1(c)
    parts = []
    for i in range(8):
        v = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(ALPHABET), F.shiftright(v, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*parts)


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query; scheme, ``www.``, default port
    and fragment dropped.  A URL that cannot be split is its own key."""
    try:
        u = urlsplit((url or "").strip())
        host = re.sub(r"^www\d*\.", "", (u.hostname or "").lower())
        port = f":{u.port}" if u.port and u.port not in (80, 443) else ""
    except ValueError:
        return (url or "").lower()
    return f"{','.join(reversed(host.split('.')))}{port}){(u.path or '/').lower()}" + (f"?{u.query.lower()}" if u.query else "")


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, digest, size, first): ``first`` is the smallest
    page_id among records of an equal payload of at least ``min_bytes``.

    Groups form over ids and digests; the payloads themselves move only if the
    list of revisits is too large for Spark to broadcast by its own size check."""
    html = F.coalesce(F.col("html"), F.lit(""))
    d = pages.select(F.col("page_id").cast("bigint"), "url", html.alias("html")).withColumns(
        {"digest": base32_sha1(F.col("html")), "size": F.octet_length("html").cast("long")}
    )
    light = d.select("page_id", "digest", "size")
    firsts = light.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    again = light.join(firsts.where("n > 1 and first is not null"), "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    again = stored(again.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "first").distinct(), "revisits")
    return d.join(again, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")), "left").drop("_p", "_d")


def _date(page_id) -> dt.datetime:
    """A stable capture time for tables that carry none: ids are seconds."""
    return FIRST_DATE + dt.timedelta(seconds=(page_id or 0) % (10 * 365 * 86400))


def record(page_id, url, html: str, digest: str, size: int, first) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head and leaves the body out."""
    revisit = first is not None and first != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + html.encode()
    clean = re.sub(r"[\x00-\x20]+", "%20", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{clean}')}>",
        f"WARC-Date: {_date(page_id):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[6:6] = [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {first}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(roles: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """A gzip member per record in ``folder``; (archive, bytes) of each file."""

    def write(batches):
        from pyspark import TaskContext

        part, count, buf, n = TaskContext.get().partitionId(), 0, io.BytesIO(), 0

        def closed():
            uri = f"{folder}/part-{part:06d}-{count:05d}.warc.gz"
            files.write_whole(uri, buf.getvalue())
            return pa.RecordBatch.from_pydict({"archive": [uri], "bytes": [buf.tell()]})

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "size", "first")), strict=True):
                buf.write(gzip.compress(record(*row), 4, mtime=0))
                n += 1
                if buf.tell() >= archive_bytes:
                    yield closed()
                    count, n, buf = count + 1, 0, io.BytesIO()
        if n:
            yield closed()

    return roles.mapInArrow(write, "archive string, bytes bigint")


def _members(uri: str, window: int = 1 << 20):
    """(offset, length, record), reading the archive a window at a time."""
    system, path = files.open_fs(uri)
    with system.open_input_file(path) as f:
        at, held, z, out = 0, b"", None, []
        start = 0
        while True:
            if not held:
                held = f.read(window)
                if not held:
                    break
            if z is None:
                z, out, start = zlib.decompressobj(31), [], at
            before = len(held)
            out.append(z.decompress(held))
            held = z.unused_data if z.eof else b""
            at += before - len(held)
            if z.eof:
                yield start, at - start, b"".join(out)
                z = None
        if z is not None:
            raise OSError(f"{uri}: the last record is cut off")


def parse_record(body: bytes) -> dict:
    """Headers and checked payload facts of one record."""
    head, rest = body.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if h["WARC-Type"] == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError("payload differs from its digest or length")
    refers = h.get("X-Refers-To-Page-Id")
    return {
        "urlkey": url_key(h["WARC-Target-URI"]), "stamp": re.sub(r"\D", "", h["WARC-Date"]),
        "page_id": int(h["X-Page-Id"]) if h["X-Page-Id"] else None, "record_type": h["WARC-Type"],
        "payload_bytes": size, "payload_digest": digest, "refers_to": int(refers) if refers else None,
    }


_RUN_NAMES = [c.split()[0] for c in RUN.split(", ")]
_ARROW = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in INDEX.split(", ")])


def order(r) -> tuple:
    """Order of captures: URL key, time, page; nulls first."""
    return r["urlkey"], r["stamp"], -1 if r["page_id"] is None else r["page_id"]


def read_runs(archives: DataFrame) -> DataFrame:
    """Every archive read back to its captures, sorted within the archive."""

    def read(batches):
        for b in batches:
            for uri in b.column("archive").to_pylist():
                rows = [parse_record(body) | {"offset": at, "length": size} for at, size, body in _members(uri)]
                rows.sort(key=order)
                for i, r in enumerate(rows):
                    r |= {"run": uri.rsplit("/", 1)[1], "seq": i}
                cols = [pa.array([r[c] for r in rows], _ARROW.field(c).type) for c in _RUN_NAMES]
                yield pa.RecordBatch.from_arrays(cols, _RUN_NAMES)

    return archives.select("archive").mapInArrow(read, RUN)


class LoserTree:
    """Merges sorted runs: inner nodes keep the loser of their match, so taking
    the next row replays one path from a leaf to the root."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.losers = [-1] * self.size
        win = [i if i < len(runs) else -1 for i in range(self.size)]
        base = self.size
        while len(win) > 1:
            base //= 2
            pairs = [self._match(a, b) for a, b in zip(win[::2], win[1::2], strict=True)]
            for k, (_, loser) in enumerate(pairs):
                self.losers[base + k] = loser
            win = [w for w, _ in pairs]
        self.winner = win[0] if win else -1

    def _key(self, run: int):
        if run < 0 or self.at[run] >= len(self.runs[run]):
            return None
        return self.runs[run][self.at[run]]

    def _match(self, a: int, b: int) -> tuple[int, int]:
        x, y = self._key(a), self._key(b)
        return (a, b) if y is None or (x is not None and (x, a) <= (y, b)) else (b, a)

    def __iter__(self):
        while self.runs and (key := self._key(self.winner)) is not None:
            yield key
            w = self.winner
            self.at[w] += 1
            node = (self.size + w) // 2
            while node:
                w, self.losers[node] = self._match(w, self.losers[node])
                node //= 2
            self.winner = w


def _merged(batches):
    runs: dict[str, list] = {}
    for b in batches:
        for r in b.to_pylist():
            runs.setdefault(r["run"], []).append(r)
    rows = {name: [(*order(r), k, i) for i, r in enumerate(rs)] for k, (name, rs) in enumerate(sorted(runs.items()))}
    names, out, last, nth = list(rows), [], None, 0
    for urlkey, _, _, k, i in LoserTree(list(rows.values())):
        row = runs[names[k]][i]
        nth = nth + 1 if urlkey == last else row["before"] + 1
        last = urlkey
        out.append(row | {"nth": nth})
        if len(out) == 5000:
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def merge_runs(runs: DataFrame, rows_per_range: int = RUN_ROWS_PER_RANGE) -> DataFrame:
    """One capture index in (urlkey, stamp, page_id) order from sorted runs.

    Ranges of that order are cut so that a task holds about ``rows_per_range``
    index rows (never payloads); within a range every run's stretch is in order
    already, and a loser tree merges them.  One URL's captures may span ranges:
    ``nth`` goes on from the count of them in earlier ranges.
    """
    n = int(max(1, -(-runs.count() // rows_per_range)))
    cut = runs.repartitionByRange(n, "urlkey", "stamp", F.coalesce("page_id", F.lit(-1)))
    cut = stored(cut.withColumn("range", F.spark_partition_id()), "warc-ranges")
    earlier = Window.partitionBy("urlkey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy("urlkey", "range").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(earlier))
    before = before.where("before > 0").select("urlkey", "range", "before")
    return (
        cut.join(before, ["urlkey", "range"], "left").withColumn("before", F.coalesce("before", F.lit(0)))
        .repartitionByRange(n, "range")
        .sortWithinPartitions("run", "seq")
        .mapInArrow(_merged, INDEX)
    )


def warc_index(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as WARC archives, read them back, merge their indexes.

    Defined cases: null html is an empty payload and null url an empty target; a
    null page_id never is the one referred to unless all of its payload are null
    (then all are responses); rows that repeat the smallest page_id are responses;
    an empty table gives an empty index; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    archives = stored(write_archives(with_roles(pages, min_bytes), folder), "warc-files")
    total = archives.agg(F.sum("bytes")).first()[0] or 0
    k = int(max(spark.sparkContext.defaultParallelism, -(-total // ARCHIVE_BYTES)))
    runs = stored(read_runs(archives.repartition(k)), "warc-runs")
    return merge_runs(runs)


def op10(spark, sf_dir: str) -> DataFrame:
    out = warc_index(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (
  SELECT page_id, strlen(h) AS payload_bytes, x,
         list_aggregate(list_transform(range(0, 32), lambda i:
           substr('{ALPHABET}',
                  (((('0x' || substr(x, (i // 4) * 5 + 1, 5))::INTEGER) >> ((3 - i % 4) * 5)::INTEGER) & 31) + 1, 1)),
           'string_agg', '') AS payload_digest
  FROM p),
f AS (SELECT x, min(page_id) AS first FROM d GROUP BY x)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN d.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id = f.first THEN NULL ELSE f.first END AS refers_to
FROM d JOIN f USING (x)
"""
