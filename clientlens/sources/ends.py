"""The ends of log files: first lines and last bytes, to order and prune files
without reading them."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEAD_LINES = 256
#: First and largest window of bytes at a file's end; each try takes four times as many.
TAIL, MOST_TAIL = 1 << 16, 1 << 20
MAX_LINE = 1 << 20
SCHEMA = "file string, part string, line bigint, value string, bytes_read bigint"


def list_files(spark: SparkSession, paths: list[str]) -> list[tuple[str, int]]:
    """(path, size) of the files that paths, folders and patterns name, in the order
    given; those of a folder or pattern by name.  A path given twice is there twice."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []

    def add(system, status) -> None:
        if status.isDirectory():
            inner = sorted(system.listStatus(status.getPath()), key=lambda s: s.getPath().getName())
            for s in inner:
                if not s.getPath().getName().startswith(("_", ".")):
                    add(system, s)
        else:
            out.append((status.getPath().toString(), status.getLen()))

    for p in paths:
        path = hadoop.Path(p)
        system = path.getFileSystem(conf)
        found = system.globStatus(path)
        if not found:
            raise FileNotFoundError(p)
        for status in sorted(found, key=lambda s: s.getPath().toString()):
            add(system, status)
    return out


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and place of a path as Hadoop writes it."""
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


class End(InputPartition):
    def __init__(self, file: str, size: int, tail: int):
        self.file, self.size, self.tail = file, size, tail


class _Counted(io.RawIOBase):
    """A file handle that counts the bytes read from it."""

    def __init__(self, handle):
        self.handle, self.n = handle, 0

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.handle.read(len(into))
        into[: len(data)] = data
        self.n += len(data)
        return len(data)


class EndsReader(DataSourceReader):
    """Two byte ranges a file: its head, and ``tail`` bytes before its end."""

    def __init__(self, options):
        self.files = [f.rsplit("|", 1) for f in options["files"].split("\n") if f]
        self.tail = int(options["tail"])

    def partitions(self):
        return [End(f, int(size), self.tail) for f, size in self.files] or [End("", 0, 0)]

    def read(self, part: End) -> Iterator[tuple]:
        if not part.file:
            return
        system, path = opened(part.file)
        packed = part.file.endswith(".gz")
        if part.tail:
            if packed or not part.size:
                return
            with system.open_input_file(path) as f:
                n = min(part.tail, part.size)
                f.seek(part.size - n)
                pieces = f.read(n).split(b"\n")
                # the first piece is the end of a longer line, unless the file begins there
                for k, piece in enumerate(pieces):
                    if (k or n == part.size) and piece.strip():
                        yield part.file, "tail", k, piece.decode("utf-8", "replace"), n
            return
        with system.open_input_file(path) as f:
            raw = _Counted(f)
            handle = io.BufferedReader(raw, 1 << 14)
            handle = gzip.GzipFile(fileobj=handle) if packed else handle
            for k in range(HEAD_LINES):
                line = handle.readline(MAX_LINE)
                if not line:
                    return
                yield part.file, "head", k, line.rstrip(b"\r\n").decode("utf-8", "replace"), raw.n


class LogEnds(DataSource):
    """``spark.read.format("log_ends")``: lines at the ends of files."""

    @classmethod
    def name(cls):
        return "log_ends"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return EndsReader(self.options)


def read_ends(spark: SparkSession, files: list[tuple[str, int]], tail: int = 0) -> DataFrame:
    """Lines of the heads of ``files``, or, with ``tail``, of so many last bytes."""
    spark.dataSource.register(LogEnds)
    return spark.read.format("log_ends").option("files", "\n".join(f"{f}|{n}" for f, n in dict(files).items())).option("tail", tail).load()


def spans(spark: SparkSession, files: list[tuple[str, int]], parse, tails: bool = True) -> list[dict]:
    """One dict a distinct file: file, size, first and last time (or None) and
    bytes_read.

    ``parse`` makes entries of lines.  Heads are read once; files whose last 64 KiB
    have no time are tried again with four times as many bytes, up to 1 MiB; .gz
    files have no cheap end.  A row a file comes to the driver, as its name did.
    """

    def times(lines: DataFrame, pick) -> dict[str, tuple]:
        entries = parse(lines.withColumn("seq", F.struct("file", "line", "bytes_read")))
        t = F.when(F.col("skip_reason").isNull() & F.col("ts").isNotNull(), F.col("seq.line"))
        rows = entries.groupBy(F.col("seq.file").alias("file")).agg(F.unix_micros(pick("ts", t)).alias("us"), F.max("seq.bytes_read").alias("n")).collect()
        return {r["file"]: (r["us"], r["n"]) for r in rows}

    out = {f: {"file": f, "size": n, "first": None, "last": None, "bytes_read": 0} for f, n in files}
    for f, (us, n) in times(read_ends(spark, files), F.min_by).items():
        out[f]["first"] = us
        out[f]["bytes_read"] += n
    todo = [(f, x["size"]) for f, x in out.items() if x["first"] is not None and not f.endswith(".gz") and x["size"]] if tails else []
    tail = TAIL
    while todo:
        for f, (us, n) in times(read_ends(spark, todo, tail), F.max_by).items():
            out[f]["last"] = us
            out[f]["bytes_read"] += n
        todo = [(f, n) for f, n in todo if out[f]["last"] is None and n > tail] if tail < MOST_TAIL else []
        tail = min(tail * 4, MOST_TAIL)
    return list(out.values())


def order_logs(
    spark: SparkSession, files: list[tuple[str, int]], parse, since_seconds: float | None = None, from_latest: bool = False, now: float | None = None
) -> tuple[list[tuple[str, int]], float | None, list[dict]]:
    """(files in order of time, start of the window, spans).

    Files without a time come first, in the order given, and always stay.  With
    ``since_seconds`` the window ends ``now``, or with ``from_latest`` at the newest
    time of the files; files that end before it go.  A .gz ends where the next
    file begins, the last one is kept.
    """
    found = {s["file"]: s for s in spans(spark, files, parse, tails=since_seconds is not None)}
    untimed = [f for f in files if found[f[0]]["first"] is None]
    timed = sorted((f for f in files if found[f[0]]["first"] is not None), key=lambda f: found[f[0]]["first"])
    if since_seconds is None:
        return untimed + timed, None, list(found.values())
    seen = [found[f[0]] for f in timed]
    if from_latest and seen:
        anchor = max(s["first"] if s["last"] is None else s["last"] for s in seen)
    else:
        import time

        anchor = int((time.time() if now is None else now) * 1e6)
    start = anchor - int(since_seconds * 1e6)
    kept = []
    for k, f in enumerate(timed):
        upper = seen[k]["last"]
        if upper is None and k + 1 < len(seen):
            upper = seen[k + 1]["first"]
        if upper is None or upper >= start:
            kept.append(f)
    return untimed + kept, start / 1e6, list(found.values())
