"""Periodic runs of words: all-lag scan, its document-lag ranges dealt over the cluster."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.llm.common import WORD, parallelism, row_key, stored

#: A run has at least as many words, and at least as many periods.
LEAST_WORDS, LEAST_EXPONENT = 12, 2
#: Word pairs compared in one document-lag range, and in one array operation.
WORK, CELLS = 4_000_000_000, 1 << 18
#: Texts below this many characters never need more than one range.
SHORT = 100_000
#: Shortest stretch of equal pairs that can be a run: lag p needs max(12 - p, p) of them.
LEAST_STRETCH = 6

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUN_KIND = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def words_of(text: bytes | None, doc_id=None, plant: bool = True) -> list[bytes]:
    """Words of a text; with ``plant`` every tenth document, by a checksum of its
    id, repeats the words after a place with a period, as the query's contract says."""
    w = (text or b"").split()
    if plant and w and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            tail = w[a : a + p]
            w[a:] = (tail * ((n - a) // p + 1))[: n - a]
    return w


def word_ids(words: list[bytes]) -> np.ndarray:
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


def string_ids(ids: np.ndarray) -> np.ndarray:
    """Ids of the six words from each place on, equal for equal strings only."""

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = a * (int(b.max(initial=0)) + 1) + b
        return np.unique(both, return_inverse=True)[1]

    two = joined(ids[:-1], ids[1:])
    four = joined(two[:-2], two[2:])
    six = joined(four[:-2], two[4:])
    most = int(six.max(initial=0)) + 1
    return six.astype(np.uint8 if most < 255 else np.uint16 if most < 65535 else np.uint32)


def stretches(ids: np.ndarray, low: int, high: int) -> dict[tuple[int, int], int]:
    """{(start, length): period} of the runs that lags low..high-1 show, with the
    smallest such lag.

    The word ids, taken as strings of the six words that a run needs equal at least,
    are compared with themselves shifted by each lag, a few lags to an array, and
    stretches of equal places are measured.  A stretch of a multiple of the period
    has the same start and length as that of the period itself, so the smallest lag
    of each is its period.
    """
    out: dict[tuple[int, int], int] = {}
    high = min(high, len(ids) // LEAST_EXPONENT + 1)
    if len(ids) < LEAST_WORDS or low >= high:
        return out
    strings = string_ids(ids)
    n = len(strings)
    # beyond the end stands a string that is equal to none
    wide = np.concatenate([strings, np.full(high, strings.max() + 1, strings.dtype)])
    per = max(1, CELLS // n)
    for p in range(low, high, per):
        q, m = min(p + per, high), n - p
        same = np.lib.stride_tricks.as_strided(wide[p:], (q - p, m), (wide.itemsize, wide.itemsize), writeable=False) == strings[:m]
        if not same.any():
            continue
        at = np.flatnonzero(same)
        lag, place = at // m + p, at % m
        first = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (place == 0))
        lag, place = lag[first], place[first]
        size = np.diff(first, append=len(at)) + LEAST_STRETCH - 1
        good = size >= np.maximum(LEAST_WORDS - lag, (LEAST_EXPONENT - 1) * lag)
        for s, length, k in zip(place[good].tolist(), (size + lag)[good].tolist(), lag[good].tolist(), strict=True):
            out.setdefault((s, length), k)
    return out


def report(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """n_runs, the longest run's four numbers, and both digests; runs by start."""
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    keep = np.ones(len(words) + 1, np.int64)
    gone = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        gone[s + q] += 1
        gone[s + n] -= 1
    keep = np.cumsum(gone)[: len(words)] == 0
    text = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k) if runs else b" ".join(words)
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *top, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(left).hexdigest()


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli"]


def _batch(doc_ids, reports: list[tuple], runs: list[list]) -> pa.RecordBatch:
    cols = list(zip(*reports, strict=True)) or [()] * 7
    made = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.string()) for c in cols[5:]]
    found = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], RUN_KIND)
    return pa.RecordBatch.from_arrays([doc_ids, *made, found], names=["doc_id", *COLUMNS, "runs_sha256", "collapsed_sha256", "runs"])


def periodic_runs(docs: DataFrame, plant: bool = False, work: int = WORK, short: int = SHORT) -> DataFrame:
    """Per document (doc_id, text): its runs and what is left without repetition.

    A run is a stretch of words with smallest period q, at least 12 and at least
    2*q words long, that no neighbour extends.  Every lag up to half the words is
    compared in full.  A document of more than ``work`` pairs is dealt in ranges
    of lags to several tasks, and its ranges meet again by document: their number
    grows with the square of the words, each of them takes a copy of the text.

    Null and empty texts have no words and no runs; rows that repeat each give a
    row; a null doc_id stays null (and is never planted in); an empty table gives
    an empty one.  Other columns are left out.  ``runs`` lists the runs by start,
    then period.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} bigint' for c in COLUMNS)}, runs_sha256 string, collapsed_sha256 string, runs {RUNS}"
    n = F.regexp_count("text", F.lit(WORD)).cast("double")
    ranges = F.when(F.char_length("text") < short, F.lit(1)).otherwise(F.greatest(F.ceil(n * n * 0.375 / work), F.lit(1)).cast("int"))
    given = docs.select("doc_id", "text", F.coalesce(ranges, F.lit(1)).alias("_ranges"))

    def whole(batches):
        for batch in batches:
            ids, text = batch.column(0), batch.column(1).cast(pa.binary())
            for i in range(0, batch.num_rows, 256):
                reports, runs = [], []
                for k in range(i, min(i + 256, batch.num_rows)):
                    words = words_of(text[k].as_py(), ids[k].as_py(), plant)
                    found = stretches(word_ids(words), 1, len(words) // LEAST_EXPONENT + 1)
                    runs.append(sorted(((s, size, q) for (s, size), q in found.items()), key=lambda r: (r[0], r[2])))
                    reports.append(report(words, runs[-1]))
                yield _batch(ids.slice(i, 256), reports, runs)

    one = given.where("_ranges = 1").select("doc_id", "text").mapInArrow(whole, schema)

    def some(batches):
        for batch in batches:
            key, ids, low, high = batch.column(0), batch.column(1), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            text = batch.column(2).cast(pa.binary())
            for k in range(batch.num_rows):
                words = words_of(text[k].as_py(), ids[k].as_py(), plant)
                most = len(words) // LEAST_EXPONENT + 1
                # ranges are shares of the lags
                found = stretches(word_ids(words), 1 + int((most - 1) * low[k]), 1 + int((most - 1) * high[k]))
                rows = [{"start": s, "length": size, "period": q} for (s, size), q in found.items()]
                yield pa.RecordBatch.from_arrays([key.slice(k, 1), pa.array([rows], RUN_KIND)], names=["_key", "runs"])

    def finish(batches):
        for batch in batches:
            ids, text = batch.column(0), batch.column(1).cast(pa.binary())
            for k in range(batch.num_rows):
                words = words_of(text[k].as_py(), ids[k].as_py(), plant)
                runs = [(r["start"], r["length"], r["period"]) for r in batch.column(2)[k].as_py() or ()]
                yield _batch(ids.slice(k, 1), [report(words, runs)], [runs])

    # rows that repeat an id and a text are scanned once
    long = given.where("_ranges > 1").groupBy("doc_id", "text", "_ranges").agg(F.count(F.lit(1)).alias("_copies"))
    long = stored(long.withColumn("_key", row_key()), "long-texts")
    parts = long.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_ranges") - 1)))
    parts = parts.repartition(parallelism(docs.sparkSession) * 4, "_key", "_part").select(
        "_key", "doc_id", "text", (F.col("_part") / F.col("_ranges")).alias("low"), ((F.col("_part") + 1) / F.col("_ranges")).alias("high")
    )
    found = parts.mapInArrow(some, f"_key binary, runs {RUNS}").select("_key", F.explode("runs").alias("r"))
    found = found.groupBy("_key", "r.start", "r.length").agg(F.min("r.period").alias("period"))
    found = found.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    # array_sort goes by start, then length: of one start the period decides
    by_period = F.transform(F.array_sort(F.transform("runs", lambda r: F.struct(r["start"], r["period"], r["length"]))), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
    met = long.join(found.withColumn("runs", by_period), "_key", "left")
    many = met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("doc_id", "text", "runs").mapInArrow(finish, schema)
    return one.union(many)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True).drop("runs")
