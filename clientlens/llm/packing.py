"""Packing documents into fixed-length sequences along a Hilbert curve."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.llm import tokens

LENGTH = 1024
DIMS, BITS, CELLS, SEED = 3, 16, 256, 20240229
#: A range holds at most about so many bytes of text, and where texts are few
#: enough for a range of LEAST_BYTES a core, fewer.
BYTES_PER_PARTITION, LEAST_BYTES, RANGES_PER_CORE = 128 << 20, 1 << 20, 6
ROWS_AT_ONCE = 128
#: Pieces in one batch of results.
PIECES_AT_ONCE = 4096
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows), by the
    transpose method: undo excess work from the top bit, then Gray encode."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def document_vectors(texts: list[bytes]) -> np.ndarray:
    """Hashed byte-pair counts of whole texts, log-damped, of unit length."""
    out = np.zeros((len(texts), CELLS), dtype=np.float64)
    for k, t in enumerate(texts):
        b = np.frombuffer(t, dtype=np.uint8)
        if len(b) > 1:
            out[k] = np.bincount((b[:-1] * np.uint8(167)) ^ (b[1:] * np.uint8(59)), minlength=CELLS)
    out = np.log1p(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def curve_keys(texts: list[bytes]) -> np.ndarray:
    """Hilbert keys of texts, from a fixed random projection to a few dimensions."""
    plane = np.random.default_rng(SEED).normal(size=(CELLS, DIMS)) / np.sqrt(CELLS)
    at = np.round(document_vectors(texts) @ plane, 9)  # the same key on any machine
    top = (1 << BITS) - 1
    return hilbert_key(np.clip((at * 4 + 0.5) * top, 0, top).astype(np.int64))


def _keyed(batches):
    for b in batches:
        raw, keys = b.column("text").cast(pa.binary()), []
        for lo in range(0, len(raw), ROWS_AT_ONCE):
            keys.extend(curve_keys([x or b"" for x in raw.slice(lo, ROWS_AT_ONCE).to_pylist()]).tolist())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(keys, pa.int64())], ["doc_id", "text", "_key"])


class Packer:
    """Cuts one range of the curve into sequences, document after document."""

    def __init__(self, path: str, length: int, base: int):
        self.words, self.length, self.seq, self.at = tokens.pieces(path), length, base, 0

    def add(self, doc_id, text: str, out: list) -> None:
        ids = np.append(np.frombuffer(self.words.ids(text), dtype="<u2").astype("<u4"), np.uint32(0)).astype("<u4")
        n, raw, start = len(ids), ids.tobytes(), 0
        while start < n:
            size = min(n - start, self.length - self.at)
            crc = zlib.crc32(raw[4 * start : 4 * (start + size)])
            out.append((doc_id, start, size, crc, n, self.seq, self.at))
            start, self.at = start + size, self.at + size
            if self.at == self.length:
                self.seq, self.at = self.seq + 1, 0


def pack(docs: DataFrame, vocab: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents in sequences of at most ``length`` tokens.

    Documents are ordered along a Hilbert curve through hashed, projected text
    vectors (ties by a hash of the id), range partitioned by that order, and each
    range is packed end to end, cutting documents where a sequence is full.  Only
    a range's last sequence may be short.  Sequence ids are unique, not dense.

    Defined cases: a null text is an empty one: its end mark alone is packed; a
    null doc_id is packed as null; repeated rows are packed each; an empty table
    gives no pieces; other columns are ignored.

    Plan: one range exchange of texts; tokens are made after it and never
    shuffled.  A group of equal texts has one key, and ties let the range
    partitioner split it over tasks.
    """
    path = vocab or tokens.vocab_path()
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    ranges = int(max(1, -(-total // BYTES_PER_PARTITION), min(RANGES_PER_CORE * cores, total // LEAST_BYTES)))
    keyed = (
        d.mapInArrow(_keyed, "doc_id bigint, text string, _key bigint")
        .withColumn("_tie", F.xxhash64("doc_id", "_key"))
        .repartitionByRange(ranges, "_key", "_tie")
        .sortWithinPartitions("_key", "_tie", "doc_id")
        .select("doc_id", "text")
    )
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def packed(batches):
        from pyspark import TaskContext

        p, out = Packer(path, length, TaskContext.get().partitionId() << 32), []

        def made():
            cols = list(zip(*out, strict=True)) or [[] for _ in names]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        for b in batches:
            for doc_id, text in zip(b.column("doc_id"), b.column("text"), strict=True):  # one text at a time
                p.add(doc_id.as_py(), text.as_py(), out)
                if len(out) >= PIECES_AT_ONCE:
                    yield made()
        yield made()
        pa.default_memory_pool().release_unused()

    return keyed.mapInArrow(packed, SCHEMA)


def op3(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
