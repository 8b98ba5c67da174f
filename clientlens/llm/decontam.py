"""Benchmark decontamination: words of documents that lie in windows of a benchmark."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.llm.common import stored, worker_store

WINDOW = 10
#: Windows in one broadcast; a larger benchmark is searched for in several passes.
BLOCK_WINDOWS = 200_000
#: Words of a piece of an item; pieces overlap, so that they hold all its windows.
PIECE_WORDS = 20_000
#: Bytes of text searched at once, and of the parts of it that advance together.
SLICE, PART = 2 << 20, 1024
BLOCK = 8
#: A-Z become a-z; what is neither a digit, a letter nor beyond ASCII is a space.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def _little(rows: np.ndarray) -> np.ndarray:
    """Rows of up to 8 bytes as one number each."""
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view("<u8").ravel()


def _slot(block: np.ndarray, bits: int) -> np.ndarray:
    return ((block * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Table:
    """Shift table and buckets of test strings of similar length.

    Only the first ``m`` bytes of each string, the length of the shortest, enter
    the tables.  ``shift`` says by a block of text how far its end may move
    before a string can end there; where it is 0, a bucket, found by that block and
    the string's first bytes, names the lengths to compare.
    """

    def __init__(self, strings: list[bytes]):
        self.m = m = min(map(len, strings))
        self.b = b = min(BLOCK, m)
        heads = np.frombuffer(b"".join(s[:m] for s in strings), np.uint8).reshape(-1, m)
        self.most = min(m - b + 1, 255)
        self.bits = int(np.clip(np.ceil(np.log2(32 * self.most * len(strings))), 12, 24))
        self.shift = np.full(1 << self.bits, self.most, np.uint8)
        for back in range(self.most - 1, -1, -1):
            self.shift[_slot(_little(heads[:, m - b - back : m - back]), self.bits)] = back
        keys = self._key(_little(heads[:, m - b :]), _little(heads[:, :b]))
        self.lengths: dict[int, list[int]] = {}
        for k, s in zip(keys.tolist(), strings, strict=True):
            have = self.lengths.setdefault(k, [])
            if len(s) not in have:
                have.append(len(s))
        self.keys = np.unique(keys)

    @staticmethod
    def _key(last: np.ndarray, first: np.ndarray) -> np.ndarray:
        return last * np.uint64(0xC2B2AE3D27D4EB4F) ^ (first * np.uint64(0x165667B19E3779F9) >> np.uint64(7))

    def candidates(self, text: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(start, lengths to compare) wherever block and first bytes fit a bucket."""
        m, b = self.m, self.b
        if len(text) < m:
            return
        cols = np.arange(b)
        at = np.arange(m - 1, len(text), PART)
        end = np.minimum(at + PART, len(text))
        while len(at):
            block = _little(text[at[:, None] - (b - 1) + cols])
            step = self.shift[_slot(block, self.bits)].astype(np.int64)
            hit = step == 0
            if hit.any():
                start = at[hit] - (m - 1)
                key = self._key(block[hit], _little(text[start[:, None] + cols]))
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                for s, k in zip(start[(ok := self.keys[place] == key)].tolist(), key[ok].tolist(), strict=True):
                    yield s, self.lengths[k]
                step[hit] = 1
            at = at + step
            go = at < end
            at, end = at[go], end[go]


class Windows:
    """All windows of some pieces of items, ready to search texts for."""

    def __init__(self, pieces: list[tuple[str | None, bytes]]):
        self.items: dict[bytes, set] = {}
        for item, text in pieces:
            w = text.split(b" ")
            k = min(WINDOW, len(w))
            for i in range(len(w) - k + 1):
                self.items.setdefault(b" %b " % b" ".join(w[i : i + k]), set()).add(item)
        by: dict[int, list[bytes]] = {}
        for s in self.items:
            by.setdefault(min(len(s), 128).bit_length(), []).append(s)
        self.tables = [Table(s) for s in by.values()]

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, bytes]]:
        """(text, start, end, window) of every occurrence; texts begin and end with
        a space and have single spaces between words."""
        whole = b"\0".join(texts)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        flat = np.frombuffer(whole, np.uint8)
        for t in self.tables:
            for s, lengths in t.candidates(flat):
                for n in lengths:
                    if len(found := whole[s : s + n]) == n and found in self.items:
                        k = int(np.searchsorted(begins, s, "right")) - 1
                        yield k, s - int(begins[k]), s - int(begins[k]) + n, found

    def hits(self, texts: list[bytes]) -> list[tuple[list[tuple[int, int]], set]]:
        """For each text its hit stretches of words, apart and in order, and the items."""
        found: dict[int, list] = {}
        for k, a, b, window in self.search(texts):
            found.setdefault(k, []).append((a, b, window))
        out: list[tuple[list[tuple[int, int]], set]] = [([], set())] * len(texts)
        for k, hits in found.items():
            gaps = np.flatnonzero(np.frombuffer(texts[k], np.uint8) == 32)
            spans: list[list[int]] = []
            items: set = set()
            for a, b, window in sorted(hits, key=lambda h: h[0]):
                a, b = int(np.searchsorted(gaps, a)), int(np.searchsorted(gaps, b - 1))
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
                items |= self.items[window]
            out[k] = ([(a, b) for a, b in spans], {x for x in items if x is not None})
        return out


def built(name: str, pieces: list[tuple[str | None, bytes]]) -> Windows:
    """The tables of one block, made once in a worker; one block is kept at a time."""
    return worker_store(f"windows {name}", lambda: Windows(pieces))


def item_pieces(benchmark: DataFrame, piece_words: int = PIECE_WORDS) -> DataFrame:
    """(item, text, windows): items' words with single spaces, long ones in pieces
    that overlap by a window less a word.  An item without words gives no row."""

    def cut(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                w = words_of(text)
                for i in range(0, max(1, len(w) - WINDOW + 1), piece_words - WINDOW + 1):
                    if part := w[i : i + piece_words]:
                        rows.append((item, b" ".join(part), max(1, len(part) - WINDOW + 1)))
            item, text, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(text, pa.binary()), pa.array(n, pa.int64())], names=["item", "text", "windows"])

    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(cut, "item string, text binary, windows bigint")


def blocks(pieces: DataFrame, most: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Pieces in lists of about ``most`` windows, streamed from the table."""
    block, n = [], 0
    for r in pieces.toLocalIterator():
        if block and n + r.windows > most:
            yield block
            block, n = [], 0
        block.append((r.item, bytes(r.text)))
        n += r.windows
    if block:
        yield block


def search(docs: DataFrame, pieces: list[tuple[str | None, bytes]]) -> DataFrame:
    """(doc_id, text, n_words, spans, items) of every row, for one block of windows."""
    given, name = docs.sparkSession.sparkContext.broadcast(pieces), uuid.uuid4().hex
    out = docs.select("doc_id", "text")
    schema = "doc_id {}, _key binary, n_words bigint, spans array<struct<a:bigint,b:bigint>>, items array<string>".format(docs.schema["doc_id"].dataType.simpleString())
    kinds = [pa.binary(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.list_(pa.string())]

    def run(batches):
        windows = built(name, given.value)
        for batch in batches:
            text = batch.column(2).cast(pa.binary())
            i = 0
            while i < batch.num_rows:
                # a few megabytes of text at a time
                texts, counts, size, j = [], [], 0, i
                while j < batch.num_rows and (j == i or size < SLICE):
                    w = words_of(text[j].as_py())
                    texts.append(b" %b " % b" ".join(w))
                    counts.append(len(w))
                    size += len(texts[-1])
                    j += 1
                found = windows.hits(texts)
                cols = [counts, [[{"a": a, "b": b} for a, b in s] for s, _ in found], [sorted(x) for _, x in found]]
                rest = [pa.array(c, k) for c, k in zip(cols, kinds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *rest], names=["doc_id", "_key", "n_words", "spans", "items"])
                i = j

    return out.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("_key"), "text").mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """Per document (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, and the hit stretches ``spans`` with the ``items``.

    Words are runs of digits, letters and anything beyond ASCII, A-Z lower-cased.  A
    window is ten consecutive words of an item, or all of a shorter item.  Windows
    are searched for by shift tables over blocks of eight bytes; a document is
    read once for each block of ``block_windows`` windows, once in all for a usual
    benchmark.

    Null and empty texts have no words; an empty benchmark hits nothing, an empty
    table gives an empty one.  Repeated rows each give a row.  Rows of the benchmark
    that repeat an item_id are one item; the windows of an item without an id hit,
    but it is not counted.  Other columns are left out, whatever their names.
    """
    pieces = stored(item_pieces(benchmark, piece_words), "benchmark-windows")
    parts = [search(docs, block) for block in blocks(pieces, block_windows)] or [search(docs, [])]
    if len(parts) == 1:
        found = parts[0]
    else:
        found = stored(parts[0].withColumn("_block", F.lit(0)), "windows-found")
        for k, part in enumerate(parts[1:], 1):
            found = found.union(stored(part.withColumn("_block", F.lit(k)), "windows-found"))
        # rows that repeat an id and a text are counted in one block and given as often
        found = (
            found.groupBy("doc_id", "_key", "n_words")
            .agg(F.count_if(F.col("_block") == 0).alias("_n"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
        )
    merged = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0).cast("bigint"))).alias("n")), lambda s: s["n"],
    )
    return found.withColumn("items", F.array_sort("items")).select(
        "doc_id", "n_words", merged.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (merged > 0).alias("contaminated"), F.array_sort("spans").alias("spans"), "items",
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return decontaminate(read("documents"), read("benchmark")).drop("spans", "items")


OP12_SQL = """
with d as (
  select doc_id, row_number() over () as r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as w
  from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as w
  from benchmark),
bw as (
  select distinct item_id, k, array_to_string(w[s:s + k - 1], ' ') as win
  from (select item_id, w, least(10, len(w)) as k, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) as s from b where len(w) > 0)),
dw as (
  select r, k, s, array_to_string(w[s:s + k - 1], ' ') as win
  from (select r, w, k, unnest(generate_series(1, len(w) - k + 1)) as s from d, (select distinct k from bw) where len(w) >= k)),
hit as (select r, s, dw.k, item_id from dw join bw on dw.k = bw.k and dw.win = bw.win),
hw as (select r, count(distinct i) as n_hit from (select r, unnest(generate_series(s, s + k - 1)) as i from (select distinct r, s, k from hit)) group by r),
hi as (select r, count(*) as n_items, string_agg(i, ',' order by i) as names from (select distinct r, cast(item_id as varchar) as i from hit where item_id is not null) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hw using (r) left join hi using (r)
"""
