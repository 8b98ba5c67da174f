"""Suffix-array dedup: remove bytes that a string of 100 bytes, seen earlier, covers.

A string of 100 bytes is owned by one of its 32-byte substrings, the one with the
smallest hash (winnowing), so equal strings anywhere have equal owners.  Owners
deal the strings to shards: all strings that can be equal meet in one shard, whose
suffix array, built by induced sorting, and common prefixes decide every class.

A stretch (the strings of one owner at one place) that occurs over and over goes
to its shard twice, from its first two places; a third and later place has the
owner and the 128 bits of hash of a stretch that is there, and starts later.  An
owner's shard is named by the text and page where it first occurs, so neighbouring
stretches mostly go to one shard and are laid down there as one piece; owners with
many surroundings have one of their own.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.llm.common import parallelism, stored
from clientlens.llm.shingles import mix64
from clientlens.llm.suffixes import common_prefixes, suffix_array

LENGTH, GRAM, WIDE = 100, 16, 32
SIDE = (LENGTH - GRAM) // 2  # a match reaches this far left or right of its owner
#: Bits of a hash of either side; two sides that only agree by chance are looked at.
SIDE_BITS = 16
CHUNK, PAGE = 1 << 18, 11  # bytes looked at in one go; bits of a place within a page
SHARD_BYTES = 1 << 17
#: Stretches are dealt in so many rounds, by owner: what a round shuffled is removed
#: before the next one shuffles, so disk holds one round's at a time.
ROUNDS = 2
#: Text bytes and stretches that a task of the two exchanges takes, about.
BYTES_PER_TASK, STRETCHES_PER_TASK = 16 << 20, 20_000
#: Owners with more surroundings than HOT, estimated on a SAMPLE-th of the texts, have
#: their strings dealt one by one; at most HOT_OWNERS of them, the most frequent.
HOT, SAMPLE, HOT_OWNERS = 1024, 16, 100_000
#: Owners with more surroundings than this have a shard of their own, so that the
#: shard of a page, which has some 50 owners, stays a small part of a task.
CROWDED = 64
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.uint64(pow(_BASE, 1 << i, 1 << 64)) for i in range(6)]
_POS = np.uint64((1 << 31) - 1)


def _chunks(texts: list[bytes]):
    """(number of the first text, texts) of about CHUNK bytes or one long text."""
    begin = held = 0
    for k, t in enumerate(texts):
        if held and held + len(t) > CHUNK:
            yield begin, texts[begin:k]
            begin, held = k, 0
        held += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]


def _grams(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the GRAM and of the WIDE bytes from each place."""
    h = b.astype(np.uint64) + np.uint64(1)
    for i in range(GRAM.bit_length() - 1):
        h = h[: -(1 << i)] * _POWERS[i] + h[1 << i :]
    return h, h[:-GRAM] * _POWERS[4] + h[GRAM:]


def owners(texts: list[bytes], turn: int | None = None) -> tuple[np.ndarray, ...]:
    """Per stretch (of the owners of one round, if ``turn`` names it): its owner's hash, a hash of the bytes its strings cover, hashes
    of what is left and right of the owner (in one number), number of its text,
    first string, last string and the owner's place.  Texts shorter than a string
    have none."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    b = np.frombuffer(b"".join(texts), np.uint8)
    n, w = len(b), LENGTH - GRAM + 1
    if n < LENGTH or size.max() < LENGTH:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, *[np.int64] * 5))
    h, wide = _grams(b)
    least = ((mix64(h) >> np.uint64(1)) & ~_POS) | np.arange(len(h), dtype=np.uint64)
    s = 1
    while 2 * s <= w:
        least, s = np.minimum(least[:-s], least[s:]), 2 * s
    if w > s:
        least = np.minimum(least[: s - w], least[w - s :])
    begin = np.cumsum(size) - size
    inside = np.zeros(n + 1, np.int64)  # places where a string starts that ends in its text
    long = size >= LENGTH
    inside[begin[long]] += 1
    inside[(begin + size)[long] - LENGTH + 1] -= 1
    v = np.flatnonzero(np.cumsum(inside)[: len(least)])
    at = (least[v] & _POS).astype(np.int64)
    new = np.append(True, (np.diff(at) != 0) | (np.diff(v) != 1))
    lo, p = v[new], at[new]
    hi = v[np.append(np.flatnonzero(new)[1:] - 1, len(v) - 1)]
    if turn is not None:
        own = (mix64(h[p]) >> np.uint64(32)) % np.uint64(ROUNDS) == turn
        lo, hi, p = lo[own], hi[own], p[own]
    end = hi + LENGTH
    ctx = ((end - lo) * 256 + (p - lo)).astype(np.uint64)
    for t in range(-(-(2 * LENGTH - GRAM) // WIDE)):
        ctx = mix64(ctx * _POWERS[0] + wide[np.minimum(lo + WIDE * t, end - WIDE)])
    # the outer WIDE of the SIDE bytes on either side, where the stretch reaches as far
    left = np.where(p - lo >= SIDE, mix64(wide[np.maximum(p - SIDE, 0)]) >> np.uint64(64 - SIDE_BITS), np.uint64(0))
    right = np.where(end - p - GRAM >= SIDE, mix64(wide[np.minimum(p + GRAM + SIDE - WIDE, n - WIDE)]) >> np.uint64(64 - SIDE_BITS), np.uint64(0))
    of = np.searchsorted(begin, lo, side="right") - 1  # of empty texts the last, which is none
    off = begin[of]
    return h[p], ctx, ((left << np.uint64(SIDE_BITS)) | right).astype(np.int64), of, lo - off, hi - off, p - off


def _pack(lo, hi):
    """Place of a run of strings in its text, in order of its first string."""
    return (lo << 32) | (hi - lo)


def _unpack(pos):
    lo = pos >> 32
    return lo, lo + (pos & 0xFFFFFFFF)


_FOUND = pa.schema([("h", pa.int64()), ("ctx", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("pos", pa.int64()), ("sides", pa.int64()), ("done", pa.bool_())])


def _strings(texts: list[bytes], of, lo, hi) -> tuple[np.ndarray, ...]:
    """The strings of some stretches one by one, as stretches of their own: their
    key is a hash of the whole string, and they need no look at their sides."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(size) - size
    n = hi - lo + 1
    start = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    of = np.repeat(of, n)
    _, wide = _grams(np.frombuffer(b"".join(texts), np.uint8))
    key, ctx = np.full(len(start), 7, np.uint64), np.full(len(start), 11, np.uint64)
    for at in (0, WIDE, 2 * WIDE, LENGTH - WIDE):
        g = wide[begin[of] + start + at]
        key, ctx = mix64(key * _POWERS[1] + g), mix64((ctx ^ g) * _POWERS[0])
    return key, ctx, np.zeros(len(start), np.int64), of, start, start


def _ranked(h, ctx, doc, tie, pos) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (h, ctx, doc, tie, pos) without rows that are there twice, which
    rows begin a class (h, ctx), and every row's number in its class from 0."""
    o = np.lexsort((pos, tie, doc, ctx, h))
    cols = [x[o] for x in (h, ctx, doc, tie, pos)]
    step = [np.append(True, x[1:] != x[:-1]) for x in cols]
    keep = step[0] | step[1] | step[2] | step[3] | step[4]
    new = (step[0] | step[1])[keep]
    at = np.arange(len(new))
    return o[keep], new, at - at[new][np.cumsum(new) - 1]


def _stretches(texts: list[bytes], hot: np.ndarray, turn: int | None = None) -> tuple[np.ndarray, ...]:
    found = owners(texts, turn)[:-1]
    if not len(hot) or not len(found[0]):
        return found
    at = np.minimum(np.searchsorted(hot, found[0]), len(hot) - 1)
    some = hot[at] == found[0]
    if not some.any():
        return found
    single = _strings(texts, *(x[some] for x in found[3:]))
    return tuple(np.concatenate([x[~some], y]) for x, y in zip(found, single, strict=True))


def _scan(hot: np.ndarray, turn: int):
    """Stretches of every text whose owner has its turn.  The third and later of a kind in a batch are done:
    they start again what starts earlier, so frequent ones stay few."""

    def scan(batches):
        for b in batches:
            docs, ties = (b.column(c).to_numpy() for c in ("doc", "tie"))
            cols = []
            for first, texts in _chunks(b.column("text").cast(pa.binary()).to_pylist()):
                h, ctx, sides, of, lo, hi = _stretches(texts, hot, turn)
                if len(h):
                    cols.append((h.view(np.int64), ctx.view(np.int64), docs[first + of], ties[first + of], _pack(lo, hi), sides))
            if not cols:
                continue
            h, ctx, doc, tie, pos, sides = map(np.concatenate, zip(*cols, strict=True))
            o, _, rank = _ranked(h, ctx, doc, tie, pos)
            h, ctx, doc, tie, pos, sides = (x[o] for x in (h, ctx, doc, tie, pos, sides))
            done = rank > 1
            h = np.where(done, mix64((doc ^ tie ^ (pos << 7)).view(np.uint64)).view(np.int64), h)  # done rows go anywhere
            ctx, sides = np.where(done, 0, ctx), np.where(done, 0, sides)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, ctx, doc, tie, pos, sides, done)], schema=_FOUND)

    return scan


def _contexts(batches):
    for b in batches:
        found = [owners(t)[:2] for _, t in _chunks(b.column("text").cast(pa.binary()).to_pylist())]
        if found:
            h, ctx = map(np.concatenate, zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ctx.view(np.int64))], ["h", "ctx"])


def hot_owners(d: DataFrame, hot: int, sample: int) -> np.ndarray:
    """Owners with more than about ``hot`` surroundings, sorted.  They only say how
    strings are dealt, not which are removed, so an estimate from the texts of
    every ``sample``-th key is enough; the list has HOT_OWNERS entries at most."""
    some = d.where(F.pmod(F.xxhash64("tie", "doc"), F.lit(sample)) == 0).select("text")
    n = some.mapInArrow(_contexts, "h bigint, ctx bigint").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rows = n.where(F.col("n") > max(1, hot // sample)).orderBy(F.col("n").desc(), "h").limit(HOT_OWNERS).select("h").collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(np.uint64))


_JUDGED = pa.schema([("shard", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("pos", pa.int64()), ("done", pa.bool_())])


def _judge(batches):
    """Of stretches in order of their owner: the third and later of a kind are
    done; the first two of a kind go to the shard, and so does one that is alone
    but agrees on a side with another kind of its owner.  Holds a batch and one owner."""
    held = None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        end = int(np.searchsorted(cols[0], cols[0][-1]))
        held = [x[end:] for x in cols]
        if end:
            yield _of_owners([x[:end] for x in cols])
    if held is not None:
        yield _of_owners(held)


def _of_owners(cols) -> pa.RecordBatch:
    h, ctx, doc, tie, pos, sides, done = cols
    out = [(np.zeros(int(done.sum()), np.int64), doc[done], tie[done], pos[done], np.ones(int(done.sum()), bool))]  # of any shard
    h, ctx, doc, tie, pos, sides = (x[~done] for x in (h, ctx, doc, tie, pos, sides))
    if len(h):
        o, new, rank = _ranked(h, ctx, doc, tie, pos)
        h, doc, tie, pos, sides = (x[o] for x in (h, doc, tie, pos, sides))
        look = rank == 1
        look[:-1] |= rank[1:] == 1
        first = np.flatnonzero(new)
        fh, fs = h[first], sides[first]
        for side in (fs >> SIDE_BITS, fs & ((1 << SIDE_BITS) - 1)):
            k = np.lexsort((side, fh))
            eq = (fh[k][1:] == fh[k][:-1]) & (side[k][1:] == side[k][:-1]) & (side[k][1:] != 0)
            look[first[k[1:][eq]]] = look[first[k[:-1][eq]]] = True
        # an owner's shard: the page of its first place, or its own
        o = np.lexsort((pos, tie, doc, h))
        page = mix64((mix64((doc ^ (tie << 1)).view(np.uint64)) + (pos >> (32 + PAGE)).view(np.uint64))).view(np.int64)
        head = np.append(True, h[1:] != h[:-1])  # the same places in both orders, h is their first key
        owner = np.cumsum(head) - 1
        crowded = np.bincount(owner, weights=new)[owner] > CROWDED
        shard = np.where(crowded, h, page[o][np.flatnonzero(head)][owner])
        for some, is_done in ((rank > 1, True), (look & (rank < 2), False)):
            out.append((np.where(is_done, 0, shard[some]), doc[some], tie[some], pos[some], np.full(int(some.sum()), is_done)))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=_JUDGED)


_CUT = pa.schema([("shard", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])


def _cut(batches):
    """The bytes of the stretches of each text that a shard looks into; stretches
    that follow on one another in one shard are one piece."""
    for b in batches:
        rows = []
        for doc, tie, text, items in zip(b.column("doc").to_pylist(), b.column("tie").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("items"), strict=True):
            shard, pos = (items.values.field(c).to_numpy() for c in ("shard", "pos"))
            o = np.lexsort((pos, shard))
            shard, (lo, hi) = shard[o], _unpack(pos[o])
            new = np.append(True, (shard[1:] != shard[:-1]) | (lo[1:] != hi[:-1] + 1))
            end = hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)] + LENGTH
            rows.extend((k, doc, tie, i, text[i:j]) for k, i, j in zip(shard[new].tolist(), lo[new].tolist(), end.tolist(), strict=True))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CUT, strict=True)], schema=_CUT)


def repeated_strings(doc: np.ndarray, ties: np.ndarray, starts: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """(doc, tie, pos) of the runs of strings in a shard that also start earlier in it.

    Pieces of equal bytes are laid down once, with all their places."""
    kind: dict[bytes, int] = {}
    of = np.array([kind.setdefault(x, len(kind)) for x in pieces])
    by = np.argsort(of, kind="stable")  # places, piece by piece
    n_places = np.bincount(of)
    place0 = np.cumsum(n_places) - n_places
    size = np.array([len(x) for x in kind], dtype=np.int64)
    begin = np.cumsum(size + 1) - size - 1
    t = np.frombuffer(b"\0".join(kind), dtype=np.uint8).astype(np.int64) + 2
    sep = (begin + size)[:-1]
    t[sep] = 1
    t = np.append(t, 0)
    sa = suffix_array(t, 258)
    common = common_prefixes(t.astype(np.int16), sa, LENGTH)
    piece = np.repeat(np.arange(len(size)), np.append(size[:-1] + 1, size[-1] + 1))
    offset = np.arange(len(t)) - begin[piece]
    valid = offset + LENGTH <= size[piece]
    # strings in one class: no smaller common prefix between them in suffix order
    ordered = valid[sa]
    group = np.cumsum(common[sa] < LENGTH)
    at, g = sa[ordered], group[ordered]
    # every string at each of its places
    n = n_places[piece[at]]
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at, g = np.repeat(at, n), np.repeat(g, n)
    row = by[place0[piece[at]] + nth]
    d, start, tie = doc[row], starts[row] + offset[at], ties[row]
    o = np.lexsort((start, tie, d, g))
    g, d, start, tie, row = g[o], d[o], start[o], tie[o], row[o]
    new = np.append(True, g[1:] != g[:-1])[: len(g)]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    hit = (d != d[first]) | (start != start[first]) | (tie != tie[first])
    start, row = start[hit], row[hit]
    if not len(row):
        return tuple(np.empty(0, np.int64) for _ in range(3))
    o = np.lexsort((start, row))
    start, row = start[o], row[o]
    cut = np.ones(len(row), bool)
    cut[1:] = (np.diff(start) != 1) | (row[1:] != row[:-1])
    f = np.flatnonzero(cut)
    k, last = row[f], start[np.append(f[1:], len(row)) - 1]
    return doc[k], ties[k], _pack(start[f], last)


def _shards(batches):
    """Suffix arrays over whole shards, of SHARD_BYTES or more at a time."""
    rows, held, at = [], 0, None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held >= SHARD_BYTES and row[0] != at:
                yield _runs(rows)
                rows, held = [], 0
            at = row[0]
            rows.append(row)
            held += len(row[4])
    if rows:
        yield _runs(rows)


def _runs(rows):
    _, doc, tie, start, pieces = zip(*rows, strict=True)
    found = repeated_strings(*(np.array(x, np.int64) for x in (doc, tie, start)), pieces)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["doc", "tie", "pos"])


def _removed(text: bytes, runs: list[int] | None) -> tuple[bytes, int, int]:
    """Text without the bytes its runs cover, their number, and maximal runs."""
    if not runs:
        return text, 0, 0
    lo, hi = _unpack(np.array(runs, np.int64))
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi + LENGTH, -1)
    gone = np.cumsum(edge)[:-1] > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def suffix_dedup(docs: DataFrame, hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans) for every row of ``docs``.

    Earlier means a smaller doc_id, or the same document and an earlier start.

    Defined cases: null text is empty; texts under 100 bytes stay whole; a null
    doc_id comes after all others; texts that differ under one doc_id are told
    apart and ordered by 63 bits of a hash; exact repeats of a row are the same
    document and lose the same bytes; an empty table gives no rows; other columns
    are ignored.

    Plan: an exchange of stretches (a row for about 35 bytes of text) by owner
    hash in ROUNDS rounds, each a scan of the texts, sorted and streamed owner by
    owner, after the third and later of a kind in a batch are settled; two
    exchanges of texts by id.  Owners with very many
    surroundings have their strings dealt one by one, so no owner fills a task;
    the numbers of tasks follow the bytes.  Lineage ends at written tables.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    # ids that are all different need no ties, which would not compress
    same = F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("doc")
    alike = not docs.groupBy(same).count().where("count > 1").limit(1).isEmpty()
    half = F.shiftrightunsigned(F.xxhash64(text), 1) if alike else F.lit(0).cast("bigint")
    d = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("doc"),
        # negative under an id, so that a null id also comes after the largest one
        F.when(F.col("doc_id").isNull(), half).otherwise(-half - 1).alias("tie"),
    )
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = lambda n, each: int(max(parallelism(spark), -(-n // each)))
    most, rounds = hot_owners(d, hot, sample), []
    for turn in range(ROUNDS):
        found = d.select("doc", "tie", "text").mapInArrow(_scan(most, turn), "h bigint, ctx bigint, doc bigint, tie bigint, pos bigint, sides bigint, done boolean")
        found = found.repartition(tasks(total // ROUNDS, BYTES_PER_TASK), "h").sortWithinPartitions("h")
        rounds.append(stored(found.mapInArrow(_judge, "shard bigint, doc bigint, tie bigint, pos bigint, done boolean"), "stretches"))
    judged = reduce(DataFrame.union, rounds)
    look = judged.where("not done")
    items = look.groupBy("doc", "tie").agg(F.collect_set(F.struct("shard", "pos")).alias("items"))
    cut = d.select("doc", "tie", "text").join(items, ["doc", "tie"]).select("doc", "tie", "text", "items").mapInArrow(_cut, "shard bigint, doc bigint, tie bigint, start bigint, bytes binary")
    cut = cut.repartition(tasks(look.count(), STRETCHES_PER_TASK), "shard").sortWithinPartitions("shard")
    more = stored(cut.mapInArrow(_shards, "doc bigint, tie bigint, pos bigint"), "repeats")
    runs = judged.where("done").select("doc", "tie", "pos").union(more)
    runs = runs.groupBy("doc", "tie").agg(F.collect_set("pos").alias("runs"))

    def strip(batches):
        for b in batches:
            rows = []
            for doc_id, text, got in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("runs").to_pylist(), strict=True):
                kept, n, spans = _removed(text, got)
                rows.append((doc_id, kept, hashlib.sha256(kept).hexdigest(), len(text), n, spans))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "kept", "kept_sha256", "n_bytes", "n_removed", "n_spans"])

    return d.join(runs, ["doc", "tie"], "left").select("doc_id", "text", "runs").mapInArrow(
        strip, "doc_id bigint, kept binary, kept_sha256 string, n_bytes bigint, n_removed bigint, n_spans bigint"
    )


def op9(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
