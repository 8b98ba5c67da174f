"""N-gram Jaccard join: parity sketches, a pigeonhole join by size band, and an
exact check of what is left."""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.llm.common import connected_components, stored
from clientlens.llm.shingles import mix64, set_digest, shingle_set

#: Similarity as a fraction: 75 of 100.
NUM, DEN = 75, 100
#: Sets of at most TINY shingles are compared by subsets; larger ones by parts.
TINY, PARTS, LEAST_PARTS = 6, 64, 64
#: Keys of at most FEW sets are joined in full; larger ones are compared in blocks of
#: about BLOCK_BYTES of sketches, BOX sets at a time.
FEW, BLOCK_BYTES, BOX = 8, 1 << 18, 32
#: Candidates written in the first round for two components that meet in two blocks.
QUOTA, GROWTH = 8, 64
#: A list of open components of at most so many rows is broadcast.
SMALL_LIST = 100_000


_BAND, _START = np.uint64(31), np.uint64(30)  # low bits of a key: its band, 31 for subsets, 30 for starts
_STARTS = np.uint64(0x7A3D11E9C2B5F04D)


def bands(n: int) -> list[int]:
    """Size bands a set of ``n`` shingles takes part in: band i holds sizes from
    7 * 2**i; a set also probes the next band if a partner can be that large."""
    i = (n // (TINY + 1)).bit_length() - 1
    out = [i]
    if n * DEN // NUM >= (TINY + 1) << (i + 1):
        out.append(i + 1)
    return out


def part_count(band: int) -> int:
    """Parts of a band: one more than the largest symmetric difference that two
    linked sets of the band can have, (1 - t) / (1 + t) of both sizes."""
    return max(LEAST_PARTS, 2 * ((TINY + 1) << (band + 1)) * (DEN - NUM) // (DEN + NUM) + 1)


def most_differing(n: int, band: int) -> int:
    """Most shingles in which a set of ``n`` can differ from a linked set of the band."""
    largest = min(n * DEN // NUM, ((TINY + 1) << (band + 1)) - 1)
    return (n + largest) * (DEN - NUM) // (DEN + NUM)


def join_keys(s: np.ndarray, parts: int | None = PARTS) -> np.ndarray:
    """Keys such that linked, different sets share at least one.

    Tiny sets: if the smaller of two linked sets has at most 6 shingles it is a
    subset of the other and misses at most a quarter of it, so sets of up to 8
    give the hash of each subset with up to a quarter left out.

    Larger sets: the parity sketch of a set in which every slot holds the XOR of
    the hashes in one part of the hash space, so that a differing shingle changes
    one slot only.  Linked sets differ in fewer shingles than there are parts, so
    some slot agrees (pigeonhole), and shingles fall at random, so about a third
    do; slots are the keys, empty ones are none.

    ``parts`` None is the exact join: all slots are keys, and a set that fills no
    more slots than it can have differing shingles also gives the start of its
    sorted hashes, of which linked sets share one.  Where one of two linked sets
    fills more slots, one of those agrees; where neither does, their starts meet.
    With ``parts`` slots of a larger band, a link at the very threshold is missed
    with a chance below 1e-11, one above it with far less.
    """
    n, out = len(s), []
    if 0 < n <= TINY + 2:
        for gone in range(n // 4 + 1):
            for keep in combinations(range(n), n - gone):
                raw = np.frombuffer(hashlib.blake2b(s[list(keep)].tobytes(), digest_size=8).digest(), "<u8")
                out.append(raw | _BAND)
    if n > TINY:
        h = mix64(s)
        for band in bands(n):
            p = part_count(band)
            part = ((s >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)
            step = np.flatnonzero(np.diff(part, prepend=np.uint64(p + 1)))
            if len(step) <= most_differing(n, band):
                start = mix64(h[: n - -(-NUM * n // DEN) + 1] ^ _STARTS)
                out.append((start & ~_BAND) | _START)
            end = n if parts is None else int(np.searchsorted(part, parts))
            step = step[step < end]
            if end:
                word = np.bitwise_xor.reduceat(h[:end], step)
                key = mix64(word ^ mix64(part[step] + np.uint64((band + 1) << 32)))
                out.append((key & ~_BAND) | np.uint64(min(band, 29)))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def parity_sketch(s: np.ndarray) -> bytes:
    """A bit per slot, flipped by every shingle in it; at least 4 slots a shingle."""
    size = max(64, 1 << (4 * len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Hamming distance, at most the symmetric difference; the longer sketch is
    folded to the shorter one's size first."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    if len(y) > len(x):
        y = _fold(y, len(x))
    return int(np.bitwise_count(x ^ y).sum())


def _fold(y: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(y.reshape(-1, size), axis=0)


def _signed(parts: int | None):
    def signed(batches):
        for b in batches:
            ids, n, digest, keys, sketch = b.column("doc_id"), [], [], [], []
            for t in b.column("text").cast(pa.binary()):
                s = shingle_set(t.as_py())
                n.append(len(s))
                digest.append(set_digest(s))
                keys.append(join_keys(s, parts).view(np.int64))
                sketch.append(parity_sketch(s))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["doc_id", "n", "digest", "keys", "sketch"],
            )

    return signed


def _near(batches):
    """Pairs whose sketches allow a link."""
    for b in batches:
        ok = [
            sketch_distance(x, y) * (DEN + NUM) <= (m + n) * (DEN - NUM)
            for x, y, m, n in zip(*(b.column(c).to_pylist() for c in ("sa", "sb", "na", "nb")), strict=True)
        ]
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _sets(batches):
    for b in batches:
        found = [shingle_set(t.as_py()).tobytes() for t in b.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.binary())], ["node", "set"])


def _linked(batches):
    """Pairs whose sets reach the similarity."""
    for b in batches:
        ok = []
        for x, y in zip(b.column("xa").to_pylist(), b.column("xb").to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate([p, q])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            ok.append(DEN * common >= NUM * (len(p) + len(q) - common))
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that are links: sizes, sketches, then sets."""
    c = classes.select("node", "n", "sketch")
    left = c.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = c.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    sized = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM)
    near = stored(sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near, "a bigint, b bigint").distinct(), "near-pairs")
    nodes = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = stored(docs.select("doc_id", "text").join(nodes, "doc_id").mapInArrow(_sets, "node bigint, set binary"), "near-sets")
    full = near.join(sets.select(F.col("node").alias("a"), F.col("set").alias("xa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("set").alias("xb")), "b"
    )
    return stored(full.select("a", "b", "xa", "xb").mapInArrow(_linked, "a bigint, b bigint").distinct(), "links")


class Block:
    """Some sets of a key: ids, components, sizes and sketches folded to one
    length, in order of component, with a box around every BOX of them: the bits
    that all and that any of them have, their sizes, first and last component."""

    def __init__(self, node, comp, n, sketches):
        o = np.lexsort((n, comp))
        self.node, self.comp, self.n = node[o], comp[o], n[o]
        short = min(map(len, sketches))
        bits = np.stack([_fold(np.frombuffer(sketches[i], np.uint8), short) for i in o])
        self._boxes(np.ascontiguousarray(bits).view(np.uint64))

    def _boxes(self, bits):
        self.bits, at = bits, np.arange(0, len(self.node), BOX)
        self.every, self.some = np.bitwise_and.reduceat(bits, at), np.bitwise_or.reduceat(bits, at)
        self.least, self.most = np.minimum.reduceat(self.n, at), np.maximum.reduceat(self.n, at)
        self.first, self.last = np.minimum.reduceat(self.comp, at), np.maximum.reduceat(self.comp, at)

    def folded(self, words: int) -> Block:
        if self.bits.shape[1] == words:
            return self
        out = Block.__new__(Block)
        out.node, out.comp, out.n = self.node, self.comp, self.n
        out._boxes(np.bitwise_xor.reduce(self.bits.reshape(len(self.node), -1, words), axis=1))
        return out

    def packed(self) -> bytes:
        head = np.array([len(self.node), self.bits.shape[1]], np.int64)
        return b"".join(x.tobytes() for x in (head, self.node, self.comp, self.n, self.bits))

    @staticmethod
    def unpacked(raw: bytes) -> Block:
        n, words = np.frombuffer(raw, np.int64, 2)
        out = Block.__new__(Block)
        out.node, out.comp, out.n = np.frombuffer(raw, np.int64, 3 * n, 16).reshape(3, n)
        out._boxes(np.frombuffer(raw, np.uint64, n * words, 16 + 24 * n).reshape(n, words))
        return out

    def box(self) -> bytes:
        """One box around all."""
        head = np.array([self.least.min(), self.most.max(), self.first.min(), self.last.max()], np.int64)
        return b"".join(x.tobytes() for x in (head, np.bitwise_and.reduce(self.every), np.bitwise_or.reduce(self.some)))


def boxes_allow(least, most, first, last, every, some, other) -> np.ndarray:
    """Whether a set in one box can be linked with one of another component in the
    other box: sizes, then bits that differ whatever the sets."""
    least2, most2, first2, last2, every2, some2 = other
    sizes = (most2 * DEN >= least * NUM) & (most * DEN >= least2 * NUM)
    comps = (first != last) | (first2 != last2) | (first != first2)
    far = np.bitwise_count((every & ~some2) | (every2 & ~some)).sum(axis=-1, dtype=np.int64)
    return sizes & comps & (far * (DEN + NUM) <= (most + most2) * (DEN - NUM))


def _boxes_meet(x: bytes, y: bytes) -> bool:
    def parts(raw):
        head, bits = np.frombuffer(raw, np.int64, 4), np.frombuffer(raw, np.uint64, -1, 32).reshape(2, -1)
        return head, bits

    (hx, bx), (hy, by) = sorted((parts(x), parts(y)), key=lambda z: z[1].shape[1])
    if bx.shape[1] != by.shape[1]:  # folding mixes bits: only sizes and components tell
        bx, by = np.array([[0], [-1]]).astype(np.uint64), np.array([[0], [-1]]).astype(np.uint64)
    return bool(boxes_allow(*hx, *bx, (*hy, *by)))


def block_candidates(x: Block, y: Block, quota: int) -> list[tuple]:
    """(a, b, more) of pairs of different components in two blocks that sizes and
    sketches allow to be linked, the ``quota`` nearest of every two components;
    ``more`` tells that there are others."""
    same = x is y
    words = min(x.bits.shape[1], y.bits.shape[1])
    x, y = x.folded(words), (x if same else y).folded(words)
    found = []
    for i in range(len(x.least)):
        ok = boxes_allow(x.least[i], x.most[i], x.first[i], x.last[i], x.every[i], x.some[i], (y.least, y.most, y.first, y.last, y.every, y.some))
        p = slice(i * BOX, (i + 1) * BOX)
        for j in np.flatnonzero(ok):
            if same and j < i:
                continue
            q = slice(j * BOX, (j + 1) * BOX)
            m, n = x.n[p][:, None], y.n[q][None]
            hit = (x.comp[p][:, None] != y.comp[q][None]) & (np.minimum(m, n) * DEN >= np.maximum(m, n) * NUM)
            far = np.bitwise_count(x.bits[p][:, None] ^ y.bits[q][None]).sum(axis=2, dtype=np.int64)
            hit &= far * (DEN + NUM) <= (m + n) * (DEN - NUM)
            r, c = np.nonzero(hit)
            if len(r):
                found.append((r + p.start, c + q.start, far[r, c] * 1000 // (m + n)[r, c]))
    if not found:
        return []
    r, c, far = map(np.concatenate, zip(*found, strict=True))
    lo, hi = np.minimum(x.comp[r], y.comp[c]), np.maximum(x.comp[r], y.comp[c])
    a, b = np.minimum(x.node[r], y.node[c]), np.maximum(x.node[r], y.node[c])
    o = np.lexsort((b, a, far, hi, lo))
    new = np.append(True, (lo[o][1:] != lo[o][:-1]) | (hi[o][1:] != hi[o][:-1]))
    at = np.arange(len(o))
    first = np.flatnonzero(new)
    rank = at - first[np.cumsum(new) - 1]
    over = np.diff(np.append(first, len(o)))[np.cumsum(new) - 1] > quota
    keep = rank < quota
    return list(zip(a[o][keep].tolist(), b[o][keep].tolist(), over[keep].tolist(), strict=True))


_BLOCK = "key bigint, part bigint, sub bigint, a bigint, b bigint, more boolean, box binary, sets binary"
_BLOCK_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]
_BLOCK_KINDS = [pa.int64()] * 5 + [pa.bool_(), pa.binary(), pa.binary()]


def _blocks(quota: int):
    """Rows in order of (key, part, sub): the candidates within every block, and
    the block itself where its key has others."""

    def block(at, rows):
        x = Block(*(np.array([r[k] for r in rows], np.int64) for k in (4, 5, 6)), [r[7] for r in rows])
        out = [(*at, a, b, more, None, None) for a, b, more in block_candidates(x, x, quota)] if len(rows) > 1 else []
        return out if rows[0][3] else [*out, (*at, None, None, None, x.box(), x.packed())]

    def run(batches):
        at, rows = None, []
        for batch in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:3] != at:
                    out += block(at, rows) if rows else []
                    at, rows = r[:3], []
                rows.append(r)
            yield _as_blocks(out)
        yield _as_blocks(block(at, rows) if rows else [])

    return run


def _as_blocks(rows):
    cols = list(zip(*rows, strict=True)) or [[]] * len(_BLOCK_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _BLOCK_KINDS, strict=True)], _BLOCK_NAMES)


def _meeting(batches):
    for b in batches:
        ok = [_boxes_meet(x, y) for x, y in zip(b.column("box").to_pylist(), b.column("box2").to_pylist(), strict=True)]
        out = b.filter(pa.array(ok, pa.bool_()))
        yield out.select(["key", "part", "sub", "part2", "sub2"])


def _across(quota: int):
    def run(batches):
        for b in batches:
            rows = [r for x, y in zip(b.column("sets").to_pylist(), b.column("sets2").to_pylist(), strict=True) for r in block_candidates(Block.unpacked(x), Block.unpacked(y), quota)]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["a", "b", "more"])

    return run


def in_blocks(members: DataFrame, classes: DataFrame, quota: int) -> DataFrame:
    """(a, b, more): candidates of different components within the keys of
    ``members`` (key, node, component, and w, the bytes of the node's sketch).

    A key's sets are dealt into blocks, the sets of a component together; a
    component with too many has blocks of its own.  Blocks of a key whose boxes
    exclude a link never meet; the others are compared two by two.  Nothing that
    the sketches exclude is written.
    """
    m = members.drop("w").join(classes.select("node", "n", "sketch"), "node")
    per = members.groupBy("key", "component").agg(F.sum("w").alias("own"))
    of = per.groupBy("key").agg(F.sum("own").alias("all"))
    sizes = stored(per.join(of, "key"), "block-sizes")
    crowd = F.col("own") > BLOCK_BYTES
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_BYTES)
    m = m.join(sizes, ["key", "component"]).select(
        "key", F.when(crowd, F.col("component")).otherwise(F.lit(-1)).cast("bigint").alias("part"),
        F.when(crowd, F.pmod(F.xxhash64("node"), blocks("own"))).otherwise(F.pmod(F.xxhash64("component"), blocks("all"))).cast("bigint").alias("sub"),
        (F.col("all") <= BLOCK_BYTES).alias("alone"), "node", "component", "n", "sketch",
    )
    order = ["key", "part", "sub"]
    built = stored(m.repartition(*order).sortWithinPartitions(*order).mapInArrow(_blocks(quota), _BLOCK), "blocks")
    within = built.where("a is not null").select("a", "b", "more")
    rows = built.where("sets is not null")
    boxes = rows.select(*order, "box")
    two = boxes.join(boxes.select("key", *[F.col(c).alias(f"{c}2") for c in ("part", "sub", "box")]), "key")
    two = two.where(F.struct("part", "sub") < F.struct(F.col("part2").alias("part"), F.col("sub2").alias("sub")))
    met = stored(two.mapInArrow(_meeting, "key bigint, part bigint, sub bigint, part2 bigint, sub2 bigint"), "block-pairs")
    sets = rows.select(*order, "sets")
    both = met.join(sets, order).join(sets.select("key", *[F.col(c).alias(f"{c}2") for c in ("part", "sub", "sets")]), ["key", "part2", "sub2"])
    across = both.select("sets", "sets2").mapInArrow(_across(quota), "a bigint, b bigint, more boolean")
    return within.union(across).groupBy("a", "b").agg(F.max("more").alias("more"))


def _few(members: DataFrame) -> DataFrame:
    """Pairs of different components within keys of at most FEW sets."""
    y = members.select("key", F.col("node").alias("b"), F.col("component").alias("cb"))
    x = members.withColumnRenamed("node", "a").withColumnRenamed("component", "ca")
    return x.join(y, "key").where("a < b and ca <> cb").select("a", "b").distinct()


def _merged(comp: DataFrame, found: DataFrame) -> DataFrame:
    """``comp`` after further links: components of components, so that only what
    the links touch is gone through again."""
    of = lambda side: comp.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    at = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    at = stored(at, "new-links")
    up = connected_components(at.select("ca", "cb").distinct(), "ca", "cb").select(F.col("node").alias("was"), F.col("component").alias("now"))
    ends = at.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ca").alias("was")), F.struct(F.col("b").alias("node"), F.col("cb").alias("was")))).alias("x")).select("x.*")
    # a node without a component so far stands for itself
    fresh = ends.where("node = was").select("node", "was").distinct()
    old = comp.select("node", F.col("component").alias("was"))
    out = old.union(fresh).distinct().join(up, "was", "left").select("node", F.coalesce("now", "was").alias("component"))
    return stored(out, "components")


def ngram_components(docs: DataFrame, parts: int | None = PARTS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Equal sets are one class first, represented by its smallest doc_id, so copies
    are never paired.  Classes join by the keys of :func:`join_keys`.  Within a
    key every class is paired with the key's smallest and largest only; the links
    among those pairs merge most classes.  Keys that still hold several components
    are then compared across components: small ones pair by pair, larger ones in
    blocks whose sketches exclude nearly all pairs before any is written.  Of two
    components that meet in two blocks only the nearest pairs are verified at
    first; where they prove no link and there were more, GROWTH times as many are,
    until a link is found or all are tried.  So no link between components is
    lost, and neither a group of thousands of near copies nor groups that share a
    passage are expanded into pairs.  ``parts`` None makes the keys exact too.

    Defined cases: texts without words have n_shingles 0 and stand alone; rows
    that repeat a doc_id share its component; a row with a null doc_id gets the
    component of its equal set, null if there is none; an empty table gives no
    rows; other columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("bigint"), "text")
    signed = stored(d.mapInArrow(_signed(parts), "doc_id bigint, n bigint, digest binary, keys array<bigint>, sketch binary"), "signed")
    classes = stored(
        signed.where("n > 0 and doc_id is not null").groupBy("digest")
        .agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")),
        "classes",
    )
    keyed = classes.select(F.explode("keys").alias("key"), "node", F.octet_length("sketch").alias("w"))
    ends = stored(
        keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi"), "key-ends"
    )
    shared = stored(keyed.join(ends, "key"), "shared-keys")
    star = (
        shared.select(F.col("node"), F.explode(F.array("lo", "hi")).alias("end"))
        .select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b"))
        .where("a < b").distinct()
    )
    tested = stored(star, "star-pairs")
    comp = connected_components(_verify(tested, classes, d))
    quota, some, n_open = QUOTA, None, 0
    while True:
        marked = shared.select("key", "node", "w").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
        if some is not None:  # only what was left open
            open_ = some.join(comp.withColumnRenamed("node", "c"), "c", "left").select(F.coalesce("component", "c").alias("component")).distinct()
            marked = marked.join(F.broadcast(open_) if n_open <= SMALL_LIST else open_, "component", "left_semi").select("key", "node", "w", "component")
        marked = stored(marked.distinct(), "marked-keys")
        per = marked.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("sets"))
        mixed = per.where("comps > 1").select("key", (F.col("sets") > FEW).alias("many"))
        members = stored(marked.join(mixed, "key"), "mixed-members")
        blocks = stored(in_blocks(members.where("many").drop("many"), classes, quota), "near-blocks")
        pairs = blocks.select("a", "b").union(_few(members.where("not many").drop("many"))).distinct()
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), "cross-pairs")
        tested, found = tested.union(pairs), _verify(pairs, classes, d)
        if found.limit(1).count():
            comp = _merged(comp, found)
        of = lambda side, by: by.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        left = blocks.where("more").select("a", "b")
        now = left.join(of("a", comp), "a", "left").join(of("b", comp), "b", "left")
        now = now.where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        some = stored(now.select(F.explode(F.array(F.coalesce("ca", "a"), F.coalesce("cb", "b"))).alias("c")).distinct(), "open-components")
        n_open = some.count()
        if not n_open:
            break
        quota *= GROWTH

    of = classes.select("digest", "node").join(comp, "node", "left").select("digest", F.coalesce("component", "node").alias("c"))
    direct = comp.select(F.col("node").alias("doc_id"), F.col("component").alias("own"))
    out = signed.select("doc_id", "n", "digest").join(of, "digest", "left").join(direct, "doc_id", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.least(F.coalesce("own", "c", "doc_id"), F.coalesce("c", "doc_id")).alias("component_id")
    )


def op8(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
