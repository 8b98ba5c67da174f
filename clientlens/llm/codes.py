"""Vector code compression: codebooks by filtering Lloyd over kd-trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of one set of trees, and about the parts of one leaf.
TREE, LEAF = 4096, 16


def components(vectors: list) -> np.ndarray:
    """floor(1024 * x) of every component, whole numbers."""
    v = np.floor(np.asarray(vectors, np.float64) * SCALE)
    if v.size and np.abs(v).max() >= 2**62:
        raise ValueError("a component beyond 2**52 does not fit a code")
    return v.astype(np.int64)


def exact_kind(most: int, width: int) -> type:
    """A number kind that holds every product and sum of squares exactly: doubles
    where they stay whole, else 64-bit integers."""
    bound = 16 * max(most, 1) ** 2 * max(width, 1)
    if bound >= 2**63:
        raise ValueError("components are too large for squared distances of 64 bits")
    return np.float64 if bound < 2**53 else np.int64


class Tree:
    """A kd-tree over one part of some vectors.

    Level l has 2**l nodes; node k of them covers the points from k*n>>l on.  Every
    node keeps its bounding box and the sum of its points.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, low: list, high: list, sums: list):
        self.points, self.order, self.low, self.high, self.sums = points, order, low, high, sums

    @staticmethod
    def starts(n: int, level: int) -> np.ndarray:
        return (np.arange((1 << level) + 1) * n) >> level

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        n = len(points)
        order, low, high, sums = np.arange(n), [], [], []
        depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
        for level in range(depth + 1):
            cut = cls.starts(n, level)
            mine = points[order]
            low.append(np.minimum.reduceat(mine, cut[:-1], axis=0))
            high.append(np.maximum.reduceat(mine, cut[:-1], axis=0))
            sums.append(np.add.reduceat(mine, cut[:-1], axis=0))
            if level < depth:
                # halves of each node by its widest side
                node = np.repeat(np.arange(1 << level), np.diff(cut))
                side = (high[-1] - low[-1]).argmax(axis=1) if points.shape[1] else np.zeros(1 << level, int)
                value = mine[np.arange(n), side[node]] if points.shape[1] else np.zeros(n, int)
                order = order[np.lexsort((value, node))]
        return cls(points[order], order, low, high, sums)

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code of each point in tree order, sums, counts) for the entries ``book``.

        From the root down each node keeps the entries that may be nearest to one
        of its points: an entry goes if no corner of the box is nearer to it than
        to the entry nearest the middle (or as near, at a lower index).  A node with
        one entry left is assigned whole, by its cached sum.
        """
        n, width = self.points.shape
        k = len(book)
        most = int(max(np.abs(self.points).max(initial=0), np.abs(book).max(initial=0)))
        kind = exact_kind(most, width)
        c = book.astype(kind)
        norm = (c * c).sum(axis=1)
        code = np.empty(n, np.int64)
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        nodes = np.zeros(1, np.int64)
        alive = np.ones((1, k), bool)
        last = len(self.low) - 1
        for level in range(last + 1):
            low, high = self.low[level][nodes].astype(kind), self.high[level][nodes].astype(kind)
            far = 4 * norm - 4 * ((low + high) @ c.T) if width else np.zeros((len(nodes), k))
            best = np.where(alive, far, far.max() + 1).argmin(axis=1)
            f, z = np.nonzero(alive)
            toward = c[z] - c[best[f]]
            reach = np.maximum(toward * low[f], toward * high[f]).sum(axis=1)
            gap = norm[z] - norm[best[f]] - 2 * reach  # least difference of squared distances in the box
            gone = (gap > 0) | ((gap == 0) & (z > best[f]))
            alive[f[gone], z[gone]] = False
            cut = self.starts(n, level)
            sole = alive.sum(axis=1) == 1
            if sole.any():
                own, entry = nodes[sole], alive[sole].argmax(axis=1)
                np.add.at(total, entry, self.sums[level][own])
                size = cut[own + 1] - cut[own]
                np.add.at(count, entry, size)
                code[_within(cut[own], size)] = np.repeat(entry, size)
                nodes, alive = nodes[~sole], alive[~sole]
            if not len(nodes):
                break
            if level < last:
                nodes, alive = (2 * nodes[:, None] + np.arange(2)).ravel(), np.repeat(alive, 2, axis=0)
            else:
                size = cut[nodes + 1] - cut[nodes]
                rows = _within(cut[nodes], size)
                x = self.points[rows].astype(kind)
                d = norm - 2 * (x @ c.T)
                entry = np.where(np.repeat(alive, size, axis=0), d, d.max() + 1).argmin(axis=1)
                code[rows] = entry
                np.add.at(total, entry, self.points[rows])
                count += np.bincount(entry, minlength=k)
        return code, total, count


def _within(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each stretch, one after another."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def _whole(a: np.ndarray) -> bytes:
    return a.astype("<i4" if np.abs(a).max(initial=0) < 2**31 else "<i8").tobytes()


def _pack(tree: Tree) -> list[bytes]:
    return [_whole(tree.points), tree.order.astype("<i4").tobytes(), *[_whole(np.concatenate(a)) for a in (tree.low, tree.high, tree.sums)]]


def _unpack(raw: list[bytes], n: int, width: int) -> Tree:
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
    whole = lambda b, rows: np.frombuffer(b, "<i4" if len(b) == 4 * rows * width else "<i8").astype(np.int64).reshape(rows, width)
    split = lambda a: np.split(a, np.cumsum(1 << np.arange(depth)))
    nodes = (2 << depth) - 1
    return Tree(whole(raw[0], n), np.frombuffer(raw[1], "<i4"), *[split(whole(b, nodes)) for b in raw[2:]])


FIELDS = ["points", "order", "low", "high", "sums"]


def usable(embeddings: DataFrame) -> DataFrame:
    """Rows whose vector is there and whose components all are finite numbers."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label").where(v.isNotNull() & finite)


def first_books(kept: DataFrame) -> list[np.ndarray]:
    """The parts of the vectors with the 256 smallest ids, in order; of rows that
    repeat an id the smaller vector comes first."""
    rows = [r.embedding for r in kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).select("embedding").collect()]
    width = len(rows[0]) if rows else 0
    if any(len(r) != width for r in rows) or width % PARTS:
        raise ValueError("vectors need one length, a multiple of four")
    return np.split(components(rows).reshape(len(rows), width), PARTS, axis=1)


def trees(kept: DataFrame, width: int) -> DataFrame:
    """Rows of up to 4096 vectors: their ids, labels and one tree for each part."""
    s = kept.schema
    schema = f"ids array<{s['vec_id'].dataType.simpleString()}>, labels array<{s['label'].dataType.simpleString()}>, n int, trees array<array<binary>>"

    def build(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(0, batch.num_rows, TREE):
                part = batch.slice(i, TREE)
                column = part.column(1)
                sizes = np.diff(column.offsets.to_numpy())
                if (sizes != width).any():
                    raise ValueError(f"vectors need one length; here it is {width} and {sizes[sizes != width][0]}")
                points = components(column.flatten().to_numpy(zero_copy_only=False)).reshape(part.num_rows, width)
                packed = [_pack(Tree.build(p)) for p in np.split(points, PARTS, axis=1)]
                n = part.num_rows
                whole = lambda a: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), a)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [whole(part.column(0)), whole(part.column(2)), pa.array([n], pa.int32()), pa.array([packed], pa.list_(pa.list_(pa.binary())))],
                    names=["ids", "labels", "n", "trees"],
                )

    return kept.select("vec_id", "embedding", "label").mapInArrow(build, schema)


def _rows(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, list[Tree]]]:
    n, packed = batch.column("n").to_pylist(), batch.column("trees")
    for k in range(batch.num_rows):
        yield k, [_unpack([b.as_py() for b in t.values], n[k], width) for t in packed[k].values]


def gathered(grown: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Entries after one round: floor of the mean of the parts assigned to each.

    A partition adds up its trees, Spark adds up partitions; what comes to the
    driver is one row an entry, 1024 in all.
    """
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]):
        total = [np.zeros(b.shape, np.int64) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for _, parts in _rows(batch, width):
                for j, tree in enumerate(parts):
                    _, t, c = tree.assign(books[j])
                    total[j] += t
                    count[j] += c
        for j in range(PARTS):
            used = np.flatnonzero(count[j])
            yield pa.RecordBatch.from_arrays(
                [pa.array([j] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array(count[j][used], pa.int64()), pa.array(total[j][used].tolist(), pa.list_(pa.int64()))],
                names=["part", "entry", "n", "total"],
            )

    sums = grown.select("n", "trees").mapInArrow(run, "part int, entry int, n bigint, total array<bigint>")
    wide = lambda i: F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"t{i}")
    out = [b.copy() for b in books]
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[wide(i) for i in range(width)]).collect():
        out[r.part][r.entry] = [int(r[f"t{i}"]) // r.n for i in range(width)]
    return out


def coded(grown: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of every vector for the final entries."""
    width = books[0].shape[1]
    kind = lambda c: grown.schema[c].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k, parts in _rows(batch, width):
                n = len(parts[0].points)
                codes, error = np.empty((n, PARTS), np.uint8), np.zeros(n, np.int64)
                for j, tree in enumerate(parts):
                    code, _, _ = tree.assign(books[j])
                    codes[tree.order, j] = code
                    error[tree.order] += ((tree.points - books[j][code]) ** 2).sum(axis=1)
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[k].values, batch.column("labels")[k].values, pa.array([text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string()), pa.array(error, pa.int64())],
                    names=["vec_id", "label", "code", "error"],
                )

    return grown.mapInArrow(run, f"vec_id {kind('ids')}, label {kind('labels')}, code string, error bigint")


def compress(embeddings: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error) of every usable vector, codebooks).

    Trees are built once and written to the shared folder; each round reads them,
    so that a lost executor costs one tree row's work.  Codebooks are 1024 entries
    at most and are all that goes to the driver and back.

    Rows whose vector is null or holds a null, NaN or infinite component are left
    out; repeated rows each count and each give a row; fewer than 256 vectors make a
    smaller codebook; an empty table gives no row.  A null vec_id comes last among
    the first entries.  Vectors of several lengths, of one that four does not divide,
    or with components whose squares leave 64 bits are an error.
    """
    kept = usable(embeddings)
    books = first_books(kept)
    grown = stored(trees(kept, sum(b.shape[1] for b in books)), "vector-trees")
    if not len(books[0]):
        return coded(grown, books), books
    for _ in range(rounds):
        books = gathered(grown, books)
    return coded(grown, books), books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(map(str, np.concatenate([b.ravel() for b in books]).tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds label_error: the error of all vectors with an equal label, nulls
    together; summed before it is shuffled, and joined where Spark can split a
    label that holds much of the table."""
    codes = stored(codes, "vector-codes")
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Lloyd's rounds by comparing every part with every entry, in whole numbers."""
    nearest = "select b.rid, b.p, min_by(k.e, (k.n - 2 * list_inner_product(b.x, k.x)) * 1000 + k.e) as e from b join {0} k using (p) group by b.rid, b.p"
    out = """
with kept as (
  select row_number() over (order by vec_id, embedding) - 1 as rid, vec_id, label,
         list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
b as materialized (
  select rid, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] as x from kept, (select unnest([0, 1, 2, 3]) as p)),
k0 as materialized (select p, rid as e, x, list_inner_product(x, x) as n from b where rid < 256)"""
    for r in range(1, ROUNDS + 1):
        out += f""",
a{r} as materialized ({nearest.format(f"k{r - 1}")}),
m{r} as (
  select p, e, list(m order by i) as x from (
    select p, e, i, floor(cast(sum(cast(c as hugeint)) as double) / count(*)) as m
    from (select b.p, a.e, unnest(generate_series(1, len(b.x))) as i, unnest(b.x) as c from b join a{r} a using (rid, p)) group by p, e, i)
  group by p, e),
k{r} as materialized (
  select p, e, coalesce(m.x, k.x) as x, list_inner_product(coalesce(m.x, k.x), coalesce(m.x, k.x)) as n from k{r - 1} k left join m{r} m using (p, e))"""
    last = f"k{ROUNDS}"
    return out + f""",
z as materialized ({nearest.format(last)}),
s as (
  select rid, string_agg(printf('%02x', e), '' order by p) as code,
         cast(sum(list_inner_product(b.x, b.x) - 2 * list_inner_product(b.x, k.x) + k.n) as bigint) as error
  from z join b using (rid, p) join {last} k using (p, e) group by rid),
g as (select label, cast(sum(error) as bigint) as label_error from s join kept using (rid) group by label),
h as (select sha256(string_agg(cast(cast(c as bigint) as varchar), ',' order by p, e, i)) as codebooks_sha256
      from (select p, e, unnest(generate_series(1, len(x))) as i, unnest(x) as c from {last}))
select vec_id, code, error, label_error, codebooks_sha256
from s join kept using (rid) join g on kept.label is not distinct from g.label, h
"""


OP13_SQL = _sql()
