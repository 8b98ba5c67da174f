"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientlens.llm.common import parallelism, row_key, stored

WIDTH = 8  # cells of each of a fingerprint's three rows
BLOCK_WIDTH, BLOCK_ITEMS = 16, 24  # cells of a row, and items expected, in a larger try
ROUNDS, TRIES = 8, 5
IDS_PER_RANGE, PAIRS_PER_TASK = 50_000, 4_000
#: A paragraph: up to 32 words of a line, counted from its start.
PARAGRAPH = r"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*){1,32}"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def paragraphs(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs."""
    parts = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_extract_all(x, F.lit(PARAGRAPH), F.lit(0)))
    return F.array_distinct(F.transform(F.flatten(parts), lambda p: F.xxhash64(F.rtrim(p))))


def _entry(x: Column, sign: Column, width: int, seed: int) -> Column:
    """A digest with its sign, check value, and cell in each of three rows."""
    cell = [(F.pmod(F.xxhash64(x, F.lit(seed + k)), F.lit(width)) + k * width).cast("int") for k in range(3)]
    return F.struct(x.alias("x"), sign.alias("s"), F.xxhash64(x, F.lit(seed + 9)).alias("c"), *[c.alias(f"p{k}") for k, c in enumerate(cell)])


def _apply(cells: Column, entries: Column) -> Column:
    """Cells with the entries added by their sign."""

    def one(cell, i):
        mine = F.filter(entries, lambda e: (e["p0"] == i) | (e["p1"] == i) | (e["p2"] == i))
        return F.aggregate(
            mine, cell,
            lambda a, e: F.struct(
                (a["n"] + e["s"]).alias("n"), a["k"].bitwiseXOR(e["x"]).alias("k"), a["c"].bitwiseXOR(e["c"]).alias("c")
            ),
        )

    return F.transform(cells, one)


def sketch(items: Column, width: int = WIDTH, seed: int = 0) -> Column:
    """Three rows of cells (n, k, c): how many digests fell in, the XOR of the
    digests and the XOR of their check values."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))
    return let(
        F.transform(items, lambda x: _entry(x, F.lit(1), width, seed)),
        lambda entries: _apply(F.array_repeat(zero, 3 * width), entries),
    )


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(
        a, b,
        lambda x, y: F.struct(
            (x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")
        ),
    )


def peel(cells: Column, width: int = WIDTH, seed: int = 0, rounds: int = ROUNDS) -> Column:
    """The digests in a difference of sketches; null if it does not come apart.

    A round takes every cell that holds one digest, by its count and check value,
    out of that digest's cells, which lays open others.
    """
    pure = lambda c: (F.abs(c["n"]) == 1) & (c["c"] == F.xxhash64(c["k"], F.lit(seed + 9)))

    def step(state, _):
        found = F.array_distinct(F.transform(F.filter(state["cells"], pure), lambda c: _entry(c["k"], -c["n"], width, seed)))
        return let(
            found,
            lambda f: F.struct(
                F.when(F.size(f) == 0, state["cells"]).otherwise(_apply(state["cells"], f)).alias("cells"),
                F.concat(state["out"], F.transform(f, lambda e: e["x"])).alias("out"),
            ),
        )

    start = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("out"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    empty = lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0)
    return let(done, lambda d: F.when(F.forall(d["cells"], empty), d["out"]))


def blocks_of(a: Column, b: Column, seed: int) -> Column:
    """Two sets cut into blocks of about ``BLOCK_ITEMS`` by hash: one sorted run of
    (g, side, x), sliced where g changes, so that the work is linear."""
    blocks = F.greatest(F.ceil((F.size(a) + F.size(b)) / BLOCK_ITEMS).cast("int"), F.lit(1))
    tagged = lambda items, side: F.transform(
        items, lambda x: F.struct(F.pmod(F.xxhash64(x, F.lit(seed + 50)), blocks).cast("int").alias("g"), F.lit(side).alias("side"), x.alias("x"))
    )

    def sliced(run):
        places = F.when(F.size(run) > 0, F.sequence(F.lit(1), F.size(run))).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 1) | (F.get(run, i - 1)["g"] != F.get(run, i - 2)["g"]))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.slice(run, i, F.coalesce(F.get(at, k + 1), F.size(run) + 1) - i)))

    return let(F.array_sort(F.concat(tagged(a, 0), tagged(b, 1))), sliced)


def difference(a: Column, b: Column, attempt: int) -> Column:
    """Digests in one of two sets only, recovered from sketches; null on failure.

    The first attempt subtracts the fingerprints themselves, later ones sketches
    whose width doubles; after ``TRIES`` the sets are compared directly.
    """
    if attempt == 0:
        return peel(subtract(sketch(a), sketch(b)))
    if attempt >= TRIES:
        return F.concat(F.array_except(a, b), F.array_except(b, a))
    width, seed = BLOCK_WIDTH << (attempt - 1), 100 * attempt
    return peel(subtract(sketch(a, width, seed), sketch(b, width, seed)), width, seed)


def differences(pairs: DataFrame) -> DataFrame:
    """(id, which, diff) with the digests that differ, in one row or more a pair.

    What a fingerprint's own sketch does not bring apart is dealt into blocks by
    hash; each block tries again with its own sketch, twice as large every time.
    """
    solved, rest = [], pairs
    for attempt in range(TRIES + 1):
        out = rest.withColumn("diff", difference(F.col("a"), F.col("b"), attempt))
        keep = F.col("diff").isNull()
        out = stored(out.select("id", "which", "diff", F.when(keep, F.col("a")).alias("a"), F.when(keep, F.col("b")).alias("b")), "sketch-tries")
        solved.append(out.where("diff is not null").select("id", "which", "diff"))
        rest = out.where("diff is null").select("id", "which", "a", "b")
        left = rest.count()
        if not left:
            break
        if attempt == 0:
            rest = rest.repartition(int(max(parallelism(pairs.sparkSession), -(-left // PAIRS_PER_TASK))), "id", "which")
            side = lambda k: F.transform(F.filter("run", lambda r: r["side"] == k), lambda r: r["x"])
            rest = rest.select("id", "which", F.explode(blocks_of(F.col("a"), F.col("b"), 100)).alias("run"))
            rest = rest.select("id", "which", side(0).alias("a"), side(1).alias("b"))
    out = solved[0]
    for s in solved[1:]:
        out = out.union(s)
    return out


def next_documents(keys: DataFrame) -> DataFrame:
    """(doc_id, rk, next_rk, n_chars, copies): the next document by descending doc_id,
    after the last one the first.  Ids are range partitioned, each range orders its own,
    and ranges are linked through their first rows, one row a range."""
    keys = stored(keys, "doc-keys")
    n = int(max(1, -(-keys.count() // IDS_PER_RANGE)))
    order = [F.col("doc_id").desc_nulls_last(), F.col("rk")]
    ranged = stored(keys.repartitionByRange(n, *order).withColumn("pid", F.spark_partition_id()), "doc-ranges")
    w = Window.partitionBy("pid").orderBy(*order)
    local = ranged.select("pid", "doc_id", "rk", "n_chars", "copies", F.lead("rk").over(w).alias("next_rk"), F.row_number().over(w).alias("i"))
    local = stored(local, "doc-order")
    heads = local.where("i = 1").select("pid", "rk")
    row = Window.orderBy("pid")
    every = row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("pid", F.coalesce(F.lead("rk").over(row), F.first("rk").over(every)).alias("after"))
    return local.join(F.broadcast(after) if n <= 10_000 else after, "pid").select("doc_id", "rk", F.coalesce("next_rk", "after").alias("next_rk"), "n_chars", "copies")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint, that of its edited text, and their likenesses.

    The edited text ends in the start of the next document (descending doc_id)
    in place of its own last third.  Likeness is the Jaccard similarity of the
    paragraph sets, from their sizes and the differing digests that peeling the
    subtracted sketches recovers; two sets without paragraphs are alike (1).

    Defined cases: null text is empty; a null doc_id comes last in the order;
    rows that repeat a doc_id with other texts are documents of their own (in the
    order of a digest), exact repeats are one in the order and each returned; a
    single document is its own next; an empty table gives no rows; other columns
    are ignored.

    Plan: texts cross one exchange by row key, which both joins read, and the
    heads (a third of them) one; all else is ids and short arrays of digests.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("rk", row_key())
    ids = d.select("doc_id", "rk", F.char_length("text").cast("long").alias("n_chars"))
    links = next_documents(ids.groupBy("doc_id", "rk", "n_chars").agg(F.count(F.lit(1)).cast("int").alias("copies")))
    texts = d.select("rk", "text")
    carried = ("doc_id", "next_rk", "n_chars", "copies")
    k = F.floor(F.col("n_chars") / 3).cast("int")
    heads = (
        texts.join(links.select(F.col("next_rk").alias("rk"), F.col("rk").alias("prev"), "doc_id", "n_chars", "copies"), "rk")
        .select(F.col("prev").alias("rk"), F.col("rk").alias("next_rk"), "doc_id", "n_chars", "copies", F.left("text", k).alias("head"))
        .groupBy("rk").agg(*[F.first(c).alias(c) for c in (*carried, "head")])
    )
    edited = F.concat(F.left("text", (F.col("n_chars") - k).cast("int")), F.col("head"))
    base = stored(
        texts.join(heads, "rk").withColumn("edited", edited).select(
            "rk", *carried, F.sha2("edited", 256).alias("edited_sha256"),
            paragraphs(F.col("text")).alias("own"), paragraphs(F.col("edited")).alias("new"),
        ).dropDuplicates(["rk"]),
        "paragraphs",
    )
    following = base.select(F.col("rk").alias("next_rk"), F.col("own").alias("b"))
    own = base.select(F.col("rk").alias("id"), "next_rk", F.col("own").alias("a"))
    pairs = base.select(F.col("rk").alias("id"), F.lit("edited").alias("which"), F.col("own").alias("a"), F.col("new").alias("b")).union(
        own.join(following, "next_rk").select("id", F.lit("next"), "a", "b")
    )
    count = lambda w: F.coalesce(F.sum(F.when(F.col("which") == w, F.size("diff"))), F.lit(0)).alias(w)
    near = differences(pairs).groupBy(F.col("id").alias("rk")).agg(count("edited"), count("next"))
    sizes = base.select(F.col("rk").alias("next_rk"), F.size("own").alias("n_next"))

    def alike(diff, other):
        both = F.size("own") + F.col(other)
        return F.when(both == 0, F.lit(1.0)).otherwise((both - F.col(diff)) / (both + F.col(diff)))

    base = base.join(sizes, "next_rk").withColumn("n_new", F.size("new"))
    base = base.withColumns({"_own": shown(sketch(F.col("own"))), "_new": shown(sketch(F.col("new")))})
    each = base.join(near, "rk").withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return each.select(
        "doc_id", "n_chars", "edited_sha256", F.col("_own").alias("fingerprint"), F.col("_new").alias("edited_fingerprint"),
        alike("edited", "n_new").alias("near_edited"), alike("next", "n_next").alias("near_next"),
    )


def shown(cells: Column) -> Column:
    """A sketch as text: count, digests and checks of each cell in hexadecimal."""
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(".", F.hex(c["n"]), F.hex(c["k"]), F.hex(c["c"]))), " ")


def op5(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
