"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientlens.llm.common import WORD, stored

WEIGHTS = (3.0, 1.0, 2.0)  # fixed values: by source in code point order, repeating, null last
SHARE, MOST = 1.5, 2  # the mix's words per word of input; copies of a document at most
CELL_ROWS = 128  # rows that are rounded together, on average
CAPPED = 1 - 1e-12


def word_count(text="text"):
    """Runs of anything but ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) to targets: weight shares of ``share`` x all sizes,
    none above ``most`` x its source, the excess reshared by weight.

    The table has one row per source.  Sources fill up in the order of
    most x size / weight, so the water level is read off prefix sums.
    """
    w = F.array(*map(F.lit, weights))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("_w", F.element_at(w, (rank % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    up = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (
        s.withColumn("_mix", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    )
    # the first source that its level doesn't fill sets the level of all after it
    level = (F.col("_mix") - F.col("_before")) / F.col("_left")
    s = s.withColumn("_level", level).withColumn("_open", F.col("_level") * F.col("_w") < F.col("_cap"))
    final = F.min(F.when(F.col("_open"), F.struct(F.col("_before"), F.col("_level")))).over(every)["_level"]
    return s.withColumn("_final", final).select(
        "source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_final") * F.col("_w"), F.col("_cap"))).alias("target")
    )


def _rate(lam, x, share: float, most: int):
    """Copies wanted of a document: ``most`` draws, each kept at the mix's base
    rate, tilted by exp(lam * x)."""
    base = F.lit(float(most / share - 1))
    return F.lit(float(most)) / (F.lit(1.0) + base * F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -lam * x))))


def multipliers(hist: DataFrame, targets: DataFrame, share: float = SHARE, most: int = MOST, rounds: int = 60) -> DataFrame:
    """(source, lam): Newton iterations on the dual of entropy balancing.

    ``hist`` has (source, size, n).  The dual of "stay near the base rate, take
    ``target`` words of each source" has one multiplier per source; its gradient
    is taken words minus target, its Hessian is diagonal over sources.  A round
    is one join by source and one partial aggregation, with exact decimal sums so
    that reruns agree to the last bit.  A bracket keeps Newton from overshooting.
    Sources whose target is 0 or ``most`` x their size need no multiplier.
    """
    st = targets.select(
        F.col("source").alias("_s"), "source_size", "target",
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
        (F.col("target") >= F.col("source_size") * most * CAPPED).alias("done"),
    )
    per = hist.groupBy(F.col("source").alias("_p")).agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("unit"))
    st = stored(st.join(per, F.col("_s").eqNullSafe(F.col("_p"))).drop("_p"), "mix-state")
    exact = lambda c: F.sum((c * 1e6).cast("decimal(38,0)")).cast("double") / 1e6
    for _ in range(rounds):
        x = F.col("size") / F.col("unit")
        r = _rate(F.col("lam"), x, share, most)
        words = F.col("n") * F.col("size")
        sums = (
            hist.join(st.where("not done").select("_s", "lam", "unit"), F.col("source").eqNullSafe(F.col("_s")))
            .groupBy(F.col("source").alias("_p"))
            .agg(exact(words * r).alias("got"), exact(words * r * (1 - r / most) * x).alias("slope"))
        )
        off = F.col("got") - F.col("target")
        lo = F.when(off < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        j = st.join(sums, F.col("_s").eqNullSafe(F.col("_p")), "left").withColumn("lo", lo).withColumn("hi", hi)
        newton = F.col("lam") - off / F.greatest(F.col("slope"), F.lit(1e-9))
        mid = (F.coalesce("lo", F.col("hi") - 4.0) + F.coalesce("hi", F.col("lo") + 4.0)) / 2
        inside = (newton > F.coalesce("lo", F.col("hi") - 8.0)) & (newton < F.coalesce("hi", F.col("lo") + 8.0))
        near = F.abs(off) <= F.greatest(F.col("target") * 1e-9, F.lit(1e-3))
        st = stored(
            j.select(
                "_s", "source_size", "target",
                F.when(F.col("done") | F.coalesce(near, F.lit(True)), F.col("lam")).when(inside, newton).otherwise(mid).alias("lam"),
                "lo", "hi", (F.col("done") | F.coalesce(near, F.lit(True))).alias("done"), "unit",
            ),
            "mix-state",
        )
        if not st.where("not done").limit(1).count():
            return st
    raise RuntimeError(f"multipliers are not found after {rounds} rounds")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, rate and copies.

    Rates solve the entropy balancing problem of :func:`multipliers`.  They are
    rounded in cells of about ``CELL_ROWS`` rows that a hash of id and size picks
    within a source: largest first, each row takes the whole copies nearest to
    its wanted words plus what earlier rows of the cell left over.  So every cell
    comes within a word or so of its share, and no cell grows with a source.

    Defined cases: null text has size 0 and takes nothing; null source is a
    source of its own, last in order; rows that repeat are rows of their own; an
    empty table gives an empty table.  Columns named like an output are replaced.
    """
    spark = docs.sparkSession
    made = ["size", "source_size", "target", "rate", "copies"]
    d = docs.drop(*made).withColumn("size", word_count())
    hist = stored(d.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    sizes = hist.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("_rows")
    )
    targets = stored(source_targets(sizes, weights, share, most), "mix-targets")
    st = multipliers(hist, targets, share, most)
    info = st.join(sizes.select(F.col("source").alias("_p"), "_rows"), F.col("_s").eqNullSafe(F.col("_p"))).drop("_p")
    full = F.col("target") >= F.col("source_size") * most * CAPPED
    rated = (
        d.join(info, d["source"].eqNullSafe(F.col("_s")))
        .withColumn(
            "rate",
            F.when(F.col("source_size") == 0, F.lit(0.0)).when(full, F.lit(float(most)))
            .otherwise(_rate(F.col("lam"), F.col("size") / F.col("unit"), share, most)),
        )
        .withColumn("_cells", F.ceil(F.col("_rows") / CELL_ROWS))
        .withColumn("_cell", F.pmod(F.xxhash64("doc_id", "size"), F.col("_cells")))
    )
    return _round(rated, most).select(*docs.drop(*made).columns, *made)


def _round(rated: DataFrame, most: int) -> DataFrame:
    """Copies by cell.  Equal (doc_id, size) rows of a source are rounded as one
    entry with a count, so that the join back is by those keys."""
    items = rated.groupBy("_s", "_cell", "doc_id", "size").agg(F.count(F.lit(1)).alias("m"), F.first("rate").alias("rate"))
    entry = F.struct((-F.col("size")).alias("o"), F.xxhash64("doc_id").alias("t"), "doc_id", "size", "m", "rate")
    cells = items.groupBy("_s", "_cell").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    kind = rated.schema["doc_id"].dataType.simpleString()
    zero = F.struct(
        F.lit(0.0).alias("over"),
        F.array().cast(f"array<struct<doc_id:{kind},size:bigint,k:int>>").alias("out"),
    )

    def take(acc, e):
        words = F.greatest(e["size"] * e["m"], F.lit(1)).cast("double")
        want = e["rate"] * words + acc["over"]
        k = F.greatest(F.lit(0), F.least(F.lit(most), F.round(want / words).cast("int")))
        one = F.struct(e["doc_id"].alias("doc_id"), e["size"].alias("size"), k.alias("k"))
        over = F.when(e["size"] == 0, acc["over"]).otherwise(want - k * words)
        return F.struct(over.alias("over"), F.concat(acc["out"], F.array(one)).alias("out"))

    picked = (
        cells.select("_s", F.explode(F.aggregate("e", zero, take)["out"]).alias("p"))
        .select(F.col("_s").alias("_ps"), F.col("p.doc_id").alias("_pd"), F.col("p.size").alias("_pz"), F.col("p.k").alias("copies"))
    )
    on = F.col("_s").eqNullSafe(F.col("_ps")) & F.col("doc_id").eqNullSafe(F.col("_pd")) & (F.col("size") == F.col("_pz"))
    return rated.join(picked, on)


def op6(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
