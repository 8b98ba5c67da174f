"""Who is one client: identities, routes, and what ordered traffic measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientlens import config as C
from clientlens.functions.entry import with_flags
from clientlens.functions.hosts import subnet
from clientlens.sources.shared import kept

KEY = ["client_ip", "client_ua"]


def identity(name: str = "ip_ua") -> tuple[Column, Column]:
    """(ip, ua) of the client an entry belongs to."""
    ip, ua = F.col("remote_host"), F.col("user_agent")
    none = F.lit(None).cast("string")
    return {
        "ip": (ip, none),
        "ip_ua": (ip, ua),
        "ip_ua_subnet": (F.coalesce(subnet(ip, 4), ip), ua),
        "forwarded": (F.coalesce(F.get("forwarded_for", F.lit(0)), ip), ua),
    }[name]


def with_client(entries: DataFrame, name: str = "ip_ua") -> DataFrame:
    ip, ua = identity(name)
    return entries.withColumns({"client_ip": ip, "client_ua": ua})


def by_client():
    """Null User-Agents are a value of their own: windows group nulls together."""
    return Window.partitionBy(*KEY)


def _seconds() -> Column:
    return F.unix_micros("ts") / 1e6


def in_slices(flagged: DataFrame, parts: int | None = None) -> DataFrame:
    """Entries in slices: range partitioned by client and order, so that a client
    with much of the log is several slices, each in a task of its own.  What an
    entry needs of those before it is measured within its slice, and the table is
    written once; :func:`with_order` adds what earlier slices carry over.  Entries
    without flags get them after the exchange, which evaluates what is before it
    twice, for its bounds and its rows."""
    n = parts or int(flagged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = flagged.repartitionByRange(n, *KEY, "seq")
    d = (d if "static" in d.columns else with_flags(d)).withColumn("_part", F.spark_partition_id())
    own = Window.partitionBy("_part", *KEY)
    w = own.orderBy("seq")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({
        "_head": F.lag(F.lit(1)).over(w).isNull(), "_top": F.lag("top").over(w), "_newest": F.max(F.when(~F.col("static"), F.col("ts"))).over(before),
        "_content": F.coalesce(F.max((~F.col("robots_file")).cast("int")).over(before), F.lit(0)),
        "_pages": F.max(F.when(F.col("page"), _seconds())).over(before), "_clock": F.max(_seconds()).over(before),
    })
    quiet = F.coalesce(_seconds() > F.col("_pages") + C.COLOAD_SECONDS, F.lit(False))
    return kept(d.withColumns({"_wait": F.sum(quiet.cast("int")).over(upto), "_late": F.max(F.coalesce(F.col("_clock") > _seconds(), F.lit(False)).cast("int")).over(own)}), "ordered")


def carried(slices: DataFrame) -> DataFrame:
    """(client, _part, _c): what a client's earlier slices leave to a later one, null
    for the first.  Where time goes back between slices, a cut of the later one may
    come while pages of earlier ones wait; such a slice is not cut (``whole``).

    Two neighbours share at most one client, so there are at most two rows a
    partition; they are put in order on the driver.
    """
    who = F.struct(*KEY)
    ends = slices.groupBy("_part").agg(F.min(who).alias("lo"), F.max(who).alias("hi")).orderBy("_part").collect()
    spanning = {b.lo for a, b in zip(ends, ends[1:], strict=False) if a.hi == b.lo}
    spark = slices.sparkSession
    keys = ", ".join(f"{k} {slices.schema[k].dataType.simpleString()}" for k in KEY)
    some = spark.createDataFrame([tuple(c) for c in spanning], keys).withColumnsRenamed({k: f"_{k}" for k in KEY})
    own = slices.join(F.broadcast(some), F.col(KEY[0]).eqNullSafe(F.col(f"_{KEY[0]}")) & F.col(KEY[1]).eqNullSafe(F.col(f"_{KEY[1]}")))
    parts = own.groupBy(*KEY, "_part").agg(
        F.max_by("top", "seq").alias("top"), F.max(F.when(~F.col("static"), F.unix_micros("ts"))).alias("newest"), F.bool_or(~F.col("robots_file")).alias("content"),
        F.max(F.when(F.col("page"), _seconds())).alias("pages"), F.max("_wait").alias("wait"),
        F.min(F.when(_seconds() > F.col("_pages") + C.COLOAD_SECONDS, _seconds())).alias("cut"),
    ) if spanning else None
    rows, state = [], {}
    most = lambda a, b: a if b is None else b if a is None else max(a, b)
    for r in sorted(parts.collect(), key=lambda r: r["_part"]) if parts is not None else []:
        c = (r[KEY[0]], r[KEY[1]])
        _, newest, content, pages, wait = state.get(c, (None, None, False, None, None))
        whole = None not in (pages, r["cut"]) and r["cut"] <= pages + C.COLOAD_SECONDS
        rows.append((*c, r["_part"], (*state[c], whole) if c in state else None))
        # a slice in which nothing is cut goes on with the group of the one before
        wait = f"{r['_part']}:{r['wait']}" if wait is None or (r["wait"] and not whole) else wait
        state[c] = (r["top"], most(newest, r["newest"]), content or r["content"], most(pages, r["pages"]), wait)
    return spark.createDataFrame(rows, f"{keys}, _part int, _c struct<top:string,newest:bigint,content:boolean,pages:double,wait:string,whole:boolean>")


def with_order(flagged: DataFrame, parts: int | None = None) -> DataFrame:
    """:func:`ordered` entries, and whether the referer is a page this client fetched
    before (``followed``)."""
    return with_first(ordered(flagged, parts))


def ordered(flagged: DataFrame, parts: int | None = None) -> DataFrame:
    """What needs an entry's predecessors: change of top segment, gap since the
    latest earlier page-like request, whether robots.txt came first, and the group
    of requests (``_wait``) that no ten quiet seconds cut."""
    d = in_slices(flagged, parts)
    carry = F.broadcast(carried(d)).withColumnsRenamed({k: f"_{k}" for k in KEY} | {"_part": "_p"})  # two rows a partition at most
    same = (F.col("_part") == F.col("_p")) & F.col(KEY[0]).eqNullSafe(F.col(f"_{KEY[0]}")) & F.col(KEY[1]).eqNullSafe(F.col(f"_{KEY[1]}"))
    d = d.join(carry, same, "left").drop(*(f"_{k}" for k in KEY))
    c = F.col("_c")
    newest = F.greatest(F.unix_micros("_newest"), c["newest"])
    own = F.col("has_referer") & (F.col("ref_path") == F.col("path"))
    wait = F.when(c.isNotNull() & ((F.col("_wait") == 0) | c["whole"]), c["wait"]).otherwise(F.concat_ws(":", F.col("_part").cast("string"), F.col("_wait").cast("string")))
    return d.withColumns({
        "turned": F.coalesce(F.when(F.col("_head"), c["top"]).otherwise(F.col("_top")) != F.col("top"), F.lit(False)),
        "delta": F.when(~F.col("static") & (F.unix_micros("ts") >= newest), (F.unix_micros("ts") - newest) / 1e6),
        "robots_first": F.col("robots_file") & (F.col("_content") == 0) & ~F.coalesce(c["content"], F.lit(False)),
        "self_ref": own, "_wait": wait, "_pages": F.coalesce("_pages", c["pages"]), "_late": (F.col("_late") == 1) | F.col("_p").isNotNull(),  # late entries may be in another slice
    }).drop("_c", "_p")


def fetched(d: DataFrame) -> DataFrame:
    """(client, path, first_seq): when each path was fetched first."""
    return d.groupBy(*KEY, "path").agg(F.min("seq").alias("first_seq"))


def with_first(d: DataFrame) -> DataFrame:
    first = fetched(d).withColumnsRenamed({"client_ip": "_i", "client_ua": "_u", "path": "_p"})
    on = F.col("client_ip").eqNullSafe(F.col("_i")) & F.col("client_ua").eqNullSafe(F.col("_u")) & (F.col("ref_path") == F.col("_p"))
    j = d.join(first, on, "left").drop("_i", "_u", "_p")
    return j.withColumn("followed", F.col("has_referer") & ~F.col("self_ref") & F.coalesce(F.col("first_seq") < F.col("seq"), F.lit(False)))


def follows(entries: DataFrame) -> DataFrame:
    """(client, followed): entries whose referer is a page this client fetched before,
    of clients with any.  Only entries that name another page are joined."""
    refs = entries.where(F.col("has_referer") & ~F.col("self_ref")).select(*KEY, "seq", "ref_path")
    first = fetched(entries).withColumnsRenamed({"client_ip": "_i", "client_ua": "_u", "path": "_p"})
    on = F.col("client_ip").eqNullSafe(F.col("_i")) & F.col("client_ua").eqNullSafe(F.col("_u")) & (F.col("ref_path") == F.col("_p"))
    return refs.join(first, on).where("first_seq < seq").groupBy(*KEY).agg(F.count(F.lit(1)).alias("followed"))


def spread(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Different paths, different targets and the first User-Agent of clients.  Each is
    grouped by value first, which the slices all but do, so no entry is repeated for
    a count of different values and none is sorted."""
    paths = fetched(entries).groupBy(*KEY).agg(F.count("path").alias("distinct_paths"))
    found = entries.groupBy(*KEY, "target").agg(F.max((F.col("status") == 404).cast("int")).alias("missing"))
    capped = lambda c, name: F.least(F.count(c), F.lit(C.TARGET_CAP)).alias(name)
    targets = found.groupBy(*KEY).agg(capped(F.when(F.col("missing") == 1, F.col("target")), "distinct_404"), capped(F.col("target"), "distinct_targets"))
    said = entries.where("user_agent <> ''").groupBy(*KEY, "user_agent").agg(F.min("seq").alias("seq"))
    return paths, targets, said.groupBy(*KEY).agg(F.min_by("user_agent", "seq").alias("user_agent"))


def coload(flagged: DataFrame) -> DataFrame:
    """(client, pages_total, pages_satisfied) of clients with timed entries, see
    :func:`coload_ordered`."""
    return coload_ordered(ordered(flagged))


def coload_ordered(entries: DataFrame) -> DataFrame:
    """A page is satisfied by an asset that names it as referer within ten seconds;
    one asset satisfies one page, the oldest waiting, and pages that waited longer
    fall away.

    One ordered fold for each group of requests between which no ten seconds pass
    without a page: the state at its start is empty, so groups are independent and
    a busy client's are spread over tasks.  Groups without a page are not folded;
    of other entries only those that can push the clock past late ones are.
    """
    kind = F.when(F.col("page"), "P").when(F.col("static") & ~F.col("chrome_asset") & F.col("has_referer"), "A").otherwise("O")
    ev = entries.where("ts is not null").select(*KEY, "seq", "_wait", "_pages", "_late", _seconds().alias("t"), kind.alias("k"), F.when(kind == "P", F.col("path")).otherwise(F.col("ref_path")).alias("p"))
    ev = ev.where("k = 'P' or (_pages is not null and (k = 'A' or _late))")
    pend = "array<struct<t:double,p:string>>"

    def step(acc, x):
        alive = F.array_position(F.transform(acc["pend"], lambda y: y["t"] >= x["t"] - C.COLOAD_SECONDS), True)
        kept_ = F.when(alive == 0, F.array().cast(pend)).otherwise(F.slice(acc["pend"], F.greatest(alive, F.lit(1)).cast("int"), F.greatest(F.size(acc["pend"]), F.lit(1))))

        def use(q):
            at = F.array_position(F.transform(q, lambda y: y["p"]), x["p"])
            hit = (x["k"] == "A") & (at > 0)
            grown = F.when(x["k"] == "P", F.concat(q, F.array(F.struct(x["t"].alias("t"), x["p"].alias("p")))))
            return F.struct(
                grown.when(hit, F.filter(q, lambda y, j: j != at - 1)).otherwise(q).alias("pend"), (acc["hits"] + F.when(hit, 1).otherwise(0)).alias("hits")
            )

        return F.element_at(F.transform(F.array(kept_), use), 1)

    start = F.struct(F.array().cast(pend).alias("pend"), F.lit(0).alias("hits"))
    items = F.sort_array(F.collect_list(F.struct("seq", "t", "k", "p")))
    groups = ev.groupBy(*KEY, "_wait").agg(F.count_if(F.col("k") == "P").alias("pages"), F.aggregate(items, start, step, lambda a: a["hits"]).alias("hits"))
    timed = entries.where("ts is not null").groupBy(*KEY).agg(F.lit(0).cast("bigint").alias("pages"), F.lit(0).alias("hits"))
    return groups.select(*KEY, "pages", "hits").unionByName(timed).groupBy(*KEY).agg(F.sum("pages").alias("pages_total"), F.sum("hits").cast("int").alias("pages_satisfied"))


def gap_bucket(delta: Column) -> Column:
    """Bucket of a gap: 0 for none, then ten a decade from 1 ms to 10**7 s, with the
    shorter in the first and the longer in the last."""
    at = F.floor((F.log10(delta) + 3) * 10) + 1
    return F.when(delta <= 0, F.lit(0)).otherwise(F.least(F.greatest(at, F.lit(1)), F.lit(C.GAP_BUCKETS - 1))).cast("int")


def gaps(entries: DataFrame) -> DataFrame:
    """(client, iat_n, iat_mean, iat_sq, iat_min, iat_median, iat_p95): exact up to
    256 gaps; beyond, quantiles are read off a mergeable histogram of 102 buckets, as
    the geometric centre of a bucket.

    Gaps are summed by slice and bucket first; lists exist only for buckets of up to
    256 gaps, so no client's gaps are ever in one place.
    """
    d = entries.where("delta is not null").withColumn("bucket", gap_bucket(F.col("delta")))
    n = F.count(F.lit(1))
    some = d.groupBy(*KEY, "_part", "bucket").agg(
        n.alias("n"), F.sum("delta").alias("s"), F.sum(F.col("delta") * F.col("delta")).alias("sq"), F.min("delta").alias("least"), F.when(n <= C.EXACT_DELTAS, F.collect_list("delta")).alias("list"),
    )
    whole = some.groupBy(*KEY).agg(
        F.sum("n").alias("iat_n"), F.sum("s").alias("_s"), F.sum("sq").alias("_sq"), F.min("least").alias("iat_min"),
        F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("_hist"), F.when(F.sum("n") <= C.EXACT_DELTAS, F.array_sort(F.flatten(F.collect_list("list")))).alias("_all"),
    )
    s, k = F.col("_all"), F.col("iat_n")
    at = lambda i: F.get(s, i.cast("int"))
    median = F.when(k % 2 == 1, at(F.floor(k / 2))).otherwise((at(F.floor(k / 2) - 1) + at(F.floor(k / 2))) / 2)
    p95 = at(F.bround(F.lit(0.95) * (k - 1)))

    def binned(q):
        def step(a, x):
            seen = a["n"] + x["n"]
            return F.struct(seen.alias("n"), F.coalesce(a["b"], F.when(seen >= F.lit(q) * k, x["bucket"])).alias("b"))

        b = F.aggregate("_hist", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("int").alias("b")), step, lambda a: a["b"])
        return F.when(b <= 0, F.lit(0.0)).otherwise(F.pow(F.lit(10.0), (b - 0.5) / 10 - 3))

    return whole.select(
        *KEY, "iat_n", (F.col("_s") / k).alias("iat_mean"), (F.col("_sq") / k).alias("iat_sq"), "iat_min",
        F.when(k <= C.EXACT_DELTAS, median).otherwise(binned(0.5)).alias("iat_median"), F.when(k <= C.EXACT_DELTAS, p95).otherwise(binned(0.95)).alias("iat_p95"),
    )


def features(flagged: DataFrame) -> DataFrame:
    return features_of(ordered(flagged))


def features_of(entries: DataFrame) -> DataFrame:
    """One row of measures per client, from :func:`ordered` entries.

    The log is read once, into ordered slices; from these come totals with partial
    sums, gaps, the per-minute peak (grouped by minute first), different values
    (grouped by value first), followed referers, and the co-load fold.
    """
    c = lambda e: F.count_if(e)
    s = F.col("status")
    low = entries.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("total_bytes"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        c(s.isNotNull()).alias("with_status"), *[c(s.between(100 * k, 100 * k + 99)).alias(f"n{k}xx") for k in (2, 3, 4, 5)],
        c(s == 404).alias("n404"), c(s == 403).alias("n403"), c(s == 304).alias("n304"),
        c(F.col("probe")).alias("probe_hits"), c(F.col("submit")).alias("submit_hits"), c(F.col("traversal")).alias("traversal_hits"),
        c(F.col("evasion")).alias("evasion_hits"), c(F.col("exotic")).alias("exotic_hits"), c(F.col("static")).alias("static_hits"),
        c(F.col("feed")).alias("feed_hits"), c(F.col("page")).alias("page_count"), c(F.col("method") == "GET").alias("gets"),
        c(F.col("method") == "HEAD").alias("heads"), c(F.col("method") == "POST").alias("posts"), F.bool_or("robots_file").alias("fetched_robots"), F.bool_or("robots_first").alias("robots_first"),
        c(F.col("same_site") & F.col("ref_host").startswith("www.")).alias("www_referers"), c(F.col("same_site") & ~F.col("ref_host").startswith("www.")).alias("apex_referers"),
        c(F.col("has_referer")).alias("referers"), c(F.col("self_ref")).alias("self_referers"),
        c(F.col("turned")).alias("turns"),
    )
    minute = entries.where("ts is not null").groupBy(*KEY, F.floor(F.unix_seconds("ts") / 60).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    peak = minute.groupBy(*KEY).agg(F.max("n").alias("peak_rpm"))
    out = low
    for other in (*spread(entries), follows(entries), peak, coload_ordered(entries), gaps(entries)):
        o = other.withColumnsRenamed({"client_ip": "_i", "client_ua": "_u"})
        out = out.join(o, F.col("client_ip").eqNullSafe(F.col("_i")) & F.col("client_ua").eqNullSafe(F.col("_u")), "left").drop("_i", "_u")
    return finalize(out.withColumn("followed", F.coalesce("followed", F.lit(0).cast("bigint"))))


def finalize(p: DataFrame) -> DataFrame:
    """Ratios and statistics, once all counts are together."""
    n, seen = F.col("requests"), F.nullif(F.col("with_status"), F.lit(0))
    share = lambda a, b: F.coalesce(F.col(a) / b, F.lit(0.0))
    p = p.withColumn("iat_n", F.coalesce("iat_n", F.lit(0)).cast("int"))
    revisits = n - F.col("distinct_paths")
    return p.withColumns({
        "mean_bytes": F.col("total_bytes") / n,
        "duration": F.coalesce((F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 1e6, F.lit(0.0)),
        "ratio_2xx": share("n2xx", seen), "ratio_3xx": share("n3xx", seen), "ratio_4xx": share("n4xx", seen), "ratio_404": share("n404", seen),
        "ratio_403": share("n403", seen), "probe_ratio": F.col("probe_hits") / n, "regularity": F.when(F.col("iat_mean") > 0, F.sqrt(F.greatest(F.col("iat_sq") - F.col("iat_mean") ** 2, F.lit(0.0))) / F.col("iat_mean")),
        "peak_rpm": F.coalesce("peak_rpm", F.lit(0)),
        "coload_ratio": F.coalesce(F.col("pages_satisfied") / F.nullif(F.col("pages_total"), F.lit(0)), F.lit(0.0)),
        "coverage": F.col("distinct_paths") / n, "breadth": F.when(n > 1, F.col("turns") / (n - 1)).otherwise(0.0),
        "follow_ratio": F.col("followed") / n, "self_referer_ratio": F.col("self_referers") / n, "static_ratio": F.col("static_hits") / n,
        "get_ratio": F.col("gets") / n, "head_ratio": F.col("heads") / n, "post_ratio": F.col("posts") / n, "feed_ratio": F.col("feed_hits") / n,
        "holds_no_cache": (F.col("n304") == 0) & (F.col("distinct_paths") > 0) & ((revisits >= 20) | (n >= 500)),
        "refetches": ((revisits >= 20) & (revisits >= n * 0.5)) | (n >= 2000),
    }).drop("iat_sq")


def request_buckets(entries: DataFrame) -> DataFrame:
    """(client, bucket, requests): a client's requests over forty equal parts of
    its own span, by minutes; nothing where the span is one minute."""
    m = F.floor(F.unix_seconds("ts") / 60)
    per = entries.where("ts is not null").groupBy(*KEY, m.alias("m")).agg(F.count(F.lit(1)).alias("n"))
    span = per.withColumns({"lo": F.min("m").over(by_client()), "hi": F.max("m").over(by_client())}).where("hi > lo")
    slot = F.least(F.floor((F.col("m") - F.col("lo")) * C.BUCKETS / (F.col("hi") - F.col("lo"))), F.lit(C.BUCKETS - 1)).cast("int")
    return span.groupBy(*KEY, slot.alias("bucket")).agg(F.sum("n").alias("requests"))


def ua_count(entries: DataFrame) -> DataFrame:
    """(ip, uas): distinct User-Agents of an address; a missing one counts.  Where
    entries have routes, those of folds do not."""
    own = entries.where("route = 'regular'") if "route" in entries.columns else entries
    return own.groupBy(F.col("remote_host").alias("ip")).agg(
        (F.count_distinct("user_agent") + F.max(F.col("user_agent").isNull().cast("int"))).alias("uas")
    )


def first_paths(entries: DataFrame, k: int) -> DataFrame:
    """(client, paths): the first ``k`` different paths of each client, in order."""
    first = entries.groupBy(*KEY, "path").agg(F.min("seq").alias("seq"))
    some = first.withColumn("place", F.row_number().over(by_client().orderBy("seq"))).where(F.col("place") <= k)
    return some.groupBy(*KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths"))


def trace(entries: DataFrame, k: int) -> DataFrame:
    """The first ``k`` entries of each client, with their place."""
    return entries.withColumn("place", F.row_number().over(by_client().orderBy("seq"))).where(F.col("place") <= k)
