"""Eighteen classifiers as columns, and the verdict from their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens import config as C
from clientlens.functions.agents import version_band

col, when, lit = F.col, F.when, F.lit


def add(*parts: tuple[Column, float]) -> Column:
    """Sum of the weights whose condition holds."""
    out = lit(0.0)
    for cond, weight in parts:
        out = out + when(F.coalesce(cond, lit(False)), lit(weight)).otherwise(lit(0.0))
    return out


def recognised() -> Column:
    return col("ua_crawler") | col("ua_feed")


def known_agent() -> Column:
    return col("ua_bot") | recognised()


def clean() -> Column:
    return (col("probe_hits") == 0) & (col("traversal_hits") == 0) & (col("evasion_hits") == 0)


def storm() -> Column:
    return (col("ratio_404") > 0.6) & (col("distinct_404") >= 15)


def forbidden() -> Column:
    return (col("n403") >= 5) & (col("ratio_403") >= 0.5)


def declared(category: str) -> Column:
    """Agents that say who they are: 0.7, more for asking robots.txt and for
    clean requests; 0.6 for those only their AS tells."""
    said = when(col("agent_category") == category, 0.7 + add((col("fetched_robots"), 0.08), (clean(), 0.05)))
    return F.coalesce(said, when(col("as_category") == category, lit(0.6)))


def vuln_scanner() -> Column:
    strong = (col("probe_hits") >= 3) | (col("probe_ratio") >= 0.5)
    s = add(
        (col("ua_scanner") | (col("agent_category") == "vuln_scanner"), 0.5), (strong, 0.45), (~strong & (col("probe_hits") > 0), 0.2),
        (storm(), 0.3), (forbidden(), 0.3), (col("traversal_hits") > 0, 0.15), (col("evasion_hits") > 0, 0.25), (col("exotic_hits") > 0, 0.1),
    )
    quick = (col("iat_median") < 0.5) & (col("requests") >= 5)
    return when(s > 0, s + add((quick, 0.1)))


def browser() -> Column:
    """A fixed sequence: credits, then penalties and ceilings in their order, the
    later ones only if anything spoke for a browser before."""
    n, reg = col("requests"), col("regularity")
    said = lit(False)
    metronomic = F.coalesce((reg < 0.15) & (n >= 5), lit(False))
    first = [
        ((col("page_count") >= 1) & (col("coload_ratio") > 0.4), 0.45), (col("ua_browser"), 0.2), (reg > 0.6, 0.1), (metronomic, -0.2),
        (col("follow_ratio") > 0.3, 0.1), ((col("ratio_404") < 0.1) & (col("probe_hits") == 0), 0.1), (col("static_ratio") > 0.3, 0.05),
        (col("n304") > 0, 0.1),
    ]
    for cond, _ in first:
        said = said | F.coalesce(cond, lit(False))
    # each step is conf = least(conf + credit, ceiling), so that no step repeats another
    band, never = col("band"), lit(9.0)
    old = band.isin("ancient", "impossible")
    probing = (col("traversal_hits") > 0) | (col("evasion_hits") > 0) | (col("probe_hits") >= 2)
    forged = (col("self_referer_ratio") >= 0.5) & (n >= 4)
    steps = [
        (said & old, None), (said & (band == "current"), 0.1), (said & (band == "stale"), -0.15), (said & col("fetched_robots"), -0.15),
        (said & col("holds_no_cache") & col("refetches"), None), (said & col("holds_no_cache") & ~col("refetches"), -0.2), (probing, None), (forged, None),
        ((said | probing | forged) & (col("head_ratio") > 0.1), None),
    ]
    conf = add(*first)
    for cond, credit in steps:
        cond = F.coalesce(cond, lit(False))
        conf = F.least(conf, when(cond, lit(0.3)).otherwise(never)) if credit is None else conf + when(cond, lit(credit)).otherwise(lit(0.0))
    out = metronomic | old | col("fetched_robots") | col("holds_no_cache") | probing | forged | (col("head_ratio") > 0.1)
    least = when(col("ua_browser") & ~F.coalesce(out, lit(False)), lit(C.UNKNOWN_THRESHOLD)).otherwise(lit(-9.0))
    return when((said | probing | forged) & ~known_agent(), F.greatest(conf, least))


def crawler() -> Column:
    broad = (col("distinct_paths") >= 20) & (col("coverage") > 0.7)
    lean = (col("coload_ratio") < 0.1) & (col("requests") >= 4)
    s = add(
        (broad, 0.3), ((col("regularity") < 0.5) & (col("requests") >= 10), 0.2), (col("follow_ratio") > 0.3, 0.15), (col("ua_bot"), 0.15),
        (col("ua_bot") & lean & (col("distinct_paths") >= 20), 0.3), (col("ua_bot") & lean & (col("distinct_paths") < 20), 0.2),
    )
    good = (col("ratio_2xx") > 0.7) & (col("coload_ratio") < 0.1)
    return when((s > 0) & ~recognised(), s + add((good, 0.1)))


def scraper() -> Column:
    broad = (col("distinct_paths") >= 10) & (col("requests") >= 15)
    s = add(
        (broad & (col("coload_ratio") < 0.1) & ~col("ua_browser"), 0.3), (broad & (col("follow_ratio") < 0.1), 0.15), (col("ua_library"), 0.2),
        (~col("ua_library") & col("ua_empty") & broad, 0.15),
    )
    return when((s > 0) & ~recognised(), s + add(((col("probe_hits") == 0) & (col("ratio_2xx") > 0.6), 0.05)))


def monitor() -> Column:
    n = col("requests")
    s = add(
        (col("ua_monitor") | (col("agent_category") == "monitor"), 0.4), ((col("distinct_targets") <= 2) & (n >= 5), 0.2), (col("head_ratio") > 0.5, 0.2),
        ((col("regularity") < 0.2) & (n >= 5), 0.25),
    )
    return when(s > 0, s)


def feed_reader() -> Column:
    n, much = col("requests"), col("feed_ratio") >= 0.5
    s = add(
        (much, 0.5), (~much & (col("feed_hits") > 0), 0.2), (col("ua_feed"), 0.5), ((col("distinct_targets") <= 3) & (n >= 4), 0.1),
        ((col("regularity") < 0.3) & (n >= 4), 0.1), (col("n304") > 0, 0.1), (col("head_ratio") > 0.2, 0.1),
    )
    return when(col("ua_feed") | much, s)


def spam_bot() -> Column:
    posting = col("post_ratio") > 0.3
    s = add((posting & (col("posts") >= 3), 0.4), (posting & (col("coload_ratio") < 0.1), 0.15), (col("submit_hits") > 0, 0.15))
    return when(s > 0, s)


def impossible_referer() -> Column:
    """Referers that name the side of the site which only redirects."""
    hits = when(col("shadow") == "www", col("www_referers")).when(col("shadow") == "apex", col("apex_referers")).otherwise(lit(0))
    return col("ua_browser") & ~known_agent() & (col("feed_hits") == 0) & (hits >= C.IMPOSSIBLE_HITS) & (hits / col("requests") >= C.IMPOSSIBLE_SHARE)


def spoofed_browser() -> Column:
    n = col("requests")
    cold = col("coload_ratio") < 0.4
    s = add(
        (impossible_referer(), 0.6), (col("datacenter"), 0.3), (col("head_ratio") > 0.1, 0.3), ((col("self_referer_ratio") >= 0.5) & (n >= 4), 0.3),
        (col("holds_no_cache") & col("refetches"), 0.45), (cold & (col("page_count") > 0) & (col("coload_ratio") == 0), 0.15),
        (cold & (col("follow_ratio") == 0), 0.15), (cold & (n >= 10) & (1 - col("referers") / n >= 0.9), 0.2),
        (cold & col("band").isin("ancient", "impossible"), 0.15),
    )
    gate = col("ua_browser") & ~known_agent() & (col("feed_ratio") < 0.5) & (n >= 2)
    return when(gate & (F.round(s, 3) >= 0.45), F.least(s, lit(0.9)))


def app() -> Column:
    return when(col("ua_app") & ~known_agent(), 0.65)


#: Kinds and their scores; null where a classifier has nothing to say.
SCORES = {k: (lambda k=k: declared(k)) for k in C.KINDS[1:10]} | {
    "vuln_scanner": vuln_scanner, "spam_bot": spam_bot, "feed_reader": feed_reader, "monitor": monitor, "browser": browser, "app": app,
    "scraper": scraper, "crawler": crawler, "spoofed_browser": spoofed_browser,
}


def with_context(features: DataFrame, profile: DataFrame) -> DataFrame:
    """Features with what the User-Agent says and the age of its version."""
    j = features.join(profile.withColumnRenamed("user_agent", "_ua"), F.col("user_agent").eqNullSafe(F.col("_ua")), "left").drop("_ua")
    flags = [c for c, t in profile.dtypes if t == "boolean"]
    j = j.withColumns({c: F.coalesce(c, lit(c == "ua_empty")) for c in flags})
    if "datacenter" not in j.columns:
        j = j.withColumn("datacenter", lit(False))
    # what checks say: of the network (identity, and each channel) and of signatures (wba)
    for name in ("shadow", "as_category", "identity", "dns_state", "range_state", "wba", "signer", "signer_claimed"):
        if name not in j.columns:
            j = j.withColumn(name, lit(None).cast("string"))
    if "wba_tags" not in j.columns:
        j = j.withColumn("wba_tags", F.array().cast("array<string>"))
    return j.withColumn("band", version_band(col("family"), col("major"), col("last_seen")))


def scores(clients: DataFrame) -> DataFrame:
    """A column ``s_<kind>`` per classifier, to three places, within 0 and 1."""
    raw = clients.withColumns({f"s_{k}": f() for k, f in SCORES.items()})
    # least and greatest skip nulls, which must stay null here
    within = lambda c: F.when(c.isNotNull(), F.round(F.greatest(F.least(c, lit(1.0)), lit(0.0)), 3))
    return raw.withColumns({f"s_{k}": within(col(f"s_{k}")) for k in SCORES})


def combine(scored: DataFrame, threshold: float = C.UNKNOWN_THRESHOLD) -> DataFrame:
    """Kind and confidence: scores are adjusted in order, the highest wins (ties by
    the order of kinds), and below the threshold fixed rungs decide."""
    browser_ = when(col("datacenter"), F.greatest(col("s_browser") - 0.1, lit(0.0))).otherwise(col("s_browser"))
    signed = F.coalesce(col("wba").isin("verified", "expired"), lit(False))
    d = scored.withColumn("s_browser", when(col("s_spoofed_browser").isNull() & ~signed, F.round(browser_, 3)))
    excused = F.coalesce(col("s_vuln_scanner") >= threshold, lit(False)) | (signed & col("signer").isNotNull())
    d = d.withColumn("s_spoofed_browser", when(~excused, col("s_spoofed_browser")))
    rank = {k: i for i, k in enumerate(C.KINDS)}
    best = F.array_max(F.array(*[when(col(f"s_{k}").isNotNull(), F.struct(col(f"s_{k}").alias("c"), lit(-rank[k]).alias("r"), lit(k).alias("k"))) for k in SCORES]))
    d = d.withColumn("_best", best)
    dc_scraper = col("datacenter") & (col("requests") >= 5) & (col("distinct_paths") >= 3) & (col("ua_library") | col("ua_empty")) & clean()
    # a forged signature, or a check that failed where no signature holds, or one
    # that holds for another operator than the one claimed
    yes = lambda c: F.coalesce(c, lit(False))
    other = signed & yes(col("signer") != col("signer_claimed"))
    faked = yes(col("wba") == "forged") | other | (yes(col("identity") == "impersonator") & ~signed)
    tell = signed | col("ua_headless") | ((col("n304") == 0) & col("holds_no_cache")) | generic_ua() | bot_ua()
    low = ~F.coalesce(col("_best.c") >= threshold, lit(False))
    kind = when(faked, "impersonator").when(~low, col("_best.k")).when(dc_scraper, "scraper").when(tell | col("datacenter"), "automation").otherwise("unknown")
    conf = when(faked, lit(0.9)).when(~low, col("_best.c")).when(dc_scraper | tell | col("datacenter"), 0.5).otherwise(F.coalesce(col("_best.c"), lit(0.0)))
    return d.withColumns({"kind": kind, "confidence": conf}).drop("_best")


def generic_ua() -> Column:
    return col("band").isNull() & ~col("ua_browser") & col("ua_library")


def bot_ua() -> Column:
    return col("band").isNull() & ~col("ua_browser") & ~col("ua_library") & col("ua_bot") & ~recognised()


# What a channel's answer is called in tags.
CHANNEL = {"pass": "verified", "fail": "violation", "unknown": "unverified"}


def tag_columns() -> dict[str, Column]:
    n, reg = col("requests"), F.when(col("requests") >= 5, col("regularity"))
    fake = col("ua_browser") & ~known_agent() & (n >= 2) & (col("coload_ratio") == 0) & (col("follow_ratio") == 0)
    many = F.coalesce(col("uas"), lit(1)) >= 4
    return {
        "metronomic": reg < 0.15, "steady": reg.between(0.15, 0.6), "bursty": reg > 0.6,
        "loads-assets": (col("page_count") >= 1) & (col("coload_ratio") > 0.4), "no-assets": (col("page_count") >= 1) & (col("coload_ratio") < 0.1),
        "follows-links": (col("referers") > 0) & (n >= 4) & (col("follow_ratio") > 0.3), "cold": (col("referers") > 0) & (n >= 4) & (col("follow_ratio") < 0.1),
        "has-cache": col("n304") > 0, "lacks-cache": (col("n304") == 0) & col("holds_no_cache"), "headless-browser": col("ua_headless"),
        **{f"{b}-browser-ua": col("band") == b for b in ("current", "stale", "ancient", "impossible")},
        "browser-ua": col("band").isNull() & col("ua_browser"), "generic-ua": generic_ua(), "bot-ua": bot_ua(),
        "probe-paths": (col("probe_hits") >= 3) | (col("probe_ratio") >= 0.05), "traversal": col("traversal_hits") > 0,
        "encoding-evasion": col("evasion_hits") > 0, "404-storm": storm(), "often-forbidden": forbidden(), "exotic-method": col("exotic_hits") > 0,
        "uses-HEAD": col("head_ratio") > 0.1, "post-heavy": (col("post_ratio") > 0.5) & (n >= 5),
        "impossible-referer": impossible_referer(), "asn-associated": col("identity") == "asn-associated", "asn-attributed": col("as_category").isNotNull(),
        **{f"{x}-{word}": col(state) == found for x, state in (("dns", "dns_state"), ("ip", "range_state")) for found, word in CHANNEL.items()},
        "forged-referer": (col("self_referer_ratio") >= 0.5) & (n >= 4) & col("ua_browser") & ~known_agent(), "singleton": n == 1,
        "datacenter": col("datacenter"), "no-user-agent": col("ua_empty"), "checked-robots": col("fetched_robots"), "declares-known-bot": col("ua_crawler"),
        "fetches-feeds": col("ua_feed"), "polls-feeds": col("feed_hits") > 0, "declares-app-client": col("ua_app"),
        "ua-rotating": many & (col("datacenter") | fake), "shared-ip": many & ~(col("datacenter") | fake),
        "fetches-non-feeds": (col("kind") == "feed_reader") & (n - col("feed_hits") - col("fetched_robots").cast("int") > 0),
    }


def with_tags(combined: DataFrame) -> DataFrame:
    """Sorted tags of each client."""
    d = combined if "uas" in combined.columns else combined.withColumn("uas", lit(1))
    tags = F.array_compact(F.array(*[when(c, lit(t)) for t, c in tag_columns().items()]))
    return d.withColumn("tags", F.array_sort(F.array_union(tags, F.coalesce("wba_tags", F.array().cast("array<string>")))))
