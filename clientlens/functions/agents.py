"""What a User-Agent says.  Computed once per distinct value, then joined."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens import config as C
from clientlens.functions.text import has_any, quoted


def is_empty(ua: Column) -> Column:
    return F.coalesce(F.trim(ua), F.lit("")) == ""


# Patterns of contacts, product names and versions.
def declares_bot(ua: Column) -> Column:
    words = f"(?i){quoted(C.AUTOMATION)}|\\b(?:feed|rss)\\b|bot\\b"
    contact = r"(?i)\+(?:https?://|www\.|mailto:|[\w.%+-]+@)"
    return ~is_empty(ua) & (F.coalesce(ua.rlike(words), F.lit(False)) | F.coalesce(ua.rlike(contact), F.lit(False)))


def looks_like_browser(ua: Column) -> Column:
    return F.coalesce(ua.rlike(f"(?i)mozilla/\\d.*(?:{quoted(C.ENGINES)})"), F.lit(False)) & ~declares_bot(ua)


def is_feed_reader(ua: Column) -> Column:
    words = f"(?i)\\b(?:{'|'.join(C.FEED_TERMS)})\\b|{quoted(C.FEED_READERS)}"
    return ~is_empty(ua) & F.coalesce(ua.rlike(words), F.lit(False))


def product_token(ua: Column) -> Column:
    """The name a robots.txt would call an agent by: that after ``compatible;``,
    else the first name with a version unless that is Mozilla."""
    after = F.regexp_extract(ua, r"(?i)compatible;\s*([A-Za-z][A-Za-z0-9._-]*)", 1)
    first = F.regexp_extract(ua, r"([A-Za-z][A-Za-z0-9._-]+)/[0-9]", 1)
    return F.when(after != "", F.lower(after)).when((first != "") & (F.lower(first) != "mozilla"), F.lower(first))


def browser_family(ua: Column) -> Column:
    return (
        F.when(ua.rlike(r"(?i)(?:firefox|fxios)/\d{1,9}"), "firefox").when(ua.rlike(r"(?i)(?:chrome|crios)/\d{1,9}"), "chrome")
        .when(ua.rlike(r"(?i)version/\d{1,9}.*safari"), "safari")
    )


def browser_major(ua: Column) -> Column:
    ex = lambda p: F.regexp_extract(ua, p, 1).try_cast("bigint")
    return F.coalesce(ex(r"(?i)(?:firefox|fxios)/(\d{1,9})"), ex(r"(?i)(?:chrome|crios)/(\d{1,9})"), ex(r"(?i)version/(\d{1,9}).*safari"))


def version_band(family: Column, major: Column, as_of: Column) -> Column:
    """current, stale, ancient or impossible, from an estimate of when the
    version came out; null where neither can be said."""
    released = F.lit(None).cast("date")
    for name, anchor, date, days in C.RELEASES:
        m = F.when(major >= 26, major - 7).otherwise(major) if name == "safari" else major  # 19 to 25 were skipped
        shift = F.least(F.greatest((m - anchor) * days, F.lit(-36500)), F.lit(365000)).cast("int")
        released = F.when(family == name, F.date_add(F.lit(date).cast("date"), shift)).otherwise(released)
    age = F.datediff(as_of.cast("date"), released) / F.lit(30.4)
    safari = F.when(age < -13, None).when(age <= 13, "current").when(age >= 24, "stale")
    other = F.when(age < -12, "impossible").when(age <= 6, "current").when(age >= 36, "ancient").when(age >= 18, "stale")
    return F.when(family == "safari", safari).otherwise(other)


def agent_table(spark, agents=None) -> DataFrame:
    """(rank, category, token) of declared agents; ``agents`` replaces the list."""
    rows = [(i, c, t.lower()) for i, (c, t) in enumerate(agents or C.AGENTS)]
    return spark.createDataFrame(rows, "rank int, category string, token string")


#: Agents up to which their tokens are one array that each User-Agent is held against.
MOST_AGENTS = 10_000


def agent_profile(uas: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """One row per distinct ``user_agent`` of ``uas`` with all that it says.

    Tokens are matched on distinct values: all of them are one literal array, so no
    side is joined; only a list of more than ``MOST_AGENTS`` is.  The first token
    in order wins, of all and of each category (``category_tokens``).
    """
    ua = F.col("user_agent")
    d = uas.select("user_agent").distinct()
    known = agents if agents is not None else agent_table(d.sparkSession)
    known = known.select(F.col("rank").cast("int").alias("rank"), "category", F.lower("token").alias("token"))
    some = known.limit(MOST_AGENTS + 1).collect()
    if len(some) <= MOST_AGENTS:
        table = F.from_json(F.lit(json.dumps([r.asDict() for r in some])), "array<struct<rank:int,category:string,token:string>>")
        d = d.withColumn("_hits", F.array_sort(F.filter(table, lambda x: F.contains(F.lower(ua), x["token"]))))
    else:
        hit = d.join(known, F.lower(ua).contains(F.col("token"))).groupBy("user_agent").agg(F.array_sort(F.collect_list(F.struct("rank", "category", "token"))).alias("_hits"))
        d = d.join(hit, "user_agent", "left")
    cats = F.array_distinct(F.transform("_hits", lambda x: x["category"]))
    first = F.transform(cats, lambda c: F.get(F.filter("_hits", lambda x: x["category"] == c), F.lit(0))["token"])
    d = d.withColumns({"first": F.get("_hits", F.lit(0)), "categories": cats, "category_tokens": F.map_from_arrays(cats, first)})
    crawler = F.coalesce(F.arrays_overlap("categories", F.array(*map(F.lit, C.KNOWN_CRAWLERS))), F.lit(False))
    return d.select(
        "user_agent", is_empty(ua).alias("ua_empty"), looks_like_browser(ua).alias("ua_browser"), declares_bot(ua).alias("ua_bot"),
        has_any(ua, C.HEADLESS).alias("ua_headless"), has_any(ua, C.LIBRARIES).alias("ua_library"), is_feed_reader(ua).alias("ua_feed"),
        has_any(ua, C.APPS).alias("ua_app"), has_any(ua, C.SCANNERS).alias("ua_scanner"), has_any(ua, C.MONITORS).alias("ua_monitor"),
        crawler.alias("ua_crawler"), F.col("first.category").alias("agent_category"), F.col("first.token").alias("agent_token"), "category_tokens",
        product_token(ua).alias("product"), browser_family(ua).alias("family"), browser_major(ua).alias("major"),
    )
