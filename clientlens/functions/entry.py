"""Flags of a single log entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens import config as C
from clientlens.functions.hosts import bare_host, referer_host, referer_path, site_key
from clientlens.functions.text import has_any, quoted


def extension(path: Column) -> Column:
    """Lower-cased extension of the last segment, "" if it has none."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"\.([^.]*)$", 1))


def media_type(content_type: Column, status: Column) -> Column:
    """The response's media type where the status makes it tell of the path."""
    return F.coalesce(F.when(status == 200, F.lower(F.trim(F.split(content_type, ";", 2)[0]))), F.lit(""))


def is_static(path: Column, media: Column) -> Column:
    by_type = media.rlike("^(?:" + quoted(C.STATIC_MEDIA) + ")")
    return F.when(media != "", by_type).otherwise(extension(path).isin(C.STATIC_EXT))


def is_page(path: Column, status: Column, media: Column, static: Column | None = None) -> Column:
    static = is_static(path, media) if static is None else static
    by_type = media.rlike("^(?:" + quoted(C.PAGE_MEDIA) + ")")
    by_path = ~static & (path.endswith("/") | (extension(path) == "") | extension(path).isin(C.PAGE_EXT))
    return F.coalesce(status == 200, F.lit(False)) & F.when(media != "", by_type).otherwise(by_path)


def is_feed(path: Column, content_type: Column) -> Column:
    name = F.lower(F.substring_index(path, "/", -1))
    parts = F.arrays_overlap(F.split(name, r"[.\-_]"), F.array(F.lit("feed"), F.lit("rss"), F.lit("atom")))
    typed = F.coalesce(F.lower(content_type).rlike("rss|atom"), F.lit(False))
    return (name == "index.xml") | parts | typed


def top_segment(path: Column) -> Column:
    return F.coalesce(F.regexp_extract(path, "^/*([^/]+)", 1), F.lit(""))


def served_host(server_name: Column, host: Column) -> Column:
    return F.coalesce(F.when(server_name != "", server_name), host)


def with_flags(entries: DataFrame) -> DataFrame:
    """``entries`` with the flags every later step reads.  All are expressions of
    one row, so they fuse with the scan."""
    e = entries
    for name, kind in (("content_type", "string"), ("server_name", "string"), ("host_header", "string")):
        if name not in e.columns:
            e = e.withColumn(name, F.lit(None).cast(kind))
    path, query, status = F.col("path"), F.coalesce("query", F.lit("")), F.col("status")
    target = F.when(query != "", F.concat_ws("?", path, query)).otherwise(path)
    both = F.concat(F.lower(path), F.lower(query))
    absent = F.coalesce(status.isin(404, 410), F.lit(False))
    media = media_type(F.col("content_type"), status)
    ref = F.col("referer")
    has_ref = F.coalesce(ref != "", F.lit(False))
    host = served_host(F.col("server_name"), F.col("host_header"))
    # In steps that read one another, so that what they share is evaluated once.
    steps = [
        {
            "bytes": F.greatest(F.coalesce("bytes_sent", F.lit(0)), F.lit(0)).cast("bigint"),
            "target": target,
            "static": is_static(path, media),
            "has_referer": has_ref,
            "host": bare_host(host),
        },
        {
            "page": is_page(path, status, media, F.col("static")),
            "feed": is_feed(path, F.col("content_type")),
            "ref_path": F.when(F.col("has_referer"), referer_path(ref)),
            "ref_host": F.when(F.col("has_referer"), referer_host(ref)),
            "site": F.regexp_replace("host", r"^www\.", ""),
        },
        {
            "traversal": has_any(both, C.TRAVERSAL),
            "evasion": has_any(both, C.EVASION),
            "exotic": F.coalesce(F.col("method").isin(C.EXOTIC_METHODS), F.lit(False)),
            "robots_file": path == "/robots.txt",
            "top": top_segment(path),
            "same_site": F.coalesce(F.col("has_referer") & (site_key(F.col("ref_host")) == F.col("site")), F.lit(False)),
            "chrome_asset": has_any(path, C.CHROME_ASSETS),
            "probe": has_any(path, C.ALWAYS_PROBE) | (has_any(path, C.PROBE_IF_ABSENT) & absent),
            "submit": F.coalesce(F.col("method") == "POST", F.lit(False)) & has_any(path, C.SUBMIT),
        },
    ]
    for step in steps:
        e = e.withColumns(step)
    return e
