"""Log lines to entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.sources import logformat
from clientlens.sources.ends import list_files

MAX_LINE = 1 << 20
GROUP_MARK = "\x1f"


#: Files up to which the list of files is sent to every task.
MOST_FILES = 100_000


def _plain(path):
    """A file's path as both listings write it: one slash after file:."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def read_lines(spark: SparkSession, paths: list[str], files: list[tuple[str, int]] | None = None) -> DataFrame:
    """(file_rank, block, row, value): text or .gz files in the order given; a
    path given twice counts twice.  Files of a folder or pattern go by name; give
    ``files`` (as :func:`clientlens.sources.ends.order_logs` returns them) for
    another order.  Bytes that are no UTF-8 become U+FFFD, and a line over 1 MiB is
    cut into pieces that are read by themselves."""
    files = list_files(spark, paths) if files is None else files
    if not files:
        none = spark.createDataFrame([], "file_rank int, block bigint, row bigint, piece int, value string")
        return none.withColumn("seq", F.struct("file_rank", "block", "row", "piece"))
    # one scan for all files; each file's places in the order come from a small table
    ranks = spark.createDataFrame([(k, f) for k, (f, _) in enumerate(files)], "file_rank int, _uri string").select("file_rank", _plain(F.col("_uri")).alias("_file"))
    ranks = F.broadcast(ranks) if len(files) <= MOST_FILES else ranks
    names = list(dict.fromkeys(f for f, _ in files))
    out = spark.read.text(names).select(
        _plain(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))).alias("_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.make_valid_utf8("value").alias("value")
    )
    out = out.join(ranks, "_file").drop("_file")
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.length("value") / MAX_LINE), F.lit(1)).cast("int") - 1),
        lambda i: F.substring("value", i * MAX_LINE + 1, F.lit(MAX_LINE)),
    )
    cut = out.select("file_rank", "block", "row", F.posexplode(pieces).alias("piece", "value"))
    return cut.where(F.trim("value") != "").withColumn("seq", F.struct("file_rank", "block", "row", "piece"))


def parse_apache(lines: DataFrame, log_format: str = "combined") -> DataFrame:
    """Entries of a LogFormat or preset, with skip_reason where a line is none."""
    regex, fields = logformat.pattern(logformat.tokenize(logformat.PRESETS.get(log_format, log_format)))
    # one match a line: its groups, with a mark between them that no line has
    clean = F.translate("value", GROUP_MARK, "\ufffd")
    parts = F.split(F.regexp_replace(clean, regex, GROUP_MARK + GROUP_MARK.join(f"${k + 1}" for k in range(len(fields)))), GROUP_MARK, -1)
    lines = lines.withColumn("_parts", parts)
    groups = [F.get("_parts", F.lit(k + 1)) for k in range(len(fields))]
    fits = F.size("_parts") > 1
    # a trailing group that is not there reads "": tell it from one that is empty
    cols = logformat.columns(fields, groups)
    last = [t for t in fields if t.quoted and (t.name or "").lower() in ("referer", "user-agent")]
    if last:
        shorter = F.regexp_count("value", F.lit(r'(?<!\\)"')) < 2 * (len([t for t in fields if t.quoted]))
        for t in last:
            c = logformat.HEADERS[t.name.lower()]
            cols[c] = F.when(~(shorter & (cols[c] == "")), cols[c])
    return lines.select(
        "seq", "value", *[F.when(fits, c).alias(n) for n, c in cols.items()], F.when(~fits, "unmatched_line").alias("skip_reason")
    )


CLOUDFLARE = (
    "ClientIP string, ClientRequestMethod string, ClientRequestURI string, ClientRequestPath string, ClientRequestHost string, "
    "ClientRequestProtocol string, ClientRequestReferer string, ClientRequestUserAgent string, ClientRequestScheme string, "
    "EdgeResponseStatus int, EdgeResponseBytes bigint, EdgeStartTimestamp string, ClientASN bigint, RequestHeaders string"
)


def epoch_or_rfc3339(c):
    """RFC 3339, or seconds, milli-, micro- or nanoseconds by magnitude."""
    n = c.try_cast("bigint")  # whole numbers stay whole
    thousandth = (n.cast("decimal(20,0)") / 1000).cast("decimal(20,3)")
    micros = F.when(n > 10**17, F.floor(thousandth).cast("bigint")).when(n > 10**14, n).when(n > 10**11, n * 1000).otherwise(n * 1_000_000)
    fraction = F.timestamp_micros(F.floor(c.try_cast("double") * 1e6).cast("bigint"))
    whole = c.rlike(r"^\s*-?[0-9]+\s*$")
    return F.when(whole, F.timestamp_micros(micros)).otherwise(F.coalesce(fraction, c.try_cast("timestamp")))


#: Headers of signed requests, by the names that they are kept under.
SIGNED_HEADERS = ("Signature-Input", "Signature", "Signature-Agent")


def without_lone_surrogates(c):
    """A JSON text whose escapes of half a character are those of U+FFFD."""
    high, low = r"\\u[dD][89abAB][0-9a-fA-F]{2}", r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    c = F.regexp_replace(c, rf"{high}(?!{low})", r"\\ufffd")
    return F.regexp_replace(c, rf"(?<!{high}){low}", r"\\ufffd")


def _signed_headers(text):
    """The headers of signed requests in an object of any spelling."""
    given = F.from_json(text, "map<string,string>")
    low = F.transform_keys(given, lambda k, v: F.lower(k))
    return F.create_map(*[x for n in SIGNED_HEADERS for x in (F.lit(n), low[n.lower()])])


def parse_cloudflare(lines: DataFrame) -> DataFrame:
    """Entries of NDJSON request logs; values of another type read as null."""
    j = F.from_json(without_lone_surrogates(F.col("value")), CLOUDFLARE)
    good = F.col("value").rlike(r"^\s*\{") & j.isNotNull()
    d = lines.withColumn("j", j).withColumn("ok", good & F.col("j.ClientIP").isNotNull())
    uri = F.coalesce("j.ClientRequestURI", "j.ClientRequestPath")
    none = F.lit(None).cast("string")
    scheme = F.lower("j.ClientRequestScheme")
    return d.select(
        "seq", "value", F.when(F.col("ok"), F.col("j.ClientIP")).alias("remote_host"), none.alias("remote_logname"), none.alias("remote_user"),
        F.array().cast("array<string>").alias("forwarded_for"), epoch_or_rfc3339(F.col("j.EdgeStartTimestamp")).alias("ts"),
        none.cast("bigint").alias("response_usec"), F.col("j.ClientRequestMethod").alias("method"),
        F.coalesce(F.split(uri, r"\?", 2)[0], F.lit("")).alias("path"), F.get(F.split(uri, r"\?", 2), F.lit(1)).alias("query"),
        F.col("j.ClientRequestProtocol").alias("protocol"), F.lit("").alias("raw_request"), F.col("j.EdgeResponseStatus").alias("status"),
        F.col("j.EdgeResponseBytes").alias("bytes_sent"), F.col("j.ClientRequestReferer").alias("referer"),
        F.col("j.ClientRequestUserAgent").alias("user_agent"), F.col("j.ClientRequestHost").alias("host_header"), none.alias("server_name"),
        none.alias("content_type"), F.when(scheme.isin("http", "https"), scheme).alias("scheme"),
        F.map_filter(F.map_concat(F.create_map(F.lit("asn"), F.col("j.ClientASN").cast("string")), F.coalesce(_signed_headers(F.col("j.RequestHeaders")), F.create_map().cast("map<string,string>"))), lambda k, v: v.isNotNull()).alias("extra"),
        F.when(~F.coalesce("ok", F.lit(False)), "invalid_json").alias("skip_reason"),
    )


#: Parsers by name; add one to read another kind of log.
PARSERS = {"apache": parse_apache, "cloudflare": lambda lines, _=None: parse_cloudflare(lines)}


def read_log(spark: SparkSession, paths: list[str], log_format: str = "combined", source: str = "apache", files: list[tuple[str, int]] | None = None) -> DataFrame:
    return PARSERS[source](read_lines(spark, paths, files), log_format)


def skip_counts(parsed: DataFrame, window_start=None, vhosts: list[str] | None = None) -> DataFrame:
    """One row of counters: parse, then window, then host, in that order."""
    ok = F.col("skip_reason").isNull()
    inside = in_window(window_start)
    return parsed.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("parsed"), F.count_if(~ok).alias("skipped"),
        F.count_if(ok & ~inside).alias("out_of_window"), F.count_if(ok & inside & ~on_hosts(vhosts)).alias("excluded"),
        F.count_if(ok & F.col("ts").isNull()).alias("untimed"), F.min_by("value", F.when(~ok, F.col("seq"))).alias("first_skipped"),
    )


def in_window(start):
    """Entries from ``start`` on; those without a time stay."""
    return F.lit(True) if start is None else F.coalesce(F.col("ts") >= F.lit(start), F.lit(True))


def on_hosts(vhosts: list[str] | None):
    """Entries whose host contains one of the terms, in any case."""
    if not vhosts:
        return F.lit(True)
    host = F.lower(F.coalesce(F.when(F.col("server_name") != "", F.col("server_name")), F.col("host_header")))
    out = F.lit(False)
    for t in vhosts:
        out = out | F.coalesce(F.contains(host, F.lit(t.lower())), F.lit(False))
    return out
