"""From entries to classified clients and their rollups."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens import config as C
from clientlens.functions.agents import agent_profile
from clientlens.functions.entry import with_flags
from clientlens.functions.hosts import as_number
from clientlens.operators import classify, clients, network, robots, rollup, signatures, verify
from clientlens.sources import ends, logs
from clientlens.sources.shared import kept


@dataclass
class Census:
    """Everything a run yields.  Entries and clients are written to the shared folder
    once; the rest are DataFrames that have not run yet."""

    entries: DataFrame
    clients: DataFrame
    kinds: DataFrame
    top: DataFrame
    counters: DataFrame | None = None
    networks: DataFrame | None = None
    operators: DataFrame | None = None
    files: list[dict] = field(default_factory=list)


def flagged(entries: DataFrame, identity: str = "ip_ua") -> DataFrame:
    return with_flags(clients.with_client(entries, identity))


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join by keys of which null is a value; the right side's keys go."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(r, on, how).drop(*(f"_r_{k}" for k in keys))


def attributed(
    entries: DataFrame, ranges: DataFrame | None, egress: DataFrame | None, agents: DataFrame | None = None, identity: str = "ip_ua",
    verifiable: DataFrame | None = None, most_residents: int | None = None,
) -> DataFrame:
    """Entries with route and group key.  Ranges and agents are looked up once
    per distinct address and User-Agent; Spark broadcasts what is small.  Declared
    crawlers of ``verifiable`` tokens stay single clients; with ``most_residents`` only
    the first so many do, the others fold by network."""
    out = entries
    for name, table in (("hosting", ranges), ("egress", egress)):
        if table is None:
            out = out.withColumns({name: F.lit(None).cast("string"), f"{name}_rank": F.lit(None).cast("int")})
        else:
            hit = network.in_ranges(entries, table).select(F.col("ip").alias("_ip"), F.col("name").alias(name), F.col("rank").alias(f"{name}_rank"))
            out = out.join(hit, F.col("remote_host") == F.col("_ip"), "left").drop("_ip")
    if "as_agent" not in out.columns:
        out = out.withColumn("as_agent", F.lit(None).cast("string"))
    said = agent_profile(entries, agents).select(F.col("user_agent").alias("_u"), "ua_crawler", "agent_token")
    out = out.join(said, F.col("user_agent").eqNullSafe(F.col("_u")), "left").drop("_u")
    if verifiable is not None:
        out = out.join(verifiable.select("agent_token", F.lit(True).alias("_v")).distinct(), "agent_token", "left")
        if most_residents is None:
            out = out.withColumn("resident", F.coalesce(F.col("_v") & F.col("ua_crawler"), F.lit(False))).drop("_v")
        else:
            ip, ua = clients.identity(identity)
            out = out.withColumns({"_rip": ip, "_rua": ua})
            stay = network.residents(out.where("_v and ua_crawler"), ["_rip", "_rua"], most_residents).withColumn("resident", F.lit(True))
            out = joined(out, stay, ["_rip", "_rua"]).drop("_v", "_rip", "_rua")
    return network.route(out, clients.identity(identity))


def with_as(entries: DataFrame, as_db: DataFrame | None = None, by_asn: DataFrame | None = None) -> DataFrame:
    """Adds as_number and as_org: a database's (intervals lo, hi, asn, as_org), else
    what the log holds; and as_agent, as_category of agents that own their AS."""
    out = entries
    logged = F.lit(None).cast("bigint")
    if "extra" in entries.columns:
        own = F.map_filter("extra", lambda k, v: F.regexp_replace(F.lower(k), "[^a-z]", "").endswith("asn") | (F.lower(k) == "asn"))
        logged = as_number(F.get(F.map_values(own), F.lit(0)))
    if as_db is not None:
        table = as_db.where("asn is not null").select(F.lit(0).alias("rank"), F.to_json(F.struct("asn", "as_org")).alias("name"), "lo", "hi")
        hit = network.in_ranges(entries, table).select(F.col("ip").alias("_ip"), F.from_json("name", "asn bigint, as_org string").alias("_as"))
        out = out.join(hit, F.col("remote_host") == F.col("_ip"), "left").drop("_ip")
        out = out.withColumns({"as_number": F.coalesce("_as.asn", logged), "as_org": F.col("_as.as_org")}).drop("_as")
    else:
        out = out.withColumns({"as_number": logged, "as_org": F.lit(None).cast("string")})
    if by_asn is not None:
        kind = F.col("category") if "category" in by_asn.columns else F.lit(None).cast("string")
        agent = by_asn.where("role = 'agent'").groupBy(F.col("asn").alias("as_number")).agg(F.min_by("name", "rank").alias("as_agent"), F.min_by(kind, "rank").alias("as_category"))
        out = out.join(agent, "as_number", "left")
    return out


def facts(e: DataFrame) -> DataFrame:
    """What a client's entries say of its origin: the first AS in order, the first
    of its ranges in rank."""
    has = lambda c: c in e.columns
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    ranked = [F.min_by(c, F.col(f"{c}_rank")).alias(c) for c in ("hosting", "egress") if has(c)]
    return e.groupBy(*clients.KEY).agg(
        F.max(F.col("hosting").isNotNull()).alias("datacenter") if has("hosting") else F.lit(False).alias("datacenter"), *ranked,
        *[first(c) for c in ("as_number", "as_org", "as_category", "route") if has(c)],
    )


def verified(found: DataFrame, agents: DataFrame | None, agent_ranges: DataFrame | None, answers: DataFrame | None) -> DataFrame:
    """(client, identity, range_state, dns_state, domain) of clients that name an agent
    with ranges, domains or ASes to check them by.

    ``agents`` may have domains, asns and fallback beside its token; ``agent_ranges``
    are (agent_token, lo, hi), whole lists; ``answers`` are lookups by address."""
    texts = F.array().cast("array<string>")
    facts_ = agents.groupBy(F.lower("token").alias("agent_token")).agg(
        *[F.min_by(c, "rank").alias(c) if c in agents.columns else F.lit(None).cast(t).alias(c) for c, t in (("domains", "array<string>"), ("asns", "array<bigint>"), ("fallback", "boolean"))]
    )
    c = found.where("agent_token is not null").select(*clients.KEY, "agent_token", "as_number").join(facts_, "agent_token")
    if agent_ranges is not None:
        agent_ranges = agent_ranges.withColumn("agent_token", F.lower("agent_token"))
        inside = network.in_own_ranges(c, agent_ranges).select("agent_token", F.col("ip").alias("client_ip"), F.lit(True).alias("inside"))
        c = c.join(inside, ["agent_token", "client_ip"], "left").join(agent_ranges.select("agent_token", F.lit(True).alias("has_ranges")).distinct(), "agent_token", "left")
    else:
        c = c.withColumns({"inside": F.lit(False), "has_ranges": F.lit(False)})
    c = c.withColumns({"has_ranges": F.coalesce("has_ranges", F.lit(False)), "complete": F.lit(True), "domains": F.coalesce("domains", texts)})
    c = c.where("has_ranges or size(domains) > 0 or size(asns) > 0")
    spark = found.sparkSession
    answers = answers if answers is not None else spark.createDataFrame([], "ip string, host string, no_record boolean, forward array<string>")
    return verify.verify(c, answers).select(*clients.KEY, F.col("status").alias("identity"), "range_state", "dns_state", "domain")


def classified(
    flagged_entries: DataFrame, agents: DataFrame | None = None, threshold: float = C.UNKNOWN_THRESHOLD, min_requests: int = 1, *,
    agent_ranges: DataFrame | None = None, answers: DataFrame | None = None, by_asn: DataFrame | None = None, signatures_: DataFrame | None = None, shadow: DataFrame | None = None,
) -> DataFrame:
    """One row per client: features, network, checks, scores, kind, confidence and tags.
    The entries are read once, into ordered slices; all else reads those."""
    e = clients.ordered(flagged_entries)
    profile = agent_profile(e, agents)
    f = clients.features_of(e).where(F.col("requests") >= min_requests)
    f = joined(f, facts(e), clients.KEY)
    if agents is not None and {"domains", "asns"} & set(agents.columns) or agent_ranges is not None:
        named = f.join(profile.select(F.col("user_agent").alias("_u"), "agent_token"), F.col("user_agent").eqNullSafe(F.col("_u")), "left").drop("_u")
        named = named if "as_number" in named.columns else named.withColumn("as_number", F.lit(None).cast("bigint"))
        f = joined(f, verified(named, agents, agent_ranges, answers), clients.KEY)
    if signatures_ is not None:
        f = joined(f, signatures_.select(*clients.KEY, "wba", F.col("operator").alias("signer"), "wba_tags"), clients.KEY)
    if shadow is not None:
        f = f.crossJoin(F.broadcast(shadow.select("shadow").limit(1))) if shadow.limit(1).count() else f  # one row
    if by_asn is not None and "hosting" in f.columns:
        f = f if "as_number" in f.columns else f.withColumn("as_number", F.lit(None).cast("bigint"))
        f = network.provider(f.withColumn("verified_domain", F.col("domain") if "domain" in f.columns else F.lit(None).cast("string")), by_asn)
        f = f.withColumn("datacenter", F.col("category") == "datacenter")
    elif "hosting" in f.columns:
        f = f.withColumn("network", F.col("hosting"))
    c = classify.with_context(f, profile)
    uas = clients.ua_count(e).withColumnRenamed("ip", "_ip")
    c = c.join(uas, F.col("client_ip") == F.col("_ip"), "left").drop("_ip")
    return classify.with_tags(classify.combine(classify.scores(c), threshold))


def analyze(
    spark, paths: list[str], *, log_format: str = "combined", source: str = "apache", identity: str = "ip_ua", vhosts=None, since=None,
    since_seconds: float | None = None, from_latest: bool = False, now: float | None = None, ranges: DataFrame | None = None, egress: DataFrame | None = None,
    agents: DataFrame | None = None, agent_ranges: DataFrame | None = None, answers: DataFrame | None = None, by_asn: DataFrame | None = None, as_db: DataFrame | None = None,
    key_sets: DataFrame | None = None, operators: DataFrame | None = None, robots_text: str | None = None,
    unknown_threshold: float = C.UNKNOWN_THRESHOLD, min_requests: int = 1, max_per_kind: int = C.MAX_PER_KIND, most_residents: int | None = None,
) -> Census:
    """A whole run over log files.

    Files are put in order of time by their ends, and those before the window are
    not read.  Entries are parsed once and kept; clients are measured, checked by
    ranges, names, ASes and signatures as far as the tables for that are given,
    classified, and kept; thresholds of what is out of the ordinary follow from them.
    """
    parse = lambda lines: logs.PARSERS[source](lines, log_format)
    files, start, spans = ends.order_logs(spark, ends.list_files(spark, paths), parse, since_seconds, from_latest, now)
    since = datetime.datetime.fromtimestamp(start, datetime.UTC) if start is not None else since
    parsed = kept(logs.read_log(spark, paths, log_format, source, files), "parsed")
    counters = logs.skip_counts(parsed, since, vhosts)
    entries = parsed.where(F.col("skip_reason").isNull() & logs.in_window(since) & logs.on_hosts(vhosts)).drop("value")
    tokens = [agents.where("size(domains) > 0").select(F.lower("token").alias("agent_token"))] if agents is not None and "domains" in agents.columns else []
    tokens += [agent_ranges.select(F.lower("agent_token").alias("agent_token"))] if agent_ranges is not None else []
    verifiable = reduce(DataFrame.union, tokens) if tokens else None
    e = kept(with_flags(attributed(with_as(entries, as_db, by_asn), ranges, egress, agents, identity, verifiable, most_residents)), "entries")
    signed = None
    if key_sets is not None:
        claimed = kept(signatures.with_base(signatures.claims(e)), "claims")
        signed = signatures.verdicts(claimed, signatures.with_status(claimed, signatures.keys(key_sets)), operators)
    shadow = network.redirect_shadow(network.redirect_sides(e))
    c = classified(e, agents, unknown_threshold, min_requests, agent_ranges=agent_ranges, answers=answers, by_asn=by_asn, signatures_=signed, shadow=shadow)
    if robots_text:
        prod = agent_profile(e, agents).select(F.col("user_agent").alias("_u"), "product")
        marked = e.join(prod, F.col("user_agent").eqNullSafe(F.col("_u")), "left").drop("_u")
        c = joined(c, robots.compliance(marked, robots.parse(robots_text), clients.KEY), clients.KEY)
        c = c.withColumn("verdict", F.coalesce("verdict", F.lit("unknown")))
        c = c.withColumn("tags", F.when(F.col("verdict") == "ignores", F.array_sort(F.array_union("tags", F.array(F.lit("ignores-robots"))))).otherwise(F.col("tags")))
    c = kept(c, "clients")
    c = kept(rollup.outlier_tags(c, rollup.thresholds(c)), "clients")
    merged = verify.merge_verified(c.withColumn("status", F.col("identity"))) if "domain" in c.columns else None
    return Census(e, c, rollup.kind_rollup(c), rollup.top_clients(c, max_per_kind), counters, rollup.network_rollup(c), merged, spans)


def markdown(census: Census, top: int = 5) -> str:
    """A short report: totals by kind and the busiest clients of each.  Only
    rollups and ``top`` rows a kind come to the driver."""
    kinds = census.kinds.orderBy(F.desc("requests"), "kind").collect()
    total = sum(r["requests"] for r in kinds) or 1
    out = ["# Clients by kind", "", "| kind | clients | requests | share |", "| --- | ---: | ---: | ---: |"]
    out += [f"| {r['kind']} | {r['clients']} | {r['requests']} | {r['requests'] / total:.1%} |" for r in kinds]
    best = rollup.top_clients(census.clients, top).select("kind", "client_ip", "user_agent", "requests", "confidence", "tags").collect()
    for r in kinds:
        mine = sorted((b for b in best if b["kind"] == r["kind"]), key=lambda b: (-b["requests"], b["client_ip"]))
        out += ["", f"## {r['kind']}", ""]
        out += [f"- {b['client_ip']} ({b['requests']} requests, {b['confidence']:.2f}): {b['user_agent'] or 'no User-Agent'}; {', '.join(b['tags'])}" for b in mine]
        if r["clients"] > len(mine):
            out.append(f"- and {r['clients'] - len(mine)} more")
    return "\n".join(out) + "\n"
