"""Signed requests: claims from headers, the signature base, keys and verdicts."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientlens.functions import structured
from clientlens.operators.clients import KEY
from clientlens.sources.shared import kept

# The tag of these signatures, header names, reasons and statuses.
TAG = "web-bot-auth"
INPUT, SIGNATURE, AGENT = "Signature-Input", "Signature", "Signature-Agent"
NOT_PARSED = "Signature-Input does not parse"
NOT_LOGGED = "Signature header not logged"
NO_LABEL = "Signature has no value for the web-bot-auth label"
TAGS = {"present": "wba", "verified": "wba-verified", "expired": "wba-expired", "unverifiable": "wba-unverified", "forged": "wba-violation"}
SAMPLE = 8
DAY = 86400

_PARSED = "_h string, problem string, label string, components array<string>, params string, keyid string, alg string, created bigint, expires bigint, nonce string, signature_bytes binary, agent_url string"


def _agent_url(text: str | None) -> str | None:
    """The URL of a Signature-Agent header: a string, a dictionary's first string,
    or, leniently, a URL without quotes."""
    text = (text or "").strip()
    try:
        f = structured.Fields(text)
        value, _ = f.member()
        if f.at == len(f.text) and type(value) is str:
            return value
    except ValueError:
        pass
    for value, _ in (structured.dictionary(text) or {}).values():
        if type(value) is str:
            return value
    return text.split(",")[0].strip().strip('"') if text.startswith(("http://", "https://")) else None


def _claim(given: str, signature: str | None, agent: str | None) -> tuple:
    """Everything the headers say, or the problem with them."""
    none = (None,) * 9
    members = structured.dictionary(given)
    lists = {k: m for k, m in (members or {}).items() if isinstance(m[0], list)}
    if not lists:
        return (NOT_PARSED, *none, None)
    label = next((k for k, (_, p) in lists.items() if p.get("tag") == TAG), None)
    if label is None:
        return (None, *none, None)
    items, p = lists[label]
    text = lambda k: str(p[k]) if isinstance(p.get(k), str) else None
    number = lambda k: p[k] if type(p.get(k)) is int else None
    raw = (structured.dictionary(signature) or {}).get(label, (None,))[0]
    problem = None if isinstance(raw, bytes) else NO_LABEL if signature else NOT_LOGGED
    said = [str(v).lower() for v, _ in items]
    return (
        problem, label, said, structured.member_text(lists[label]), text("keyid"), text("alg"), number("created"), number("expires"), text("nonce"),
        raw if problem is None else None, _agent_url(agent),
    )


def claims(entries: DataFrame) -> DataFrame:
    """Signed ``entries`` (an ``extra`` map with the headers) with what their
    headers claim: a row with a ``label`` and no ``problem`` is a claim.

    Header sets are parsed once each, and joined back by a digest.
    """
    h = lambda name: F.col("extra")[name]
    null = lambda c: F.coalesce(c, F.lit("\0"))
    made = [c.split()[0] for c in _PARSED.split(", ")]
    signed = entries.drop(*made, "signature_agent").where(F.coalesce(h(INPUT), F.lit("")) != "").withColumn("_h", F.sha2(F.concat_ws("\x01", *[null(h(n)) for n in (INPUT, SIGNATURE, AGENT)]), 256))
    distinct = signed.groupBy("_h").agg(*[F.any_value(h(n)).alias(n) for n in (INPUT, SIGNATURE, AGENT)])

    def parse(batches: Iterator[pa.RecordBatch]):
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        for batch in batches:
            rows = [(k, *_claim(i, s, a)) for k, i, s, a in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=made)

    return signed.join(distinct.mapInArrow(parse, _PARSED), "_h").withColumn("signature_agent", F.trim(h(AGENT)))


def authority(host: Column, scheme: Column) -> Column:
    """Lower-cased host without the port that its scheme implies."""
    low = F.lower(host)
    bare = F.when(scheme == "http", F.regexp_replace(low, ":80$", "")).otherwise(F.regexp_replace(low, ":443$", ""))
    return F.when(bare != "", bare)


def with_base(claimed: DataFrame) -> DataFrame:
    """Adds ``base``, the text that was signed, or ``unavailable``, the first covered
    component that a log does not hold."""
    scheme = F.when(F.col("scheme").isin("http", "https"), F.col("scheme")).otherwise("https")
    known = {
        "@authority": authority(F.col("host_header"), scheme), "@method": F.upper(F.nullif(F.col("method"), F.lit(""))), "@path": F.nullif(F.col("path"), F.lit("")),
        "@scheme": scheme, "signature-agent": F.col("signature_agent"),
    }

    def value(c):
        out = F.lit(None).cast("string")
        for name, v in known.items():
            out = F.when(c == name, v).otherwise(out)
        return out

    lines = F.transform("components", lambda c: F.concat(F.lit('"'), c, F.lit('": '), value(c)))
    missing = F.get(F.filter("components", lambda c: value(c).isNull()), F.lit(0))
    base = F.array_join(F.concat(lines, F.array(F.concat(F.lit('"@signature-params": '), F.col("params")))), "\n")
    return claimed.withColumns({"unavailable": missing, "base": F.when(missing.isNull() & F.col("label").isNotNull(), base)})


def thumbprint(x: Column) -> Column:
    """The id of an Ed25519 key by its public part, as written in a key set."""
    digest = F.base64(F.unhex(F.sha2(F.concat(F.lit('{"crv":"Ed25519","kty":"OKP","x":"'), x, F.lit('"}')), 256)))
    return F.rtrim(F.translate(digest, "+/", "-_"), F.lit("="))


def keys(key_sets: DataFrame) -> DataFrame:
    """(keyid, x) of all Ed25519 keys in key sets (a column ``jwks`` of JSON).  A key
    goes by its own digest, whatever the set calls it."""
    k = key_sets.select(F.explode(F.from_json("jwks", "keys array<struct<kty:string,crv:string,x:string>>")["keys"]).alias("k")).select("k.*")
    ours = k.where((F.col("kty") == "OKP") & (F.col("crv") == "Ed25519") & F.col("x").rlike("^[A-Za-z0-9_-]+$"))
    return ours.select(thumbprint(F.col("x")).alias("keyid"), "x").distinct()


def with_status(based: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``status`` and ``reason`` of each claim, by keys (keyid, x): verified,
    expired, forged or unverifiable.

    A signature is checked once for each distinct (key, base, signature).  Only a
    signature that fails against the key it names is forged; what cannot be
    rebuilt or has no key is unverifiable.
    """
    c = based.where("label is not null and problem is null").join(known.select("keyid", "x"), "keyid", "left")
    can = F.col("x").isNotNull() & F.col("base").isNotNull()
    c = c.withColumn("_c", F.when(can, F.sha2(F.concat_ws("\x01", "x", "base", F.hex("signature_bytes")), 256)))
    todo = c.where("_c is not null").groupBy("_c").agg(F.any_value("x").alias("x"), F.any_value("base").alias("base"), F.any_value("signature_bytes").alias("s"))

    def check(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ok, many = [], Counter(batch.column("x").to_pylist())
            for x, base, s in zip(*(batch.column(k).to_pylist() for k in ("x", "base", "s")), strict=True):
                try:
                    ok.append(structured.valid_signature(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4)), base.encode(), s, many[x] > 3))
                except ValueError:
                    ok.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("_c"), pa.array(ok, pa.bool_())], names=["_c", "good"])

    # signatures are costly to check: all cores take part
    n = based.sparkSession.sparkContext.defaultParallelism
    c = c.join(todo.repartition(n, "_c").mapInArrow(check, "_c string, good boolean"), "_c", "left")
    late = F.col("ts").isNull() | (F.unix_micros("ts") / 1e6 > F.col("expires"))
    unavailable = F.when(F.col("unavailable") == "content-digest", F.lit("the request body was signed")).otherwise(F.concat(F.lit("covered component "), F.col("unavailable"), F.lit(" is not in the log")))
    reason = (
        F.when(F.col("keyid").isNull(), "signature names no key").when(F.col("x").isNull(), "key unavailable").when(F.col("unavailable").isNotNull(), unavailable)
        .when(F.col("good").isNull(), "the key is not usable").when(~F.col("good"), "the signature fails against the key")
        .when(F.col("expires").isNotNull() & late, "valid, but not at the time of the request").otherwise("valid")
    )
    status = F.when(F.col("good").isNull(), "unverifiable").when(~F.col("good"), "forged").when(F.col("expires").isNotNull() & late, "expired").otherwise("verified")
    return c.withColumns({"status": status, "reason": reason}).drop("_c", "good", "x")


def rotation_note(status: Column, reason: Column, age_seconds: Column) -> Column:
    """What a request's age says about a key that could not be had."""
    return F.when(
        (status == "unverifiable") & (reason == "key unavailable"),
        F.when(age_seconds < 0, "dated in the future").when(age_seconds < DAY, "recent: rotation is unlikely").otherwise("old: the key may have been rotated"),
    )


def first_claims(judged: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The first ``most`` different signatures of each client, with their ``place``."""
    own = judged.groupBy(*KEY, F.col("extra")[SIGNATURE].alias("_s")).agg(F.min_by(F.struct("seq", "status", "reason", "keyid", "agent_url", "nonce"), "seq").alias("c"))
    w = Window.partitionBy(*KEY).orderBy("c.seq")
    return own.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(*KEY, "place", "c.*")


def unusable(claimed: DataFrame) -> DataFrame:
    """(client, problem, requests) of signed requests that make no claim."""
    return claimed.where("problem is not null").groupBy(*KEY, "problem").agg(F.count(F.lit(1)).alias("requests"))


def operator_of(claimed: DataFrame, operators: DataFrame) -> DataFrame:
    """Adds ``operator`` by ``operators`` (rank, operator, keyid, agent_url): by the key
    first, else by the address of the key set; the first in rank."""
    norm = lambda c: F.lower(F.rtrim(F.trim(c), F.lit("/")))
    first = lambda key, name: operators.where(F.col(key).isNotNull()).groupBy((norm(F.col(key)) if key == "agent_url" else F.col(key)).alias(f"_{key}")).agg(F.min_by("operator", "rank").alias(name))
    d = claimed.join(first("keyid", "_by_key"), F.col("keyid") == F.col("_keyid"), "left")
    d = d.join(first("agent_url", "_by_url"), norm(F.col("agent_url")) == F.col("_agent_url"), "left")
    return d.withColumn("operator", F.coalesce("_by_key", "_by_url")).drop("_keyid", "_agent_url", "_by_key", "_by_url")


def verdicts(claimed: DataFrame, judged: DataFrame, operators: DataFrame | None = None, most: int = SAMPLE) -> DataFrame:
    """(client, wba, reason, mixed, replayed, nonce_reused, operator, wba_tags) of each
    client with a signed request.

    The first claim gives the status; ``mixed`` says that another of the first eight
    has another one.  A client whose address shares a nonce with another address
    is replayed; reuse at one address is a milder note.  Where no request makes a
    claim the client is unverifiable, with the problems as reason.
    """
    sample = kept(first_claims(judged, most), "first-claims")  # two readers, and signatures are costly
    used = claimed.where("nonce is not null")
    at = used.groupBy("nonce", "remote_host").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    nonces = at.groupBy("nonce").agg((F.count(F.lit(1)) > 1).alias("shared"), (F.min_by("n", "first") > 1).alias("_again"))
    copied = at.join(nonces.where("shared"), "nonce").select("remote_host").distinct()
    by = claimed.join(copied, "remote_host").select(*KEY, F.lit(True).alias("replayed")).distinct()
    # a nonce that comes again to the address it came to first
    again = nonces.where("_again").select("nonce", "_again")
    head = F.min_by(F.struct("status", "reason", "keyid", "agent_url"), "place")
    own = sample.join(again, "nonce", "left").groupBy(*KEY).agg(head.alias("h"), (F.count_distinct("status") > 1).alias("mixed"), F.coalesce(F.bool_or("_again"), F.lit(False)).alias("reused"))
    own = own.select(*KEY, F.col("h.status").alias("wba"), F.col("h.reason").alias("reason"), F.col("h.keyid").alias("keyid"), F.col("h.agent_url").alias("agent_url"), "mixed", "reused")
    bad = unusable(claimed).groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_set("problem")), "; ").alias("_why"))
    same = lambda a, b: (a[KEY[0]].eqNullSafe(b[KEY[0]])) & (a[KEY[1]].eqNullSafe(b[KEY[1]]))
    none = bad.join(own, same(bad, own), "left_anti")
    d = own.join(by, same(own, by), "left").select(*[own[c] for c in own.columns], F.coalesce("replayed", F.lit(False)).alias("replayed"))
    d = d.unionByName(none.select(*KEY, F.lit("unverifiable").alias("wba"), F.concat(F.lit("unusable: "), "_why").alias("reason"), F.lit(False).alias("mixed"), F.lit(False).alias("reused"), F.lit(False).alias("replayed")), allowMissingColumns=True)
    d = operator_of(d, operators) if operators is not None else d.withColumn("operator", F.lit(None).cast("string"))
    d = d.withColumn("nonce_reused", F.col("reused") & ~F.col("replayed"))
    tag = F.lit(None).cast("string")
    for status, name in TAGS.items():
        tag = F.when(F.col("wba") == status, name).otherwise(tag)
    tags = F.filter(F.array(tag, F.when(F.col("mixed"), "wba-mixed"), F.when(F.col("replayed"), "wba-replay"), F.when(F.col("nonce_reused"), "wba-nonce-reuse")), lambda x: x.isNotNull())
    return d.select(*KEY, "wba", "reason", "mixed", "replayed", "nonce_reused", "operator", F.array_sort(tags).alias("wba_tags"))
