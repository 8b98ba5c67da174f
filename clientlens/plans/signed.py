"""Queries over signed requests made from the given tables, with reference SQL."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.functions import structured as st
from clientlens.operators import signatures
from clientlens.sources.shared import kept

SEEDS = [bytes([k]) * 32 for k in range(3)]
AGENT_URL = "https://Bots.example/"


@lru_cache(8)
def _secret(seed: bytes) -> tuple[int, bytes, bytes]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | (1 << 254)
    return a, h[32:], st.compress(st.times_known(a, st.base_multiples()))


def sign(seed: bytes, message: bytes) -> bytes:
    """An Ed25519 signature, for made requests."""
    a, prefix, public = _secret(seed)
    number = lambda *parts: int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % st.ORDER
    r = number(prefix, message)
    point = st.compress(st.times_known(r, st.base_multiples()))
    return point + ((r + number(point, public, message) * a) % st.ORDER).to_bytes(32, "little")


def _public(seed: bytes) -> str:
    return base64.urlsafe_b64encode(_secret(seed)[2]).decode().rstrip("=")


def _keyid(seed: bytes) -> str:
    text = f'{{"crv":"Ed25519","kty":"OKP","x":"{_public(seed)}"}}'
    return base64.urlsafe_b64encode(hashlib.sha256(text.encode()).digest()).decode().rstrip("=")


def requests(spark, d) -> DataFrame:
    """A signed request a customer: by its number good, altered, expired, with a signed
    body, without a signature, with a broken header, or signed for something else."""
    n = F.col("c_custkey")
    kind, key = n % 7, (n % 3).cast("int")
    created = F.lit(1714521600) + n
    ids = F.array(*[F.lit(_keyid(s)) for s in SEEDS])
    nonce = F.when(n % 11 == 0, F.concat(F.lit("r"), (n % 90).cast("string"))).when(n % 13 == 0, F.concat(F.lit("c"), (n % 40).cast("string"))).otherwise(F.concat(F.lit("u"), n.cast("string")))
    covered = F.when(kind == 3, '("@authority" "content-digest")').otherwise('("@authority" "@method" "@path" "signature-agent")')
    params = F.concat(
        covered, F.lit(";created="), created.cast("string"), F.lit(";expires="), F.when(kind == 2, created - 10).otherwise(created + 60).cast("string"), F.lit(';keyid="'), F.get(ids, key),
        F.lit('";alg="ed25519";nonce="'), nonce, F.lit('";tag="'), F.when(kind == 6, "other").otherwise("web-bot-auth"), F.lit('"'),
    )
    e = spark.read.parquet(f"{d}/customer.parquet").select(
        n.alias("id"), n.alias("seq"), kind.alias("kind"), key.alias("key"), params.alias("params"), F.concat(F.lit("10.9."), (n % 40).cast("string"), F.lit(".1")).alias("remote_host"),
        F.timestamp_seconds(created).alias("ts"), F.lit("get").alias("method"), F.concat(F.lit("/p"), n.cast("string")).alias("path"), F.lit("Www.Example.org:443").alias("host_header"), F.lit("https").alias("scheme"),
    )
    base = F.concat(F.lit('"@authority": www.example.org\n"@method": GET\n"@path": '), F.col("path"), F.when(F.col("kind") == 1, "x").otherwise(""), F.lit(f'\n"signature-agent": "{AGENT_URL}"\n"@signature-params": '), F.col("params"))

    def signed(batches):
        for b in batches:
            rows = zip(b.column("key").to_pylist(), b.column("base").to_pylist(), strict=True)
            made = [base64.b64encode(sign(SEEDS[k], m.encode())).decode() for k, m in rows]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(made, pa.string())], names=["id", "made"])

    sigs = e.withColumn("base", base).select("id", "key", "base").repartition(spark.sparkContext.defaultParallelism, "id").mapInArrow(signed, "id bigint, made string")
    e = e.join(sigs, "id")
    header = F.when(F.col("kind") == 5, "sig1=(\"@authority\";").otherwise(F.concat(F.lit("sig1="), F.col("params")))
    extra = F.map_filter(
        F.create_map(F.lit("Signature-Input"), header, F.lit("Signature"), F.when(F.col("kind") != 4, F.concat(F.lit("sig1=:"), F.col("made"), F.lit(":"))), F.lit("Signature-Agent"), F.lit(f'"{AGENT_URL}"')), lambda k, v: v.isNotNull()
    )
    # written once: every later step would sign again
    return kept(e.withColumns({"extra": extra, "client_ip": F.col("remote_host"), "client_ua": F.lit(None).cast("string")}), "signed")


def _judged(spark, d) -> tuple[DataFrame, DataFrame]:
    sets = ", ".join(f'{{"kty":"OKP","crv":"Ed25519","x":"{_public(s)}","kid":"any"}}' for s in SEEDS[:2])
    known = signatures.keys(spark.createDataFrame([(f'{{"keys":[{sets},{{"kty":"RSA","n":"x"}}]}}',), ("no key set",)], "jwks string"))
    c = kept(signatures.with_base(signatures.claims(requests(spark, d))), "claims")
    return c, signatures.with_status(c, known)


def signed_requests(spark, d) -> DataFrame:
    c, j = _judged(spark, d)
    bad = c.where("problem is not null").select("id", "problem", F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("reason"))
    return j.select("id", F.lit(None).cast("string").alias("problem"), "status", "reason").unionByName(bad)


def signed_clients(spark, d) -> DataFrame:
    c, j = _judged(spark, d)
    operators = spark.createDataFrame([(0, "first", _keyid(SEEDS[0]), None), (1, "second", None, "https://bots.example")], "rank int, operator string, keyid string, agent_url string")
    v = signatures.verdicts(c, j, operators)
    return v.select("client_ip", "wba", "reason", "operator", F.array_join("wba_tags", ",").alias("tags"))


def queries() -> dict:
    return {f.__name__: f for f in (signed_requests, signed_clients)}


_SQL = """e AS (SELECT c_custkey AS id, c_custkey % 7 AS kind, c_custkey % 3 AS key, '10.9.' || c_custkey % 40 || '.1' AS ip,
    CASE WHEN c_custkey % 11 = 0 THEN 'r' || c_custkey % 90 WHEN c_custkey % 13 = 0 THEN 'c' || c_custkey % 40 ELSE 'u' || c_custkey END AS nonce FROM customer),
  j AS (SELECT *, CASE WHEN key = 2 OR kind = 3 THEN 'unverifiable' WHEN kind = 1 THEN 'forged' WHEN kind = 2 THEN 'expired' ELSE 'verified' END AS status,
    CASE WHEN key = 2 THEN 'key unavailable' WHEN kind = 3 THEN 'the request body was signed' WHEN kind = 1 THEN 'the signature fails against the key' WHEN kind = 2 THEN 'valid, but not at the time of the request' ELSE 'valid' END AS reason
    FROM e WHERE kind < 4)"""


def oracle_sql() -> dict[str, str]:
    return {
        "signed_requests": f"""WITH {_SQL} SELECT id, NULL::VARCHAR AS problem, status, reason FROM j
            UNION ALL SELECT id, CASE kind WHEN 4 THEN 'Signature header not logged' ELSE 'Signature-Input does not parse' END, NULL, NULL FROM e WHERE kind IN (4, 5)""",
        "signed_clients": f"""WITH {_SQL}, named AS (SELECT * FROM e WHERE kind < 5), at_ AS (SELECT nonce, ip, count(*) AS n, min(id) AS f FROM named GROUP BY ALL),
            nn AS (SELECT nonce, count(*) > 1 AS shared, arg_min(n, f) > 1 AS again FROM at_ GROUP BY nonce),
            copied AS (SELECT DISTINCT ip FROM at_ JOIN nn USING (nonce) WHERE shared),
            s AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY id) AS place FROM j),
            h AS (SELECT ip, arg_min(status, place) AS wba, arg_min(reason, place) AS reason, arg_min(key, place) AS key, count(DISTINCT status) > 1 AS mixed, bool_or(coalesce(again, FALSE)) AS again FROM s LEFT JOIN nn USING (nonce) WHERE place <= 8 GROUP BY ip),
            w AS (SELECT h.*, c.ip IS NOT NULL AS replayed FROM h LEFT JOIN copied c USING (ip))
            SELECT ip AS client_ip, wba, reason, CASE WHEN key = 0 THEN 'first' ELSE 'second' END AS operator,
              array_to_string(list_sort(list_filter([CASE wba WHEN 'verified' THEN 'wba-verified' WHEN 'expired' THEN 'wba-expired' WHEN 'forged' THEN 'wba-violation' ELSE 'wba-unverified' END,
                CASE WHEN mixed THEN 'wba-mixed' END, CASE WHEN replayed THEN 'wba-replay' END, CASE WHEN again AND NOT replayed THEN 'wba-nonce-reuse' END], lambda x: x IS NOT NULL)), ',') AS tags FROM w""",
    }
