"""Toxicity: restore disguised words with a noisy-channel decoder, then score."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.llm.common import stored, worker_store

#: The classifier's size: labelled rows it is fitted on at most, features it keeps,
#: and documents of the sample that a feature must occur in.
TRAIN_ROWS, FEATURES, LEAST_DOCS = 12_000, 512, 3
RIDGE, PREFIXES = 1.0, (3, 4, 5, 6)
# What a sign may stand for, and signs that only separate letters.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
GAPS = ".-_*~'"
# costs of the channel, in nats: a sign for a letter, a gap that vanishes, a gap
# that ends a word, a stuttered letter, a sign that stands for nothing
SWAP, GAP, BREAK, REPEAT, LONE = 0.7, 0.7, 1.0, 0.3, 4.0
PIECE = 64  # characters decoded in one go; longer words come apart into pieces
N = 28  # classes of the character model: no letter, a-z, any other byte of a letter

_CLASS = np.zeros(256, dtype=np.int32)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[128:] = 27
_EDGE = "\"'.,;:?!#%&*$()[]{}<>|/\\~^=+-_`…«»¡¿"
_NOISY = re.compile(r"(.)\1\1|[0-9@$!|+(€£.\-_*~']")
_LETTER = re.compile(r"[^\W\d_]")
_SHORT = re.compile(r"(?<!\S)\S{1,2}(?:[ \t]\S{1,2}){2,}(?!\S)")  # what may be a word with spaces in it
_STUTTER = re.compile(r"(.)\1{3,}")
_PARTS = re.compile(r"[,;:?#%&=/\\\[\]{}<>\"«»¡¿…^`]+")


def _class(c: str) -> int:
    return int(_CLASS[min(ord(c), 255)])


def character_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts of letter classes over all texts, summed on the cluster.

    Every task adds up one table of N**3 cells; at most that many sums return.
    """

    def count(batches):
        worker_store("toxicity", dict)  # what another operator kept goes
        table = np.zeros(N**3, dtype=np.int64)
        for b in batches:
            for t in b.column("text").cast(pa.binary()):
                c = _CLASS[np.frombuffer((t.as_py() or b"").lower(), dtype=np.uint8)]
                c = np.concatenate([[0], c, [0]])
                if len(c) > 2:
                    table += np.bincount((c[:-2] * N + c[1:-1]) * N + c[2:], minlength=N**3)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(table[at], pa.int64())], ["gram", "n"])

    rows = docs.select("text").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(N**3)
    for r in rows:
        out[r["gram"]] = r["n"]
    return out


def character_costs(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b), three orders interpolated by how often a context occurs."""
    tri = counts.reshape(N, N, N)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + N)
    p2 = (bi + 20 * p1) / (bi.sum(axis=1, keepdims=True) + 20)
    p3 = (tri + 20 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 20)
    return np.round(-np.log(p3), 6)


def channel(text: str, k: int) -> list[tuple[str, float]]:
    """What the character at ``k`` may stand for, with its cost: itself, letters
    for a sign, nothing or the end of a word for a gap, nothing for a stutter."""
    c = text[k]
    if c == " ":
        out = [("", GAP), (" ", 0.0)]
    elif c in GAPS:
        out = [("", GAP), (" ", BREAK)]
    elif c in LEET:
        out = [(x, SWAP) for x in LEET[c]]
    elif _LETTER.match(c):
        out = [(c, 0.0)]
    else:
        out = [("", LONE)]
    if k and c == text[k - 1] and c != " ":
        run = text[max(0, k - 2) : k] == c * 2 or text[k + 1 : k + 2] == c
        out.append(("", REPEAT if run else LONE))
    return out


def restore(text: str, costs: np.ndarray) -> str:
    """The cheapest clean spelling of a disguised word or of a run of short words:
    a Viterbi search over the lattice of :func:`channel`.  The state is the last
    two letters' classes."""
    states = {(0, 0): (0.0, "")}
    for k in range(len(text)):
        best: dict = {}
        for out, extra in channel(text, k):
            z = _class(out) if out else -1
            for (a, b), (cost, said) in states.items():
                if z >= 0:
                    key, total, now = (b, z), cost + extra + costs[a, b, z], said + out
                else:
                    key, total, now = (a, b), cost + extra, said
                if key not in best or (total, now) < best[key]:
                    best[key] = (total, now)
        states = best
    return min((cost + costs[a, b, 0], said) for (a, b), (cost, said) in states.items())[1]


class Features(dict):
    """Tokens, and runs of short ones, to the features of their restored words, of
    those in ``known`` (all where it is None); bounded per worker."""

    def __init__(self, costs: np.ndarray, known=None):
        super().__init__()
        self.costs, self.known = costs, known

    def _words(self, token: str):
        for part in _PARTS.split(_STUTTER.sub(r"\1\1\1", token)):
            for at in range(0, len(part), PIECE):
                piece = part[at : at + PIECE]
                inner = piece.strip("'~^|()*.-_ ") if " " not in piece else piece
                letters = len(_LETTER.findall(inner))
                if letters and (" " in inner or _NOISY.search(inner) and letters * 2 >= len(inner.strip(GAPS)) - inner.count(".")):
                    yield from (w.strip(_EDGE) for w in restore(inner, self.costs).split())
                else:
                    yield piece.strip(_EDGE)

    def __missing__(self, token: str) -> tuple:
        out = {f for word in self._words(token) if len(word) > 2 for f in (f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n))}
        out = tuple(sorted(out if self.known is None else (f for f in out if f in self.known)))
        if len(self) >= 100_000:
            self.clear()
        if len(token) <= PIECE:
            self[token] = out
        return out

    def of(self, text: str | None) -> set:
        low = (text or "").lower()
        found: set = set()
        for run in set(_SHORT.findall(low)):
            found.update(self[run.replace("\t", " ")])
        for f in map(self.__getitem__, set(low.split())):
            if f:
                found.update(f)
        return found


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, costs: np.ndarray, train_rows: int = TRAIN_ROWS) -> tuple[float, dict[str, float]]:
    """Bias and feature weights of a ridge logistic regression.

    Learns from at most ``train_rows`` labelled rows outside the held-out fifth,
    those with the smallest hash of their id.  Features are restored words and
    word beginnings; the ``FEATURES`` that set the classes apart most are kept.
    Labels without a doc_id or value are left out, repeated ones count as toxic
    if one does.  Without both classes the score is a constant.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # the limit again: an id may have many texts
    picked = picked.join(docs.select("doc_id", "text"), "doc_id").dropDuplicates(["doc_id", "text"])
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(train_rows)
    picked = stored(picked, "toxic-sample").repartition(8 * docs.sparkSession.sparkContext.defaultParallelism)

    def count(batches):
        words, seen = Features(costs), {}
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                for f in words.of(text):
                    n = seen.setdefault(f, [0, 0])
                    n[y > 0] += 1
        names = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([seen[f][0] for f in names], pa.int64()), pa.array([seen[f][1] for f in names], pa.int64())],
            ["feature", "clean", "bad"],
        )

    sizes = {r["y"]: r["n"] for r in picked.groupBy((F.col("toxic") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    bad_n, clean_n = sizes.get(True, 0), sizes.get(False, 0)
    if not bad_n or not clean_n:
        return math.log((bad_n + 0.5) / (clean_n + 0.5)), {}
    table = picked.select("text", "toxic").mapInArrow(count, "feature string, clean bigint, bad bigint")
    both = F.col("clean") + F.col("bad")
    apart = F.abs(F.col("bad") / bad_n - F.col("clean") / clean_n) / F.sqrt((both + 1) / (bad_n + clean_n) * (1 / bad_n + 1 / clean_n))
    top = (
        table.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
        .where(both >= LEAST_DOCS).orderBy(apart.desc(), "feature").limit(FEATURES).collect()
    )
    names = [r["feature"] for r in top]
    index = {f: k for k, f in enumerate(names)}

    def present(batches):
        words = Features(costs, frozenset(index))
        for b in batches:
            rows = [sorted(index[f] for f in words.of(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), b.column("toxic")], ["on", "toxic"])

    rows = picked.select("text", "toxic").mapInArrow(present, "on array<int>, toxic int").collect()  # <= train_rows short lists
    rows.sort(key=lambda r: (r["toxic"], r["on"]))
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1
    for k, r in enumerate(rows):
        x[k, r["on"]] = 1
    y = np.array([r["toxic"] > 0 for r in rows], dtype=float)
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-3
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    w = np.round(w, 9)
    return float(w[-1]), {f: float(v) for f, v in zip(names, w[:-1], strict=True)}


def score(docs: DataFrame, bias: float, weights: dict[str, float], costs: np.ndarray) -> DataFrame:
    """``docs`` with score and predicted added, from the whole restored text."""
    base = docs.drop("score", "predicted")
    at = base.columns.index("text")

    def run(batches):
        worker_store("toxicity", dict)
        words = Features(costs, weights)
        for b in batches:
            out = []
            for t in b.column(at).to_pylist():
                z = math.fsum([bias, *(weights[f] for f in words.of(t))])
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32())],
                [*b.schema.names, "score", "predicted"],
            )

    schema = T.StructType([*base.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return base.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Every row of ``docs`` with held_out, score (0 to 1) and predicted (0 or 1).

    The character model counts all of ``docs``; labels are learnt from rows
    outside the held-out fifth only; id, source and language are no inputs.
    Signs, gaps, spaces and stutter are all choices of the lattice: a word with
    spaces in it is found in runs of three or more pieces of one or two letters.

    Defined cases: null and empty texts get the score of a text without any known
    feature; a null doc_id is not held out; repeated rows score alike; an empty
    table gives no rows; columns named like an output are replaced.
    """
    base = docs.drop("held_out", "score", "predicted")
    costs = character_costs(character_counts(base))
    bias, weights = fit(base, labels, costs, train_rows)
    return score(base.withColumn("held_out", held_out()), bias, weights, costs)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")
