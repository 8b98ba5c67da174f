"""What op9's exchanges carry, and ids that meet once they are numbers."""

import hashlib

import numpy as np

from clientlens.llm import repeats


def test_settled_rows_carry_no_shard():
    h, doc, pos = np.array([5, 5, 5, 9], np.int64), np.array([1, 2, 3, 4], np.int64), np.zeros(4, np.int64)
    none = np.zeros(4, np.int64)
    out = repeats._of_owners([h, none, doc, none, pos, none, np.array([False, False, False, True])]).to_pylist()
    assert {r["doc"] for r in out if r["done"]} == {3, 4}
    assert {r["shard"] for r in out if r["done"]} == {0}


def test_null_id_and_largest_id_are_two_documents(spark):
    text = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(4))
    rows = [(None, text), ((1 << 63) - 1, text), (3, text[:120])]
    got = {r["doc_id"]: r["n_removed"] for r in repeats.suffix_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {3: 0, (1 << 63) - 1: 120, None: 256}


def test_rounds_part_the_stretches_by_owner():
    texts = ["".join(hashlib.sha256(f"{k} {i}".encode()).hexdigest() for i in range(40)).encode() for k in (1, 1, 2)] + [b"", b"short"]
    rows = lambda found: sorted(zip(*(x.tolist() for x in found), strict=True))
    parts = [repeats.owners(texts, turn) for turn in range(repeats.ROUNDS)]
    assert sorted(r for p in parts for r in rows(p)) == rows(repeats.owners(texts)) and all(len(p[0]) for p in parts)
    assert not set(parts[0][0].tolist()) & set(parts[1][0].tolist())
