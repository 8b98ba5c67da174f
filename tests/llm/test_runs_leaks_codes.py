"""Periodic runs, benchmark windows and vector codes against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from clientlens.llm import codes, decontam, periodic

ODD = [(None, None), (1, None), (2, ""), (3, " \t\n "), (3, " \t\n "), (4, "a"), (5, "a b " * 40), (5, "a b " * 40), (6, "x"), (None, "p q r " * 9)]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "c", 7) for r in rows], "doc_id bigint, text string, n_runs string, items int")


def texts(seed, n):
    rng = random.Random(seed)
    for k in range(n):
        voc = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(rng.choice([2, 4, 30]))]
        w = [rng.choice(voc) for _ in range(rng.choice([3, 12, 40, 150]))]
        if rng.random() < 0.7:
            at, p = rng.randrange(len(w)), rng.randint(1, 8)
            w[at:at] = (w[:p] * 9)[: rng.randint(1, 9 * p)]
        yield 100 + k, " ".join(w)


def runs_by_hand(w):
    """Every stretch with its smallest period, tried start by start."""
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(12, 2 * q) and not any(all(w[x] == w[x + d] for x in range(i, i + size - d)) for d in range(1, q)):
                out.add((i, size, q))
            i = j + 1 if j == i else j
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_by_hand(doc_id, text):
    w = re.findall(r"[^\x09-\x0D\x20]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(w)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("work", [periodic.WORK, 2000])
def test_periodic_runs(spark, work):
    rows = ODD + list(texts(3, 120))
    got = periodic.periodic_runs(docs(spark, rows), plant=True, work=work, short=100 if work < 10_000 else periodic.SHORT).drop("runs").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted((periodic_by_hand(*r) for r in rows), key=key)
    assert sum(r["n_runs"] > 0 for r in got) > 30 and any(zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 and r["n_runs"] for r in got)
    assert periodic.periodic_runs(docs(spark, [])).count() == 0


def test_lag_ranges_agree_with_one_scan():
    ids = periodic.word_ids([b"%d" % (i % 7 if 100 < i < 900 else i % 13) for i in range(2000)])
    whole = periodic.stretches(ids, 1, 1001)
    parts: dict = {}
    for a in range(1, 1001, 77):
        for k, q in periodic.stretches(ids, a, a + 77).items():
            parts[k] = min(q, parts.get(k, q))
    assert parts == whole and {7, 13} == {*whole.values()}


def hits_by_hand(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows: dict = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s : s + 10]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if (x := tuple(w[s : s + k])) in windows:
                    hit |= {*range(s, s + k)}
                    found |= windows[x]
        names = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize(("block", "piece"), [(decontam.BLOCK_WINDOWS, decontam.PIECE_WORDS), (20, 14)])
def test_decontamination(spark, block, piece):
    rng = random.Random(4)
    items = [(i, t.replace(" ", rng.choice([" ", ", ", "\n"])).upper()) for i, t in texts(9, 25)]
    items += [(1, None), (2, ""), (3, "..."), (None, "nameless item of very few words"), (125, "a second text of an item that is there twice already, and long enough"), (9, "Ünd é")]
    rows = ODD + [(d, f"{t} -- {rng.choice(items)[1] or ''} {t[:20]}") for d, t in texts(5, 60)]
    rows += [(900, "Nameless ITEM of; very few words! ünd é Ünd É"), (901, "z " * 30_000 + (items[3][1] or ""))]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, doc_id int")
    got = decontam.decontaminate(docs(spark, rows), bench, block, piece).drop("spans", "items").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(hits_by_hand(rows, items), key=key)
    assert decontam.decontaminate(docs(spark, []), bench).count() == 0
    clean = decontam.decontaminate(docs(spark, ODD), bench.where("false")).collect()
    assert len(clean) == len(ODD) and not any(r["contaminated"] for r in clean)


def codes_by_hand(rows):
    """Lloyd's rounds in whole numbers, every part against every entry."""
    kept = [(i, lab, [math.floor(1024 * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(kept[0][2]) // 4
    parts = [[tuple(v[j * w : j * w + w]) for _, _, v in kept] for j in range(4)]
    books = [[list(p) for p in parts[j][:256]] for j in range(4)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda k: (far(x, book[k]), k))
    for _ in range(4):
        for j in range(4):
            at = [nearest(x, books[j]) for x in parts[j]]
            for k in {*at}:
                mine = [x for x, a in zip(parts[j], at, strict=True) if a == k]
                books[j][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for r, (i, lab, _) in enumerate(kept):
        at = [nearest(parts[j][r], books[j]) for j in range(4)]
        out.append((i, lab, "".join(f"{a:02x}" for a in at), sum(far(parts[j][r], books[j][at[j]]) for j in range(4))))
    label = {}
    for _, lab, _, e in out:
        label[lab] = label.get(lab, 0) + e
    return [(i, c, e, label[lab], digest) for i, lab, c, e in out]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id bigint, embedding array<float>, label int, code string")


@pytest.mark.parametrize(("n", "spread"), [(900, 1.0), (40, 0.01), (600, 40.0)])
def test_vector_codes(spark, n, spread):
    rng = np.random.default_rng(n)
    base = rng.normal(size=(12, 8)) * spread
    v = np.float32(np.round(base[rng.integers(0, 12, n)] + rng.normal(size=(n, 8)) * spread / 8, 2))
    rows = [(int(i) * 3 - 50, [float(x) for x in v[i]], [0, 0, 0, 1, None][i % 5]) for i in range(n)]
    rows += rows[:30] + [(5000, None, 1), (-9000, [1.0, None] + [0.0] * 6, 1), (-9001, [float("nan")] * 8, 1), (-9002, [float("inf")] + [0.0] * 7, None), (None, rows[3][1], None)]
    made, books = codes.compress(vectors(spark, rows).repartition(3))
    got = codes.with_label_error(made).selectExpr("vec_id", "code", "error", "label_error").collect()
    digest = codes.books_digest(books)
    key = lambda r: tuple(map(str, r))
    assert sorted(((*r, digest) for r in got), key=key) == sorted(codes_by_hand(rows), key=key)


def test_vector_codes_of_nothing(spark):
    for rows in ([], [(1, None, 1)]):
        made, _ = codes.compress(vectors(spark, rows))
        assert codes.with_label_error(made).count() == 0
    with pytest.raises(ValueError, match="multiple of four"):
        codes.compress(vectors(spark, [(1, [1.0, 2.0], 1)]))


def test_filtering_leaves_nothing_out():
    rng = np.random.default_rng(1)
    for width, n, k in ((3, 700, 256), (16, 300, 40), (2, 5, 9), (1, 64, 64)):
        points = np.floor(rng.normal(size=(n, width)) * 30).astype(np.int64)
        book = np.floor(rng.normal(size=(k, width)) * 30).astype(np.int64)
        tree = codes.Tree.build(points)
        code, total, count = tree.assign(book)
        d = ((tree.points[:, None] - book) ** 2).sum(axis=2)
        assert (code == d.argmin(axis=1)).all() and (tree.points == points[tree.order]).all()
        assert (count == np.bincount(code, minlength=k)).all() and all((total[c] == tree.points[code == c].sum(axis=0)).all() for c in range(k))
        again = codes._unpack(codes._pack(tree), n, width)
        assert all((a == b).all() for x, y in ((again.low, tree.low), (again.sums, tree.sums)) for a, b in zip(x, y, strict=True))
