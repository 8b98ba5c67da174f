"""Suffix arrays by induced sorting."""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it (S type)."""
    n = len(t)
    s = np.zeros(n, dtype=bool)
    s[-1] = True
    if n > 1:
        up, same = t[:-1] < t[1:], t[:-1] == t[1:]
        at = np.where(same, n, np.arange(n - 1))
        at = np.minimum.accumulate(at[::-1])[::-1]  # next place where neighbours differ
        s[:-1] = np.where(at < n - 1, up[np.minimum(at, n - 2)], True)
    return s


def _induce(t: np.ndarray, s: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """All suffixes in order, induced from LMS suffixes in the order given.

    Letters are taken in turn; within a letter, waves of suffixes put those that
    start one place before them at the head (L) or the tail (S) of their letter's
    bucket, a wave at a time.
    """
    size = np.bincount(t, minlength=k)
    end = np.cumsum(size)
    start = end - size
    sa = np.full(len(t), -1, dtype=np.int64)
    first = t[seeds]
    n_seed = np.bincount(first, minlength=k)
    by = np.argsort(first, kind="stable")
    seeds, first = seeds[by], first[by]
    sa[(end - n_seed)[first] + np.arange(len(seeds)) - (np.cumsum(n_seed) - n_seed)[first]] = seeds

    def put(from_, want, edge, down):
        j = from_ - 1
        j = j[j >= 0]
        j = j[s[j] == want]
        if not len(j):
            return
        d = t[j]
        by = np.argsort(d, kind="stable")
        j, d = j[by], d[by]
        n = np.bincount(d, minlength=k)
        rank = np.arange(len(j)) - (np.cumsum(n) - n)[d]
        sa[edge[d] - 1 - rank if down else edge[d] + rank] = j
        edge += -n if down else n

    head, tail = start.copy(), end.copy()
    used = np.flatnonzero(size)
    for c in used:
        lo = start[c]
        while lo < head[c]:
            lo, wave = head[c], sa[lo : head[c]].copy()
            put(wave, False, head, False)
        if n_seed[c]:
            put(sa[end[c] - n_seed[c] : end[c]].copy(), False, head, False)
    for c in used[::-1]:
        hi = end[c]
        while hi > tail[c]:
            hi, wave = tail[c], sa[tail[c] : hi][::-1].copy()
            put(wave, True, tail, True)
        put(sa[start[c] : head[c]][::-1].copy(), True, tail, True)
    return sa


def _induce_list(t: list, s: list, seeds: list, k: int) -> list:
    """The same for large alphabets, suffix by suffix."""
    size = [0] * k
    for c in t:
        size[c] += 1
    start, total = [], 0
    for x in size:
        start.append(total)
        total += x
    end = [a + b for a, b in zip(start, size, strict=True)]
    sa = [-1] * len(t)
    tail = end[:]
    for i in reversed(seeds):
        c = t[i]
        tail[c] -= 1
        sa[tail[c]] = i
    # the letter before each place, if that place is of the wanted type; -1 else,
    # also for the slots still empty (index -1 is the last item)
    before = [-1, *t[:-1], -1]
    large = [c if not up else -1 for c, up in zip(before, [True, *s[:-1], True], strict=True)]
    less = [c if up else -1 for c, up in zip(before, [False, *s[:-1], False], strict=True)]
    head = start
    for i in sa:  # sees what the loop itself puts further on
        c = large[i]
        if c >= 0:
            sa[head[c]] = i - 1
            head[c] += 1
    tail = end
    for i in reversed(sa):
        c = less[i]
        if c >= 0:
            tail[c] -= 1
            sa[tail[c]] = i - 1
    return sa


def _names(t: np.ndarray, sa: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order: equal substrings, equal names."""
    n = len(t)
    mark = np.zeros(n, dtype=bool)
    mark[lms] = True
    order = sa[mark[sa]]
    length = np.zeros(n, dtype=np.int64)
    length[lms] = np.append(lms[1:], n) - lms + 1
    a, b = order[:-1], order[1:]
    differ = length[a] != length[b]
    live, k = np.flatnonzero(~differ), 0
    while len(live):
        x, y = a[live], b[live]
        same = (np.minimum(x, y) + k < n) & (np.maximum(x, y) + k < n)
        same[same] = t[x[same] + k] == t[y[same] + k]
        differ[live[~same]] = True
        k += 1
        live = live[same & (k < length[x])]
    name = np.empty(n, dtype=np.int64)
    name[order] = np.concatenate([[0], np.cumsum(differ)])
    return name[lms], int(differ.sum()) + 1


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Order of the suffixes of ``t``, whose last item is its only smallest one.

    Suffixes are classified; leftmost-smaller (LMS) substrings are sorted by one
    induction and named, the string of names is sorted recursively if names
    repeat, and the order of LMS suffixes induces all others.
    """
    if len(t) < 3:
        return np.argsort(t, kind="stable")
    small = k <= 1 << 16 and 48 * k <= len(t) or k <= 300
    if small:
        t = t.astype(np.uint16)  # sorts by counting
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    listed = (t.tolist(), s.tolist()) if not small else None
    sort = (lambda seeds: _induce(t, s, seeds, k)) if small else (lambda seeds: np.array(_induce_list(*listed, seeds.tolist(), k)))
    names, n = _names(t, sort(lms), lms)
    order = np.argsort(names) if n == len(lms) else suffix_array(names, n)
    return sort(lms[order])


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: at each position, how many items its suffix has
    in common with the suffix before it in order, up to ``most``."""
    padded = np.concatenate([t, np.full(most, -1, dtype=t.dtype)])
    view = np.lib.stride_tricks.sliding_window_view(padded, most)
    out = np.zeros(len(t), dtype=np.int64)
    for lo in range(1, len(sa), 1 << 14):
        cur, before = sa[lo : lo + (1 << 14)], sa[lo - 1 : lo - 1 + (1 << 14)]
        before = before[: len(cur)]
        other = view[cur] != view[before]
        out[cur] = np.where(other.any(axis=1), other.argmax(axis=1), most)
    return out
