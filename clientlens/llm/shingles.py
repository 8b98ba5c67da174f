"""Word shingles of whole texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

from clientlens.llm.common import worker_store

WORDS = 5
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)
_STEPS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Words (lower-cased UTF-8) to 8 hash bytes; bounded."""

    def __missing__(self, word: bytes) -> bytes:
        out = xxhash.xxh3_64_intdigest(word).to_bytes(8, "little")
        if len(self) >= 100_000:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out



def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of ``words``-word shingles; A-Z lower-cased, words
    cut at ASCII white space.  Fewer words: the whole sequence; none: empty."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    w = np.frombuffer(b"".join(map(worker_store("shingles", WordHashes).__getitem__, found)), dtype="<u8")
    k = min(words, len(w))
    n = len(w) - k + 1
    out = w[:n] * _STEPS[0]
    for i in range(1, k):
        out = out + w[i : i + n] * _STEPS[i]
    return np.unique(mix64(out + np.uint64(k)))


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()
