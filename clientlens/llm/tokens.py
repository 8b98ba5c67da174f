"""Tokenizing with a public byte-level BPE vocabulary inside tasks."""

from __future__ import annotations

import re

import numpy as np

from clientlens.llm.common import worker_store

DEFAULT_VOCAB = "byte_bpe_50k.json"


def vocab_path(name: str = DEFAULT_VOCAB) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cutter(pattern: str):
    """``findall`` of a pre-token pattern.  The standard module is more than twice as
    fast as ``regex``, whose classes it is given character by character for the
    basic plane; texts with characters beyond it are cut by ``regex`` itself."""
    import regex

    plane = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    ranges = {c: "".join(f"\\u{ord(m[0]):04x}-\\u{ord(m[-1]):04x}" for m in regex.findall(f"{c}+", plane)) for c in (r"\p{L}", r"\p{N}", r"\s")}

    def spelled(m):
        c = m[0]
        if c[0] == "[":
            return re.sub(r"\\p\{[LN]\}|\\s", lambda x: ranges[x[0]], c)
        return f"[^{ranges[r'\s']}]" if c == r"\S" else f"[{ranges[c]}]"

    own, beyond, all_ = re.compile(re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\[sS]", spelled, pattern)).findall, re.compile("[^\x00-\uffff]").search, regex.compile(pattern).findall
    return lambda text: own(text) if text.isascii() or not beyond(text) else all_(text)


class Pieces:
    """Ids of whole texts as little-endian 16-bit bytes.

    The tokenizer encodes pre-tokens one by one, so a worker asks it once for each
    pre-token, all new ones of a text in one call.  Texts that hold an added token
    of the vocabulary are encoded whole.
    """

    def __init__(self, path: str, most: int = 400_000):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.parts = cutter(public_tokenizers.PATTERN)
        # two generations: what is still in use moves to the younger one, the older goes
        self.most, self.known, self.older = most, {}, {}

    def raw(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def learn(self, new: set[str]) -> None:
        # pre-tokens that begin with a space stay apart when written one after another
        spaced = [p for p in new if len(p) > 1 and p[0] == " " and not p[1].isspace()]
        if spaced:
            code = self.tokenizer.encode("".join(spaced), add_special_tokens=False)
            ids = np.asarray(code.ids, dtype="<u2")
            cut = np.flatnonzero(np.diff(np.asarray(code.word_ids, dtype=np.int64), prepend=-1)).tolist()
            if len(cut) == len(spaced):
                raw = ids.tobytes()
                self.known.update((p, raw[2 * i : 2 * j]) for p, i, j in zip(spaced, cut, [*cut[1:], len(ids)], strict=True))
        self.known.update((p, self.raw(p)) for p in new if p not in self.known)

    def ids(self, text: str) -> bytes:
        """Ids of a whole text, 16 bits each."""
        if self.added is not None and self.added.search(text):
            return self.raw(text)
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        parts = self.parts(text)
        new = set(parts).difference(self.known)
        if new:
            self.known.update((p, self.older[p]) for p in new if p in self.older)
            self.learn({p for p in new if p not in self.known})
        out = b"".join(map(self.known.__getitem__, parts))
        for p in new:
            if len(p) > 64:
                del self.known[p]
        return out


def pieces(path: str) -> Pieces:
    """One vocabulary per Python worker."""
    return worker_store(f"pieces {path}", lambda: Pieces(path))
