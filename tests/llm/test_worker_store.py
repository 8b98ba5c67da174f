"""A Python worker keeps the store of one operator."""

import weakref

from clientlens.llm import shingles, tokens


def test_the_store_of_another_operator_goes():
    kept = weakref.ref(tokens.pieces(tokens.vocab_path()))
    assert kept() is tokens.pieces(tokens.vocab_path())
    first = shingles.shingle_set(b"one two three four five six")
    assert kept() is None
    tokens.pieces(tokens.vocab_path()).ids("one two")
    assert shingles.shingle_set(b"one two three four five six").tolist() == first.tolist()
