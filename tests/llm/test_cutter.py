"""Pre-tokens by the standard module are those of the pattern."""

import random
import time

from clientlens.llm import tokens


def test_cutter_gives_the_pre_tokens_of_the_pattern():
    import public_tokenizers
    import regex

    want, got = regex.compile(public_tokenizers.PATTERN).findall, tokens.cutter(public_tokenizers.PATTERN)
    plane = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    # every character of the basic plane after each kind of neighbour, so that no class differs
    for before in ("", "a", "1", " ", ".", "'"):
        text = "".join(before + c for c in plane)
        assert got(text) == want(text)
    rng = random.Random(7)
    some = list("ab1. '\n\t 　́²Ⅷ½éжλ字\U0001f600\U00010400\x1c\x85") + ["'s", "'ll", "  ", "\r\n"]
    for _ in range(3000):
        text = "".join(rng.choices(some, k=rng.randrange(20)))
        assert got(text) == want(text)


def test_cutter_takes_less_time_than_the_pattern():
    import public_tokenizers
    import regex

    text = "The andhainan is esly, nted haon a. Ater là où été " * 20000

    def least(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f(text)
            took.append(time.process_time() - began)
        return min(took)

    assert least(tokens.cutter(public_tokenizers.PATTERN)) < 0.8 * least(regex.compile(public_tokenizers.PATTERN).findall)
