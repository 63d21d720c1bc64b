"""Block similarity against the standard library's own matcher."""

import random
import time
from difflib import SequenceMatcher

import pytest

from palimpsest.functions import similarity
from palimpsest.functions.similarity import matching_blocks, opcodes, ratio


def _cases():
    rng = random.Random(3)
    for n in range(400):
        alphabet = "ab" if n % 3 == 0 else "abcdefgh "
        a = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))
        b = list(a) if n % 2 else [rng.choice(alphabet) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 6)):
            if b:
                b[rng.randrange(len(b))] = rng.choice(alphabet)
        yield a, "".join(b)


@pytest.mark.parametrize("small", [0, 4096])
def test_ratio_and_blocks_equal_difflib(small, monkeypatch):
    monkeypatch.setattr(similarity, "SMALL", small)
    for a, b in _cases():
        m = SequenceMatcher(a=a, b=b, autojunk=False)
        assert matching_blocks(a, b) == [tuple(x) for x in m.get_matching_blocks() if x.size]
        assert ratio(a, b) == m.ratio()


def test_threshold_only_drops_lower_ratios():
    for a, b in _cases():
        exact = SequenceMatcher(a=a, b=b, autojunk=False).ratio()
        got = ratio(a, b, 0.72)
        assert got == (exact if exact >= 0.72 else 0.0)


def test_word_opcodes_equal_difflib():
    a, b = "the board must keep records of data".split(), "the board shall keep all records".split()
    assert opcodes(a, b) == SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes()


def test_long_texts_are_aligned_as_by_difflib_without_a_step_per_character():
    rng = random.Random(8)
    words = ["quay", "a", "ab", "aba", "rope", "of", "the"]
    for turn in range(40):
        a = " ".join(rng.choice(words) for _ in range(90))
        b = a[:50] + " as amended " + a[60:150] + a[170:] if turn % 2 else " ".join(rng.choice(words) for _ in range(80))
        want = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
        assert matching_blocks(a, b) == [tuple(x) for x in want if x.size]
    text = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(7)) for _ in range(40_000))
    start = time.process_time()
    assert ratio(text, text[:100_000] + " as amended" + text[100_000:]) == 2 * len(text) / (2 * len(text) + 11)
    assert time.process_time() - start < 4
