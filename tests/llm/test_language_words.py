"""Words of language identification: what a letter is, and words of any length."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
import regex

from ledgerlens.llm import language
from ledgerlens.llm.queries import piece_vocabulary


def test_letters_are_unicode_letters_with_their_marks():
    for text in ("½ ② ² ³¼ 12_3", "", None):
        assert language.words_of(text) == []
    assert language.words_of("हिन्दी x²y a½b don't 日本_語 éáb") == ["हिन्दी", "x", "y", "a", "b", "don", "t", "日本", "語", "éáb"]
    letters = regex.compile(r"(?:\p{L}\p{M}*)+")
    for start in range(0, 0x3000, 64):
        text = "".join(map(chr, range(start, start + 64))).lower()
        assert language.words_of(text) == letters.findall(text), hex(start)


def brute(pieces, probs, word):
    """Summed over all cuts of a short word into pieces."""
    index = {t: i for i, t in enumerate(pieces.texts)}
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, start = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[start:i])
                start = i
        p = 1.0
        for x in [*parts, word[start:]]:
            k = index.get(x, len(pieces.texts) if len(x) == 1 else None)
            p *= 0 if k is None else probs[k]
        total += p
    return np.log(total)


@pytest.fixture(scope="module")
def model():
    pieces = language.Pieces(language.load_pieces(piece_vocabulary()))
    rng = np.random.default_rng(4)
    probs = np.zeros((len(pieces.texts) + 2, 2))
    probs[:-1] = rng.random((len(pieces.texts) + 1, 2)) ** 4 + 1e-9
    return pieces, probs / probs.sum(axis=0)


def test_long_words_by_the_same_sums(model, monkeypatch):
    pieces, probs = model
    word = "internationalbe"
    assert language.word_logs(pieces, probs, [word])[0] == pytest.approx([brute(pieces, probs[:, k], word) for k in (0, 1)])
    words = [word, "x", "überraschungsei", "日本q"]
    counts = np.array([1.0, 2.0, 3.0, 4.0])
    plain = language.word_logs(pieces, probs, words), language.expected_counts(pieces, probs[:, 0], words, counts)
    monkeypatch.setattr(language, "LONGEST", 0)
    assert language.word_logs(pieces, probs, words) == pytest.approx(plain[0])
    assert language.expected_counts(pieces, probs[:, 0], words, counts) == pytest.approx(plain[1])


def test_a_word_of_any_length_has_a_score(model):
    pieces, probs = model
    word = "donaudampfschifffahrtsgesellschaft" * 300
    got = language.word_logs(pieces, probs, [word, "a"])
    assert np.isfinite(got).all() and got[0, 0] < -1000
    # The expected counts of all pieces spell the word.
    expected = language.expected_counts(pieces, probs[:, 0], [word], np.ones(1))
    assert (expected * np.array([len(t) for t in pieces.texts] + [1])).sum() == pytest.approx(len(word))
