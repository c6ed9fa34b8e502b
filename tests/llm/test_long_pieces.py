"""Pieces of any length take part in language identification."""

from __future__ import annotations

import numpy as np
import pytest

from ledgerlens.llm import language
from ledgerlens.llm.queries import piece_vocabulary


def test_long_pieces_are_in_the_vocabulary():
    lengths = [len(t) for t in language.load_pieces(piece_vocabulary())]
    assert max(lengths) == 16 and sum(n > 8 for n in lengths) == 1894


def test_segmentations_with_long_pieces_are_summed():
    pieces = language.Pieces(["a", "b", "abababababab"])
    probs = np.array([[0.2], [0.3], [0.4], [0.1], [0.0]])
    letters = 0.06**6
    assert np.exp(language.word_logs(pieces, probs, ["ab" * 6, "b" + "ab" * 6]))[:, 0] == pytest.approx([letters + 0.4, 0.3 * (letters + 0.4)])
    counts = language.expected_counts(pieces, probs[:, 0], ["ab" * 6], np.array([2.0]))
    assert counts[2] == pytest.approx(2 * 0.4 / (letters + 0.4))
