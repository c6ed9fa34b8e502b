"""Words are scored a small run at a time, whose arrays are all that a worker holds
beside its table of scored words; a dropped table's memory goes back to the system."""

from __future__ import annotations

import random
import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pytest

from ledgerlens.llm import language

LETTERS = "abcdefgh"


@pytest.mark.parametrize("score", [
    lambda pieces, probs, words: language.word_logs(pieces, probs, words).sum(),
    lambda pieces, probs, words: language.expected_counts(pieces, probs[:, 0], words, np.ones(len(words))).sum(),
])
def test_many_words_take_little_memory(score):
    rng = random.Random(3)
    texts = sorted({"".join(rng.choice(LETTERS) for _ in range(n)) for n in range(1, 13) for _ in range(40)} | set(LETTERS))
    probs = np.zeros((len(texts) + 2, 4))
    probs[:-1] = 1 / (len(texts) + 1)
    pieces = language.Pieces(texts)
    words = ["".join(rng.choice(LETTERS) for _ in range(language.LONGEST)) for _ in range(20_000)]
    tracemalloc.start()
    try:
        whole = score(pieces, probs, words)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert whole == pytest.approx(sum(score(pieces, probs, words[at:at + 500]) for at in range(0, len(words), 500)))
    assert peak < 25 << 20, peak


GIVEN_BACK = """
import numpy as np
from ledgerlens.llm import common

def resident():
    return int(next(x for x in open("/proc/self/status") if x.startswith("VmRSS")).split()[1]) >> 10

class Shared:
    value, _path = 1, "x"

kept = []
def build(_):
    out = []
    for _ in range(2000):  # pieces in use lie between those that go
        out.append(np.ones(100_000, np.uint8))
        kept.append(np.ones(2_000, np.uint8))
    return out

common.worker_object("other", Shared, build)
before = resident()
common.drop_worker_objects()
print(before - resident())
"""


def test_dropped_tables_go_back_to_the_system():
    out = subprocess.run([sys.executable, "-c", GIVEN_BACK], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert int(out.stdout) > 150
