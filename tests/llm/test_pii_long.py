"""Disguised addresses are found in linear time, as by one pattern."""

from __future__ import annotations

import random
import re
import time

from ledgerlens.llm import pii

WHOLE = re.compile(
    rf"(?<![\w.%+-]){pii._NAME}(?:\x20(?:{pii._DOT_WORDS})\x20{pii._NAME})*\x20?(\x20(?:{pii._AT_WORDS})\x20|\x20?@\x20?)\x20?{pii._PLAIN_HOST.pattern}", re.I
)


def test_addresses_as_by_one_pattern():
    rng = random.Random(3)
    parts = ["a", "bob", "x-1", "é", " at ", " @ ", "@", " dot ", " point ", ".", " ", " . ", "com", "de", "\n", "(at)", " arroba ", "!"]
    same = 0
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(3, 14)))
        want, got = [m.span() for m in WHOLE.finditer(text)], pii._plain_addresses(text)
        same += want == got
        # What one pattern finds is found; it may begin a name earlier in odd runs of signs.
        assert all(any(s <= b and a <= e for s, e in got) for a, b in want), text
    assert same > 19_500
    text = "write to bob dot smith at example dot co dot uk or ann @ host dot org"
    assert [text[s:e] for s, e in pii._plain_addresses(text)] == ["bob dot smith at example dot co dot uk", "ann @ host dot org"]


def test_long_chains_take_linear_time():
    for text in ("x at y. " + "a dot " * 170_000, "a dot " * 100_000 + "b at c dot com", "a at b dot " * 80_000, "dot at " * 100_000, "@ " * 300_000 + "dot"):
        start = time.process_time()
        pii.scan(text)
        assert time.process_time() - start < 8, text[:20]
