"""Line dedup of short lines, and of lines in scripts without blanks, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from ledgerlens.llm import line_dedup

DOCS = "doc_id long, text string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def expected(rows, num, den):
    lines = [(key, i, frozenset(SPACE.findall(x.lower()))) for key, t in rows for i, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    gone = {(key, i) for n, (key, i, s) in enumerate(lines) if any(den * len(s & o) >= num * len(s | o) for _, _, o in lines[:n])}
    return Counter((k, "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone)) for k, t in rows)


def test_repeated_short_lines_go(spark):
    rows = [(1, "All rights reserved.\n\n第一章人工智能的历史与未来\nHome\n}\n a b c d"),
            (2, "all rights  reserved.\n\n第一章人工智能的历史与未来\nnew\n}\nd c b a e"),
            (3, "HOME\nAll rights reserved\n \nb a")]
    found = line_dedup.remove_repeated_lines(spark.createDataFrame(rows, DOCS), count="n")
    assert {r.doc_id: (r.text, r.n) for r in found.collect()} == {
        1: (rows[0][1], 0), 2: ("\nnew", 4), 3: ("All rights reserved\n \nb a", 1)}


@pytest.mark.parametrize("limit, num", [(1000, 80), (2, 80), (1000, 50), (2, 50)])
def test_short_lines_match_brute_force(spark, monkeypatch, limit, num):
    monkeypatch.setattr(line_dedup, "LIST_LIMIT", limit)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(14)] + [f"v{i}" for i in range(200)]
    line = lambda: " ".join(rng.choice(words[: rng.choice([14, 214])]) for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 4, 5, 6])))
    rows = [(k, "\n".join(line() for _ in range(8))) for k in range(60)]
    found = line_dedup.remove_repeated_lines(spark.createDataFrame(rows, DOCS), num=num, den=100)
    assert Counter((r.doc_id, r.text) for r in found.collect()) == expected(rows, num, 100)
