"""Lists of keys are formed where their entries arrive: no table of entries is
joined, and a list too long to be held goes on member by member."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ledgerlens.llm import line_dedup
from ledgerlens.llm.line_dedup import ENTRY, MOST, _Block


def entries(keys, classes) -> np.ndarray:
    out = np.zeros(len(keys), ENTRY)
    out["key"], out["k1"], out["n"] = keys, classes, 5
    return out


def test_a_long_list_is_not_held(monkeypatch):
    monkeypatch.setattr(line_dedup, "ROWS_AT_ONCE", 64)
    lists, out, most = _Block(10), [], 0
    for at in range(0, 5000, 50):
        part = entries([1] * 50, range(at, at + 50))
        out.append(lists.add(np.concatenate([part, part[:5], entries([2, 3, 3], [7, 7, at])])))
        most = max(most, sum(map(len, lists.held)))
    out.append(lists.sift(last=True))
    gone = np.concatenate(out)
    assert {(k, c) for k, c in zip(gone["key"].tolist(), gone["k1"].tolist()) if k == 1} == {(1, c) for c in range(5000)}
    # Key 3 has a class a step and class 7, key 2 only class 7.
    assert {c for k, c in zip(gone["key"].tolist(), gone["k1"].tolist()) if k == 3} == {7, *range(0, 5000, 50)}
    assert lists.held[0]["key"].tolist() == [2] and most < 300


def test_each_entry_is_held_once():
    lists = _Block(10)
    assert not len(lists.add(entries([4, 4, 4, 9], [1, 2, 1, 1])))
    assert not len(lists.sift(last=True))
    assert list(zip(lists.held[0]["key"].tolist(), lists.held[0]["k1"].tolist())) == [(4, 1), (4, 2)]


@pytest.mark.parametrize("met", [1, 1 << 20])
def test_lines_with_few_remembered_and_a_small_block(spark, monkeypatch, met):
    """Group of near copies and common lines, whatever is remembered and held."""
    monkeypatch.setattr(line_dedup, "MET", met)
    monkeypatch.setattr(line_dedup, "ROWS_AT_ONCE", 16)
    monkeypatch.setattr(line_dedup, "LIST_LIMIT", 5)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(12)]
    rows = [(k, "\n".join([" ".join(base[:11] + [f"x{rng.randrange(9)}"]), "all rights reserved", " ".join(rng.sample(base, 6))])) for k in range(40)]
    sets = [(k, i, frozenset(x.split())) for k, t in rows for i, x in enumerate(t.split("\n"))]
    gone = {(k, i) for n, (k, i, s) in enumerate(sets) if any(100 * len(s & o) >= 80 * len(s | o) for _, _, o in sets[:n])}
    found = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.line) for r in found.collect()} == gone


def test_sizes_beyond_the_entry_let_pairs_through(spark):
    """Two lines of more distinct words than an entry counts, of which few differ."""
    words = [f"w{i}" for i in range(MOST + 2000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-100], *(f"v{i}" for i in range(100))])), (3, " ".join(words[: MOST // 2]))]
    found = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.line) for r in found.collect()} == {(2, 0)}


def test_no_join_by_key_of_entries(spark, monkeypatch):
    """Entries meet where they are dealt to, not in a join by key."""
    plans = []
    keep = line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, tag, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, tag, *a))
    line_dedup.repeated_lines(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g")], "doc_id long, text string"))
    conditions = [x for p in plans for x in p.split("\n") if "Join Inner, (key#" in x]
    assert conditions == []
