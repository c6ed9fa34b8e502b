"""Line dedup reads the texts once to build the full sets, also where long lists
leave pairs to be decided later, and only texts that lose lines go to Python again."""

from __future__ import annotations

import random

import numpy as np

from ledgerlens.llm import line_dedup


def test_full_sets_are_built_in_one_reading(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LIST_LIMIT", 5)
    reads, rest = [], []
    build, keep = line_dedup.word_sets, line_dedup.materialize

    def kept(df, tag, *a):
        out = keep(df, tag, *a)
        if tag == "line-rest":
            rest.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "word_sets", lambda *a: reads.append(1) or build(*a))
    monkeypatch.setattr(line_dedup, "materialize", kept)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(12)]
    rows = [(k, "\n".join([" ".join(rng.sample(base, 11) + [f"x{rng.randrange(9)}"]), "", " ".join(rng.sample(base, 6))])) for k in range(60)]
    sets = [(k, i, frozenset(x.split())) for k, t in rows for i, x in enumerate(t.split("\n")) if x]
    gone = {(k, i) for n, (k, i, s) in enumerate(sets) if any(100 * len(s & o) >= 80 * len(s | o) for _, _, o in sets[:n])}
    found = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.line) for r in found.collect()} == gone
    assert sum(rest) > 0 and len(reads) == 1


def test_rows_of_one_id_are_told_apart_by_text(spark):
    """Repeated rows change alike, another text of their id does not."""
    rows = [(1, "a b c\nnew"), (2, "a b c\nx y"), (2, "a b c\nx y"), (2, "other"), (2, None), (None, "x y")]
    found = line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), count="n")
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [
        (1, "a b c\nnew", 0), (2, "", 2), (2, "", 2), (2, "other", 0), (2, None, 0), (None, "x y", 0)]))


def test_texts_are_not_digested_in_python_to_rewrite_them(spark):
    found = line_dedup.remove_repeated_lines(spark.createDataFrame([(1, "a b"), (2, "b a\nc")], "doc_id long, text string"), count="n")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "digest(" not in plan and "xxhash64(" in plan


def test_classes_that_share_half_their_bits_are_told_apart():
    key = np.array([7, 3, 7, 7, 3], np.uint32)
    k1 = np.array([5, -1, 4, 5, 1 << 40], np.int64)
    order, by, classes = line_dedup._by_key(key, k1)
    assert by.tolist() == [3, 3, 7, 7, 7] and classes[2:].tolist() == [4, 5, 5]
    assert (key[order] == by).all() and (k1[order] == classes).all()
