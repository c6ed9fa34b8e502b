"""Cutting lines without Python, and the pairs of a key's list."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import line_dedup

TEXTS = ["a", "a\n", "\na", "\n\n", "a\r\nb\n\nc", "a\nb\nc\n", " \n\tä漢\n", ""]


def test_lines_are_cut_as_by_python(spark):
    rows = [(t, sorted(set(gone))) for t in TEXTS for gone in ([0], [1], [0, 1], [2, 0], [0, 1, 2, 3], [7])]
    cut = spark.createDataFrame(rows, "text string, gone array<int>").withColumn("out", line_dedup._cut(F.col("text"), F.col("gone")))
    assert "PythonUDF" not in cut._jdf.queryExecution().optimizedPlan().toString()
    assert "cut(" not in cut._jdf.queryExecution().optimizedPlan().toString()
    for r in cut.collect():
        assert r.out == "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in r.gone)


def test_runs_are_joined_by_line_feeds():
    texts = ["a b", None, "", "Ä\nc", "x" * line_dedup.TEXT_BYTES, "y"]
    for type_ in (pa.string(), pa.large_string()):
        runs = list(line_dedup._joined_runs(pa.array([None, *texts], type_).slice(1)))
        assert len(runs) > 1
        assert b"\n".join(runs) == "\n".join(t or "" for t in texts).encode()


@pytest.mark.parametrize(("num", "den", "most"), [(80, 100, 16), (1, 2, 1), (9, 10, 1000)])
def test_list_pairs_are_all_that_pass_the_filters(num, den, most):
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 40, 60)
    key = np.repeat(np.sort(rng.choice(1 << 40, 60, replace=False)), sizes)
    count = len(key)
    n = rng.integers(1, 12, count).astype(np.uint16)
    n[rng.random(count) < 0.05] = line_dedup.MOST
    pos, k1 = (rng.integers(0, 3, count) % n).astype(np.uint16), rng.permutation(count).astype(np.int64)
    bits = rng.choice(np.array([0, 1, 3, 7, 1 << 60], np.uint64), count)
    x, y, given_up = line_dedup._list_pairs(key, k1, n, pos, bits, num, den, most)
    pairs = {}
    for i in range(count):
        for j in range(i):
            a, b, differ = int(n[i]), int(n[j]), bin(int(bits[i]) ^ int(bits[j])).count("1")
            rest = min(a - int(pos[i]), b - int(pos[j]))
            if key[i] == key[j] and den * min(a, b) >= num * max(a, b) and (num + den) * rest >= num * (a + b) and (num + den) * differ <= (den - num) * (a + b):
                pairs.setdefault(int(key[i]), []).append(tuple(sorted((int(k1[i]), int(k1[j])))))
    long_ = {k for k, found in pairs.items() if len(found) > most * int((key == k).sum())}
    assert set(given_up.tolist()) == long_
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == sorted(p for k, found in pairs.items() if k not in long_ for p in found)


def test_a_task_sends_a_set_once(spark):
    text = "one two three\n" + "four five " * (line_dedup.TEXT_BYTES // 10 + 1)  # a run of its own
    docs = spark.createDataFrame([(text,)] * 20, "text string").coalesce(1)
    full = spark.sparkContext.broadcast(bytes([255]) * 64)
    assert sorted(len(r.words) for r in line_dedup.word_sets(docs, "text", full).collect()) == [2, 3]
