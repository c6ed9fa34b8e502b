"""The Merkle manifest against a plain recomputation of trees, proofs and roots."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    return h("".join(map(field, (row[0], row[3], row[2], row[4], text))))


def tree(nodes):
    """Digest of the top, and each node's siblings (left, right) upwards."""
    ways = [[] for _ in nodes]
    at, level = list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // 3 * 3:p // 3 * 3 + 3]
            ways[i].append((run[:p % 3], run[p % 3 + 1:]))
            at[i] = p // 3
        level = [h("".join(level[i:i + 3])) for i in range(0, len(level), 3)]
    return level[0], ways


def expected(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    tops, lower = [], {}
    for s in order:
        own = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        lower[s] = own, *tree([leaf_of(r, r[1]) for r in own])
        tops.append(lower[s][1])
    root, above = tree(tops) if tops else (None, [])
    out = []
    for s, up in zip(order, above):
        own, subroot, ways = lower[s]
        for r, way in zip(own, ways):
            way = way + up
            leaf = leaf_of(r, r[1])
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            acc = leaf_of(r, r[1].replace("\n", "")) if tampered else leaf
            for left, right in way:
                acc = h("".join(left) + acc + "".join(right))
            out.append((r[0], leaf, subroot, root, h("".join("".join(a + b) for a, b in way)), acc, acc == root))
    return Counter(out)


def table(seed, n, sources):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = None if rng.random() < 0.1 else "".join(rng.choice("ab\né ") for _ in range(rng.randint(0, 30)))
        rows.append((i * 7 % 1009, text, rng.choice([None, "de", ""]), rng.choice(sources), rng.choice([None, 3])))
    return rows


def write(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).withColumn("subroot", F.lit(1)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("rows", [
    [],
    [(5, "a\nb", None, None, 3)],
    [(1, "x", "en", "s", 1), (2, None, "en", "s", None)],
    table(1, 120, [None, "b", "é", "", "a"]) + [(7, "\n", "en", "only", 1), (None, "n", None, "b", 1), (None, "n", None, "b", 1)],
    table(2, 200, ["hot"] * 8 + [f"s{i}" for i in range(40)]) + [(3, "same", "en", "hot", 4)] * 30,
], ids=["empty", "one", "two", "groups", "hot"])
def test_query_equals_recomputation(spark, tmp_path, rows):
    found = queries.op11_merkle_manifest(spark, write(spark, tmp_path, rows))
    assert found.columns == COLUMNS
    assert Counter(tuple(r[c] for c in COLUMNS) for r in found.collect()) == expected(rows)


def test_columns_pass_through(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z")], "id long, g string, way string")
    df = df.selectExpr("*", "sha2('a', 256) AS proof", "1 AS pos", "2 AS group", "unhex(sha2(way, 256)) AS digest")
    found = merkle.prove(df, "g", "id", "digest")
    assert found.columns == ["id", "g", "way", "pos", "group", "digest", "subroot", "root", "proof"]
    assert found.where(merkle.fold(F.col("digest"), F.col("proof")) == F.col("root")).count() == 3
