"""Language-model scoring: counts and unigram scores against plain Python, the
model's probabilities against its definition, and its use on held-out texts."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import log_bilinear as lb
from ledgerlens.llm import queries
from ledgerlens.llm.common import Tally

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def sentences(seed, n):
    """Two languages of made-up words; each word limits the next."""
    rng = random.Random(seed)
    langs = [["".join(rng.choice(a) for _ in range(rng.randint(2, 6))) for _ in range(60)] for a in ("abcdé", "stuvwx")]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "One\x0btwo  ONE"), (None, "one Ünseen"), (6, "new-word " * 3), (6, "new-word " * 3), (7, "x" * 70_000)]
    for i in range(n):
        words, k = rng.choice(langs), rng.randrange(60)
        out = []
        for _ in range(rng.randint(5, 120)):
            k = (k * 7 + rng.randrange(3)) % 60
            out.append(words[k] if rng.random() < 0.95 else f"n{rng.randrange(10**6)}")
        rows.append((10 + i, " ".join(out)))
    return rows


def write(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def unigram(rows):
    counts = Counter(w for d, t in rows if not held(d) for w in [*words_of(t), ""])
    return counts, sum(counts.values()), len(counts)


def test_query_against_plain_counts(spark, tmp_path):
    rows = sentences(1, 4000)
    found = queries.op12_lm_scoring(spark, write(spark, tmp_path, rows))
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    counts, n, v = unigram(rows)
    expected = {}
    for d, t in rows:
        toks = [*words_of(t), ""]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks)
        expected.setdefault(d, []).append((held(d), len(toks), sum(counts[w] > 0 for w in toks), n, base))
    got = found.collect()
    assert len(got) == len(rows)
    gain = []
    for r in got:
        e = expected[r.doc_id][0]
        assert tuple(r)[1:5] == e[:4] and r.base_score == pytest.approx(e[4], rel=1e-9)
        assert r.score < 0
        if r.held_out and r.n_tokens > 5:
            gain.append((r.score - r.base_score) / r.n_tokens)
    assert np.mean(gain) > 0.1


@pytest.mark.parametrize("head", [1 << 20, 20, 0])
def test_model_is_normalised_and_scores_follow(spark, head):
    rows = sentences(2, 150)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS h", "2 AS n_tokens", "'r' AS row", "3 AS at")
    model = lb.fit(docs.where("doc_id < 100"), head_words=head, rounds=2)
    p, lex = model.params, model.lexicon
    train = [(d, t) for d, t in rows if d is not None and d < 100]
    counts = Counter(w for _, t in train for w in [*words_of(t), ""])
    assert (lex.n, lex.v) == (sum(counts.values()), len(counts)) and len(lex.hashes) <= head + 1
    targets = [w for w, _ in sorted(((w, c) for w, c in counts.items() if w), key=lambda x: -x[1])] if head > 1000 else None
    # All targets of a context add up to one.
    for one, two in ((0, 0), (1, 0), (5, 3), (lb.MODEL_IDS - 1, 700)):
        s = (p.context[one] * p.position[0] + p.context[two] * p.position[1]) @ p.target.T + p.bias
        assert np.exp(s - model.logs[two, one]).sum() == pytest.approx(1, abs=1e-4)
    assert targets is None or (lex.ids <= lb.MODEL_WORDS).sum() == min(len(targets), lb.MODEL_WORDS) + 1
    # The words of a class and the one that training never met add up to one.
    def ids_of(word):
        h, k, _ = lb.tokens([word])
        return int(lex.model_ids(h[:1], k[:1])[0])

    by_id = {w: ids_of(w) if w else 0 for w in counts}
    shares = Counter()
    for w, i in by_id.items():
        if i > lb.MODEL_WORDS:
            shares[i] += (counts[w] + 0.5) / (lex.mass[i] + 0.5 * (lex.types[i] + 1))
    for i, total in shares.items():
        assert total + 0.5 / (lex.mass[i] + 0.5 * (lex.types[i] + 1)) == pytest.approx(1)
    # Scores from the definition.
    found = lb.score(docs, model).collect()
    assert set(found[0].asDict()) == {"doc_id", "text", "h", "row", "at", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    for r in found:
        toks = [*words_of(r.text), ""]
        one = two = 0
        total = 0.0
        for w in toks:
            i = ids_of(w) if w else 0
            s = (p.context[one] * p.position[0] + p.context[two] * p.position[1]) @ p.target.T + p.bias
            total += (s[i] - np.log(np.exp(s.astype(float)).sum())) / math.log(10)
            if i > lb.MODEL_WORDS:
                total += math.log10((counts[w] + 0.5) / (lex.mass[i] + 0.5 * (lex.types[i] + 1)))
            one, two = i, one
        assert r.score == pytest.approx(total, rel=1e-3, abs=1e-3)
        assert r.n_known == sum(counts[w] > 0 for w in toks)


def test_without_training_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = lb.fit(empty)
    assert lb.score(empty, model).count() == 0
    got = lb.score(spark.createDataFrame([(1, "a b")], SCHEMA), model).first()
    assert (got.n_tokens, got.n_known, got.train_tokens) == (3, 0, 0) and got.base_score == 0 and got.score < 0


def test_tasks_are_averaged_in_groups(spark, monkeypatch):
    monkeypatch.setattr(lb, "FAN", 2)
    docs = spark.createDataFrame(sentences(3, 60), SCHEMA).repartition(7)
    model = lb.fit(docs, rounds=1)
    assert np.isfinite(model.params.flat()).all() and np.isfinite(model.logs).all()


def test_tally_merges_within_its_limit():
    rng, tally, want, got = np.random.default_rng(1), Tally(50), Counter(), Counter()
    for _ in range(40):
        keys = rng.integers(0, 200, 30)
        want.update(keys.tolist())
        if tally.add(keys, np.ones(30, np.int64), keys * 2):
            k, c, m = tally.take()
            assert (m == k * 2).all()
            got.update(dict(zip(k.tolist(), c.tolist())))
    k, c, _ = tally.take()
    got.update(dict(zip(k.tolist(), c.tolist())))
    assert got == want and tally.take() == ()
