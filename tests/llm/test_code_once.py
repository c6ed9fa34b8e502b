"""Texts are encoded once, in pieces, and workers keep bounded tables."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from ledgerlens.llm import bpe, language
from ledgerlens.llm.queries import word_vocabulary

TEXTS = [None, "", "a", "One two  three\nfour.", "äöü ﬁ 漢字 🙂", "<unk> x", "word " * 400]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_code_is_encode_and_decode(spark, monkeypatch):
    monkeypatch.setattr(bpe, "TEXT_BYTES", 8)
    docs = spark.createDataFrame([(i, t, [i]) for i, t in enumerate(TEXTS + TEXTS)], "doc_id long, text string, `Ids` array<long>").repartition(1)
    both = bpe.decode(bpe.encode(docs.select("doc_id", "text"), word_vocabulary()), word_vocabulary())
    want = {(r.doc_id, r.text, tuple(r.ids), r.decoded) for r in both.collect()}
    coded = bpe.code(docs, word_vocabulary())
    assert coded.columns == ["doc_id", "text", "ids", "decoded"]
    got = [(r.doc_id, r.text, tuple(r.ids), r.decoded) for r in coded.collect()]
    assert len(got) == 2 * len(TEXTS) and set(got) == want


def test_each_text_is_encoded_once(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert "encode(" not in _plan(corpus_pipeline.encode(spark, docs, ""))


def test_scored_words_are_bounded(monkeypatch):
    monkeypatch.setattr(language, "CACHED", 50)
    texts = ["a", "b", "ab", "ba"]
    probs = np.vstack([np.full((5, 2), 0.1), np.zeros((1, 2))])
    probs[1] = 0.2, 0.3
    scores = language.WordScores(texts, probs)
    rng, seen = np.random.default_rng(3), set()
    for _ in range(200):
        words = ["".join(rng.choice(["a", "b"], rng.integers(1, 9))) for _ in range(20)]
        seen.update(words)
        got = scores.sums([words, [], words[:3]])
        each = language.word_logs(scores.pieces, probs, words)
        assert np.allclose(got, [each.sum(axis=0), np.zeros(2), each[:3].sum(axis=0)])
        assert len(scores.rows) + len(scores.older) <= 100
    assert len(seen) > 100


def test_words_met_again_are_not_scored_again(monkeypatch):
    monkeypatch.setattr(language, "CACHED", 4)
    scores = language.WordScores(["a", "b"], np.vstack([np.full((3, 1), 0.1), np.zeros((1, 1))]))
    scores.sums([["a", "b", "ab"]])
    scores.sums([["ba", "bb"]])  # the first three grow old
    before, scored = language.word_logs, []
    monkeypatch.setattr(language, "word_logs", lambda pieces, probs, words: scored.extend(words) or before(pieces, probs, words))
    assert np.allclose(scores.sums([["ab"]]), 2 * np.log(0.1))
    assert not scored


def test_ids_are_laid_end_to_end():
    class Spelled:
        def encode(self, text):
            return np.array([ord(c) for c in text or ""], np.int32)

    assert bpe._id_lists(Spelled(), iter(["ab", None, "", "c"])).to_pylist() == [[97, 98], [], [], [99]]
    assert bpe._id_lists(Spelled(), iter([])).type == pa.list_(pa.int32())
