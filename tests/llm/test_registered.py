"""Queries without SQL as they are registered, and the pipeline's stages, against
plain Python on a small fixture."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from ledgerlens.llm import language, ngram_join, quality_rules, queries, rule_ensemble

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DE = "der die das und nicht ein haus garten strasse kinder spielen heute morgen wasser schule wir gehen über grün schön".split()
EN = "the and not a house garden street children play today morning water school we go over green nice with under".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def remainder(doc_id, modulus):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def documents():
    rng = random.Random(8)
    rows = []
    for i in range(160):
        lang, words = ("de", DE) if i % 2 else ("en", EN)
        text = " ".join(rng.choice(words) for _ in range(rng.randint(8, 140))).capitalize()
        if i % 10 == 3:
            text = re.sub(r" (\w+) ", r" \1. ", text, count=6) + f".\nMail me at user{i}@mail.example.org or 10.0.{i}.7, call +49 (30) 1234567{i % 10}."
        if i % 16 == 5:
            text = "## $$ || " * 40 + text
        if i % 20 == 7:
            text = "buy now! " * 60
        rows.append((i, text, lang if i % 7 else None, f"src{i % 3}"))
    texts = [None, "", "  \n\t", "½ ② 12", "1", "Über", "x" * 60_000, "4111 1111 1111 1111 and 999.1.1.1 or 1.2.3.4", "same line here\n" * 30]
    rows += [(1000 + k, t, "en", None) for k, t in enumerate(texts)] + [(3, rows[3][1], "de", "src0"), (None, rows[5][1], "en", "src1")]
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(d, None if d % 11 == 0 else int(not (d % 16 == 5 or d % 20 == 7)), 0) for d, *_ in rows if d is not None and d < 160]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    items = [(1, " ".join(EN[:15])), (2, None), (3, "word")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def counted(rows, *columns):
    return Counter(tuple(r[c] for c in columns) for r in rows)


def test_op1(spark, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.word_vocabulary())
    library.no_truncation(), library.no_padding()
    want = Counter()
    for d, t, *_ in documents():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    found = queries.op1_bpe(spark, folder)
    assert found.dtypes[:4] == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert counted(found.collect(), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub(r"\D", "", s)) <= 19 and luhn(re.sub(r"\D", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15),
}


def luhn(digits):
    doubled = [sum(divmod(2 * int(x), 10)) if k % 2 else int(x) for k, x in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def test_op3(spark, folder):
    want, spans = Counter(), {}
    for d, t, *_ in documents():
        hits = {k: [m.span() for m in re.finditer(p, t or "") if good(m[0])] for k, (p, good) in BASE.items()}
        listed = ",".join(f"{k}:{s}:{e}" for k in BASE for s, e in hits[k])
        want[(d, *(len(hits[k]) for k in BASE), sha(listed))] += 1
        spans[d] = set(filter(None, listed.split(",")))
    assert sum(n for key, n in want.items() if any(key[1:5])) > 15
    found = queries.op3_pii(spark, folder)
    assert [t for _, t in found.dtypes[:7]] == ["bigint"] * 5 + ["string"] * 2
    rows = found.collect()
    assert counted(rows, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want
    assert all(spans[r.doc_id] <= set(r.spans.split(",")) for r in rows if r.doc_id not in (None, 3))


def test_op4(spark, folder):
    found = queries.op4_language(spark, folder)
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    rows = found.collect()
    given = {d: (t, lang) for d, t, lang, *_ in documents()}
    assert len(rows) == len(documents())
    train = [(t, lang) for d, t, lang, *_ in documents() if remainder(d, 4) != 2]
    model = language.fit(spark.createDataFrame(train, "text string, lang string"), queries.piece_vocabulary())
    pieces = language.Pieces(model.pieces)
    for r in rows:
        text, lang = given[r.doc_id]
        assert r.held_out == (remainder(r.doc_id, 4) == 2)
        words = language.words_of(text)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) == (not words)
        if words:
            total = language.word_logs(pieces, model.probs, words).sum(axis=0)
            post = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
            assert r.score == pytest.approx(post.max(), rel=1e-6) and r.lang_pred == model.languages[post.argmax()]
        if r.doc_id is not None and r.doc_id < 160 and r.doc_id % 20 != 7:
            assert r.lang_pred == ("de" if r.doc_id % 2 else "en")


def plain_counts(text):
    words = WORD.findall(text or "")
    chars = sum(map(len, words))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), chars, sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def plain_em(patterns, rounds):
    """Accuracies of rules and posteriors of vote patterns, as two plain steps."""
    accuracy = [quality_rules.FIRST_ACCURACY] * len(patterns[0])
    for _ in range(rounds):
        good = [posterior(p, accuracy) for p in patterns]
        for j in range(len(accuracy)):
            cast = [(p[j], g) for p, g in zip(patterns, good) if p[j]]
            if cast:
                share = sum(g if v > 0 else 1 - g for v, g in cast) / len(cast)
                accuracy[j] = min(quality_rules.MOST_ACCURACY, max(quality_rules.LEAST_ACCURACY, share))
    return accuracy


def posterior(pattern, accuracy):
    odds = math.prod((a / (1 - a)) ** v for v, a in zip(pattern, accuracy))
    return odds / (1 + odds)


def test_op7(spark, folder):
    found = queries.op7_quality_rules(spark, folder)
    rows = found.collect()
    assert [t for _, t in found.dtypes[:8]] == ["bigint"] * 6 + ["boolean"] * 2
    want = Counter((d, *plain_counts(t)) for d, t, *_ in documents())
    assert counted(rows, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    stats = quality_rules.statistics(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    votes = stats.select("doc_id", *[r.vote() for r in quality_rules.default_rules()]).collect()
    accuracy = plain_em([tuple(v[1:]) for v in votes], quality_rules.ROUNDS)
    by_id = {v.doc_id: posterior(tuple(v[1:]), accuracy) for v in votes}
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.p_good == pytest.approx(by_id[r.doc_id], rel=1e-6)
        assert r.kept == (not r.base_failed and r.p_good >= quality_rules.KEEP_AT)
    assert {r.kept for r in rows} == {True, False}


def test_op10(spark, folder, monkeypatch):
    models, real = [], rule_ensemble.fit
    monkeypatch.setattr(rule_ensemble, "fit", lambda *a, **kw: models.append(real(*a, **kw)) or models[-1])
    found = queries.op10_quality_classifier(spark, folder)
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = found.collect()
    assert len(rows) == len(documents())
    # The fitted rules, walked one by one over plain statistics.
    (model,) = models
    assert model.rules
    texts = {d: t for d, t, *_ in documents()}
    hits = []
    for r in rows:
        s = rule_ensemble.text_statistics(texts[r.doc_id])
        values = [s[name.removeprefix("s_")] for name in model.statistics]
        total = model.intercept + sum(w for w, rule in model.rules if all(values[f] <= v if side == "<=" else values[f] > v for f, side, v in rule))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6)
        assert r.held_out == (remainder(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.3)
        if r.held_out and r.doc_id < 160:
            hits.append(r.predicted == int(not (r.doc_id % 16 == 5 or r.doc_id % 20 == 7)))
    assert np.mean(hits) > 0.9


CLASHES = ["_found", "_removed", "_cut", "_suspect", "_own_td", "_id", "_td", "_gone", "_m", "_d", "_n", "n_words", "item_ids", "contaminated", "hit_spans", "keys", "n", "td", "_aside0", "_decoded"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(documents(), SCHEMA)
    return df.selectExpr("*", *[f"concat('k', coalesce(doc_id, -1)) AS {c}" for c in CLASHES])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_and_take_empty_tables(spark, folder, odd, name, stage):
    found = stage(spark, odd, folder)
    own = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"] if name == "bpe" else []
    assert found.columns == odd.columns + own
    rows = found.collect()
    assert all(r[c] == f"k{-1 if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHES)
    assert {r.doc_id for r in rows} <= {d for d, *_ in documents()} and len(rows) > 40
    empty = stage(spark, odd.where("false"), folder)
    assert empty.columns == odd.columns + own and empty.count() == 0


def test_encode_replaces_columns_of_its_names(spark, folder):
    df = spark.createDataFrame([(1, "a", "x", "y"), (2, None, "x", "y")], "doc_id long, text string, ids string, n_tokens string")
    got = {r.doc_id: r for r in corpus_pipeline.encode(spark, df, folder).collect()}
    assert got[1].n_tokens == 1 and got[2].ids == [] and got[2].decoded_sha256 == sha("")


def plain_pipeline(model):
    """The stages on lists of (doc_id, text), by their definitions."""
    pieces = language.Pieces(model.pieces)
    rows = []
    for d, t, *_ in documents():
        words = language.words_of(t)
        if words:
            total = language.word_logs(pieces, model.probs, words).sum(axis=0)
            if 1 / np.exp(total - total.max()).sum() > corpus_pipeline.LEAST_LANGUAGE_SCORE:
                rows.append((d, t))
    # Lines: a later one goes if it resembles an earlier one's words by 0.8 or more.
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    order = sorted({(d is not None, d or 0, t): (d, t) for d, t in rows}.items())
    firsts, gone = [], set()
    for _, (d, t) in order:
        for i, line in enumerate(t.split("\n")):
            s = frozenset(WORD.findall(line.translate(lower)))
            if not s:
                continue
            if any(len(s & o) >= 0.8 * len(s | o) for o in firsts):
                gone.add((d, t, i))
            firsts.append(s)
    cut = []
    for d, t in rows:
        lines = [x for i, x in enumerate(t.split("\n")) if (d, t, i) not in gone]
        new = "\n".join(lines)
        if len(lines) == t.count("\n") + 1 or WORD.search(new):
            cut.append((d, new))
    # Near copies by links of 3-word sets at 0.9, the smallest id of a component stays.
    sets = []
    for d, t in cut:
        w = WORD.findall(t.translate(lower))
        sets.append(frozenset(tuple(w[i:i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else []))
    label = list(range(len(cut)))
    for i in range(len(cut)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (d, _), k in zip(cut, label):
        if d is not None:
            least[k] = min(d, least.get(k, d))
    kept = [(d, t) for (d, t), k, s in zip(cut, label, sets) if not s or least.get(k, d) == d]
    # Benchmark windows.
    bword = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = [tuple(EN[i:i + 13]) for i in range(3)] + [("word",)]
    out = []
    for d, t in kept:
        w = bword.findall(t.translate(lower))
        hit = {i + k for x in windows for i in range(len(w) - len(x) + 1) if tuple(w[i:i + len(x)]) == x for k in range(len(x))}
        if not hit or 20 * len(hit) < len(w):
            out.append((d, t))
    return Counter(out)


def test_run_against_the_stages_definitions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.fit(docs, queries.piece_vocabulary())
    found = corpus_pipeline.run(spark, folder)
    rows = found.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == plain_pipeline(model)
    assert all(r.n_tokens == len(r.ids) for r in rows)


def test_near_copies_without_ids_clash(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, None)], "doc_id long, text string").selectExpr("*", "1 AS _td", "2 AS _suspect")
    assert sorted(tuple(r) for r in ngram_join.one_per_component(df).collect()) == [(1, "a b c d e f g h", 1, 2), (3, None, 1, 2)]
