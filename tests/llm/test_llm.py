"""Operators of ledgerlens.llm against brute force on small fixtures, with
nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

from __future__ import annotations

import json
import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import bpe, chat, decontaminate, language, line_dedup, ngram_join, pii, quality_rules, rule_ensemble, warc
from ledgerlens.llm.components import components
from ledgerlens.llm.queries import ORACLE, QUERIES, piece_vocabulary, word_vocabulary

DOCS = "doc_id long, text string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def corpus(seed=1):
    """Templates, edited copies, repeated and shared lines, odd texts."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    shared = " ".join(rng.choice(vocab) for _ in range(25))
    texts = [None, "", "  \n\t", "one", "One two", "ONE two", "x y z " * 300]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 160))]
        for edits in (0, 0, 1, 1, 2, 3, 5, 8, 20):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            lines = [" ".join(words[i:i + 20]) for i in range(0, len(words), 20)]
            if rng.random() < 0.4:
                lines.insert(rng.randrange(len(lines)), shared)
            texts.append("\n".join(lines))
    rows = list(enumerate(texts))
    return rows + [rows[10], (None, texts[11]), (None, None)]


def rows_of(spark, rows=None, extra=False):
    df = spark.createDataFrame(corpus() if rows is None else rows, DOCS)
    if extra:
        df = df.selectExpr("*", "'k' AS keys", "1 AS n", "2 AS td", "'x' AS spans")
    return df


def by_id(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_bpe_matches_the_library(spark):
    from tokenizers import Tokenizer

    path = word_vocabulary()
    library = Tokenizer.from_file(path)
    encoder = bpe.Encoder(json.load(open(path, encoding="utf-8")))
    rng = random.Random(2)
    letters = "abcdeéèßİΣςσ人中😀 'stLLve<|endoftext|>​123½\t\n\x00\x85\xa0-_ﬁ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += ["a" * 5000, "<|endoftext|>x<|startoftext|>", "I'LL don't"] + [t for _, t in corpus() if t]
    for t in texts:
        assert encoder.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", *texts[-20:]])], DOCS).selectExpr("*", "'old' AS ids")
    for r in bpe.decode(bpe.encode(docs, path), path).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_pii_base_spans_match_patterns():
    def keep(kind, s):
        digits = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": all(int(p) <= 255 for p in s.split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits or "1"), "phone": 9 <= len(digits) <= 15}[kind]

    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("ab1234567890..@@+-( )%_é 4") for _ in range(rng.randint(0, 40)))
        for kind, pattern in PATTERNS.items():
            assert pii.DETECTORS[kind](t) == [m.span() for m in re.finditer(pattern, t) if keep(kind, m[0])]


@pytest.mark.parametrize("text, kind, span", [
    ("to john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
    ("mail john at mail dot example dot com", "email", "john at mail dot example dot com"),
    ("jоhn@ехаmple.com x", "email", "jоhn@ехаmple.com"),
    ("+１ ２１２ ５５５ ０１５３ yes", "phone", "+１ ２１２ ５５５ ０１５３"),
    ("card four" + " one" * 15, "card", "four" + " one" * 15),
    ("ip 10 dot 0 dot 0 dot 1 z", "ip", "10 dot 0 dot 0 dot 1"),
])
def test_pii_disguises(text, kind, span):
    assert (kind, span, False) in [(k, text[s:e], b) for k, s, e, b in pii.scan(text)]


def test_pii_column(spark):
    docs = rows_of(spark, [(1, None), (2, ""), (3, "a@b.com at the dot"), (3, "a@b.com at the dot"), (4, "x" * 50_000)], extra=True)
    found = {(r.doc_id, len(r.pii)) for r in pii.find_pii(docs).collect()}
    assert found == {(1, 0), (2, 0), (3, 1), (4, 0)}


def test_language(spark):
    rng = random.Random(4)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(40))
    a, b = ["the", "ing", "tion", "er"], ["eau", "oux", "ais", "que"]
    train = spark.createDataFrame([(make(a), "en") for _ in range(20)] + [(make(b), "fr") for _ in range(20)] + [(None, "en"), ("x", None)], "text string, lang string")
    model = language.fit(train, piece_vocabulary())
    docs = rows_of(spark, [(1, make(a)), (2, make(b)), (3, None), (4, "12 !!"), (5, "z" * 20_000)], extra=True)
    found = {r.doc_id: (r.lang_pred, r.lang_score) for r in language.identify(docs, model).collect()}
    assert found[1][0] == "en" and found[2][0] == "fr" and found[3] == found[4] == ("und", 0.0) and 0 <= found[5][1] <= 1
    none = language.fit(train.limit(0), piece_vocabulary())
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}


def test_segmentations_are_summed():
    pieces = language.Pieces(["a", "b", "ab"])
    probs = np.array([[0.2], [0.3], [0.4], [0.1], [0.0]])
    assert np.exp(language.word_logs(pieces, probs, ["ab", "aab", "c"]))[:, 0] == pytest.approx([0.2 * 0.3 + 0.4, 0.2 * 0.46, 0.1])
    counts = language.expected_counts(pieces, probs[:, 0], ["ab"], np.array([2.0]))
    assert counts[:3] == pytest.approx([2 * 0.06 / 0.46, 2 * 0.06 / 0.46, 2 * 0.4 / 0.46])


def test_chat_keeps_maximal_conversations(spark):
    turns = ["q1", "a1", "q2", "a2"]
    rows = [(1, i, "user", t) for i, t in enumerate(turns)] + [(2, i, "user", t) for i, t in enumerate(turns[:2])]
    rows += [(3, i, "user", t) for i, t in enumerate(turns)] + [(4, 0, "user", "q1"), (4, 1, "user", "other"), (4, 1, "user", "other")]
    rows += [(5, None, None, None), (None, 0, "user", "q9")] + [(6, i, "user", f"t{i}") for i in range(200)] + [(7, i, "user", f"t{i}") for i in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part")
    found = chat.format_chats(df).collect()
    assert {r.conv_id for r in found} == {1, 4, 5, None, 6}
    whole = "".join(r.text for r in sorted((r for r in found if r.conv_id == 6), key=lambda r: r.part))
    assert whole == "".join(f"<|im_start|>user\nt{i}<|im_end|>\n" for i in range(200))
    assert chat.format_chats(df.limit(0)).count() == 0


def test_warc_audit_finds_damage(spark):
    pages = [(i, f"http://h/{i}", f"<p>{i}</p>" * (1 + i % 7)) for i in range(400)] + [(5, "http://h/5", "<p>5</p>" * 6), (None, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS offset")
    assert warc.audit(df, df).count() == 0
    assert warc.audit(df.limit(0), df.limit(0)).count() == 0
    found = {(r.page_id, r.status) for r in warc.audit(df, warc.damaged_replica(df)).collect() if r.status != "moved"}
    expected = {(i, s) for h in range(0, 400, 100) for i, s in ((h + 1, "changed"), (h + 2, "changed"), (h + 3, "missing"), (h + 4 + 1_000_000_000, "extra"))}
    assert found == expected


def test_quality_statistics(spark):
    rng = random.Random(5)
    texts = [None, "", "\n \n"] + ["".join(rng.choice(["a ", "b ", "a\n", "#", "c! ", "a b a\n"]) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    got = {r.doc_id: r for r in quality_rules.statistics(rows_of(spark, list(enumerate(texts)), extra=True)).collect()}
    for i, t in enumerate(texts):
        words = SPACE.findall(t or "")
        count = Counter(zip(words, words[1:], words[2:]))
        cover = {k + j for k in range(len(words) - 2) if count[tuple(words[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if SPACE.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))
    model = quality_rules.estimate([((-1, 0), 10), ((0, 1), 80), ((-1, 1), 2)])
    assert all(0.5 < a < 1 for a in model.accuracy)
    assert quality_rules.judge(quality_rules.statistics(rows_of(spark, []))).count() == 0


def test_decontamination(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([30, 20, 13, 5, 14])] + [(9, None), (None, "q1 q2 q3"), (3, "solo")]
    docs = corpus()[:20] + [(100, "x " + items[0][1].upper() + " y"), (101, "a, " + items[3][1].replace(" ", "; ") + "."), (102, " ".join(items[1][1].split()[:15])), (103, "solo q1 q2 q3 " * 3)]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))

    def brute(text):
        doc, hit, ids = split(text), set(), set()
        for key, body in items:
            w = split(body)
            for win in ([w] if len(w) <= 13 else [w[k:k + 13] for k in range(len(w) - 12)]) if w else []:
                for p in range(len(doc) - len(win) + 1):
                    if doc[p:p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        ids |= {key} - {None}
        return len(doc), len(hit), tuple(sorted(ids)), bool(hit) and 20 * len(hit) >= len(doc)

    expected = Counter((i, *brute(t)) for i, t in docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (decontaminate.BLOCK_BYTES, 200):
        found = decontaminate.contamination(rows_of(spark, docs, extra=True), bench, block_bytes=size)
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in found.collect()) == expected
    assert decontaminate.contamination(rows_of(spark, docs), bench.limit(0)).where("contaminated").count() == 0


def test_ngram_join_matches_brute_force(spark):
    rows = corpus(7)

    def shingles(t):
        w = SPACE.findall(lower(t or ""))
        return frozenset(tuple(w[i:i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 90 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    expected = Counter((k, len(s), least.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets)))
    assert len(set(least.values())) < len(least) + 1 and any(k != c for k, _, c in expected if k is not None)
    found = ngram_join.similar_components(rows_of(spark, rows, extra=True))
    assert by_id(found, "doc_id", "n_shingles", "component_id") == expected
    kept = ngram_join.one_per_component(rows_of(spark, rows))
    assert {r.doc_id for r in kept.collect()} - {None} == {c for _, _, c in expected} - {None}
    assert ngram_join.similar_components(rows_of(spark, [])).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(30)] + [("z1", "z2")], "u string, v string")
    assert {(r.node, r.label) for r in components(links).collect()} == {(f"n{i:02}", "n00") for i in range(31)} | {("z1", "z1"), ("z2", "z1")}


@pytest.mark.parametrize("limit, long_list", [(250, 256), (2, 4)])
def test_line_dedup_matches_brute_force(spark, monkeypatch, limit, long_list):
    monkeypatch.setattr(line_dedup, "LIST_LIMIT", limit)
    monkeypatch.setattr(line_dedup, "LONG_LIST", long_list)
    rows = [r for r in corpus(8) if r[0] is not None]
    lines = [(key, i, frozenset(SPACE.findall(lower(x)))) for key, t in sorted(set(rows), key=lambda r: r[0]) if t for i, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= line_dedup.LEAST_WORDS]
    gone = set()
    for n, (key, i, s) in enumerate(lines):
        if any(100 * len(s & o) >= 80 * len(s | o) for _, _, o in lines[:n]):
            gone.add((key, i))
    expected = Counter((k, t and "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone)) for k, t in rows)
    found = line_dedup.remove_repeated_lines(rows_of(spark, rows, extra=True))
    assert by_id(found, "doc_id", "text") == expected and len(gone) > 50
    assert line_dedup.remove_repeated_lines(rows_of(spark, [])).count() == 0


def test_rule_ensemble(spark):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta."]) for _ in range(50))
    bad = lambda: " ".join(rng.choice(["a|", "b#", "c$"]) for _ in range(50))
    texts = [(i, good() if i % 2 else bad()) for i in range(120)] + [(200, None), (201, "")]
    stats = rule_ensemble.with_statistics(rows_of(spark, texts, extra=True))
    train = stats.where("doc_id < 120").selectExpr("*", "CAST(doc_id % 2 AS int) AS quality").cache()
    model = rule_ensemble.fit(train, "quality")
    scores = {r.doc_id: r.s for r in stats.select("doc_id", model.score().alias("s")).collect()}
    assert all((scores[i] > 0.5) == bool(i % 2) for i in range(120)) and 0 <= scores[200] == scores[201] <= 1
    assert model.rules and all(w for w, _ in model.rules)
    assert rule_ensemble.fit(train.limit(0), "quality").score() is not None
    assert stats.select(rule_ensemble.fit(train.limit(0), "quality").score().alias("s")).first().s == 0.5


def test_queries_are_registered():
    assert [q for n in range(1, 11) for q in QUERIES if q.startswith(f"op{n}_")] == list(QUERIES)
    assert set(ORACLE) <= set(QUERIES)
