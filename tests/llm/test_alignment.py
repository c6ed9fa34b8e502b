"""Cross-tokenizer alignment against the libraries' own tokens, aligned plainly."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerlens.llm import alignment, queries

ALPHABET = "ab c  \n\t é中😀'sl123.,ﬁ▁½ \u0085 \x00\x1c"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.byte_vocabulary())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.piece_vocabulary())


def plain_tokens(libraries, text):
    """(id, bytes) of both tokenizers' tokens; none if they don't give the text."""
    a, b = libraries
    if not text:
        return [], []
    byte_of = {c: i for i, c in enumerate(alignment.byte_alphabet())}
    left = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else ([], [])


def plain_align(left, right):
    """Groups as text and all linked (a, b), token by token."""
    spans = []
    for side in (left, right):
        at, out = 0, []
        for i, raw in side:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        spans.append(out)
    links, j = [], 0
    for i, s, e in spans[0]:
        while j and spans[1][j][1] > s:
            j -= 1
        k = j
        while k < len(spans[1]) and spans[1][k][1] < e:
            if spans[1][k][2] > s:
                links.append((i, spans[1][k][0]))
            k += 1
        j = max(0, k - 1)
    cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
    groups = [[[], []] for _ in cuts]
    for side in (0, 1):
        g = 0
        for i, _, e in spans[side]:
            while e > cuts[g]:
                g += 1
            groups[g][side].append(str(i))
    return ";".join(",".join(a) + "|" + ",".join(b) for a, b in groups), links


def plain_query(libraries, rows):
    found = []
    docs = Counter()
    for d, text in rows:
        left, right = plain_tokens(libraries, text)
        groups, links = plain_align(left, right)
        docs.update(set(links))
        found.append((d, left, right, groups, links))
    best = defaultdict(int)
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    return Counter(
        (d, len(left), len(right), groups.count(";") + 1 if left else 0, len(links), sum(docs[x] == best[x[0]] for x in links), sum(docs[x] for x in links),
         hashlib.sha256(groups.encode()).hexdigest() if left else "")
        for d, left, right, groups, links in found
    )


def texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(200)] + ["don't", "<|endoftext|>", "</s>", "x▁y", "日本", "😀"]
    out = [None, "", " ", "a", "  two  blanks ", "x▁y z", "\n\n", "tab\tand\r\nline", "é́ à", "<s> <|endoftext|>", "z" * 3000, "a b " * 2000]
    out += ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return list(enumerate(out)) + [(None, "a null id"), (3, "a"), (3, "a")]


@pytest.mark.parametrize("head", [alignment.HEAD_PAIRS, 40, 0])
def test_query_against_the_libraries(spark, tmp_path, monkeypatch, libraries, head):
    rows = texts(head, 120)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    real = alignment.pair_table
    monkeypatch.setattr(alignment, "pair_table", lambda counts, vocab: real(counts, vocab, head))
    found = queries.op13_token_alignment(spark, str(tmp_path))
    assert found.columns == COLUMNS
    assert Counter(tuple(r) for r in found.collect()) == plain_query(libraries, rows)


def test_empty_table_and_columns_pass(spark):
    vocab = alignment.vocabularies(spark, queries.byte_vocabulary(), queries.piece_vocabulary())
    df = spark.createDataFrame([(1, "one two")], "id long, text string").selectExpr("*", "7 AS n_a", "8 AS row", "9 AS found", "1 AS at")
    got = alignment.align(df, vocab)
    assert got.columns[:5] == ["id", "text", "row", "found", "at"] and got.first().n_groups == 2
    rows = alignment.align(df.where("id > 1"), vocab)
    table = alignment.pair_table(alignment.pair_counts(rows, vocab), vocab)
    assert alignment.with_link_counts(rows, vocab, table).count() == 0


@pytest.fixture(scope="module")
def tok():
    return alignment.Tokenizers(open(queries.byte_vocabulary(), encoding="utf-8").read(), open(queries.piece_vocabulary(), "rb").read())


def test_blocks_and_library_give_the_same(tok, libraries, monkeypatch):
    """Long texts in blocks, whole texts without splitting, and the slower library."""
    cases = [t for _, t in texts(5, 60)] + [" ".join(["some words and ünits\n"] * 500)]
    want = [plain_align(*plain_tokens(libraries, t)) for t in cases]
    spec = open(queries.byte_vocabulary(), encoding="utf-8").read()
    other = alignment.Tokenizers(spec, open(queries.piece_vocabulary(), "rb").read())
    other.encode_a, other.splits = other._library(spec), False
    monkeypatch.setattr(alignment, "BLOCK", 300)
    monkeypatch.setattr(alignment, "CACHED", 50)
    for t in (tok, other):
        for (groups, links), x in zip(want, alignment.align_texts(t, cases), strict=True):
            row = x.row()
            assert row[4].decode() == groups and row[3] == len(links)
            codes, sizes = alignment._codes(alignment.pa.array([row[5]], alignment.pa.binary()), np.uint32)
            got = dict(zip(codes.tolist(), np.frombuffer(row[6], np.uint32).tolist()))
            assert got == Counter(a * len(tok.b_texts) + b for a, b in links)


def test_pieces_of_the_merge(tok):
    rng = np.random.default_rng(1)
    for n in (1, 5, 60, 400):
        ends = np.sort(rng.choice(np.arange(1, 3 * n), n, replace=False))
        a, b = (np.append(np.sort(rng.choice(ends, max(1, n // 2), replace=False)), 3 * n) for _ in range(2))
        whole = alignment.overlaps(a, b, 1 << 20)
        spans = lambda x: list(zip([0, *x[:-1]], x))
        brute = {(i, j) for i, (s, e) in enumerate(spans(a)) for j, (p, q) in enumerate(spans(b)) if s < q and p < e}
        assert len(whole[0]) == len(brute) and set(zip(whole[0].tolist(), whole[1].tolist())) == brute
        for piece in (1, 2, 3, 7):
            found = alignment.overlaps(a, b, piece)
            assert set(zip(found[0].tolist(), found[1].tolist())) == brute and len(found[0]) == len(brute)
            assert (a[found[2]] == b[found[3]]).all() and a[found[2]].tolist() == sorted(set(a) & set(b))


def test_ranked_needs_ids_in_merge_order(tok):
    tree = json.load(open(queries.byte_vocabulary(), encoding="utf-8"))
    tree["model"]["merges"][5], tree["model"]["merges"][9] = tree["model"]["merges"][9], tree["model"]["merges"][5]
    assert tok._ranked(tree) is None and tok.splits
