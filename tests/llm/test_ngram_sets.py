"""The N-gram join keeps one full set of each node, however often its rows repeat."""

from __future__ import annotations

from ledgerlens.llm import ngram_join


def test_one_set_of_each_node(spark, monkeypatch):
    counted = {}
    keep = ngram_join.materialize

    def counting(df, name):
        out = keep(df, name)
        counted[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "materialize", counting)
    words = [f"w{i}" for i in range(100)]
    copy, near, far = " ".join(words), " ".join([*words[:99], "x"]), " ".join(f"z{i}" for i in range(100))
    rows = [(1, copy)] * 9 + [(2, copy)] * 3 + [(3, near)] * 4 + [(4, far)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.component_id) for r in ngram_join.similar_components(docs).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert counted["ngram-sets"] == 2 and counted["ngram-judged"] == 1
