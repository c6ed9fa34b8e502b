"""The line dedup's workers hold the arrays of a small run of texts at a time."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from ledgerlens.llm import common, line_dedup


def texts() -> list[str]:
    rng = random.Random(5)
    return ["\n".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(8)) for _ in range(40)) for _ in range(3000)]


def test_words_of_many_texts_take_little_memory():
    many = texts()
    list(line_dedup._line_words(many[:10]))  # tables of powers are kept
    tracemalloc.start()
    try:
        lines = sum(len(line) for _f, _l, _d, line, _v, _o in line_dedup._line_words(many))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert lines == 3000 * 40
    assert peak < 30 << 20, peak


def test_runs_hold_every_text_once():
    many = [None, "", *texts(), "é" * (1 << 20), None]
    runs = list(line_dedup._runs(pa.array(many)))
    assert [t for _, part in runs for t in part] == many
    assert [at for at, _ in runs] == [0, *np.cumsum([len(part) for _, part in runs])[:-1]]


def test_tables_of_another_operator_are_dropped():
    common.worker_object("other", type("Shared", (), {"value": 1, "_path": "x"})(), lambda v: bytes(v))
    assert common._BUILT
    common.drop_worker_objects()
    assert not common._BUILT
