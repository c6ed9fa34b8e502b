"""Quality classifier: a sparse ensemble of rules taken from trees.

A small random forest is grown on text statistics of the labelled documents;
every path from a root to a node is a conjunction of thresholds, a rule. A
lasso logistic regression over the rules keeps few of them, and those become
one Spark column expression over the statistics, so scoring runs without any
model object. Statistics are counted in one pass over each whole text.

All labelled training rows are used; the trees and the regression are Spark's.

Defined cases: a null text counts as empty (all statistics 0) and is scored;
rows without a label, or whose label has no document, teach nothing; with no
training rows every score is 0.5, with one class only the scores are that
class's; repeated rows count as often as they occur; extra columns are not
read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import text_bytes

TREES = 12
DEPTH = 3
LASSO = 0.002
SEED = 7
THRESHOLD = 0.3

_LOWER, _UPPER, _DIGITS = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_MARKS, _SYMBOLS = b".,;:?'\"()-", b"#*$%&|<>=@^~\\/{}[]+_`"


def _count(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def text_statistics(text: str | None) -> dict[str, float]:
    raw = text_bytes(text)
    words = raw.split()
    n = len(words)
    many = max(1, n)
    size = max(1, len(raw))
    kinds = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper = _count(raw, _UPPER)
    letters = max(1, upper + _count(raw, _LOWER))
    return {
        "words": float(n),
        "word_bytes": sum(map(len, words)) / many,
        "distinct": len(kinds) / many,
        "top_word": max(kinds.values(), default=0) / many,
        "equal_neighbours": sum(map(eq, words, words[1:])) / many,
        "symbols": _count(raw, _SYMBOLS) / many,
        "bangs": raw.count(b"!") / many,
        "upper": upper / letters,
        "digits": _count(raw, _DIGITS) / size,
        "marks": _count(raw, _MARKS) / many,
        "stops": (raw.count(b". ") + raw.count(b".\n")) / many,
        "lines": len(lines) / many,
        "equal_lines": 1 - len(set(lines)) / max(1, len(lines)),
    }


STATISTICS = list(text_statistics(""))


def statistics_column(text: Column | str) -> Column:
    """struct of all statistics of a text column."""

    @F.arrow_udf(", ".join(f"{s} double" for s in STATISTICS))
    def count(texts: pa.Array) -> pa.Array:
        rows = [text_statistics(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([r[s] for r in rows], pa.float64()) for s in STATISTICS], names=STATISTICS)

    return count(F.col(text) if isinstance(text, str) else text)


def with_statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and one column s_<name> per statistic."""
    found = df.select(*keep, statistics_column(text).alias("_s"))
    return found.select(*keep, *[F.col(f"_s.{s}").alias(f"s_{s}") for s in STATISTICS])


#: A threshold of a path: (statistic number, "<=" or ">", value).
Condition = tuple[int, str, float]
_LINE = re.compile(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)")


def paths(tree: str) -> list[tuple[Condition, ...]]:
    """All paths to nodes below the root, from a tree's printed form."""
    out, stack = [], []
    for line in tree.splitlines():
        if m := _LINE.match(line):
            depth = len(m[1])
            while stack and stack[-1][0] >= depth:
                stack.pop()
            stack.append((depth, (int(m[2]), m[3], float(m[4]))))
            out.append(_tightest(tuple(c for _, c in stack)))
    return out


def _tightest(path: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """One bound per statistic and side."""
    best: dict[tuple[int, str], float] = {}
    for f, side, value in path:
        old = best.get((f, side))
        best[f, side] = value if old is None else (min if side == "<=" else max)(old, value)
    return tuple(sorted((f, side, value) for (f, side), value in best.items()))


def rule_column(rule: tuple[Condition, ...], statistics: list[str]) -> Column:
    out = F.lit(True)
    for f, side, value in rule:
        c = F.col(statistics[f])
        out = out & ((c <= value) if side == "<=" else (c > value))
    return out


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[tuple[float, tuple[Condition, ...]]]
    statistics: list[str]

    def score(self) -> Column:
        """Probability of label 1 as a column expression over the statistics."""
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            total = total + F.when(rule_column(rule, self.statistics), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(train: DataFrame, label: str, statistics: list[str] | None = None, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleEnsemble:
    """Learn from rows with a label column (0 or 1) and the statistics. ``train``
    is read many times: it should be a table."""
    statistics = statistics or [f"s_{s}" for s in STATISTICS]
    classes = {int(r[0]): r[1] for r in train.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    if len(classes) < 2:
        always = 0.0 if not classes else (8.0 if 1 in classes else -8.0)
        return RuleEnsemble(always, [], statistics)
    rows = train.where(F.col(label).isin(0, 1)).select(F.col(label).cast("double").alias("label"), *statistics)
    vectors = rows.select("label", array_to_vector(F.array(*statistics)).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, cacheNodeIds=False).fit(vectors)
    rules = sorted({p for t in forest.trees for p in paths(t.toDebugString)})
    if not rules:
        odds = classes[1] / (classes[0] + classes[1])
        return RuleEnsemble(_logit(odds), [], statistics)
    held = rows.select("label", array_to_vector(F.array(*[rule_column(r, statistics).cast("double") for r in rules])).alias("features"))
    model = LogisticRegression(regParam=lasso, elasticNetParam=1.0, maxIter=40).fit(held)
    kept = [(float(w), r) for w, r in zip(model.coefficients.toArray(), rules, strict=True) if w]
    return RuleEnsemble(float(model.intercept), kept, statistics)


def _logit(p: float) -> float:
    import math

    return math.log(p / (1 - p))
