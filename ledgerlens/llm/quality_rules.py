"""Quality rules combined by weak supervision, in DataFrame operations only.

Each rule looks at one statistic of a document and votes bad (-1) or good (1)
where its condition holds, else abstains (0). Detectors of one kind of junk
only ever vote bad, since the absence of one kind says little about the
others; rules that recognise plain running text only ever vote good. Nobody
says how far a rule can be trusted: expectation-maximisation estimates each
rule's accuracy, the chance that its vote is right, from how the rules agree
and clash over the corpus. The posterior probability of being good replaces
the all-must-pass filter; a document is kept if it is at least ``KEEP_AT``,
so one on which every rule abstains stays.

The corpus is summarised as the number of documents per vote pattern, at most
3 to the power of the number of rules (``MAX_PATTERNS``), whatever its size;
EM runs over that table.

Statistics per document (null text counts as empty): words are runs of
characters other than blank, tab, line feed, vertical tab, form feed and
carriage return. Three-word windows are compared by 64-bit hashes within one
document. Nothing is exploded or shuffled: arrays are handled inside the row.

Defined cases: a document without words has all counts 0 and every rule
abstains; an empty table gives an empty result; extra columns
are not read; repeated rows are judged alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP_AT = 0.5
MAX_PATTERNS = 3 ** 10
ROUNDS = 60
#: Accuracy of every rule before the first round, and the bounds of estimates.
FIRST_ACCURACY = 0.9
LEAST_ACCURACY, MOST_ACCURACY = 0.55, 0.99
SPACE_CHARS = [" ", "\t", "\n", "\x0b", "\f", "\r"]
SYMBOLS = "#*$%&|<>"
WINDOW = 3


def _without(text: Column, chars) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _count(text: Column, chars) -> Column:
    return (F.length(text) - F.length(_without(text, chars))).cast("long")


def _occurrences(text: Column, strings: list[str]) -> Column:
    return sum((F.length(text) - F.length(F.replace(text, F.lit(x), F.lit("")))) / len(x) for x in strings).cast("long")


def statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of ``df`` and each document's counts."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = df.select(*keep, whole.alias("_text"))
    word = F.split("_text", "[\\x20\\x09-\\x0D]+")
    line = F.split("_text", "\n")
    first = base.select(
        *keep,
        F.filter(word, lambda w: w != "").alias("_words"),
        F.filter(line, lambda x: F.length(_without(x, SPACE_CHARS)) > 0).alias("_lines"),
        F.length(_without(F.col("_text"), SPACE_CHARS)).cast("long").alias("word_chars"),
        _count(F.col("_text"), SYMBOLS).alias("n_symbols"),
        _count(F.col("_text"), "!").alias("n_bangs"),
        _occurrences(F.col("_text"), [". ", ".\n"]).alias("n_sentences"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "\\p{Lu}+", ""))).cast("long").alias("n_upper"),
    )
    counts = ["word_chars", "n_symbols", "n_bangs", "n_sentences", "n_upper"]
    second = first.select(
        *keep,
        *counts,
        F.size("_words").cast("long").alias("n_words"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_words") >= WINDOW, _windows(F.col("_words"))).otherwise(F.array().cast("array<bigint>")).alias("_hashes"),
    )
    counts += ["n_words", "n_distinct", "n_lines", "n_dup_lines"]
    # Only a document with equal windows needs its windows sorted.
    third = second.select(
        *keep,
        *counts,
        F.when(
            F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
            F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_sorted"),
    )
    fourth = third.select(*keep, *counts, F.when(F.col("_sorted").isNotNull(), F.sort_array(_repeated(F.col("_sorted")))).alias("_at"))
    return fourth.select(*keep, *counts, F.coalesce(_covered(F.col("_at")), F.lit(0)).cast("long").alias("n_repeat_words"))


def _windows(words: Column) -> Column:
    """A hash of each window of three words, by its first word's position."""
    return F.transform(
        F.sequence(F.lit(0), F.size(words) - F.lit(WINDOW)),
        lambda i: F.xxhash64(*[F.get(words, i + F.lit(k)) for k in range(WINDOW)]),
    )


def _repeated(ordered: Column) -> Column:
    """Positions of windows whose hash is a neighbour's in sorted order."""
    same = F.filter(
        ordered,
        lambda x, k: (F.get(ordered, k - F.lit(1))["h"].eqNullSafe(x["h"])) | (F.get(ordered, k + F.lit(1))["h"].eqNullSafe(x["h"])),
    )
    return F.transform(same, lambda x: x["i"])


def _covered(at: Column) -> Column:
    """Words covered by windows of three that begin at the (ascending) positions."""
    steps = F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + F.lit(1)), x + F.lit(WINDOW)) - x))
    return F.aggregate(steps, F.lit(0), lambda total, x: total + x)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass
class Rule:
    """Votes ``side`` (1 good, -1 bad) where the condition holds, else abstains."""

    name: str
    side: int
    holds: Column

    def vote(self) -> Column:
        return F.when(self.holds, self.side).otherwise(0).cast("int").alias(f"v_{self.name}")


def default_rules() -> list[Rule]:
    c = F.col
    n = c("n_words")
    some = n > 0
    return [
        Rule("symbols", -1, some & (10 * c("n_symbols") > n)),
        Rule("symbol_chars", -1, some & (20 * c("n_symbols") > c("word_chars"))),
        Rule("capitals", -1, some & (2 * c("n_upper") > c("word_chars"))),
        Rule("bangs", -1, some & (10 * c("n_bangs") > n)),
        Rule("word_length", -1, some & ((c("word_chars") < 2 * n) | (c("word_chars") > 15 * n))),
        Rule("lines", -1, some & (10 * c("n_dup_lines") > 3 * c("n_lines"))),
        Rule("repeats", -1, some & (10 * c("n_repeat_words") > 3 * n)),
        Rule("variety", -1, some & (10 * c("n_distinct") < 2 * n)),
        Rule("plain", 1, some & (50 * c("n_symbols") <= n) & (100 * c("n_bangs") <= n) & (5 * c("n_upper") <= c("word_chars")) & (10 * c("n_distinct") >= 3 * n)),
        Rule("sentences", 1, some & (c("n_sentences") > 0) & (n >= 4 * c("n_sentences")) & (n <= 20 * c("n_sentences"))),
    ]


@dataclass
class LabelModel:
    """Each rule's accuracy: the chance that a vote it casts is right."""

    accuracy: list[float]

    def log_odds(self, votes: list[Column]) -> Column:
        total = F.lit(0.0)
        for vote, a in zip(votes, self.accuracy, strict=True):
            total = total + vote * F.lit(math.log(a / (1 - a)))
        return total


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> LabelModel:
    """EM over (votes, number of documents), good and bad equally likely before
    any vote: expected number of right votes of a rule over its votes cast."""
    rules = len(patterns[0][0]) if patterns else 0
    accuracy = [FIRST_ACCURACY] * rules
    for _ in range(rounds):
        right, cast = [0.0] * rules, [0] * rules
        weight = [math.log(a / (1 - a)) for a in accuracy]
        for votes, n in patterns:
            good = 1 / (1 + math.exp(-sum(v * w for v, w in zip(votes, weight, strict=True))))
            for j, v in enumerate(votes):
                if v:
                    cast[j] += n
                    right[j] += n * (good if v > 0 else 1 - good)
        accuracy = [min(MOST_ACCURACY, max(LEAST_ACCURACY, r / k)) if k else FIRST_ACCURACY for r, k in zip(right, cast, strict=True)]
    return LabelModel(accuracy)


def fit(votes: DataFrame, names: list[str]) -> LabelModel:
    """Count vote patterns over all documents and estimate the model."""
    if 3 ** len(names) > MAX_PATTERNS:
        raise ValueError("too many rules for a table of vote patterns")
    rows = votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names).collect()
    return estimate([(tuple(r[:-1]), r[-1]) for r in rows] or [((0,) * len(names), 0)])


def judge(stats: DataFrame, rules: list[Rule] | None = None, keep_at: float = KEEP_AT) -> DataFrame:
    """``stats`` with the votes, ``p_good`` and ``kept``. ``stats`` is read
    twice, so it should be a table or cheap."""
    rules = default_rules() if rules is None else rules
    voted = stats.select("*", *[r.vote() for r in rules])
    names = [f"v_{r.name}" for r in rules]
    model = fit(voted, names)
    scored = voted.withColumn("p_good", 1 / (1 + F.exp(-model.log_odds([F.col(n) for n in names]))))
    return scored.withColumn("kept", F.col("p_good") >= keep_at)
