"""Chat formatting after collapsing cumulative snapshots.

Loggers often write a conversation again after every turn, so a conversation
may be a prefix of a longer one. Every turn is hashed with its position; the
exclusive-or of the hashes up to a turn is a rolling hash of that prefix, and
it can be summed by blocks of turns, so that a conversation of any length is
never in one task. A conversation whose full hash is a proper prefix's hash of
another is dropped by an anti-join; of equal conversations the one with the
smallest id stays. What remains is rendered, one row per conversation and
block of ``TURNS_PER_PART`` turn numbers, to be read in order of ``part``.

A conversation is the set of its (turn, role, text) rows; a is a prefix of b
if a's rows are those of b up to a's last turn. Hashes have 128 bits.

Defined cases: repeated rows count once; several rows of one turn number are
ordered by role, then text; a null turn comes before all others, a null role
renders as "" and a null text as ""; rows without a conversation id form one
conversation without id; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize

TURNS_PER_PART = 64
FIRST_TURN = -(1 << 63)


def _xor(turns: Column, seed: int) -> Column:
    """Exclusive-or of the turns' hashes."""
    return F.aggregate(
        turns,
        F.lit(0).cast("long"),
        lambda total, x: total.bitwiseXOR(F.xxhash64(F.lit(seed), x["turn"], x["role"].isNull(), x["role"], x["text"].isNull(), x["text"])),
    )


def parts_of(conversations: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """(conv_id, part, turns): each conversation's distinct rows by blocks of turn numbers."""
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(FIRST_TURN))
    rows = conversations.select("conv_id", turn.alias("turn"), "role", "text")
    part = F.floor(F.col("turn") / F.lit(turns_per_part)).cast("long") if turns_per_part & (turns_per_part - 1) else F.shiftright("turn", turns_per_part.bit_length() - 1)
    grouped = rows.groupBy("conv_id", part.alias("part")).agg(F.collect_set(F.struct("turn", "role", "text")).alias("turns"))
    return grouped.select("conv_id", "part", F.array_sort("turns").alias("turns"))


def prefixes_of(parts: DataFrame) -> DataFrame:
    """(conv_id, turn, n, h1, h2): rows and rolling hashes up to each turn number."""
    block = parts.select("conv_id", "part", "turns", F.size("turns").cast("long").alias("n"), _xor(F.col("turns"), 1).alias("x1"), _xor(F.col("turns"), 2).alias("x2"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = block.select(
        "conv_id", "turns",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        F.coalesce(F.bit_xor("x1").over(before), F.lit(0)).alias("c1"),
        F.coalesce(F.bit_xor("x2").over(before), F.lit(0)).alias("c2"),
    )
    upto = carried.select("conv_id", "n0", "c1", "c2", "turns", F.explode(F.array_distinct(F.transform("turns", lambda x: x["turn"]))).alias("last"))
    seen = upto.withColumn("seen", F.filter("turns", lambda x: x["turn"] <= F.col("last")))
    return seen.select(
        "conv_id",
        F.col("last").alias("turn"),
        (F.col("n0") + F.size("seen")).alias("n"),
        F.col("c1").bitwiseXOR(_xor(F.col("seen"), 1)).alias("h1"),
        F.col("c2").bitwiseXOR(_xor(F.col("seen"), 2)).alias("h2"),
    )


def maximal_conversations(parts: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no prefix of another."""
    prefixes = materialize(prefixes_of(parts), "chat-prefixes")
    whole = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("turn", "n", "h1", "h2"), "turn").alias("w")).select("conv_id", "w.*")
    # Equal conversations meet as counts and a smallest id, not as a group of rows.
    one = whole.groupBy("turn", "n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    longer = prefixes.join(whole.select(F.col("conv_id").alias("c"), F.col("n").alias("all")), F.col("conv_id").eqNullSafe(F.col("c")))
    proper = longer.where("n < all").select("turn", "n", "h1", "h2").distinct()
    return one.join(proper, ["turn", "n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def render(turns: Column) -> Column:
    """ChatML of a list of turns."""
    none = F.lit("")
    line = F.transform(
        turns,
        lambda x: F.concat(F.lit("<|im_start|>"), F.coalesce(x["role"], none), F.lit("\n"), F.coalesce(x["text"], none), F.lit("<|im_end|>\n")),
    )
    return F.array_join(line, "")


def format_chats(conversations: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """(conv_id, part, n_turns, text): maximal conversations rendered; n_turns
    counts the whole conversation's rows."""
    parts = materialize(parts_of(conversations, turns_per_part), "chat-parts")
    kept = maximal_conversations(parts).withColumnRenamed("conv_id", "c")
    joined = parts.join(kept, F.col("conv_id").eqNullSafe(F.col("c")))
    return joined.select("conv_id", "part", "n_turns", render(F.col("turns")).alias("text"))
