"""Benchmark decontamination by a prefix-filtered containment join.

Every window of an item (``WINDOW`` consecutive words, or a shorter item
whole) is a set of tokens that a document must contain in full, so of its
tokens ordered from rare to frequent a prefix of one, the rarest, is necessary.
Windows are therefore indexed by their rarest word, rarity being counted over
all documents. A document word that is in the index fixes where a window
would have to begin; positions outside the document drop out (position and
length bounds) and what remains is compared word for word.

The items are the stated query set: they are read in blocks of at most
``BLOCK_BYTES`` of text (one item at least), each broadcast and matched
against all documents. One block, the usual case, needs no shuffle at all;
more are matched one after the other, their hits kept in the shared folder
and merged per document.

Words: A-Z in lower case, runs of ASCII letters, digits and any characters
beyond ASCII. Defined cases: null texts have no words; items without words
match nothing; equal items are both reported; an item without an id marks
words but is not listed; a document without words is clean; repeated rows are
judged alike; extra columns pass through (those named like an output are
replaced).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import drop_worker_objects, materialize, set_aside, text_bytes

WINDOW = 13
BLOCK_BYTES = 8 << 20
#: A document is contaminated if its hit words times this reach all its words.
SHARE = 20

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text_bytes(text).translate(_WORD_BYTES).split()


def windows_of(words: list[bytes], width: int = WINDOW) -> Iterator[list[bytes]]:
    if len(words) > width:
        for i in range(len(words) - width + 1):
            yield words[i:i + width]
    elif words:
        yield words


def blocks(items: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of at most ``limit`` bytes of text (one at least)."""
    part, size = [], 0
    for key, body in items.select(item_id, text).where(F.col(text).isNotNull()).toLocalIterator():
        if part and size + len(body) * 4 > limit:
            yield part
            part, size = [], 0
        part.append((key, body))
        size += len(body) * 4
    yield part


class WindowIndex:
    """word -> {(offset, length): {window: item numbers}} for the rarest word of each window."""

    def __init__(self, items: list[tuple[int, str]], counts: dict[bytes, int], width: int = WINDOW) -> None:
        self.ids = [key for key, _ in items]
        self.by_word: dict[bytes, dict[tuple[int, int], dict[bytes, list[int]]]] = {}
        for number, (_, body) in enumerate(items):
            for window in windows_of(words_of(body), width):
                rarest = min(window, key=lambda w: (counts.get(w, 0), w))
                same = self.by_word.setdefault(rarest, {}).setdefault((window.index(rarest), len(window)), {})
                numbers = same.setdefault(b" ".join(window), [])
                if not numbers or numbers[-1] != number:
                    numbers.append(number)
        self.anchors = frozenset(self.by_word)

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged [start, end) word ranges inside windows, and item numbers."""
        if self.anchors.isdisjoint(words):
            return [], set()
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        n, anchors = len(words), self.anchors
        for at in [i for i, w in enumerate(words) if w in anchors]:
            for (offset, length), same in self.by_word[words[at]].items():
                start = at - offset
                if start >= 0 and start + length <= n:
                    numbers = same.get(b" ".join(words[start:start + length]))
                    if numbers:
                        found.append((start, start + length))
                        items.update(numbers)
        return merged(found), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = out[-1][0], end
        else:
            out.append((start, end))
    return out


def word_counts(docs: DataFrame, text: str, vocabulary) -> dict[bytes, int]:
    """How often each word of the (broadcast, bounded) vocabulary occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = vocabulary.value, Counter()
        for batch in batches:
            for t in batch.column(0):
                total.update(filter(known.__contains__, words_of(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    parts = docs.select(F.col(text).alias("text")).mapInArrow(count, "word binary, n long")
    return {bytes(w): n for w, n in parts.groupBy("word").agg(F.sum("n")).toLocalIterator()}


MATCH = "n_words long, spans array<struct<start:int,end:int>>, items array<long>"


def match_column(index, text: Column | str) -> Column:
    """struct(n_words, spans, items) of a text column against a broadcast index."""

    @F.arrow_udf(MATCH)
    def match(texts: pa.Array) -> pa.Array:
        drop_worker_objects()
        known = index.value
        sizes, spans, items = [], [], []
        for t in texts:
            words = words_of(t.as_py())
            ranges, numbers = known.match(words)
            sizes.append(len(words))
            spans.append([{"start": s, "end": e} for s, e in ranges])
            items.append(sorted({known.ids[i] for i in numbers if known.ids[i] is not None}))
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(pa.int64()))], names=["n_words", "spans", "items"]
        )

    return match(F.col(text) if isinstance(text, str) else text)


def _merge_spans(lists: Column) -> Column:
    @F.arrow_udf("array<struct<start:int,end:int>>")
    def merge(lists: pa.Array) -> pa.Array:
        rows = [[{"start": s, "end": e} for s, e in merged([(x["start"], x["end"]) for x in row or []])] for row in lists.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return merge(lists)


def _digest(texts: Column) -> Column:
    @F.arrow_udf("binary")
    def digest(texts: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh3_128_digest(text_bytes(t.as_py())) for t in texts], pa.binary())

    return digest(texts)


RESULTS = ("n_words", "n_hit", "hit_spans", "item_ids", "contaminated")
INTERNAL = ("_m", "_d", "_n", "_s", "_i", "_hid", "_hd")


def contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``hit_spans`` (word ranges),
    ``item_ids`` (ascending) and ``contaminated``; columns of these names are
    replaced."""
    docs, back = set_aside(docs.drop(*RESULTS), *INTERNAL)
    sc = docs.sparkSession.sparkContext
    parts = blocks(items, item_id, item_text, block_bytes)

    def index(part: list[tuple[int, str]]):
        vocabulary = sc.broadcast(frozenset(w for _, body in part for w in words_of(body)))
        counts = word_counts(docs, text, vocabulary)
        vocabulary.unpersist()
        return sc.broadcast(WindowIndex(part, counts, window))

    first = next(parts)
    second = next(parts, None)
    if second is None:
        found = docs.withColumn("_m", match_column(index(first), text))
        hits = found.select(
            *docs.columns, F.col("_m.n_words").alias("n_words"), F.col("_m.spans").alias("hit_spans"), F.col("_m.items").alias("item_ids")
        )
    else:
        hits = _in_blocks(docs, [first, second], parts, index, text, doc_id)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = hits.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))
    return found.withColumnsRenamed(back)


def _in_blocks(docs, first, rest, index, text, doc_id) -> DataFrame:
    """Match block after block; hits are few and kept by document id and text digest."""
    found = None
    for part in [*first, *rest]:
        known = index(part)
        rows = docs.select(F.col(doc_id).alias("_id"), _digest(F.col(text)).alias("_d"), match_column(known, text).alias("_m"))
        rows = rows.where(F.size("_m.spans") > 0).select("_id", "_d", "_m.spans", "_m.items").dropDuplicates(["_id", "_d"])
        rows = materialize(rows, "contamination")
        known.unpersist()
        found = rows if found is None else found.unionByName(rows)
    hits = found.groupBy("_id", "_d").agg(
        F.flatten(F.collect_list("spans")).alias("_s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_i")
    )
    size = match_column(docs.sparkSession.sparkContext.broadcast(WindowIndex([], {})), text)["n_words"]
    keyed = docs.withColumn("_d", _digest(F.col(text))).withColumn("_n", size)
    hits = hits.withColumnsRenamed({"_id": "_hid", "_d": "_hd"})
    joined = keyed.join(hits, (keyed[doc_id].eqNullSafe(hits["_hid"])) & (keyed["_d"] == hits["_hd"]), "left")
    return joined.select(
        *docs.columns,
        F.col("_n").alias("n_words"),
        _merge_spans(F.col("_s")).alias("hit_spans"),
        F.coalesce("_i", F.array().cast("array<bigint>")).alias("item_ids"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """The documents that are not contaminated, columns as they were."""
    rows, back = set_aside(docs, *RESULTS)
    return contamination(rows, items, **kw).where(~F.col("contaminated")).select(*rows.columns).withColumnsRenamed(back)
