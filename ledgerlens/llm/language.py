"""Language identification by unigram piece models, all segmentations summed.

The vocabulary is fixed and public (a SentencePiece model file, its path a
parameter); no tokenizer is trained. Every language gets a probability for
each piece. A word's likelihood under a language is the sum, over all ways to
cut it into pieces, of the product of their probabilities, computed by the
forward algorithm; a text's is the product over its words. Piece
probabilities are fitted by expectation-maximisation: forward and backward
sums give each piece's expected count over all segmentations of all training
words. Word counts cover every training document; they are counted per task,
summed by (language, word) and kept as a table, so a round of EM reads
distinct words, and only sums by (language, piece), bounded by the vocabulary
times ``MAX_LANGUAGES``, reach the driver.

Words are maximal runs of letters, with the marks that follow them, in lower
case. Words of more than ``LONGEST`` characters are walked letter by letter with
logarithms, so that no length underflows. A character outside the vocabulary is
a piece of its own, all such sharing one probability.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
ties go to the language first in order; training rows with null text or null
language count for nothing; with no training rows at all every text is
``und``. Only the text is read for a prediction, repeated rows get equal
predictions, extra columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import drop_worker_objects, materialize, worker_object

UNKNOWN_LANGUAGE = "und"
MAX_LANGUAGES = 64
MAX_MODEL_BYTES = 16 << 20
LONGEST = 24
ROUNDS = 3
#: Added to every expected count.
SMOOTHING = 0.1
#: No piece is less likely, so that a word of LONGEST letters stays above zero.
LEAST_PROB = 1e-12
#: Words scored together by the vectorised passes, which hold some 3 KB a word.
BATCH = 4_000
#: Texts scored together.
TEXTS = 200
#: Scored words kept per worker: two generations of this many.
CACHED = 200_000

#: Letters with the marks that follow them.
_LETTERS = regex.compile(r"(?:\p{L}\p{M}*+)++")
#: The same, and faster, for texts of the blocks up to U+024F and some signs: all
#: that counts as a word character there, but for digits, powers and fractions.
_LATIN = re.compile("[^\\W\\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+")
_BEYOND_LATIN = re.compile("[^\\x00-\u024f\u2010-\u2027\u20ac]")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    return (_LETTERS if _BEYOND_LATIN.search(text) else _LATIN).findall(text)


@dataclass
class Pieces:
    """A vocabulary of letter strings as a table addressed by polynomial hashes."""

    texts: list[str]

    def __post_init__(self) -> None:
        keys = self.hashes(self.texts)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        self.longest = max(map(len, self.texts), default=1)
        bits = max(12, int(np.ceil(np.log2(len(keys) * 8))))
        self.mask = np.uint64((1 << bits) - 1)
        self.slot_key = np.zeros(1 << bits, dtype=np.uint64)
        self.slot_id = np.full(1 << bits, -1, dtype=np.int32)
        self.probes = 1
        for i, key in enumerate(keys):
            at, step = int(self.slot(keys[i:i + 1])[0]), 1
            while self.slot_id[at] >= 0:
                at, step = (at + 1) & int(self.mask), step + 1
            self.slot_key[at], self.slot_id[at] = key, i
            self.probes = max(self.probes, step)

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(24)) & self.mask

    def hashes(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i, t in enumerate(texts):
                h = np.uint64(0)
                for c in t:
                    h = h * self.BASE + np.uint64(ord(c) + 1)
                out[i] = h
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece ids, -1 where there is none."""
        at = self.slot(keys)
        out = np.full(keys.shape, -1, dtype=np.int32)
        for _ in range(self.probes):
            ids = self.slot_id[at]
            hit = (self.slot_key[at] == keys) & (ids >= 0)
            out[hit] = ids[hit]
            at = (at + np.uint64(1)) & self.mask
        return out

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids[l, w, i]: the piece of l + 1 letters that begins at letter i of
        word w, or -1 (for one letter: the shared unknown id); and lengths."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        width = int(sizes.max(initial=1))
        codes = np.zeros((len(words), width), dtype=np.uint64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes[np.arange(width) < sizes[:, None]] = flat + np.uint64(1)
        longest = min(self.longest, width)
        ids = np.full((longest, len(words), width), -1, dtype=np.int32)
        rolled = np.zeros_like(codes)
        for n in range(longest):
            fits = width - n
            rolled = rolled[:, :fits] * self.BASE + codes[:, n:]
            inside = np.arange(fits) + n < sizes[:, None]
            found = self.find(rolled)
            if n == 0:
                found[found < 0] = len(self.texts)
            found[~inside] = -1
            ids[n, :, :fits] = found
        return ids, sizes


def forward(ids: np.ndarray, sizes: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """alpha[i, w, k]: summed probability under model k of the first i letters
    of word w. probs: one row per piece, the unknown one and a last row of zeros."""
    longest, n_words, width = ids.shape
    alpha = np.zeros((width + 1, n_words, probs.shape[1]))
    alpha[0] = 1.0
    for i in range(width):
        for n in range(min(longest, width - i)):
            edge = ids[n, :, i]
            if (edge >= 0).any():
                alpha[i + n + 1] += alpha[i] * probs[edge]
    return alpha


def long_forward(ids: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """log alpha[i, k] of one word of any length. ids: its lattice, (length,
    letter); logs: the logarithms of probs."""
    longest, width = ids.shape
    out = np.zeros((width + 1, logs.shape[1]))
    for i in range(1, width + 1):
        n = np.arange(min(longest, i))
        ways = out[i - 1 - n] + logs[ids[n, i - 1 - n]]
        most = ways.max(axis=0)
        out[i] = most + np.log(np.exp(ways - most).sum(axis=0))
    return out


def _logs(probs: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(probs)


def word_logs(pieces: Pieces, probs: np.ndarray, words: list[str]) -> np.ndarray:
    """log likelihood of each word (rows) under each model (columns)."""
    out = np.empty((len(words), probs.shape[1]))
    order = sorted((i for i in range(len(words)) if len(words[i]) <= LONGEST), key=lambda i: len(words[i]))
    if len(order) < len(words):
        logs = _logs(probs)
        for i in (i for i in range(len(words)) if len(words[i]) > LONGEST):
            out[i] = long_forward(pieces.lattice([words[i]])[0][:, 0], logs)[-1]
    for at in range(0, len(order), BATCH):
        part = order[at:at + BATCH]
        ids, sizes = pieces.lattice([words[i] for i in part])
        alpha = forward(ids, sizes, probs)
        out[part] = np.log(alpha[sizes, np.arange(len(part))])
    return out


def expected_counts(pieces: Pieces, probs: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected piece counts of words that occur ``counts`` times, one model."""
    total = np.zeros(len(pieces.texts) + 1)
    order = sorted((i for i in range(len(words)) if len(words[i]) <= LONGEST), key=lambda i: len(words[i]))
    one = probs[:, None]
    if len(order) < len(words):
        logs = _logs(one)
        for i in (i for i in range(len(words)) if len(words[i]) > LONGEST):
            total += _long_counts(pieces.lattice([words[i]])[0][:, 0], logs, len(total)) * counts[i]
    for at in range(0, len(order), BATCH):
        part = order[at:at + BATCH]
        ids, sizes = pieces.lattice([words[i] for i in part])
        longest, n_words, width = ids.shape
        alpha = forward(ids, sizes, one)[:, :, 0]
        rows = np.arange(n_words)
        beta = np.zeros((width + 1, n_words))
        beta[sizes, rows] = 1.0
        for i in range(width - 1, -1, -1):
            for n in range(min(longest, width - i)):
                beta[i] += probs[ids[n, :, i]] * beta[i + n + 1]
        scale = counts[part] / alpha[sizes, rows]
        for n in range(longest):
            for i in range(width - n):
                edge = ids[n, :, i]
                hit = edge >= 0
                if hit.any():
                    post = alpha[i] * probs[edge] * beta[i + n + 1] * scale
                    total += np.bincount(edge[hit], post[hit], minlength=len(total))
    return total


def _long_counts(ids: np.ndarray, logs: np.ndarray, size: int) -> np.ndarray:
    """Expected piece counts of one word of any length, one model."""
    longest, width = ids.shape
    alpha, logs = long_forward(ids, logs)[:, 0], logs[:, 0]
    beta = np.zeros(width + 1)
    for i in range(width - 1, -1, -1):
        n = np.arange(min(longest, width - i))
        ways = logs[ids[n, i]] + beta[i + 1 + n]
        beta[i] = ways.max() + np.log(np.exp(ways - ways.max()).sum())
    total = np.zeros(size)
    for n in range(longest):
        at = np.flatnonzero(ids[n, :width - n] >= 0)
        edge = ids[n, at]
        total += np.bincount(edge, np.exp(alpha[at] + logs[edge] + beta[at + n + 1] - alpha[-1]), minlength=size)
    return total


def load_pieces(path: str) -> list[str]:
    """The letter strings of a SentencePiece vocabulary, lower case, once each."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {model.id_to_piece(i).lstrip("▁").lower() for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_byte(i)}
    return sorted(t for t in texts if t and _LETTERS.fullmatch(t))


@dataclass
class LanguageModel:
    """Languages, and a probability for each piece under each of them."""

    pieces: list[str]
    languages: list[str]
    #: One row per piece, then the unknown character, then zeros (no piece).
    probs: np.ndarray


def word_counts(train: DataFrame, text: str, lang: str) -> DataFrame:
    """(language, word, n) over all training documents, summed per task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_objects()
        for batch in batches:
            tables: dict[str, Counter] = {}
            for t, language in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                tables.setdefault(language, Counter()).update(words_of(t.as_py()))
            for language, table in tables.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(table)), pa.array(list(table.keys())), pa.array(list(table.values()), pa.int64())],
                    names=["language", "word", "n"],
                )

    rows = train.select(F.col(text).alias("text"), F.col(lang).alias("language")).where("text IS NOT NULL AND language IS NOT NULL")
    counted = rows.mapInArrow(count, "language string, word string, n long")
    return counted.groupBy("language", "word").agg(F.sum("n").alias("n"))


def fit(train: DataFrame, path: str, text: str = "text", lang: str = "lang", rounds: int = ROUNDS) -> LanguageModel:
    """Fit piece probabilities on all rows of ``train`` with a text and a language."""
    spark = train.sparkSession
    texts = load_pieces(path)
    counts = materialize(word_counts(train, text, lang), "language-words")
    languages = sorted(r[0] for r in counts.select("language").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    size = len(texts) + 1
    if (size + 1) * max(1, len(languages)) * 8 > MAX_MODEL_BYTES:
        raise ValueError("the model would be too large to broadcast")
    probs = np.zeros((size + 1, len(languages)))
    lengths = np.array([len(t) for t in texts] + [3])
    probs[:size] = (0.05 ** lengths)[:, None]  # before any count: letters alike, whatever the cut
    for _ in range(rounds):
        got = np.zeros((size, len(languages)))
        shared = spark.sparkContext.broadcast((texts, languages, probs))
        for language, piece, n in _expected(counts, shared).toLocalIterator():
            got[piece, languages.index(language)] = n
        got += SMOOTHING
        probs = np.zeros_like(probs)
        probs[:size] = np.maximum(got / got.sum(axis=0), LEAST_PROB)
        shared.unpersist()
    return LanguageModel(texts, languages, probs)


def _expected(counts: DataFrame, shared) -> DataFrame:
    """Expected counts by (language, piece) of one round."""

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_objects()
        texts, languages, probs = shared.value
        pieces = _pieces(texts)
        total = np.zeros((len(texts) + 1, len(languages)))
        for batch in batches:
            tags = np.array(batch.column(0).to_pylist(), dtype=object)
            words, n = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            for k, language in enumerate(languages):
                rows = np.flatnonzero(tags == language)
                if len(rows):
                    total[:, k] += expected_counts(pieces, probs[:, k], [words[i] for i in rows], n[rows])
        for k, language in enumerate(languages):
            rows = np.flatnonzero(total[:, k])
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(rows), pa.string()), pa.array(rows, pa.int32()), pa.array(total[rows, k])], names=["language", "piece", "n"]
            )

    parts = counts.mapInArrow(expect, "language string, piece int, n double")
    return parts.groupBy("language", "piece").agg(F.sum("n").alias("n"))


_PIECES: dict[tuple[int, int], Pieces] = {}


def _pieces(texts: list[str]) -> Pieces:
    """A vocabulary's table, built once per worker."""
    key = (len(texts), hash(tuple(texts)))
    if key not in _PIECES:
        _PIECES.clear()
        _PIECES[key] = Pieces(texts)
    return _PIECES[key]


def predict_column(spark: SparkSession, model: LanguageModel, text: Column | str) -> Column:
    """struct(lang, score) of a text column: the likeliest language and its
    posterior under equal priors."""
    shared = spark.sparkContext.broadcast((model.pieces, model.languages, model.probs))

    @F.arrow_udf("lang string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        languages = shared.value[1]
        scores_of = worker_object("language", shared, lambda v: WordScores(v[0], v[2]))
        langs, scores = [], []
        for at in range(0, len(texts), TEXTS):
            split = [words_of(t) if languages else [] for t in texts.slice(at, TEXTS).to_pylist()]
            total = scores_of.sums(split)
            best = total.argmax(axis=1) if languages else np.zeros(len(split), dtype=int)
            odds = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1) if languages else best
            for ws, k, p in zip(split, best.tolist(), odds.tolist(), strict=True):
                langs.append(languages[k] if ws else UNKNOWN_LANGUAGE)
                scores.append(p if ws else 0.0)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return predict(F.col(text) if isinstance(text, str) else text)


class WordScores:
    """Word scores of one model: word -> row of a matrix, filled as words come.
    When full, the words move to an older generation, from which they come back
    if met again."""

    def __init__(self, vocabulary: list[str], probs: np.ndarray) -> None:
        self.pieces, self.probs = _pieces(vocabulary), probs
        self.rows: dict[str, int] = {}
        self.logs = np.empty((CACHED, probs.shape[1]))
        self.older, self.older_logs = self.rows, self.logs

    def scored(self, words: list[str]) -> np.ndarray:
        """Scores of words that aren't in the newer generation."""
        at = np.fromiter((self.older.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        out = self.older_logs[at]
        new = np.flatnonzero(at < 0)
        out[new] = word_logs(self.pieces, self.probs, [words[i] for i in new])
        return out

    def sums(self, split: list[list[str]]) -> np.ndarray:
        """Summed scores of each list of words, one column per model."""
        out = np.zeros((len(split), self.probs.shape[1]))
        flat = [w for ws in split for w in ws]
        if not flat:
            return out
        new = list(set(flat).difference(self.rows))
        if len(self.rows) + len(new) > CACHED:
            new = list(set(flat))
            self.older, self.older_logs = self.rows, self.logs
            self.rows, self.logs = {}, np.empty((max(CACHED, len(new)), self.probs.shape[1]))
        first = len(self.rows)
        self.logs[first:first + len(new)] = self.scored(new)
        self.rows.update(zip(new, range(first, first + len(new)), strict=True))
        at = np.fromiter(map(self.rows.__getitem__, flat), dtype=np.int64, count=len(flat))
        sizes = np.array([len(ws) for ws in split])
        ends = np.cumsum(sizes)
        some = np.flatnonzero(sizes)
        out[some] = np.add.reduceat(self.logs[at], (ends - sizes)[some], axis=0)
        return out


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` with columns ``lang_pred`` and ``lang_score``."""
    found = df.withColumn("lang_pred", predict_column(df.sparkSession, model, text))
    return found.withColumn("lang_score", F.col("lang_pred.score")).withColumn("lang_pred", F.col("lang_pred.lang"))
