"""Language-model scoring with a log-bilinear model trained by noise contrast.

The model predicts a word's vector from those of the two words before it: each
context word's vector is weighted, element by element, by its position's
vector, and the sum's product with a target vector, plus the target's bias, is
the target's score. It is learned by noise-contrastive estimation: words of
the corpus are told from words drawn from the unigram distribution, so that no
step sums over the vocabulary. For scoring the normalisers are computed
exactly: matrix products over batches of contexts give the sum over all
targets for every context, a table of ``MODEL_IDS`` squared numbers, and a
token's log-probability is its score less its context's entry.

Any word can be scored. The model's targets are the end of a text, the
``MODEL_WORDS`` most frequent words, and classes of all other words by their
last two bytes (the ``MODEL_CLASSES`` most frequent classes, one more for the
rest). A word of a class has the class's probability times its share of the
class's count, smoothed as in the unigram score, with one share for all words
that training never met. The probabilities of all targets, and of the words of
a class, add up to one.

Counts cover every training text: they are gathered per task, added up by word
and written as a table that grows with the corpus. Words of at least a count
chosen so that they are at most ``HEAD_WORDS`` are broadcast; a text's other
words meet the table in a join, so no table of unbounded size is sent round
and no frequent word is a join key. Training reads every training text once,
in ``ROUNDS`` parts: each task of a part trains on its texts from the same
parameters, and the tasks' results are averaged by their number of tokens, in
groups of ``FAN``; an instance of the parameters has about 200 KB.

Words are runs of characters other than blank, tab, line feed, vertical tab,
form feed and carriage return, A-Z in lower case, told apart by 64-bit hashes;
every text has one end token behind its words.

Defined cases: a null or empty text is its end token; with no training text at
all every count is 0, and the model is uniform over its targets; repeated rows
count and score as often as they come; a text of any length is handled in
pieces of words; extra columns pass through, the result's columns replace those
of equal name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Tally, chunks, hash_words, materialize, text_bytes, word_stops

MODEL_WORDS = 640
MODEL_CLASSES = 320
MODEL_IDS = 1 + MODEL_WORDS + MODEL_CLASSES + 1
HEAD_WORDS = 1 << 20
DIMENSIONS = 24
CONTEXT = 2
#: Noise words of a step, shared by its tokens; tokens of a step.
NOISE, STEP = 64, 2048
RATE = 0.2
ROUNDS = 3
FAN = 64
#: The end of a text among hashes, and its class.
END, END_CLASS = np.uint64(0), 784
#: By byte: 1 to 26 for letters, 27 outside ASCII, 0 for the rest.
_LETTER = np.zeros(256, dtype=np.int16)
_LETTER[0x61:0x7B] = np.arange(1, 27)
_LETTER[0x80:] = 27


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, classes, sizes) of texts' tokens, each text's end included."""
    raws = [text_bytes(t).lower() for t in texts]
    raw = b"\n".join(raws)
    with np.errstate(over="ignore"):
        flat, starts = hash_words(raw)
    stops = word_stops(raw)
    data = np.frombuffer(raw, dtype=np.uint8)
    last = _LETTER[data[stops - 1]]
    before = np.where(stops - starts > 1, _LETTER[data[np.maximum(stops - 2, 0)]], 0)
    owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raws]), starts, side="right")
    sizes = np.bincount(owner, minlength=len(texts)) + 1
    at = np.arange(len(flat)) + owner
    hashes = np.full(len(flat) + len(texts), END)
    classes = np.full(len(hashes), END_CLASS, dtype=np.int16)
    hashes[at], classes[at] = flat, before * 28 + last
    return hashes, classes, sizes


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    return chunks([len(t or "") for t in texts])


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(h, k, c): hash, class and count of every word and of the end token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def taken() -> Iterator[pa.RecordBatch]:
            if got := tally.take():
                yield pa.RecordBatch.from_arrays([pa.array(got[0].view(np.int64)), pa.array(got[2]), pa.array(got[1])], names=["h", "k", "c"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for first, last in _pieces(texts):
                hashes, classes, _ = tokens(texts[first:last])
                found, at, n = np.unique(hashes, return_index=True, return_counts=True)
                if tally.add(found, n.astype(np.int64), classes[at]):
                    yield from taken()
        yield from taken()

    parts = docs.select(F.col(text).alias("text")).mapInArrow(count, "h long, k short, c long")
    return parts.groupBy("h").agg(F.min("k").alias("k"), F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """Counts that every task needs: words of the head and the end token (hashes
    ascending, with count and model id), ids of classes, and each id's mass."""

    hashes: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    class_ids: np.ndarray
    #: By model id: tokens, and for classes the distinct words (0 for words).
    mass: np.ndarray
    types: np.ndarray
    n: int
    v: int
    cutoff: int

    def places(self, found: np.ndarray) -> np.ndarray:
        """Places of hashes in the head, -1 for others."""
        if not len(self.hashes):
            return np.full(len(found), -1)
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        return np.where(self.hashes[at] == found, at, -1)

    def model_ids(self, found: np.ndarray, classes: np.ndarray) -> np.ndarray:
        at = self.places(found)
        return np.where(at >= 0, self.ids[at] if len(self.ids) else 0, self.class_ids[classes])

    def word_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes (ascending) and ids of the words that are targets themselves."""
        own = self.ids <= MODEL_WORDS
        return self.hashes[own], self.ids[own]


def lexicon(counts: DataFrame, head_words: int = HEAD_WORDS) -> Lexicon:
    """The bounded part of a table of counts."""
    bins = counts.groupBy(F.floor(F.log2("c") * 8).alias("bin")).agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("n"))
    cutoff, room = 1 << 62, head_words
    for row in sorted(bins.collect(), key=lambda r: -r["bin"]):
        room -= row["n"]
        if room < 0:
            break
        cutoff = row["least"]
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    head = counts.where((F.col("c") >= cutoff) | (F.col("h") == int(END))).toArrow()
    hashes = head.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes, c, k = hashes[order], head.column("c").to_numpy()[order], head.column("k").to_numpy()[order]
    words = np.lexsort((hashes, -c))
    words = words[hashes[words] != END][:MODEL_WORDS]
    by_class = {r["k"]: (r["n"], r["v"]) for r in counts.groupBy("k").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    mass, types = np.zeros(END_CLASS + 1, np.int64), np.zeros(END_CLASS + 1, np.int64)
    for code, (n, v) in by_class.items():
        mass[code], types[code] = n, v
    np.subtract.at(mass, k[words], c[words])
    np.subtract.at(types, k[words], 1)
    of_class = np.full(END_CLASS + 1, MODEL_IDS - 1, dtype=np.int16)
    often = np.argsort(-mass[:END_CLASS], kind="stable")[:MODEL_CLASSES]
    of_class[often] = 1 + MODEL_WORDS + np.arange(len(often))
    of_class[END_CLASS] = 0
    ids = of_class[k]
    ids[words] = 1 + np.arange(len(words))
    id_mass, id_types = np.zeros(MODEL_IDS, np.int64), np.zeros(MODEL_IDS, np.int64)
    np.add.at(id_mass, of_class, mass)
    np.add.at(id_types, of_class, types)
    id_mass[1:1 + len(words)] = c[words]
    id_types[:1 + MODEL_WORDS] = 0
    return Lexicon(hashes, c, ids, of_class, id_mass, id_types, total["n"] or 0, total["v"], cutoff)


@dataclass
class Parameters:
    """Context vectors, position vectors, target vectors and biases."""

    context: np.ndarray
    position: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.context, self.position, self.target, self.bias)])

    @staticmethod
    def of(flat: np.ndarray) -> Parameters:
        size = MODEL_IDS * DIMENSIONS
        a, b, c, d = np.split(flat.astype(np.float32), np.cumsum([size, CONTEXT * DIMENSIONS, size]))
        return Parameters(a.reshape(MODEL_IDS, -1), b.reshape(CONTEXT, -1), c.reshape(MODEL_IDS, -1), d)


def unigram(lex: Lexicon) -> np.ndarray:
    """Probabilities of the targets without context: the noise."""
    return (lex.mass + 0.5) / (lex.mass.sum() + 0.5 * MODEL_IDS)


def beginning(lex: Lexicon) -> Parameters:
    """Small vectors and the unigram's biases: at first the model is the unigram."""
    rng = np.random.default_rng(12)
    vectors = rng.normal(0, 0.1, (2, MODEL_IDS, DIMENSIONS)).astype(np.float32)
    return Parameters(vectors[0], np.ones((CONTEXT, DIMENSIONS), np.float32), vectors[1] * 0, np.log(unigram(lex)).astype(np.float32))


def contexts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids one and two places before each; ends stand before a text."""
    one = np.zeros(len(ids), ids.dtype)
    one[1:] = ids[:-1]
    two = np.zeros(len(ids), ids.dtype)
    two[1:] = one[:-1]
    two[one == 0] = 0
    return one, two


def _summed(rows: np.ndarray, ids: np.ndarray, into: np.ndarray) -> None:
    """Add rows to those of ``into`` with their ids."""
    order = np.argsort(ids, kind="stable")
    at = ids[order]
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    into[at[starts]] += np.add.reduceat(rows[order], starts, axis=0)


class Trainer:
    """Steps of noise-contrastive estimation, each parameter with its own rate
    (falling with the squares of its gradients)."""

    def __init__(self, start: Parameters, noise: np.ndarray, seed: tuple[int, ...]) -> None:
        self.p = Parameters.of(start.flat().copy())
        self.rng = np.random.default_rng(seed)
        self.edges = np.cumsum(noise)
        self.log_noise = np.log(noise * NOISE).astype(np.float32)
        self.squares = [np.full_like(x, 1e-3) for x in (self.p.context, self.p.position, self.p.target, self.p.bias)]
        self.seen = 0

    def train(self, ids: np.ndarray) -> None:
        one, two = contexts(ids)
        for at in range(0, len(ids), STEP):
            self.step(ids[at:at + STEP], one[at:at + STEP], two[at:at + STEP])
        self.seen += len(ids)

    def step(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        p = self.p
        drawn = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE) * self.edges[-1]), MODEL_IDS - 1)
        first, second, own = p.context[one], p.context[two], p.target[ids]
        guess = first * p.position[0] + second * p.position[1]
        score = np.einsum("ij,ij->i", guess, own) + p.bias[ids] - self.log_noise[ids]
        right = 1 / (1 + np.exp(score))
        others = p.target[drawn]
        wrong = -1 / (1 + np.exp(-(guess @ others.T + (p.bias[drawn] - self.log_noise[drawn]))))
        back = right[:, None] * own + wrong @ others
        g_target, g_context, g_bias = np.zeros_like(p.target), np.zeros_like(p.context), np.zeros_like(p.bias)
        _summed(right[:, None] * guess, ids, g_target)
        np.add.at(g_target, drawn, wrong.T @ guess)
        np.add.at(g_bias, drawn, wrong.sum(axis=0))
        g_bias += np.bincount(ids, weights=right, minlength=MODEL_IDS).astype(np.float32)
        _summed(back * p.position[0], one, g_context)
        _summed(back * p.position[1], two, g_context)
        g_position = np.stack([np.einsum("ij,ij->j", back, first), np.einsum("ij,ij->j", back, second)])
        scale = np.float32(1 / len(ids))
        for x, g, s in zip((p.context, p.position, p.target, p.bias), (g_context, g_position, g_target, g_bias), self.squares, strict=True):
            g *= scale
            s += g * g
            x += RATE * g / np.sqrt(s)


def _train_round(docs: DataFrame, text: str, shared, number: int) -> Parameters | None:
    """Parameters after one part of the texts: the tasks' averages (None: no texts)."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, class_ids, noise, start = shared.value
        part = TaskContext.get().partitionId()
        trainer = Trainer(Parameters.of(start), noise, (number, part))
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for first, last in _pieces(texts):
                hashes, classes, _ = tokens(texts[first:last])
                at = np.minimum(np.searchsorted(words, hashes), max(0, len(words) - 1))
                known = words[at] == hashes if len(words) else np.zeros(len(hashes), bool)
                trainer.train(np.where(known, ids[at] if len(ids) else 0, class_ids[classes]).astype(np.int16))
        if trainer.seen:
            yield pa.RecordBatch.from_pylist([{"part": part, "weight": float(trainer.seen), "params": trainer.p.flat().tobytes()}])

    schema = "part long, weight double, params binary"
    found = materialize(docs.select(F.col(text).alias("text")).mapInArrow(train, schema), "lm-params")

    def average(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        weights = table.column("weight").to_numpy()
        total = np.zeros(len(table.column("params")[0].as_py()) // 4)
        for w, raw in zip(weights, table.column("params"), strict=True):
            total += w * np.frombuffer(raw.as_buffer(), np.float32)
        mean = (total / weights.sum()).astype(np.float32)
        return pa.table({"part": [table.column("part")[0].as_py() // FAN], "weight": [float(weights.sum())], "params": [mean.tobytes()]})

    while found.count() > FAN:
        found = materialize(found.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(average, schema), "lm-params")
    rows = found.toArrow()
    return Parameters.of(np.frombuffer(average(rows).column("params")[0].as_buffer(), np.float32)) if rows.num_rows else None


def normalisers(spark, params: Parameters) -> np.ndarray:
    """log of the sum over all targets, by (second, first) context id."""
    shared = spark.sparkContext.broadcast(params.flat())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Parameters.of(shared.value)
        near, far = p.context * p.position[0], p.context * p.position[1]
        for batch in batches:
            for two in batch.column(0).to_pylist():
                scores = (near + far[two]) @ p.target.T + p.bias
                top = scores.max(axis=1)
                logs = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
                yield pa.RecordBatch.from_pylist([{"two": two, "logs": logs.astype(np.float32).tobytes()}])

    rows = spark.range(MODEL_IDS).mapInArrow(sums, "two long, logs binary").toArrow().sort_by("two")
    return np.frombuffer(b"".join(x.as_py() for x in rows.column("logs")), np.float32).reshape(MODEL_IDS, MODEL_IDS)


@dataclass
class LanguageModel:
    """A fitted model: counts as a table, their bounded part, parameters and normalisers."""

    counts: DataFrame
    lexicon: Lexicon
    params: Parameters
    logs: np.ndarray


def fit(docs: DataFrame, text: str = "text", head_words: int = HEAD_WORDS, rounds: int = ROUNDS) -> LanguageModel:
    """A model of the texts of ``docs``."""
    spark = docs.sparkSession
    counts = materialize(word_counts(docs, text), "lm-counts")
    lex = lexicon(counts, head_words)
    params, noise = beginning(lex), unigram(lex)
    part = F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(rounds))
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((*lex.word_ids(), lex.class_ids, noise, params.flat()))
        params = _train_round(docs.where(part == r), text, shared, r) or params
    return LanguageModel(counts, lex, params, normalisers(spark, params))


def token_logs(params: Parameters, logs: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Base-10 log-probability of each id of a run of texts, given those before."""
    one, two = contexts(ids)
    near, far = params.context * params.position[0], params.context * params.position[1]
    out = np.empty(len(ids))
    for at in range(0, len(ids), 1 << 16):
        w, a, b = ids[at:at + (1 << 16)], one[at:at + (1 << 16)], two[at:at + (1 << 16)]
        out[at:at + len(w)] = np.einsum("ij,ij->i", near[a] + far[b], params.target[w]) + params.bias[w] - logs[b, a]
    return out / np.log(10)


FOUND = "n_tokens long, n_known long, base double, model double, tail_h array<long>, tail_n array<long>"


def _found(model: LanguageModel, spark, text: Column) -> Column:
    """What of a text's scores needs the head only, and its words outside it."""
    lex = model.lexicon
    # Of words in a class, the model has their share of it.
    share = np.where(lex.types > 0, np.log10(lex.mass + 0.5 * (lex.types + 1)), 0.0)
    in_class = np.arange(MODEL_IDS) > MODEL_WORDS
    share[in_class & (lex.types == 0)] = np.log10(0.5)
    shared = spark.sparkContext.broadcast((lex, share, model.params.flat(), model.logs))

    @F.arrow_udf(FOUND)
    def find(column: pa.Array) -> pa.Array:
        lex, share, flat, logs = shared.value
        params, scale = Parameters.of(flat), np.log10(lex.n + 0.5 * (lex.v + 1))
        texts = column.to_pylist()
        rows: list[list[np.ndarray]] = [[] for _ in range(6)]
        for first, last in _pieces(texts):
            hashes, classes, sizes = tokens(texts[first:last])
            starts = np.cumsum(sizes) - sizes
            words, at, which = np.unique(hashes, return_index=True, return_inverse=True)
            place = lex.places(words)
            ids = np.where(place >= 0, lex.ids[place] if len(lex.ids) else 0, lex.class_ids[classes[at]])
            # The end is a target of its own even where training has none.
            log_count = np.log10(np.where(place >= 0, lex.counts[place] if len(lex.counts) else 0, 0) + 0.5)
            extra = np.where(ids > MODEL_WORDS, log_count - share[ids], 0.0)
            scored = token_logs(params, logs, ids[which]) + extra[which]
            rows[0].append(sizes)
            rows[1].append(np.add.reduceat((place >= 0)[which].astype(np.int64), starts))
            rows[2].append(np.add.reduceat(log_count[which], starts) - sizes * scale)
            rows[3].append(np.add.reduceat(scored, starts))
            rare = np.flatnonzero(place[which] < 0)
            owner = np.searchsorted(starts, rare, side="right") - 1
            codes, n = np.unique(owner * len(words) + which[rare], return_counts=True)
            ends = np.concatenate([[0], np.cumsum(np.bincount(codes // len(words), minlength=len(sizes)))]).astype(np.int32)
            rows[4].append(pa.ListArray.from_arrays(pa.array(ends), pa.array(words[codes % len(words)].view(np.int64))))
            rows[5].append(pa.ListArray.from_arrays(pa.array(ends), pa.array(n.astype(np.int64))))
        joined = [pa.array(np.concatenate(r)) if r else pa.array([], t) for r, t in zip(rows[:4], (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
        joined += [pa.chunked_array(r, pa.list_(pa.int64())).combine_chunks() for r in rows[4:]]
        joined = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in joined]
        return pa.StructArray.from_arrays(joined, names=["n_tokens", "n_known", "base", "model", "tail_h", "tail_n"])

    return find(text)


def score(df: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``, or all) with n_tokens, n_known, train_tokens,
    base_score and score of the text: base-10 logs of its probability under
    the unigram and under the model."""
    results = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = [c for c in (df.columns if keep is None else keep) if c not in results]
    found = df.select(F.struct(*kept).alias("row"), _found(model, df.sparkSession, F.col(text)).alias("found"))
    found = materialize(found.withColumn("at", F.monotonically_increasing_id()), "lm-found")
    rare = found.select("at", F.explode(F.arrays_zip(F.col("found.tail_h").alias("h"), F.col("found.tail_n").alias("n"))).alias("w")).select("at", "w.h", "w.n")
    # Unmet words are in the sums as words of count 0; those of the table add the rest.
    counted = rare.join(model.counts.where((F.col("c") < model.lexicon.cutoff) & (F.col("h") != int(END))).select("h", "c"), "h")
    more = F.col("n") * (F.log10(F.col("c") + 0.5) - F.log10(F.lit(0.5)))
    added = counted.groupBy("at").agg(F.sum("n").alias("known"), F.sum(more).alias("more")).withColumnRenamed("at", "of")
    whole = found.select("row", "at", "found.n_tokens", "found.n_known", "found.base", "found.model").join(added, F.col("at") == F.col("of"), "left")
    return whole.select(
        "row.*", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(model.lexicon.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("model") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
