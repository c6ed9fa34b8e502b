"""BPE encoding and decoding.

Encoding backtracks over longest token matches instead of merging pair by
pair. An Aho-Corasick automaton over the vocabulary yields, in one pass over a
word, the longest token that starts at each position. From left to right the
encoder takes the longest token whose pair with the token before it is
*compatible*, i.e. whose concatenation would be merged back into exactly this
pair; where none fits it shortens the token or backs up, and a position once
found hopeless is never entered again, so the work is linear in the word. The
result is the merge sequence's own result. Decoding looks ids up in an offset
table: one byte string that holds every token, and where each begins.

Vocabulary files come from the ``tokenizers`` format (JSON with ``vocab`` and
``merges``); their path is a parameter. The file's content is broadcast: its
size is checked against ``MAX_VOCABULARY_BYTES``.

Defined cases: a null or empty text has no ids and decodes to ''. Special
tokens written in a text get their own ids, as in that library. Extra columns
pass through; a column of the output's name is replaced. Rows are independent,
so repeated rows and ties need no rule, and a text of any length is handled
word by word.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from ledgerlens.llm.common import chunks, worker_object

MAX_VOCABULARY_BYTES = 16 << 20
#: Encoded words kept per worker: two generations of this many.
CACHED_WORDS = 150_000
#: Judged pairs kept per worker before they are forgotten.
CACHED_PAIRS = 300_000
#: Words of at most this many characters are cached.
CACHED_WORD_CHARS = 64
#: Bytes of text encoded and sent on at a time by ``code`` (one text at least).
TEXT_BYTES = 1 << 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level
    vocabularies: itself where Latin-1 has a visible one, else 256 and up in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in visible}
    hidden = (b for b in range(256) if b not in table)
    table |= {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class PairTable:
    """Merges of a vocabulary: what a pair becomes, and what a token was made of."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            whole = vocab[left.removesuffix(suffix) + right if suffix else left + right]
            pair = vocab[left], vocab[right]
            self.merged.setdefault(pair, (rank, whole))
            self.parts.setdefault(whole, (rank, *pair))
        self.known: dict[int, bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the texts of both tokens, side by side, merge to just these
        two. Undo the merges of the pair from the latest to the earliest: the
        pair is broken if at some moment the two tokens that touch could merge
        before the merge undone last on either side."""
        a, b = left, right
        # A merge across the border wins if it has a lower rank than the merge
        # that would take its left token away, or an equal or lower one than
        # the merge that would take its right token (leftmost goes first).
        limit, from_left = 1 << 62, False
        good = True
        while True:
            across = self.merged.get((a, b))
            if across is not None and (across[0] < limit or across[0] == limit and not from_left):
                good = False
                break
            pa_, pb_ = self.parts.get(a), self.parts.get(b)
            if pa_ is None and pb_ is None:
                break
            if pb_ is None or (pa_ is not None and pa_[0] > pb_[0]):
                limit, from_left, a = pa_[0], True, pa_[2]
            else:
                limit, from_left, b = pb_[0], False, pb_[1]
        if len(self.known) >= CACHED_PAIRS:
            self.known.clear()
        self.known[left << 32 | right] = good
        return good


class EncodedWords(dict):
    """word -> its ids as the bytes of 32-bit integers, encoded on first use.
    When full, the words move to an older generation, from which they come
    back if met again."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= CACHED_WORD_CHARS:
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Text to ids for one vocabulary (built once per worker process)."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pairs = PairTable(self.vocab, merges, suffix)
        self.mark = "\0" if suffix else ""
        self.alphabet = byte_alphabet()
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        pattern = _split_pattern(spec["pre_tokenizer"])
        self.words, self.latin_words = regex.compile(pattern), _spelled_out(pattern, 0x100)
        steps = _steps(spec.get("normalizer"), "normalizers")
        if not self.words.search("".join(map(chr, WHITE_SPACE))):
            steps = [s for s in steps if s["type"] != "Replace"]  # no word holds white space
        self.normal = [{"NFC": _nfc, "Lowercase": _lower, "Replace": _collapse}[s["type"]] for s in steps]
        automaton = ahocorasick.Automaton()
        #: By token id: characters, and the longest token that is a proper prefix (-1: none).
        self.size = [0] * (max(self.vocab.values(), default=0) + 1)
        self.shorter = [-1] * len(self.size)
        for token, token_id in self.vocab.items():
            whole = bool(suffix) and token.endswith(suffix) and len(token) > len(suffix)
            chars = token.removesuffix(suffix) + self.mark if whole else token
            automaton.add_word(chars, token_id)
            self.size[token_id] = len(chars)
            for n in range(len(chars) - 1, 0, -1):
                if (found := self.vocab.get(chars[:n])) is not None:
                    self.shorter[token_id] = found
                    break
        automaton.make_automaton()
        self.automaton = automaton
        self.cache = EncodedWords(self._word)

    def encode_word(self, chars: str) -> list[int]:
        """Ids of one word given in the byte alphabet, its end mark included."""
        n = len(chars)
        size, shorter = self.size, self.shorter
        longest = [-1] * (n + 1)
        for end, token in self.automaton.iter(chars):
            longest[end - size[token]] = token  # one before its start; later ends are longer
        token = longest[-1]  # the start at 0
        if size[token] == n and token >= 0:
            return [token]
        known, compatible = self.pairs.known, self.pairs.compatible
        hopeless: set[int] = set()
        out: list[int] = []
        at, last = 0, -1
        while True:
            while token >= 0:
                end = at + size[token]
                if end not in hopeless:
                    if last < 0:
                        break
                    good = known.get(last << 32 | token)
                    if good is None:
                        good = compatible(last, token)
                    if good:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                last, at = token, end
                token = longest[at - 1]
            else:
                if not out:
                    raise ValueError("the vocabulary can't spell this word")
                hopeless.add(at)
                token = out.pop()
                last = out[-1] if out else -1
                at -= size[token]
                token = shorter[token]

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            chars = word  # the alphabet leaves visible ASCII as it is
        else:
            chars = "".join(map(self.alphabet.__getitem__, word.encode("utf-8")))
        return array("i", self.encode_word(chars + self.mark)).tobytes()

    def _plain(self, text: str) -> bytes:
        for step in self.normal:
            text = step(text)
        words = self.latin_words if _is_latin(text) else self.words
        return b"".join(map(self.cache.__getitem__, words.findall(text)))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if self.special_at is None or "<" not in text:
            raw = self._plain(text)
        else:
            parts = self.special_at.split(text)
            raw = b"".join(array("i", [self.specials[p]]).tobytes() if p in self.specials else self._plain(p) for p in parts if p)
        return np.frombuffer(raw, dtype=np.int32)


def _steps(node: dict | None, inner: str) -> list[dict]:
    if not node:
        return []
    return [s for n in node[inner] for s in _steps(n, inner)] if node["type"] == "Sequence" else [node]


def _split_pattern(node: dict) -> str:
    steps = _steps(node, "pretokenizers")
    if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[1].get("use_regex"):
        raise ValueError("only a Split followed by plain ByteLevel is supported")
    return steps[0]["pattern"]["Regex"]


#: Code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _ranges(points: list[int]) -> str:
    """Ascending code points as the inside of a character class."""
    out, start = [], None
    for a, b in zip(points, [*points[1:], -1], strict=True):
        start = a if start is None else start
        if b != a + 1:
            out.append(f"\\U{start:08x}-\\U{a:08x}")
            start = None
    return "".join(out)


def _spelled_out(pattern: str, below: int) -> re.Pattern:
    """A pattern with the classes L, N and white space as ranges of code points
    below a bound: for texts of such characters it matches alike, and faster."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(below)]
    for name in "LN":
        pattern = pattern.replace(f"\\p{{{name}}}", _ranges([i for i, k in enumerate(kinds) if k == name]))
    return re.compile(pattern.replace("\\s", _ranges([c for c in WHITE_SPACE if c < below])))


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _nfc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def _lower(text: str) -> str:
    """Lower case character by character (a final sigma is not special)."""
    return text.replace("Σ", "σ").lower()


_SPACE = re.compile("[" + _ranges(WHITE_SPACE) + "]+")


def _collapse(text: str) -> str:
    return _SPACE.sub(" ", text)


class OffsetTable:
    """Decoding: token texts laid end to end, found by offset."""

    def __init__(self, spec: dict, separator: str = " ") -> None:
        texts = {i: t for t, i in spec["model"]["vocab"].items()}
        texts |= {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        rows = [(texts.get(i, "") + separator).encode("utf-8") for i in range(max(texts) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(rows), dtype=np.uint8)
        self.separator = len(separator.encode("utf-8"))

    def decode(self, ids: np.ndarray) -> bytes:
        """All tokens of the ids, joined by the separator."""
        if not len(ids):
            return b""
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        ends = np.cumsum(size)
        take = np.arange(ends[-1], dtype=np.int64) + np.repeat(start - (ends - size), size)
        whole = self.bytes[take]
        return whole[: len(whole) - self.separator].tobytes()


class _Tables:
    """Encoder and offset table of one vocabulary, built when first asked for."""

    def __init__(self, raw: str) -> None:
        self.raw = raw

    @cached_property
    def encoder(self) -> Encoder:
        return Encoder(json.loads(self.raw))

    @cached_property
    def offsets(self) -> OffsetTable:
        return OffsetTable(json.loads(self.raw))


def _tables(shared) -> _Tables:
    return worker_object("bpe", shared, _Tables)


def vocabulary(spark: SparkSession, path: str):
    """Broadcast a vocabulary file (bounded: ``MAX_VOCABULARY_BYTES``)."""
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than a vocabulary may be")
    return spark.sparkContext.broadcast(raw)


def _id_lists(encoder: Encoder, texts: Iterator[str | None]) -> pa.Array:
    """The ids of each text, laid end to end as they come."""
    flat, ends = bytearray(), [0]
    for t in texts:
        flat += encoder.encode(t).data
        ends.append(len(flat) // 4)
    ids = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(flat)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)


def _decoded(table: OffsetTable, rows: pa.Array) -> pa.Array:
    """The text of each list of ids (null: '')."""
    flat = rows.values.to_numpy(zero_copy_only=False)
    at = rows.offsets.to_numpy()
    gone = rows.is_null().to_pylist() if rows.null_count else None
    out = [b"" if gone and gone[i] else table.decode(flat[at[i]:at[i + 1]].astype(np.int64)) for i in range(len(rows))]
    return pa.array(out, pa.binary()).cast(pa.string())


def encode_column(shared, text: Column | str) -> Column:
    """array<int> of the token ids of a text column."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return _id_lists(_tables(shared).encoder, (t.as_py() for t in texts))

    return encode(F.col(text) if isinstance(text, str) else text)


def decode_column(shared, ids: Column | str) -> Column:
    """The text of an array<int> of token ids (null: ''), special tokens included."""

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        return _decoded(_tables(shared).offsets, rows)

    return decode(F.col(ids) if isinstance(ids, str) else ids)


def encode(df: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``df`` with the ids of ``text`` in column ``into``."""
    return df.withColumn(into, encode_column(vocabulary(df.sparkSession, path), text))


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids`` in column ``into``."""
    return df.withColumn(into, decode_column(vocabulary(df.sparkSession, path), ids))


def code(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the ids of ``text`` and what they decode to. Each text is
    encoded once, and results are sent on every ``TEXT_BYTES`` of text: a worker
    holds its input batch, not all ids and decoded texts of it."""
    shared = vocabulary(df.sparkSession, path)
    kept = [c for c in df.columns if c.lower() not in {ids.lower(), decoded.lower()}]
    rows = df.select(F.col(text), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(shared)
        for batch in batches:
            for first, last in chunks(pc.binary_length(batch.column(0)).fill_null(0).to_pylist(), TEXT_BYTES):
                part = batch.slice(first, last - first)
                lists = _id_lists(tables.encoder, (t.as_py() for t in part.column(0)))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], lists, _decoded(tables.offsets, lists)], names=[*kept, ids, decoded])

    schema = StructType(rows.schema.fields[1:])
    return rows.mapInArrow(run, schema.add(ids, ArrayType(IntegerType())).add(decoded, StringType()))
