"""Cross-tokenizer alignment: which tokens of two tokenizers lie over each other.

A text behind a blank is encoded by a byte-level BPE vocabulary (A) and by a
SentencePiece model that puts the blank itself (B). Each token covers a range
of bytes; both sequences of range ends ascend, and merging them gives all
overlaps and, where both end, the cuts between groups. The merge is
partitioned by merge paths: a binary search on each diagonal finds how many
ends of A and of B the merge has consumed there, so the diagonals cut it into
pieces of ``PIECE`` steps, whatever the mix of tokens, and every piece emits
its overlaps on its own. A group may run on over a piece's border: pieces look
one end back for a cut and hand on their cuts, from which the groups of all
pieces are stitched together.

A pair of ids counts in how many documents it is linked. Tasks add up the
distinct pairs of their documents, and the counts become a table that grows
with the corpus. Pairs of at least a count chosen so that they are at most
``HEAD_PAIRS`` are broadcast, with each A id's highest count (bounded by the
vocabulary); the other pairs of a document meet the table in a join.

Where both tokenizers provably split there, texts are cut at single blanks
between other characters, and a stretch's ids are kept per worker. Texts of any
length are handled in blocks of ``BLOCK`` characters, cut at such a place.

Vocabulary files are parameters; their size is checked before the broadcast.
Defined cases: a null or empty text has no tokens, nor has one whose tokens'
joined bytes differ from it; their groups are ''. Repeated rows are documents
of their own. Extra columns pass through, the result's columns replace those
of equal name.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.bpe import byte_alphabet
from ledgerlens.llm.common import chunks, materialize, worker_object

MAX_VOCABULARY_BYTES = 16 << 20
#: Steps of a piece of the merge.
PIECE = 1 << 16
#: Characters of a block, and of the blocks handled together.
BLOCK = 1 << 18
HEAD_PAIRS = 1 << 20
#: Stretches whose ids a worker keeps, and the longest of them.
CACHED, CACHED_CHARS = 150_000, 48
#: Pairs counted in a task before they are sent on.
COUNTED = 1 << 22
#: What A splits words by.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_GAP = re.compile(r"(?<=\S) (?=\S)")
#: A blank beside other white space or at an end.
_ODD = re.compile(r" \s|\s |\A\s|\s\Z")


class Tokenizers:
    """Both tokenizers, built once per worker process."""

    def __init__(self, spec: str, model: bytes) -> None:
        import sentencepiece

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tree = json.loads(spec)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        vocab = dict(tree["model"]["vocab"]) | {t["content"]: t["id"] for t in tree.get("added_tokens", [])}
        special = {t["content"] for t in tree.get("added_tokens", [])}
        byte_of = {c: i for i, c in enumerate(byte_alphabet())}
        texts = {i: t.encode() if t in special else bytes(map(byte_of.__getitem__, t)) for t, i in vocab.items()}
        self.a_texts = [texts.get(i, b"") for i in range(max(texts) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_texts = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes = np.array([len(t) for t in self.a_texts], np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_texts], np.int64)
        self.a_at, self.b_at = np.cumsum(self.a_sizes) - self.a_sizes, np.cumsum(self.b_sizes) - self.b_sizes
        self.a_bytes, self.b_bytes = np.frombuffer(b"".join(self.a_texts), np.uint8), np.frombuffer(b"".join(self.b_texts), np.uint8)
        self.encode_a = self._ranked(tree) or self._library(spec)
        # No piece has a blank behind another character, and texts are not rewritten.
        plain = b"identity" in model and not any("▁" in p.lstrip("▁") for p in pieces)
        self.splits = plain and tree.get("normalizer") is None and tree["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.kind = np.uint16 if max(len(self.a_texts), len(self.b_texts)) <= 1 << 16 else np.uint32
        self.a_ids: dict[str, bytes] = {}
        self.b_ids: dict[str, bytes] = {}
        self.bad: set[str] = set()
        # The decimal form of each id and a comma, end to end.
        rows = [f"{i},".encode() for i in range(max(len(self.a_texts), len(self.b_texts)))]
        self.digit_at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        self.digits = np.frombuffer(b"".join(rows), np.uint8)

    def _ranked(self, tree: dict):
        """The faster library, if a token's id is its merge's rank."""
        import tiktoken

        merges = [m.split(" ") if isinstance(m, str) else m for m in tree["model"]["merges"]]
        vocab, alphabet = tree["model"]["vocab"], byte_alphabet()
        if [vocab.get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))) or any(vocab.get(c, 256) > 255 for c in alphabet) or len(vocab) != 256 + len(merges):
            return None
        byte_of = {c: i for i, c in enumerate(alphabet)}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items()}
        encoding = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [encoding.encode_ordinary(t) for t in texts]

    def _library(self, spec: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(spec)
        library.no_truncation()
        library.no_padding()
        library.encode_special_tokens = True
        return lambda texts: [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]

    def stretches(self, text: str) -> list[str]:
        """A text cut where both tokenizers split, the blanks there left out."""
        if not self.splits:
            return [text]
        return _GAP.split(text) if _ODD.search(text) else text.split(" ")

    def blocks(self, text: str) -> list[str]:
        if not self.splits or len(text) <= BLOCK:
            return [text]
        out, start = [], 0
        while len(text) - start > BLOCK and (gap := _GAP.search(text, start + BLOCK)):
            out.append(text[start:gap.start()])
            start = gap.end()
        return [*out, text[start:]]

    def learn(self, stretches: set[str]) -> None:
        """Encode stretches not met before: those that may stand side by side as
        one text, the others one by one."""
        new = [s for s in stretches if s not in self.a_ids]
        whole = [s for s in new if not (s[0].isspace() or s[-1].isspace())] if self.splits else []
        if whole and self._learn_joined(whole):
            new = [s for s in new if s not in self.a_ids]
        if not new:
            return
        for s, a, b in zip(new, self.encode_a([" " + s for s in new]), self.b.encode(new, num_threads=1), strict=True):
            whole = (" " + s).encode()
            if b"".join(map(self.a_texts.__getitem__, a)) != whole or b"".join(map(self.b_texts.__getitem__, b)) != whole:
                self.bad.add(s)
                a, b = [], []
            self.a_ids[s], self.b_ids[s] = np.array(a, self.kind).tobytes(), np.array(b, self.kind).tobytes()

    def _learn_joined(self, stretches: list[str]) -> bool:
        """Ids of stretches from one encoding of all; False, and nothing learned,
        unless both tokenizers give back every byte and end where each ends."""
        text = " ".join(stretches)
        raw = np.frombuffer((" " + text).encode(), np.uint8)
        stops = np.cumsum([len(s.encode()) + 1 for s in stretches])
        slices = []
        for ids, sizes, at, pool in (
            (self.encode_a([" " + text])[0], self.a_sizes, self.a_at, self.a_bytes),
            (self.b.encode(text), self.b_sizes, self.b_at, self.b_bytes),
        ):
            ids = np.array(ids, np.int64)
            size = sizes[ids]
            ends = np.cumsum(size)
            if not len(ids) or ends[-1] != len(raw):
                return False
            if (pool[np.arange(ends[-1]) + np.repeat(at[ids] - (ends - size), size)] != raw).any():
                return False
            last = np.searchsorted(ends, stops)
            if (ends[last] != stops).any():
                return False
            cuts = [0, *((last + 1) * np.dtype(self.kind).itemsize).tolist()]
            slices.append((ids.astype(self.kind).tobytes(), cuts))
        for known, (ids, cuts) in zip((self.a_ids, self.b_ids), slices, strict=True):
            known.update(zip(stretches, map(ids.__getitem__, map(slice, cuts, cuts[1:])), strict=True))
        return True

    def forget(self, stretches: set[str]) -> None:
        """Keep what is cached within its bounds."""
        if len(self.a_ids) > CACHED:
            self.a_ids.clear(), self.b_ids.clear(), self.bad.clear()
        for s in stretches:
            if len(s) > CACHED_CHARS and self.a_ids.pop(s, None) is not None:
                del self.b_ids[s]
                self.bad.discard(s)


def merge_path(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of ``a`` the merge of two ascending sequences has taken after so
    many steps (of equal values a's goes first)."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at = np.where(open_, mid, 0)
        ahead = a[np.minimum(at, len(a) - 1)] <= b[np.clip(diagonals - 1 - at, 0, len(b) - 1)]
        low, high = np.where(open_ & ahead, mid + 1, low), np.where(open_ & ~ahead, mid, high)
    return low


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(links' tokens in a, in b, cuts' tokens in a, in b) of two sequences of
    range ends that cover the same bytes."""
    diagonals = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    taken = merge_path(a, b, diagonals) if len(a) else diagonals
    found = [_piece(a, b, i, j, p, q) for i, j, p, q in zip(taken[:-1], taken[1:], (diagonals - taken)[:-1], (diagonals - taken)[1:], strict=True)]
    if not found:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _piece(a: np.ndarray, b: np.ndarray, i: int, j: int, p: int, q: int) -> tuple[np.ndarray, ...]:
    """Overlaps and cuts of the piece that merges a[i:j] and b[p:q]."""
    own_a = np.arange(i, j)
    over_a = p + np.searchsorted(b[p:q], a[i:j])  # the token of b in which a's token ends
    cut = b[np.minimum(over_a, len(b) - 1)] == a[i:j]
    own_b = np.arange(p, q)
    over_b = i + np.searchsorted(a[i:j], b[p:q], side="right")
    # Where a's end is the same (in this piece or the last of the one before), a has it.
    alone = (over_b == 0) | (a[np.maximum(over_b, 1) - 1] != b[p:q])
    return np.concatenate([own_a, over_b[alone]]), np.concatenate([over_a, own_b[alone]]), own_a[cut], over_a[cut]


def _written(tok: Tokenizers, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends): all groups as ``a1,a2|b1;`` and where each group ends."""
    many_a, many_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    at_a = np.arange(len(a)) + np.repeat(np.cumsum(many_b) - many_b, many_a)
    at_b = np.arange(len(b)) + np.repeat(np.cumsum(many_a), many_b)
    ids = np.empty(len(a) + len(b), np.int64)
    ids[at_a], ids[at_b] = a, b
    start = tok.digit_at[ids]
    size = tok.digit_at[ids + 1] - start
    ends = np.cumsum(size)
    out = tok.digits[np.arange(ends[-1]) + np.repeat(start - (ends - size), size)]
    out[ends[at_a[cut_a]] - 1] = ord("|")
    out[ends[at_b[cut_b]] - 1] = ord(";")
    return out, ends[at_b[cut_b]]


@dataclass
class Aligned:
    """What has been found of one text."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    bad: bool = False

    def __post_init__(self) -> None:
        self.groups: list[bytes] = []
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def row(self) -> tuple:
        if self.bad or not self.n_a:
            return 0, 0, 0, 0, b"", b"", b""
        codes, counts = self.codes[0], self.counts[0]
        if len(self.codes) > 1:
            codes, back = np.unique(np.concatenate(self.codes), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate(self.counts)).astype(np.int64)
        steps = np.diff(codes, prepend=codes.dtype.type(0))
        return self.n_a, self.n_b, self.n_groups, self.n_links, b"".join(self.groups)[:-1], steps.tobytes(), counts.astype(np.uint32).tobytes()


def align_texts(tok: Tokenizers, texts: list[str | None]) -> list[Aligned]:
    out = [Aligned() for _ in texts]
    todo = [(k, block) for k, t in enumerate(texts) if t for block in tok.blocks(t)]
    wide = len(tok.a_texts) * len(tok.b_texts) > 1 << 32
    for first, last in chunks([len(block) for _, block in todo], BLOCK):
        split = [(k, tok.stretches(block)) for k, block in todo[first:last] if not out[k].bad]
        met = {s for _, parts in split for s in parts}
        tok.learn(met)
        if tok.bad and not tok.bad.isdisjoint(met):
            for k, parts in split:
                out[k].bad |= not tok.bad.isdisjoint(parts)
            split = [(k, parts) for k, parts in split if not out[k].bad]
        raw_a = [b"".join(map(tok.a_ids.__getitem__, parts)) for _, parts in split]
        raw_b = [b"".join(map(tok.b_ids.__getitem__, parts)) for _, parts in split]
        tok.forget(met)
        if not split:
            continue
        a, b = np.frombuffer(b"".join(raw_a), tok.kind), np.frombuffer(b"".join(raw_b), tok.kind)
        size = a.itemsize
        link_a, link_b, cut_a, cut_b = overlaps(np.cumsum(tok.a_sizes[a]), np.cumsum(tok.b_sizes[b]))
        text, ends = _written(tok, a, b, cut_a, cut_b)
        # Blocks end at cuts: by tokens of A, links, groups and bytes.
        many_a, many_b = np.array([len(r) // size for r in raw_a]), np.array([len(r) // size for r in raw_b])
        stop_a = np.cumsum(many_a)
        stop_group = np.searchsorted(cut_a, stop_a - 1, side="right")
        stop_text = ends[stop_group - 1]
        owner = np.searchsorted(stop_a, link_a, side="right")
        many_links = np.bincount(owner, minlength=len(split))
        pairs = a[link_a].astype(np.uint64) * np.uint64(len(tok.b_texts)) + b[link_b]
        # Blocks of a chunk are few: sorted by pair, then block by block.
        order = np.argsort(pairs, kind="stable")
        order = order[np.argsort(owner[order].astype(np.uint16) if len(split) < 1 << 16 else owner[order], kind="stable")]
        pairs, owner = pairs[order], owner[order]
        fresh = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (owner[1:] != owner[:-1])]))
        counts = np.diff(fresh, append=len(pairs))
        pairs, owner = pairs[fresh].astype(np.uint64 if wide else np.uint32), owner[fresh]
        edges = np.searchsorted(owner, np.arange(len(split) + 1))
        raw = text.tobytes()
        begin = group = 0
        for n, (k, _) in enumerate(split):
            o = out[k]
            o.n_a, o.n_b, o.n_links = o.n_a + int(many_a[n]), o.n_b + int(many_b[n]), o.n_links + int(many_links[n])
            o.n_groups += int(stop_group[n]) - group
            o.groups.append(raw[begin:stop_text[n]])
            begin, group = int(stop_text[n]), int(stop_group[n])
            o.codes.append(pairs[edges[n]:edges[n + 1]])
            o.counts.append(counts[edges[n]:edges[n + 1]])
    return out


@dataclass
class Vocabularies:
    """Both vocabularies' files as one broadcast."""

    shared: object
    width: int  # ids of B
    wide: bool  # whether a pair needs 64 bits

    def code_type(self) -> type:
        return np.uint64 if self.wide else np.uint32


def vocabularies(spark: SparkSession, a_path: str, b_path: str) -> Vocabularies:
    """Read and broadcast a tokenizers file (A) and a SentencePiece model (B)."""
    import sentencepiece

    with open(a_path, encoding="utf-8") as f:
        spec = f.read()
    with open(b_path, "rb") as f:
        model = f.read()
    if max(len(spec), len(model)) > MAX_VOCABULARY_BYTES:
        raise ValueError("a file is larger than a vocabulary may be")
    width = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    tree = json.loads(spec)
    most = max([*tree["model"]["vocab"].values(), *(t["id"] for t in tree.get("added_tokens", []))])
    return Vocabularies(spark.sparkContext.broadcast((spec, model)), width, (most + 1) * width > 1 << 32)


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups string, pair_steps binary, pair_counts binary"


def align_column(vocab: Vocabularies, text: Column | str) -> Column:
    """struct of a text's tokens, groups and links: counts, the groups as
    ``a1,a2|b1;a3|b2,b3`` (ids in order), and its distinct linked pairs, as
    steps between ascending codes (A id times B's ids, plus B id) and how often
    each is linked."""
    shared = vocab.shared

    @F.arrow_udf(ALIGNED)
    def align(column: pa.Array) -> pa.Array:
        tok = worker_object("alignment", shared, lambda files: Tokenizers(*files))
        texts = column.to_pylist()
        rows = []
        for first, last in chunks([len(t or "") for t in texts], 4 * BLOCK):
            rows += [x.row() for x in align_texts(tok, texts[first:last])]
        kinds = [pa.int64()] * 4 + [pa.binary()] * 3
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        columns[4] = columns[4].cast(pa.string())
        return pa.StructArray.from_arrays(columns, names=["n_a", "n_b", "n_groups", "n_links", "groups", "pair_steps", "pair_counts"])

    return align(F.col(text) if isinstance(text, str) else text)


def _codes(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(codes, sizes) of a column of steps: all rows' codes end to end."""
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)) // np.dtype(kind).itemsize
    steps = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column]) if len(column) else np.empty(0, kind)
    total = np.cumsum(steps, dtype=np.uint64)
    starts = np.cumsum(sizes) - sizes
    before = np.where(starts > 0, total[np.maximum(starts, 1) - 1] if len(total) else 0, 0).astype(np.uint64)
    return total - np.repeat(before, sizes), sizes


def pair_counts(aligned: DataFrame, vocab: Vocabularies) -> DataFrame:
    """(code, docs): in how many rows each pair of ids is linked. aligned: has
    ``pair_steps``."""
    kind = vocab.code_type()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def taken() -> pa.RecordBatch:
            codes, docs = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(docs.astype(np.int64))], names=["code", "docs"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                codes, _ = _codes(batch.column(0).slice(at, 500), kind)
                held.append(codes.astype(kind))
                size += len(codes)
                if size >= COUNTED:
                    yield taken()
                    held, size = [], 0
        if held:
            yield taken()

    parts = aligned.select("pair_steps").mapInArrow(count, "code long, docs long")
    return parts.groupBy("code").agg(F.sum("docs").alias("docs"))


@dataclass
class PairTable:
    """Counts of pairs: the table, and the part that every task gets."""

    counts: DataFrame
    cutoff: int
    shared: object


def pair_table(counts: DataFrame, vocab: Vocabularies, head_pairs: int = HEAD_PAIRS) -> PairTable:
    spark = counts.sparkSession
    bins = counts.groupBy(F.floor(F.log2("docs") * 8).alias("bin")).agg(F.min("docs").alias("least"), F.count(F.lit(1)).alias("n"))
    cutoff, room = 1 << 62, head_pairs
    for row in sorted(bins.collect(), key=lambda r: -r["bin"]):
        room -= row["n"]
        if room < 0:
            break
        cutoff = row["least"]
    head = counts.where(F.col("docs") >= cutoff).toArrow()
    codes, docs = head.column("code").to_numpy().astype(vocab.code_type()), head.column("docs").to_numpy()
    order = np.argsort(codes)
    a_id = F.floor(F.col("code") / vocab.width).cast("long")
    best = counts.groupBy(a_id.alias("a")).agg(F.max("docs").alias("docs")).toArrow()
    highest = np.zeros(max(best.column("a").to_pylist(), default=-1) + 1, np.int64)
    highest[best.column("a").to_numpy()] = best.column("docs").to_numpy()
    return PairTable(counts, cutoff, spark.sparkContext.broadcast((codes[order], docs[order], highest)))


LINKED = "n_best long, count_sum long, codes array<long>, n array<long>, best array<long>"


def _linked(vocab: Vocabularies, table: PairTable, steps: Column, counts: Column) -> Column:
    """n_best and count_sum as far as the head tells, and the other pairs."""
    shared, kind, width = table.shared, vocab.code_type(), vocab.width

    @F.arrow_udf(LINKED)
    def link(steps: pa.Array, counts: pa.Array) -> pa.Array:
        head, docs, highest = shared.value
        parts = []
        for at in range(0, len(steps), 500):
            codes, sizes = _codes(steps.slice(at, 500), kind)
            n = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in counts.slice(at, 500)]).astype(np.int64)
            found, back = np.unique(codes, return_inverse=True)
            place = np.minimum(np.searchsorted(head, found.astype(kind)), max(0, len(head) - 1))
            hit = head[place] == found if len(head) else np.zeros(len(found), bool)
            count = np.where(hit, docs[place] if len(docs) else 0, 0)
            top = highest[found // np.uint64(width)] if len(found) else count
            owner = np.repeat(np.arange(len(sizes)), sizes)
            add = lambda w: np.bincount(owner, weights=w, minlength=len(sizes)).astype(np.int64)
            rare = ~hit[back]
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[rare], minlength=len(sizes)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[rare].astype(np.int64))) for x in (codes, n, top[back])]
            parts.append([pa.array(add(n * (hit & (count == top))[back])), pa.array(add(n * count[back])), *lists])
        kinds = [pa.int64()] * 2 + [pa.list_(pa.int64())] * 3
        columns = [pa.concat_arrays([p[i] for p in parts]) if parts else pa.array([], kinds[i]) for i in range(5)]
        return pa.StructArray.from_arrays(columns, names=["n_best", "count_sum", "codes", "n", "best"])

    return link(steps, counts)


def with_link_counts(aligned: DataFrame, vocab: Vocabularies, table: PairTable) -> DataFrame:
    """``aligned`` with n_best (links whose pair's count is its A id's highest)
    and count_sum (counts added up over links) for its pairs."""
    kept = [c for c in aligned.columns if c not in ("pair_steps", "pair_counts", "n_best", "count_sum")]
    found = aligned.select(F.struct(*kept).alias("row"), _linked(vocab, table, F.col("pair_steps"), F.col("pair_counts")).alias("found"))
    found = materialize(found.withColumn("at", F.monotonically_increasing_id()), "alignment-linked")
    rare = found.select("at", F.explode(F.arrays_zip(*[F.col(f"found.{c}").alias(c) for c in ("codes", "n", "best")])).alias("p")).select("at", "p.codes", "p.n", "p.best")
    counts = table.counts.where(F.col("docs") < table.cutoff)
    met = rare.join(counts, F.col("codes") == F.col("code"))
    added = met.groupBy(F.col("at").alias("of")).agg(
        F.sum(F.col("n") * F.col("docs")).alias("more"), F.sum(F.when(F.col("docs") == F.col("best"), F.col("n")).otherwise(0)).alias("more_best")
    )
    whole = found.select("row", "at", "found.n_best", "found.count_sum").join(added, F.col("at") == F.col("of"), "left")
    return whole.select(
        "row.*", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum")
    )


def align(df: DataFrame, vocab: Vocabularies, text: str = "text") -> DataFrame:
    """``df`` with the columns of ``align_column``."""
    names = [x.split(" ")[0] for x in ALIGNED.split(", ")]
    kept = [c for c in df.columns if c not in names]
    found = df.select(F.struct(*kept).alias("row"), align_column(vocab, F.col(text)).alias("found"))
    return found.select("row.*", "found.*")
