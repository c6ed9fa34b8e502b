"""Line dedup by an exact set-similarity join.

A line's set is its distinct words. Two lines match if the Jaccard similarity
of their sets reaches num/den; a line goes if it matches an earlier one, by
document id, then text digest, then line number, whether or not that one
goes too. Every line with a word takes part, however short; lines without a
word (blank ones) stay.

1. Words are counted over all lines, by hash bucket (``BUCKETS`` counters, kept
   as eighths of a power of two), and each line's words are ordered from rare
   to frequent. Lines with equal sets become one class, known by its first line.
2. Prefix filter: matching lines share a word of their first
   n - ceil(n * num / den) + 1, and another of one word more. A word that
   occurs at most ``LIST_LIMIT`` times is a key by itself, so its list is short; a
   more frequent one is a key together with each that follows it in the prefix.
   Sets so small that only an equal one can match have no keys: their class
   decides. Sets that one common word may suffice for (num/den of 1/2 or less)
   have their frequent words as keys as well.
3. Entries (a key and a class) are dealt by blocks of keys, and each block's lists
   formed where it arrives. Classes of a key's list are joined if sizes (length
   filter), positions (positional filter) and a 64-bit parity of the sets, which
   can't differ in more bits than the sets do in words, allow a match; a parity of
   128 bits tests the pairs so found. A list that yields more
   than ``LONG_LIST`` / 16 pairs a member, or is longer than ``LIST_LIMIT``, isn't
   joined with itself: its members are compared with the first class of the list,
   and only those that do not match it with the other earlier ones. So a group
   of near copies costs no more than its members, and no match is lost that
   decides about a line.
4. What remains is verified on the full sets, built for candidates only, in one
   reading of the texts.

Texts are rewritten by Spark's functions where the removed lines' documents are
joined by id and Spark's hash of the text; other documents aren't shuffled.

Words: A-Z in lower case, runs of characters other than blank, tab, vertical
tab, form feed and carriage return; compared by 64-bit hashes, sets by 128
bits. Defined cases: null and empty texts stay as they are; a null document id
comes first; rows of equal id and text are one document and change alike;
extra columns pass through, a column ``n_chars`` is counted anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import chunks, drop_worker_objects, hash_words, materialize, mix, set_aside, text_bytes
from ledgerlens.llm.ngram_join import _bit_table, in_table, suspect_column
from ledgerlens.llm.setjoin import distinct_sorted, sums

NUM, DEN = 80, 100
#: Lines of fewer distinct words are left alone: only those without any.
LEAST_WORDS = 1
BUCKETS = 1 << 21
#: A list this long costs about what the pairs of a prefix cost as keys.
LIST_LIMIT = 1000
LONG_LIST = 256
#: Bits of the table of candidate lines, a broadcast of 16 MB at any size of input.
NEEDED_BITS = 1 << 27
#: Entries of lists dealt at a time, and the least held before lists are sifted.
ROWS_AT_ONCE = 1 << 18
#: Classes that a task remembers.
MET = 1 << 20
#: Sets that a task remembers.
SETS_MET = 1 << 17
#: Keys are dealt in this many blocks at least, and this many a part of the lines.
LEAST_BLOCKS, BLOCKS_A_PART = 1 << 12, 8
#: Counters sent together.
BLOCK = 1 << 15
#: Bytes of text handled at a time: the arrays of its words take some fifty times
#: that, each less than the C library returns to the system when it is freed.
TEXT_BYTES = 1 << 18


def _runs(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first, texts) of the runs of a batch's texts that are handled at a time."""
    for first, last in chunks(pc.binary_length(column).fill_null(0).to_pylist(), TEXT_BYTES):
        yield first, column.slice(first, last - first).to_pylist()


def _joined_runs(column: pa.Array) -> Iterator[bytes]:
    """The texts of each such run (null: empty) with line feeds between them."""
    for first, last in chunks(pc.binary_length(column).fill_null(0).to_pylist(), TEXT_BYTES):
        run = column.slice(first, last - first).fill_null("")
        offsets = pa.array([0, len(run)], pa.int32())
        yield pc.binary_join(pa.ListArray.from_arrays(offsets, run), pa.scalar("\n", run.type))[0].as_buffer().to_pybytes()


def _line_words(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, document, line, word hash, owner) for runs of texts: the
    lines that have words, by text and number, and their words."""
    for first, last in chunks([len(t or "") for t in texts], TEXT_BYTES):
        raws = [text_bytes(t).lower() for t in texts[first:last]]
        raw = b"\n".join(raws)
        with np.errstate(over="ignore"):
            values, starts = hash_words(raw)
        breaks, sizes, used, owner = _by_line(raw, starts)
        begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])[:-1]])
        first_word = (np.cumsum(sizes) - sizes)[used]
        doc = np.searchsorted(begins, starts[first_word], side="right") - 1
        line = used - np.searchsorted(breaks, begins[doc])
        yield first, last, doc, line.astype(np.int32), values, owner


def _by_line(raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(breaks, sizes, used, owner): where lines end, how many words each has,
    the numbers of those with words, and which of these each word belongs to."""
    breaks = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10)
    bounds = np.searchsorted(starts, breaks)  # words before each line's end
    sizes = np.diff(np.concatenate([[0], bounds, [len(starts)]]))
    used = np.flatnonzero(sizes)  # line numbers over all texts
    return breaks, sizes, used, np.repeat(np.arange(len(used)), sizes[used])


def _bucket(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(20)) & np.uint64(BUCKETS - 1)


def word_counts(docs: DataFrame, text: str) -> np.ndarray:
    """How often words occur over all lines, by bucket, as ceil(8 * log2(n))
    (0: once or never); BUCKETS bytes. Tasks count apart and send the counters
    that aren't zero, ``BLOCK`` at a time, to be added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_objects()
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for raw in _joined_runs(batch.column(0)):
                with np.errstate(over="ignore"):
                    values, _starts = hash_words(raw.lower())
                np.add.at(total, _bucket(values).astype(np.int64), 1)
        for block, part in enumerate(total.reshape(-1, BLOCK)):
            full = np.flatnonzero(part)
            if len(full):
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "at": [full.astype(np.uint16).tobytes()], "n": [part[full].tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = totals.setdefault(block, np.zeros(BLOCK, dtype=np.int64))
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int64)
        for block, total in totals.items():
            codes = np.ceil(8 * np.log2(np.maximum(total, 1))).clip(0, 255).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "codes": [codes.tobytes()]})

    parts = docs.select(F.col(text).alias("text")).mapInArrow(count, "block int, at binary, n binary")
    out = np.zeros(BUCKETS, dtype=np.uint8)
    for block, codes in parts.repartition("block").mapInArrow(add, "block int, codes binary").collect():
        out[block * BLOCK:(block + 1) * BLOCK] = np.frombuffer(codes, np.uint8)
    return out


def _ordered(values: np.ndarray, owner: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order by owner, rank, value."""
    if len(owner) and int(owner[-1]) < 1 << 17:
        packed = owner.astype(np.uint64) << np.uint64(47) | rank.astype(np.uint64) << np.uint64(39) | values >> np.uint64(25)
        order = np.argsort(packed)
        p, v = packed[order], values[order]
        if not ((p[1:] == p[:-1]) & (v[1:] != v[:-1])).any():
            return order
    return np.lexsort((values, rank, owner))


def _set_ids(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set, whatever the order of its values."""
    return mix(sums(values, starts)).view(np.int64), mix(sums(mix(values ^ np.uint64(0x13198A2E03707344)), starts)).view(np.int64)


#: keys: 64-bit keys one after another, places: as many 32-bit positions.
LINES = "doc_id long, td long, th long, line int, k1 long, k2 long, n int, bits long, p1 long, p2 long, keys binary, places binary"


def line_index(docs: DataFrame, doc_id: str, text: str, counts, num: int, den: int, limit: int) -> DataFrame:
    """One row per line with a word: where it is (``td`` orders texts of one id,
    ``th`` is Spark's hash of the text), its set's id, size and parity, the words and pairs that are its keys and their positions."""
    code = int(8 * np.log2(limit))  # of the counters that stand for at most limit

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_objects()
        rarity = np.frombuffer(counts.value, dtype=np.uint8)
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for at, texts in _runs(batch.column(1)):
                for first, last, doc, line, values, owner in _line_words(texts):
                    with np.errstate(over="ignore"):
                        part = _index_lines(values, owner, len(line), rarity, num, den, code)
                    if part is None:
                        continue
                    keep, columns = part
                    td = np.array([xxhash.xxh3_64_intdigest(text_bytes(t)) for t in texts[first:last]], dtype=np.uint64).view(np.int64)
                    where = doc[keep]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(at + first + where)), pa.array(td[where]), batch.column(2).take(pa.array(at + first + where)), pa.array(line[keep]), *columns],
                        names=["doc_id", "td", "th", "line", "k1", "k2", "n", "bits", "p1", "p2", "keys", "places"],
                    )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    return rows.mapInArrow(index, LINES)


def _index_lines(values, owner, n_lines, rarity, num, den, limit):
    if not len(values):
        return None
    rank = rarity[_bucket(values).astype(np.int64)]
    order = _ordered(values, owner, rank)
    values, owner, rank = values[order], owner[order], rank[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner, rank = values[fresh], owner[fresh], rank[fresh]
    sizes = np.bincount(owner, minlength=n_lines)
    keep = np.flatnonzero(sizes >= LEAST_WORDS)
    if not len(keep):
        return None
    number = np.full(n_lines, -1)
    number[keep] = np.arange(len(keep))
    inside = number[owner] >= 0
    values, owner, rank = values[inside], number[owner[inside]], rank[inside]
    sizes = sizes[keep]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    k1, k2 = _set_ids(values, starts)
    bits = np.bitwise_xor.reduceat(np.uint64(1) << (values & np.uint64(63)), starts).view(np.int64)
    # A parity of 128 bits in two halves, for the pairs that the lists yield.
    bit, half = np.uint64(1) << ((values >> np.uint64(6)) & np.uint64(63)), (values >> np.uint64(12)) & np.uint64(1)
    p1, p2 = (np.bitwise_xor.reduceat(np.where(half == side, bit, np.uint64(0)), starts).view(np.int64) for side in (0, 1))
    pos = np.arange(len(values)) - starts[owner]
    common = -(-sizes * num // den)  # words that a match shares at least
    prefix = sizes - common + 1
    near = (den * sizes >= num * (sizes + 1))[owner]  # a set of one word more or less can match
    rare = near & (pos < prefix[owner]) & (rank > 0) & (rank <= limit)
    hot = near & (pos <= prefix[owner]) & (rank > limit)
    one = np.flatnonzero(near & (common == 1)[owner] & (rank > limit))
    hv, hp, ho = values[hot], pos[hot], owner[hot]
    # Pairs of frequent words: each with the one that stands 1, 2, ... places on.
    keys, where, who = [values[one]], [pos[one]], [owner[one]]
    step = 1
    while step < len(hv):
        same = np.flatnonzero(ho[step:] == ho[:-step])
        if not len(same):
            break
        keys.append(mix(hv[same] * np.uint64(0xC2B2AE3D27D4EB4F) + hv[same + step]))
        where.append(hp[same + step] - 1)  # one common word stands before it
        who.append(ho[same])
        step += 1
    keys, where, who = (np.concatenate([*x, y]) for x, y in ((keys, values[rare]), (where, pos[rare]), (who, owner[rare])))
    order = np.argsort(who, kind="stable")
    ends = np.cumsum(np.bincount(who, minlength=len(sizes)))
    return keep, [pa.array(k1), pa.array(k2), pa.array(sizes.astype(np.int32)), pa.array(bits), pa.array(p1), pa.array(p2),
                  _binaries(keys[order], ends), _binaries(where[order].astype(np.uint32), ends)]


def _binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of values, one after another up to each of ``ends``, as their bytes."""
    offsets = np.concatenate([[0], ends]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _offsets(owner: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32), pa.int32())


def _place(td: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A line's place (text digest and number) as one hash."""
    with np.errstate(over="ignore"):
        return mix(td.astype(np.uint64) ^ (line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _place_column(td: str, line: str) -> Column:
    @F.arrow_udf("long")
    def place(tds: pa.Array, lines: pa.Array) -> pa.Array:
        drop_worker_objects()
        return pa.array(_place(tds.to_numpy(zero_copy_only=False).view(np.uint64), lines.to_numpy(zero_copy_only=False)).view(np.int64))

    return place(F.col(td), F.col(line))


def word_sets(docs: DataFrame, text: str, needed) -> DataFrame:
    """(k1, k2, n, words) of the lines whose place is in the bit table. A task
    leaves out sets that it has met not long ago, as copies of a text have them."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_objects()
        bits = np.frombuffer(needed.value, dtype=np.uint8)
        # As in dealt_entries; a set is met if both halves of its name are.
        met = np.stack([~np.arange(SETS_MET), np.zeros(SETS_MET, np.int64)])
        for batch in batches:
            for _at, texts in _runs(batch.column(0)):
                raws = [text_bytes(t) for t in texts]
                raw = b"\n".join(raws)
                ends = np.append(np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10), len(raw))
                sizes = np.array([r.count(b"\n") + 1 for r in raws])  # lines of each text
                td = np.array([xxhash.xxh3_64_intdigest(r) for r in raws], dtype=np.uint64)
                line = np.arange(len(ends)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                hit = np.flatnonzero(in_table(bits, _place(np.repeat(td, sizes), line.astype(np.int32))))
                wanted = b"\n".join([raw[begin:end] for begin, end in zip((np.append(-1, ends)[hit] + 1).tolist(), ends[hit].tolist())]).lower()
                with np.errstate(over="ignore"):
                    values, starts = hash_words(wanted)
                if len(values):
                    values, owner = distinct_sorted(values, _by_line(wanted, starts)[3])
                    sizes = np.bincount(owner)
                    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                    with np.errstate(over="ignore"):
                        k1, k2 = _set_ids(values, starts)
                    at = k1 & (SETS_MET - 1)
                    new = np.flatnonzero((met[0][at] != k1) | (met[1][at] != k2))
                    met[0][at], met[1][at] = k1, k2
                    words = pa.ListArray.from_arrays(_offsets(owner, len(sizes)), pa.array(values.view(np.int64)))
                    rows = pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(sizes.astype(np.int32)), words], names=["k1", "k2", "n", "words"])
                    yield rows.take(pa.array(new))

    return docs.select(F.col(text).alias("text")).mapInArrow(build, "k1 long, k2 long, n int, words array<long>")


def _may_match(a: str, b: str, num: int, den: int) -> Column:
    """Length, positional and parity filters between two keyed rows."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    length = F.lit(den) * F.least(n, m) >= F.lit(num) * F.greatest(n, m)
    rest = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
    position = F.lit(num + den) * rest >= F.lit(num) * (n + m)
    parity = F.lit(num + den) * F.bit_count(F.col(f"{a}.bits").bitwiseXOR(F.col(f"{b}.bits"))) <= F.lit(den - num) * (n + m)
    return length & position & parity


def _list_pairs(key, k1, n, pos, bits, num: int, den: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y), x < y: the classes of each key's list that may match, and the keys
    of lists with more than ``most`` such pairs a member, given up. Entries come
    by key and class, each once. Lists are walked by size, each member up to the last that the length filter allows."""
    number = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(key) else np.empty(0, np.int64)
    place = number << 16 | n
    order = np.argsort(place, kind="stable")
    place, key, k1, n, pos, bits = place[order], key[order], k1[order], n[order].astype(np.int64), pos[order].astype(np.int64), bits[order]
    stop = np.searchsorted(place, number << 16 | np.minimum(den * n // num, MOST), side="right")  # the length filter
    room = np.bincount(number) * most
    left, right, at, step = [], [], np.arange(len(key)), 1
    while len(at := at[at + step < stop[at]]):
        # The parity first, which few pairs pass; then the positions.
        differ = np.bitwise_count(bits[at] ^ bits[at + step]).astype(np.int64)
        i = at[(num + den) * differ <= (den - num) * (n[at] + n[at + step])]
        j = i + step
        ok = (num + den) * np.minimum(n[i] - pos[i], n[j] - pos[j]) >= num * (n[i] + n[j])
        if ok.any():
            left.append(i[ok])
            right.append(j[ok])
            np.subtract.at(room, number[i[ok]], 1)
            at = at[room[number[at]] >= 0]
        step += 1
    i, j = (np.concatenate([np.empty(0, np.int64), *x]) for x in (left, right))
    stays = room[number[i]] >= 0
    x, y = k1[i[stays]], k1[j[stays]]
    return np.minimum(x, y), np.maximum(x, y), key[np.flatnonzero(np.diff(number, prepend=-1))][room < 0]


#: A class in a key's list. Of a key, the 32 bits after those of its block: two
#: keys that share them have one list, which costs time and loses nothing. A size
#: beyond ``MOST`` counts as that, at position 0: the filters then let more pairs
#: through (so large sets differ in more words than a parity has bits).
ENTRY = np.dtype([("k1", np.int64), ("bits", np.uint64), ("key", np.uint32), ("n", np.uint16), ("pos", np.uint16)])
MOST = (1 << 16) - 1


def dealt_entries(lines: DataFrame, bits: int) -> DataFrame:
    """(block, entries): the entries of all lists by the first ``bits`` bits of
    their keys. A task leaves out classes that it has met not long ago: all lines
    of a class have the same entries."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_objects()
        # A class is remembered at the place of its last bits, where another of
        # the same bits follows it; at first, by values that belong elsewhere.
        met, held, size = ~np.arange(MET), [], 0
        for batch in batches:
            k1 = batch.column(0).to_numpy()
            at = np.unique(k1, return_index=True)[1]
            at = at[met[k1[at] & (MET - 1)] != k1[at]]
            met[k1[at] & (MET - 1)] = k1[at]
            chosen = [c.take(pa.array(at)) for c in batch.columns]
            keys = np.frombuffer(b"".join(chosen[3].to_pylist()), np.uint64)
            owner = np.repeat(np.arange(len(at)), pc.binary_length(chosen[3]).to_numpy() // 8)
            n, pos = chosen[1].to_numpy()[owner], np.frombuffer(b"".join(chosen[4].to_pylist()), np.uint32)
            part = np.empty(len(keys), ENTRY)
            part["key"], part["n"], part["pos"] = keys >> np.uint64(32 - bits), np.minimum(n, MOST), np.where(n < MOST, pos, 0)
            part["k1"], part["bits"] = (chosen[i].to_numpy()[owner] for i in (0, 2))
            held.append(((keys >> np.uint64(64 - bits)).astype(np.int32), part))
            size += len(part)
            if size >= ROWS_AT_ONCE:
                yield blocks(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if size:
            yield blocks(*map(np.concatenate, zip(*held)))

    def blocks(block: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
        # A stable sort of 16-bit numbers takes linear time.
        order = np.argsort(block.astype(np.uint16) if bits <= 16 else block, kind="stable")
        block = block[order]
        ends = np.flatnonzero(np.diff(block, append=-1)) + 1
        return pa.RecordBatch.from_arrays([pa.array(block[ends - 1]), _binaries(part[order], ends)], names=["block", "entries"])

    return lines.select("k1", "n", "bits", "keys", "places").mapInArrow(deal, "block int, entries binary")


def _by_key(key: np.ndarray, k1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, key, k1) of entries by key and class: those of a key by the first
    half of the class, and by the whole where two classes share that."""
    packed = key.astype(np.uint64) << np.uint64(32) | k1.view(np.uint64) >> np.uint64(32)
    order = np.argsort(packed)
    packed, classes = packed[order], k1[order]
    if ((packed[1:] == packed[:-1]) & (classes[1:] != classes[:-1])).any():
        order = np.lexsort((k1, key))
        return order, key[order], k1[order]
    return order, (packed >> np.uint64(32)).astype(np.uint32), classes


class _Block:
    """The lists of a block of keys, as their entries come. A list found to be
    longer than ``limit`` isn't held: its entries go on as members."""

    def __init__(self, limit: int) -> None:
        self.limit, self.held, self.size, self.room, self.long = limit, [], 0, ROWS_AT_ONCE, np.empty(0, np.uint32)

    def add(self, entries: np.ndarray) -> np.ndarray:
        """Takes entries; returns those of lists that aren't held."""
        gone = np.isin(entries["key"], self.long)
        self.held.append(entries[~gone])
        self.size += len(entries) - int(gone.sum())
        return np.concatenate([entries[gone], self.sift()]) if self.size > self.room else entries[gone]

    def sift(self, last: bool = False) -> np.ndarray:
        """Holds each entry once, and at the ``last`` time only lists of several;
        returns those of lists that have become too long."""
        rows = np.concatenate([np.empty(0, ENTRY), *self.held])
        order, key, k1 = _by_key(np.ascontiguousarray(rows["key"]), np.ascontiguousarray(rows["k1"]))
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        fresh = new.copy()
        fresh[1:] |= k1[1:] != k1[:-1]
        if last:
            fresh &= ~(new & np.append(new[1:], True))
        rows, key = rows[order[fresh]], key[fresh]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        sizes = np.diff(starts, append=len(key))
        self.long = np.union1d(self.long, key[starts[sizes > self.limit]])
        gone = np.repeat(sizes > self.limit, sizes)
        self.held, self.size = [rows[~gone]], int((~gone).sum())
        self.room = max(ROWS_AT_ONCE, 2 * self.size)
        return rows[gone]


LISTS = "key long, x long, y long, n int, pos int, bits long, member boolean"


def joined_lists(lines: DataFrame, num: int, den: int, limit: int, most: int) -> DataFrame:
    """Classes x and y that share a key and may match, or (``member``) a key and
    class x of a list that is longer than ``limit`` or yields more than ``most``
    pairs a member. Keys are dealt in blocks, so many that a task holds few lists."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_objects()
        block, lists, sifted, size = None, _Block(limit), [], 0
        for batch in batches:
            of = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for first, last in zip(cuts, cuts[1:]):
                if last > first and of[first] != block:
                    yield from members(block, lists.sift(last=True))
                    sifted.append((block, lists.held[0]))
                    size += lists.size
                    block, lists = int(of[first]), _Block(limit)
                    if size >= ROWS_AT_ONCE:
                        yield from found(sifted)
                        sifted, size = [], 0
                for a, b in chunks(pc.binary_length(batch.column(1).slice(first, last - first)).to_pylist(), ENTRY.itemsize * ROWS_AT_ONCE):
                    entries = b"".join(batch.column(1).slice(first + a, b - a).to_pylist())
                    yield from members(block, lists.add(np.frombuffer(entries, ENTRY)))
        yield from members(block, lists.sift(last=True))
        yield from found([*sifted, (block, lists.held[0])])

    def found(sifted: list[tuple[int | None, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """What the lists of some blocks yield."""
        rows = np.concatenate([part for _, part in sifted])
        keys = np.concatenate([whole(block, part) for block, part in sifted])
        x, y, given_up = _list_pairs(keys, *(np.ascontiguousarray(rows[c]) for c in ("k1", "n", "pos", "bits")), num, den, most)
        up = np.isin(keys, given_up)
        yield from entries_of(keys[up], rows[up])
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        fresh = np.ones(len(x), dtype=bool)
        fresh[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        yield from batch(int(fresh.sum()), x=x[fresh], y=y[fresh], member=np.zeros(int(fresh.sum()), dtype=bool))

    def whole(block: int | None, rows: np.ndarray) -> np.ndarray:
        return rows["key"].astype(np.int64) + ((block or 0) << 32)

    def members(block: int | None, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        return entries_of(whole(block, rows), rows)

    def entries_of(keys: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = {c: rows[c].astype(np.int32) for c in ("n", "pos")} | {"bits": rows["bits"].astype(np.uint64).view(np.int64), "key": keys}
        yield from batch(len(rows), x=np.ascontiguousarray(rows["k1"]), member=np.ones(len(rows), dtype=bool), **columns)

    def batch(size: int, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        types = {"n": pa.int32(), "pos": pa.int32(), "member": pa.bool_()}
        names = [c.split()[0] for c in LISTS.split(", ")]
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(columns[c]) if c in columns else pa.nulls(size, types.get(c, pa.int64())) for c in names], names=names)

    parts = max(LEAST_BLOCKS, BLOCKS_A_PART * lines.rdd.getNumPartitions())
    dealt = dealt_entries(lines, min(24, (parts - 1).bit_length())).repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(join, LISTS)


def _full_sets(names: DataFrame, docs: DataFrame, text: str, classes: DataFrame) -> DataFrame:
    """(c, words): the full sets of the classes named."""
    places = classes.select("c", "k1", "k2", "td", "line").join(names, "c", "left_semi")
    needed = docs.sparkSession.sparkContext.broadcast(_bit_table(places.select(_place_column("td", "line").alias("d1")), NEEDED_BITS))
    # Few rows of a set are left by the tasks: they are sorted once, where they arrive.
    raw = word_sets(docs, text, needed).repartition("k1", "k2").groupBy("k1", "k2").agg(F.first("words").alias("words"))
    return materialize(raw.join(places.select("c", "k1", "k2"), ["k1", "k2"]).select("c", "words"), "line-sets")


def _matching(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs of classes (c later, e earlier) that match, by their full sets."""
    left, right = sets.withColumnRenamed("words", "c_words"), sets.withColumnsRenamed({"c": "e", "words": "e_words"})
    both = F.size(F.array_intersect("c_words", "e_words"))
    same = F.lit(den) * both >= F.lit(num) * (F.size("c_words") + F.size("e_words") - both)
    return pairs.join(left, "c").join(right, "e").where(same).select("c", "e")


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, td, line) of every line that matches an earlier one."""
    return _later_lines(docs, doc_id, text, num, den).select("doc_id", "td", "line").distinct()


def _later_lines(docs: DataFrame, doc_id: str, text: str, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, td, th, line) of every line that matches an earlier one, as often
    as there are rows of its id and text."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(word_counts(docs, text).tobytes())
    lines = materialize(line_index(docs, doc_id, text, counts, num, den, LIST_LIMIT), "lines", None, True)
    # Classes of equal sets; c is a class's first line.
    at = F.struct("doc_id", "td", "line")
    same = [F.first(x).alias(x) for x in ("n", "p1", "p2")]
    classes = materialize(lines.groupBy("k1", "k2").agg(F.min(at).alias("c"), F.count(F.lit(1)).alias("copies"), *same), "line-classes", None, True)
    joined = materialize(joined_lists(lines, num, den, LIST_LIMIT, LONG_LIST // 16), "line-lists", None, True)
    near = joined.where("NOT member").select("x", "y").distinct()
    # Classes that some list may decide about: few of all, which are read once.
    named = joined.select(F.col("x").alias("k1")).union(joined.where("NOT member").select("y")).distinct()
    listed = materialize(classes.select("*", "c.*").join(named.hint("shuffle_hash"), "k1", "left_semi"), "line-listed")
    member = listed.select("k1", "c", "n", "p1", "p2")
    i, j = (member.select(*[F.col(x).alias(side + x) for x in member.columns]) for side in "ij")
    differ = F.bit_count(F.col("ip1").bitwiseXOR(F.col("jp1"))) + F.bit_count(F.col("ip2").bitwiseXOR(F.col("jp2")))
    both = near.join(i, F.col("x") == F.col("ik1")).join(j, (F.col("y") == F.col("jk1")) & (F.lit(num + den) * differ <= F.lit(den - num) * (F.col("in") + F.col("jn"))))
    pairs = both.select(F.greatest("ic", "jc").alias("c"), F.least("ic", "jc").alias("e"))

    # Members of long lists: a class is found once for all lists that it is in.
    long_ = joined.where("member").groupBy(F.col("x").alias("k1")).agg(F.collect_set(F.struct("key", "pos")).alias("of"), *[F.first(x).alias(x) for x in ("n", "bits")])
    long_ = long_.join(listed.select("k1", "c"), "k1").select("c", "n", "bits", F.inline("of"))
    long_ = materialize(long_, "line-long-lists")
    packed = F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")
    first = long_.groupBy("key").agg(F.min("c").alias("c"), F.min_by("bits", "c").alias("bits"), F.min_by(packed, "c").alias("at"))
    first = first.select("key", "c", "bits", F.shiftright("at", 32).cast("int").alias("n"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"))

    def earlier(left: DataFrame, right: DataFrame) -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        joined = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.c") > F.col("b.c")) & _may_match("a", "b", num, den))
        return joined.select(F.col("a.c").alias("c"), F.col("b.c").alias("e"))

    wanted = materialize(pairs.unionByName(earlier(long_, first)).distinct(), "line-pairs")
    # Any member of a long list may have to be compared further on.
    names = wanted.select("c").union(wanted.select("e")).union(long_.select("c")).distinct()
    sets = _full_sets(names, docs, text, listed)
    found = materialize(_matching(wanted, sets, num, den).select("c").distinct(), "line-later")
    # Members of long lists that are not decided yet, against all earlier ones.
    rest = earlier(long_.join(found, "c", "left_anti"), long_).distinct()
    rest = materialize(rest.join(wanted, ["c", "e"], "left_anti"), "line-rest")
    if not rest.isEmpty():
        found = found.union(_matching(rest, sets, num, den).select("c")).distinct()

    # A class goes as a whole if it matches an earlier one, else all but its first line.
    none = F.lit(None).cast(classes.schema["c"].dataType)
    later = listed.join(found, "c", "left_semi").select("k1", "k2", none.alias("stays"))
    rest = classes.where("copies > 1").select("k1", "k2", F.col("c").alias("stays")).join(later, ["k1", "k2"], "left_anti")
    marked = later.union(rest).withColumnsRenamed({"k1": "c1", "k2": "c2"})
    hit = lines.select("doc_id", "td", "th", "line", "k1", "k2").join(marked.hint("shuffle_hash"), (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")))
    return hit.where(~F.struct("doc_id", "td", "line").eqNullSafe(F.col("stays"))).select("doc_id", "td", "th", "line")


def _cut(text: Column, lines: Column) -> Column:
    """A text without the lines of the given numbers."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda _line, i: ~F.array_contains(lines, i)), "\n")


def remove_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", count: str | None = None, **kw) -> DataFrame:
    """``docs`` with later matches cut from the text (and, if ``count`` is given,
    the number of lines cut in that column)."""
    spark = docs.sparkSession
    gone = _later_lines(docs, doc_id, text, **kw).groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("line").alias("_gone"))
    gone = materialize(gone, "lines-gone")
    table = spark.sparkContext.broadcast(_bit_table(gone.select(F.col("_th").alias("d1"))))
    docs, back = set_aside(docs.drop(count) if count else docs, "_own_th", "_suspect", "_cut", "_id", "_th", "_gone")
    kept = docs.columns
    marked = docs.select(*kept).withColumn("_own_th", F.xxhash64(text)).withColumn("_suspect", suspect_column(table, F.col("_own_th")))
    none = F.lit(0).cast("long")
    clear = marked.where(~F.col("_suspect")).select(*kept, none.alias("_cut"))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_id")) & (F.col("_own_th") == F.col("_th"))
    joined = marked.where(F.col("_suspect")).join(gone.hint("shuffle_hash"), same, "left")
    new = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(_cut(F.col(text), F.col("_gone")))
    changed = joined.select(*[c for c in kept if c != text], new.alias(text), F.coalesce(F.size("_gone").cast("long"), none).alias("_cut")).select(*kept, "_cut")
    out = clear.unionByName(changed)
    if "n_chars" in kept:
        out = out.withColumn("n_chars", F.when(F.col("_cut") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return (out.withColumnRenamed("_cut", count) if count else out.drop("_cut")).withColumnsRenamed(back)
