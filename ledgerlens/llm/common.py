"""Helpers shared by the operators: reading tables, cutting lineage, word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at a time by the vectorised passes (one text at least).
CHUNK_BYTES = 2 << 20
#: Bytes hashed at a time: of arrays that the C library keeps and hands out again.
PIECE_BYTES = 1 << 16


def _give_back() -> None:
    """Let this process return large arrays to the system when they are freed.
    The C library otherwise raises the size from which it does so to that of the
    largest array it has met, and a worker keeps its peak for good. Where there
    is no such setting nothing changes."""
    try:
        setting = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):
        return
    setting(-3, 1 << 20)  # M_MMAP_THRESHOLD
    setting(-1, 8 << 20)  # M_TRIM_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())


_give_back()


def _trim() -> None:
    """Return what has been freed between pieces still in use to the system."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a
    temporary one is set only where that is unset in a local session (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="ledgerlens-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str, compression: str | None = None, distinct: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends
    there, so a lost executor costs a re-read and not a recomputation.
    distinct: its values hardly repeat, so none are looked up in dictionaries."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", not distinct).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns of these names under unused ones, and the renaming
    that brings them back (for ``withColumnsRenamed``)."""
    taken, back = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            n = 0
            while (free := f"_aside{n}") in taken:
                n += 1
            taken.add(free)
            back[free] = c
    return df.withColumnsRenamed({c: free for free, c in back.items()}), back


#: Of this worker: the one object built from a broadcast, by its kind.
_BUILT: dict[str, tuple[str, object, object]] = {}


def worker_object(kind: str, shared, build: Callable[[object], object]) -> object:
    """``build`` of a broadcast's value, once per worker; told apart by the
    broadcast's id. What another operator built here is dropped, so a worker
    never holds the tables of two."""
    key = f"{kind}-{getattr(shared, '_path', None) or id(shared)}"
    if kind not in _BUILT or _BUILT[kind][0] != key:
        _BUILT.clear()
        _trim()
        _BUILT[kind] = key, build(shared.value), shared  # kept, so that its id stays its own
    return _BUILT[kind][1]


def drop_worker_objects() -> None:
    """Let go of what an earlier operator built in this worker: workers live on,
    and an operator that builds nothing would hold its tables beside its own."""
    if _BUILT:
        _BUILT.clear()
        _trim()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (finaliser with odd multipliers)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(text: str | None) -> bytes:
    """UTF-8 of a text (null: empty); lone surrogates cannot occur in Arrow strings."""
    return text.encode("utf-8") if text else b""


def chunks(sizes: Sequence[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to about ``limit``."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _gaps(raw: np.ndarray) -> np.ndarray:
    """Which bytes are a blank, tab, line feed, vertical tab, form feed or carriage return."""
    return (raw == 0x20) | (raw - np.uint8(0x09) <= 0x04)


#: An odd number and its inverse modulo 2^64: word hashes are polynomials in it.
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(n, base, dtype=np.uint64)
            table[0] = 1
            _POWERS[i] = np.cumprod(table)
    return _POWERS


def hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): a 64-bit hash of each run of non-blank bytes and where
    it begins. Prefix sums of a polynomial give all hashes at once."""
    hashes, starts, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE_BYTES)
        if end < len(raw):  # cut between words
            ends = [x for x in (raw.find(b" ", end), raw.find(b"\n", end)) if x >= 0]
            end = min(ends, default=len(raw))
        piece = np.frombuffer(raw, dtype=np.uint8, count=end - at, offset=at)
        gap = np.ones(len(piece) + 2, dtype=bool)
        gap[1:-1] = _gaps(piece)
        edges = np.flatnonzero(gap[:-1] != gap[1:])  # a word's begin, its end, the next one's begin
        begin, stop = edges[::2], edges[1::2]
        up, down = _powers(max(PIECE_BYTES, len(piece)))
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        weights = np.add(piece, 1, dtype=np.uint64)
        weights *= up[: len(piece)]
        np.cumsum(weights, out=sums[1:])
        hashes.append(mix((sums[stop] - sums[begin]) * down[begin]))
        starts.append(begin + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def word_stops(raw: bytes) -> np.ndarray:
    """Where each run of non-blank bytes ends (exclusive)."""
    stops, at = [], 0
    while at < len(raw):
        piece = np.frombuffer(raw, dtype=np.uint8, count=min(PIECE_BYTES, len(raw) - at), offset=at)
        gap = np.ones(len(piece) + 1, dtype=bool)
        gap[:-1] = _gaps(piece)
        if at + len(piece) < len(raw):
            gap[-1] = _gaps(np.frombuffer(raw, np.uint8, 1, at + len(piece)))[0]
        stops.append(np.flatnonzero(~gap[:-1] & gap[1:]) + (at + 1))
        at += len(piece)
    return np.concatenate(stops) if stops else np.empty(0, np.int64)


class Tally:
    """Counts by key within a task, in bounded memory: merged when many have
    come, to be sent on when many are distinct."""

    def __init__(self, limit: int = 1 << 21) -> None:
        self.limit, self.size, self.parts = limit, 0, []

    def add(self, keys: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> bool:
        """Add counts (and further columns that follow from the key); True if
        what has come should now be taken."""
        self.parts.append((keys, counts, *more))
        self.size += len(keys)
        if self.size > 2 * self.limit:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])
        return self.size > self.limit

    def merged(self) -> tuple[np.ndarray, ...]:
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        if not len(columns[0]):
            return tuple(columns)
        order = np.argsort(columns[0], kind="stable")
        keys = columns[0][order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[starts], np.add.reduceat(columns[1][order], starts), *[c[order[starts]] for c in columns[2:]]

    def take(self) -> tuple[np.ndarray, ...]:
        """All counts so far (none: an empty tuple); starts anew."""
        out = self.merged() if self.parts else ()
        self.size, self.parts = 0, []
        return out
