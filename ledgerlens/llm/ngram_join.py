"""N-gram Jaccard join with set-relation skipping, and its components.

A document's set is its distinct word shingles. Documents of equal sets are
one node. Nodes are indexed by position blocks (see ``setjoin``): the lists of
the index are skipped block by block, and only nodes that share a whole block
meet. Within a list, answers are derived from those of a similar set, the
list's leader, chosen as the node whose blocks the others share most. Every
member is compared with the leader only, and its difference from the leader is
kept. Two members' intersection follows from their differences and what these
have in common: if that is nothing, they can only be linked if both are linked
with the leader, and then they are connected through it. So only members not
linked with their leader are looked at again, together with members whose
difference shares an element that the link would need (a prefix of the
difference, found by a join on leader and element). A group of copies thus
costs as many comparisons as it has members, and no link that would join two
components is lost.

Finding the lists with several members is an aggregation and a join on the
key, which Spark splits where a key is hot. Full sets are built for members of
such lists only; a bit table of fixed size (``NEEDED_BITS``) names them in the
second pass over the texts, false positives drop out in the join.

Words: A-Z in lower case, runs of characters other than blank, tab, line feed,
vertical tab, form feed and carriage return; shingles are compared by 64-bit
hashes, sets by 128 bits. Defined cases: a null text or one without words has
an empty set and is linked with nothing; one with fewer words than a shingle
has its whole sequence as one shingle; rows of equal text are linked; a null
id is ignored in a component's smallest id; extra columns are not read.
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
from ledgerlens.llm.components import components
from ledgerlens.llm.setjoin import block_keys, distinct_sorted, sums, threshold

SHINGLE = 3
NUM, DEN = 90, 100
#: Bits of the tables that name documents, a broadcast of 16 MB at any size of input.
NEEDED_BITS = 1 << 27
#: Bits of the parity of a difference.
PARITY_BITS = 512

_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9, 0xA0761D6478BD642F)]

def shingle_sets(texts: list[str | None], width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, values, owner, sizes) for runs of texts: each text's
    distinct shingles as ascending hashes, owner counted from ``first``."""
    with np.errstate(over="ignore"):
        for first, last in chunks([len(t or "") for t in texts]):
            raws = [text_bytes(t).lower() for t in texts[first:last]]
            flat, starts = hash_words(b"\n".join(raws))
            ends = np.cumsum([len(r) + 1 for r in raws])
            owner = np.searchsorted(ends, starts, side="right")
            counts = np.bincount(owner, minlength=last - first)
            ends = np.cumsum(counts)
            begins = ends - counts
            total = np.zeros(len(flat), dtype=np.uint64)
            for k in range(min(width, len(flat))):
                total[: len(flat) - k] += flat[k:] * _FACTORS[k]
            inside = np.arange(len(flat)) + width <= ends[owner]
            for d in np.flatnonzero((counts > 0) & (counts < width)):
                # The whole sequence as one shingle, apart from all full ones.
                h = np.uint64(counts[d])
                for x in flat[begins[d]:ends[d]]:
                    h = mix(np.array([h * _FACTORS[0] + x], dtype=np.uint64))[0]
                total[begins[d]] = h
                inside[begins[d]] = True
            values, who = distinct_sorted(mix(total[inside]), owner[inside])
            yield first, last, values, who, np.bincount(who, minlength=last - first)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str | None], pa.Array]]:
    """(first, texts, ids of the whole batch) of the runs of texts (column 1 of
    the batches) that are handled at a time."""
    for batch in batches:
        for first, last in chunks(pc.binary_length(batch.column(1)).fill_null(0).to_pylist()):
            yield first, batch.column(1).slice(first, last - first).to_pylist(), batch.column(0)


def _digests(values: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set (0 for empty ones)."""
    out = np.zeros((2, len(sizes)), dtype=np.uint64)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    if len(starts):
        out[0][owner[starts]] = sums(values, starts)
        out[1][owner[starts]] = sums(mix(values ^ np.uint64(0x243F6A8885A308D3)), starts)
    return mix(out[0]).view(np.int64), mix(out[1]).view(np.int64)


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """One list of int64 per owner from values in owner order."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def sketches(docs: DataFrame, doc_id: str, text: str, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, td, n, d1, d2, keys): text digest, set size, set digests, index keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_objects()
        limit = threshold(num, den)
        for at, texts, ids in _runs(batches):
            for first, last, values, owner, sizes in shingle_sets(texts, width):
                with np.errstate(over="ignore"):
                    d1, d2 = _digests(values, owner, sizes)
                    keys, who = block_keys(values, owner, sizes, limit)
                order = np.argsort(who, kind="stable")
                td = [xxhash.xxh3_64_intdigest(text_bytes(t)) for t in texts[first:last]]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at + first, last - first).cast(pa.int64()),
                        pa.array(np.array(td, dtype=np.uint64).view(np.int64)),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(d1), pa.array(d2),
                        _lists(keys[order], who[order], last - first),
                    ],
                    names=["doc_id", "td", "n", "d1", "d2", "keys"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(sketch, "doc_id long, td long, n long, d1 long, d2 long, keys array<long>")


def place_hash(td: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """A document (text digest and id) as one hash."""
    with np.errstate(over="ignore"):
        return mix(td.astype(np.uint64) ^ mix(doc_id.astype(np.uint64)))


def in_table(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(len(bits) * 8)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def full_sets(docs: DataFrame, doc_id: str, text: str, width: int, needed) -> DataFrame:
    """(d1, d2, n, shingles) of the documents that are in the bit table."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_objects()
        bits = np.frombuffer(needed.value, dtype=np.uint8)
        for at, texts, ids in _runs(batches):
            td = np.array([xxhash.xxh3_64_intdigest(text_bytes(t)) for t in texts], dtype=np.uint64)
            places = place_hash(td, ids.slice(at, len(texts)).to_numpy(zero_copy_only=False).view(np.uint64))
            texts = [t for t, hit in zip(texts, in_table(bits, places), strict=True) if hit]
            for first, last, values, owner, sizes in shingle_sets(texts, width):
                with np.errstate(over="ignore"):
                    d1, d2 = _digests(values, owner, sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d1), pa.array(d2), pa.array(sizes.astype(np.int64)), _lists(values, owner, last - first)], names=["d1", "d2", "n", "shingles"]
                )

    rows = docs.select(known_id(F.col(doc_id)).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(build, "d1 long, d2 long, n long, shingles array<long>")


def known_id(doc_id: Column) -> Column:
    """An id for use in hashes: a null one is the least number."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def place_column(td: Column, doc_id: Column) -> Column:
    @F.arrow_udf("long")
    def place(tds: pa.Array, ids: pa.Array) -> pa.Array:
        drop_worker_objects()
        return pa.array(place_hash(tds.to_numpy(zero_copy_only=False).view(np.uint64), ids.to_numpy(zero_copy_only=False).view(np.uint64)).view(np.int64))

    return place(td, known_id(doc_id))


def _bit_table(digests: DataFrame, size: int = NEEDED_BITS) -> bytes:
    """Bits of the digests in column d1, modulo the table's size (a power of
    two). Tasks put the bits together, so the driver gets at most the table."""
    slot = F.col("d1").bitwiseAND(F.lit(size - 1))
    bit = F.expr("shiftleft(1L, cast(d1 & 63 AS int))")
    words = digests.select(F.shiftright(slot, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size // 64, dtype=np.int64)
    bits[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return bits.astype("<i8").tobytes()


def _differences(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y, x2, y2, cost, slack, diff, parity, bits) of each member x and leader
    y: diff has what x has more, then what it lacks; x and y are linked if cost
    <= slack; parity has a bit for each residue, 1 if diff has an odd number of
    it, and bits the same for fewer residues."""
    left = sets.select("d1", "d2", "n", "shingles").withColumnsRenamed({"d1": "x", "d2": "x2", "n": "x_n", "shingles": "x_set"})
    right = sets.select("d1", "d2", "n", "shingles").withColumnsRenamed({"d1": "y", "d2": "y2", "n": "y_n", "shingles": "y_set"})
    joined = pairs.join(left, "x").join(right, "y")
    found = joined.select("x", "y", "x2", "y2", "y_n", F.array_except("x_set", "y_set").alias("more"), F.array_except("y_set", "x_set").alias("less"))
    cost = F.lit(den) * F.size("less") + F.lit(num) * F.size("more")
    costed = found.select("x", "y", "x2", "y2", cost.cast("long").alias("cost"), (F.lit(den - num) * F.col("y_n")).cast("long").alias("slack"), F.concat("more", "less").alias("diff"))
    return costed.withColumn("p", _parity(F.col("diff"))).select(*costed.columns, "p.parity", "p.bits")


def _parity(diff: Column) -> Column:
    @F.arrow_udf("parity binary, bits long")
    def parity(lists: pa.Array) -> pa.Array:
        out, short = [], [np.empty(0, np.int64)]
        for at in range(0, len(lists), 1000):
            part = lists.slice(at, 1000)
            sizes = np.diff(part.offsets.to_numpy())
            values = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row = np.repeat(np.arange(len(part)), sizes)
            odd = np.bincount(row * PARITY_BITS + (values % np.uint64(PARITY_BITS)).astype(np.int64), minlength=len(part) * PARITY_BITS) & 1
            packed = np.packbits(odd.astype(np.uint8).reshape(len(part), PARITY_BITS), axis=1)
            out += [r.tobytes() for r in packed]
            short.append(np.bitwise_xor.reduce(packed.view(np.int64), axis=1))
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()), pa.array(np.concatenate(short))], names=["parity", "bits"])

    return parity(diff)


def _bits_apart(left: Column, right: Column) -> Column:
    """In how many bits two parities differ: no more than the differences do in elements."""

    @F.arrow_udf("int")
    def apart(a: pa.Array, b: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.int32())
        x = np.frombuffer(b"".join(a.to_pylist()), dtype=np.uint64).reshape(len(a), -1)
        y = np.frombuffer(b"".join(b.to_pylist()), dtype=np.uint64).reshape(len(b), -1)
        return pa.array(np.bitwise_count(x ^ y).sum(axis=1).astype(np.int32))

    return apart(left, right)


def _prefix(needed: Column) -> Column:
    """The elements of a difference of which one at least must be in common if
    ``needed`` are (none if there are fewer)."""
    count = F.size("diff") - F.greatest(F.lit(1), needed.cast("int")) + 1
    return F.when(count > 0, F.slice(F.col("diff"), F.lit(1), count)).otherwise(F.array().cast("array<bigint>"))


def _between_members(judged: DataFrame, num: int, den: int) -> DataFrame:
    """(x, x2, y, y2): linked members of one leader, x not linked with the leader."""
    far = judged.where("cost > slack")
    leaders = far.select(F.col("y").alias("f"), F.col("y2").alias("f2")).distinct()
    near = judged.join(leaders, (F.col("y") == F.col("f")) & (F.col("y2") == F.col("f2")), "left_semi")
    unit = num + den
    # x is the farther of two; what they need in common grows with x's excess,
    # so members are indexed by bands of it, with shorter prefixes for higher ones.
    excess, room = F.col("cost") - F.col("slack"), F.lit(unit) * F.size("diff") - F.col("cost")
    band = F.when(8 * excess < F.col("slack"), 0).when(2 * excess < F.col("slack"), 1).when(excess < 2 * F.col("slack"), 2).otherwise(3)
    probe = far.select("y", "y2", "x", "x2", "cost", "slack", excess.alias("excess"), F.size("diff").alias("size"), "bits", band.alias("band"), F.explode(_prefix(F.ceil(excess / unit))).alias("e"))
    lows = [F.lit(1).cast("long"), F.ceil(F.col("slack") / 8), F.ceil(F.col("slack") / 2), 2 * F.col("slack")]
    banded = near.select("*", room.alias("room"), F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.greatest(F.lit(1), low).cast("long").alias("low")) for i, low in enumerate(lows)])).alias("b"))
    banded = banded.where("room >= b.low")
    index = banded.select(
        "y", "y2", F.col("x").alias("o"), F.col("x2").alias("o2"), F.col("cost").alias("o_cost"), "room", F.size("diff").alias("o_size"), F.col("bits").alias("o_bits"), "b.band",
        F.explode(_prefix(F.ceil((F.col("cost") + F.col("b.low")) / unit))).alias("e"),
    )
    # Differences that differ in many bits have little in common.
    most = F.col("size") + F.col("o_size") - F.bit_count(F.col("bits").bitwiseXOR(F.col("o_bits")))
    enough = 2 * (F.col("cost") + F.col("o_cost") - F.col("slack")) <= F.lit(unit) * most
    pairs = probe.join(index, ["y", "y2", "band", "e"]).where(F.expr("(x <> o OR x2 <> o2) AND o_cost <= cost AND room >= excess") & enough)
    pairs = pairs.select("y", "y2", "x", "x2", "o", "o2").distinct()
    # The same with more bits.
    brief = judged.select("y", "y2", "x", "x2", "cost", "slack", F.size("diff").alias("size"), "parity")
    other = brief.drop("slack").withColumnsRenamed({"x": "o", "x2": "o2", "cost": "o_cost", "size": "o_size", "parity": "o_parity"})
    both = pairs.join(brief, ["y", "y2", "x", "x2"]).join(other, ["y", "y2", "o", "o2"])
    apart = both.withColumn("apart", _bits_apart(F.col("parity"), F.col("o_parity")))
    most = F.floor((F.col("size") + F.col("o_size") - F.col("apart")) / 2)
    likely = apart.where(F.col("cost") + F.col("o_cost") <= F.col("slack") + F.lit(unit) * most)
    likely = materialize(likely.select("y", "y2", "x", "x2", "cost", "slack", "o", "o2", "o_cost"), "ngram-likely")
    # The differences themselves, for these few pairs.
    names = likely.select(F.col("x").bitwiseXOR(F.col("y")).alias("d1")).union(likely.select(F.col("o").bitwiseXOR(F.col("y"))))
    table = judged.sparkSession.sparkContext.broadcast(_bit_table(names))
    named = judged.where(suspect_column(table, F.col("x").bitwiseXOR(F.col("y")))).select("y", "y2", "x", "x2", "diff")
    a = likely.join(named, ["y", "y2", "x", "x2"])
    b = a.join(named.withColumnsRenamed({"x": "o", "x2": "o2", "diff": "o_diff"}), ["y", "y2", "o", "o2"])
    shared = F.size(F.array_intersect("diff", "o_diff"))
    return b.where(F.col("cost") + F.col("o_cost") <= F.col("slack") + F.lit(unit) * shared).select("x", "x2", F.col("o").alias("y"), F.col("o2").alias("y2"))


def links(docs: DataFrame, found: DataFrame, doc_id: str, text: str, width: int, num: int, den: int) -> DataFrame:
    """(u, v) nodes of links that connect what is connected."""
    spark = docs.sparkSession
    keyed = found.select(F.explode("keys").alias("key"), F.col("d1").alias("x"), F.size("keys").alias("m"))
    several = keyed.groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo < hi").select("key")
    members = materialize(keyed.join(several, "key").distinct(), "ngram-members")
    # One document of each node that is in a list.
    one = found.groupBy("d1", "d2").agg(F.min_by("td", known_id(F.col("doc_id"))).alias("td"), F.min(known_id(F.col("doc_id"))).alias("doc_id"))
    one = one.join(members.select(F.col("x").alias("d1")).distinct(), "d1", "left_semi")
    needed = spark.sparkContext.broadcast(_bit_table(one.select(place_column(F.col("td"), F.col("doc_id")).alias("d1"))))
    # One row of each node: rows repeated with equal id and text all pass the table.
    raw = full_sets(docs, doc_id, text, width, needed)
    sets = materialize(raw.groupBy("d1", "d2").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")), "ngram-sets")
    # The more of a member's blocks others share, the better it leads.
    length = members.groupBy("key").agg(F.count(F.lit(1)).alias("length"))
    weight = members.join(length, "key").groupBy("x").agg((F.sum("length") / F.max("m")).alias("weight"))
    lead = members.join(weight, "x").groupBy("key").agg(F.max(F.struct("weight", "x")).alias("l")).select("key", F.col("l.x").alias("y"))
    star = members.select("key", "x").join(lead, "key").where("x <> y").select("x", "y").distinct()
    judged = materialize(_differences(star, sets, num, den), "ngram-judged")
    both = judged.where("cost <= slack").select("x", "x2", "y", "y2").unionByName(_between_members(judged, num, den))
    node = lambda a, b: F.concat_ws(":", F.col(a).cast("string"), F.col(b).cast("string"))
    return both.select(node("x", "x2").alias("u"), node("y", "y2").alias("v")).distinct()


def similar_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, num: int = NUM, den: int = DEN
) -> DataFrame:
    """(doc_id, td, n_shingles, component_id) of every row; td is a 64-bit digest
    of its text."""
    found = materialize(sketches(docs, doc_id, text, width, num, den), "ngram-sketches")
    edges = materialize(links(docs, found, doc_id, text, width, num, den), "ngram-links")
    labels = components(edges)
    node = F.concat_ws(":", F.col("d1").cast("string"), F.col("d2").cast("string"))
    nodes = found.where("n > 0").groupBy(node.alias("node")).agg(F.min("doc_id").alias("least"))
    rooted = nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "least")
    smallest = rooted.groupBy("label").agg(F.min("least").alias("component_id"))
    by_node = rooted.join(smallest, "label").select("node", "component_id")
    rows = found.select("doc_id", "td", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, node).alias("node"))
    # Documents without a set have a node of their own, so that nulls don't meet.
    rows = rows.withColumn("node", F.coalesce("node", F.concat(F.lit("empty:"), F.col("td").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    return rows.join(by_node, "node", "left").select(
        "doc_id", "td", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def one_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` without the rows whose id isn't their component's smallest; rows
    of equal id and text are one document."""
    found = similar_components(docs, doc_id, text, **kw)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id"), F.col("td").alias("_td")).distinct()
    return without(docs, materialize(gone, "ngram-gone"), doc_id, text)


def text_digest(text: Column) -> Column:
    @F.arrow_udf("long")
    def digest(texts: pa.Array) -> pa.Array:
        drop_worker_objects()
        values = [xxhash.xxh3_64_intdigest(text_bytes(t.as_py())) for t in texts]
        return pa.array(np.array(values, dtype=np.uint64).view(np.int64))

    return digest(text)


def suspect_column(table, digests: Column) -> Column:
    """Whether a digest's bit is set in a broadcast table."""

    @F.arrow_udf("boolean")
    def suspect(digests: pa.Array) -> pa.Array:
        drop_worker_objects()
        return pa.array(in_table(np.frombuffer(table.value, dtype=np.uint8), digests.to_numpy(zero_copy_only=False).view(np.uint64)))

    return suspect(digests)


def without(docs: DataFrame, gone: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` less the rows with (id, text digest) in ``gone`` (_id, _td). Only
    rows whose digest is in the bit table of ``gone`` are shuffled."""
    spark = docs.sparkSession
    docs, back = set_aside(docs, "_own_td", "_suspect", "_id", "_td")
    table = spark.sparkContext.broadcast(_bit_table(gone.select(F.col("_td").alias("d1"))))
    marked = docs.withColumn("_own_td", text_digest(F.col(text))).withColumn("_suspect", suspect_column(table, F.col("_own_td")))
    clear = marked.where(~F.col("_suspect")).select(*docs.columns)
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_id")) & (F.col("_own_td") == F.col("_td"))
    checked = marked.where(F.col("_suspect")).join(gone, same, "left_anti").select(*docs.columns)
    return clear.unionByName(checked).withColumnsRenamed(back)
