"""Merkle fixity audit of WARC replicas.

Pages are written as WARC records: ``FILE_RECORDS`` consecutive page ids make
a file, in which a record's offset is the length of all before it. Records are
hashed; the records that begin in the same ``RANGE_BYTES`` of a file, in order
of offset, make a range with a hash over theirs; ranges make files, files make
groups of ``FANOUT``, and so on up to one root. Two replicas are compared from
their roots downwards, and only under nodes whose hashes differ. Records of
mismatching ranges are then told apart: *changed* (other content), *moved*
(same content at another offset), *missing* or *extra* in the replica.

Each level is a grouping by the parent's number with at most ``FANOUT``
children (records of a file: at most the versions of ``FILE_RECORDS`` pages),
so no group grows with the archive.

Defined cases: null url or html count as ''; repeated rows are one record with
a count; several versions of a page are ordered by their hash and compared as
one list; a null page id is a file of its own; two empty archives agree; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize

FILE_RECORDS = 128
RANGE_BYTES = 8 << 10
FANOUT_BITS = 6


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The text of a WARC response record."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def archive_index(pages: DataFrame) -> DataFrame:
    """(file, page_id, offset, length, digest) of an archive's records; a page's
    versions are one entry with the hash of all, in order."""
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    hashed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(text).cast("long").alias("length"), F.sha2(text.cast("binary"), 256).alias("digest"))
    once = hashed.groupBy("page_id", "length", "digest").agg(F.count(F.lit(1)).alias("copies"))
    version = F.concat_ws(":", "digest", F.col("copies").cast("string"))
    entry = once.groupBy("page_id").agg(F.sum(F.col("length") * F.col("copies")).alias("length"), F.array_sort(F.collect_list(version)).alias("versions"))
    named = entry.select(F.floor(F.col("page_id") / FILE_RECORDS).cast("long").alias("file"), "page_id", "length", F.sha2(F.array_join("versions", ",").cast("binary"), 256).alias("digest"))
    before = Window.partitionBy("file").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    return named.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def _hash_children(child: list[str]) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(*child, "digest")))
    lines = F.transform(ordered, lambda x: F.concat_ws(":", *[F.coalesce(x[c].cast("string"), F.lit("-")) for c in child], x["digest"]))
    return F.sha2(F.array_join(lines, ",").cast("binary"), 256).alias("digest")


class MerkleTree:
    """Hashes of ranges, files and groups of files of one archive index."""

    def __init__(self, index: DataFrame, tag: str, range_bytes: int = RANGE_BYTES) -> None:
        self.records = materialize(index.withColumn("range", F.floor(F.col("offset") / range_bytes).cast("long")), f"warc-{tag}")
        self.ranges = materialize(self.records.groupBy("file", "range").agg(_hash_children(["offset", "page_id"])), f"warc-{tag}-ranges")
        self.files = materialize(self.ranges.groupBy("file").agg(_hash_children(["range"])), f"warc-{tag}-files")
        self.tag = tag

    def levels(self, up: int) -> list[DataFrame]:
        """Files (level 0) and groups of files, keyed by ``node``; the last has one
        node. Every level is a table, so plans stay as small as one level."""
        out = [self.files.withColumnRenamed("file", "node")]
        for level in range(1, up + 1):
            parent = F.lit(0).cast("long") if level == up else F.shiftright("node", FANOUT_BITS)
            grouped = out[-1].groupBy(parent.alias("node")).agg(_hash_children(["node"]))
            out.append(materialize(grouped, f"warc-{self.tag}-level{level}"))
        return out


def _differ(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digests differ or that one side lacks."""
    other = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("digest").alias("r_digest"))
    same_key = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]
    on = same_key[0]
    for c in same_key[1:]:
        on = on & c
    both = left.join(other, on, "full_outer").where(~F.col("digest").eqNullSafe(F.col("r_digest")))
    return both.select(*[F.when(F.col("digest").isNull(), F.col(f"r_{k}")).otherwise(F.col(k)).alias(k) for k in keys])


def _under(children: DataFrame, parents: DataFrame, parent: Column, key: str) -> DataFrame:
    names = parents.select(F.col(key).alias("_parent"))
    return children.join(names, parent.eqNullSafe(F.col("_parent")), "left_semi")


def audit(left: DataFrame, right: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(page_id, file, offset, replica_offset, status) of each record on which
    two archives of pages disagree, found by descending mismatching branches."""
    a = MerkleTree(archive_index(left), "left", range_bytes)
    b = MerkleTree(archive_index(right), "right", range_bytes)
    bounds = a.ranges.select("file").unionByName(b.ranges.select("file")).agg(F.min("file"), F.max("file")).first()
    span = max(abs(x) for x in (bounds[0] or 0, bounds[1] or 0)) + 1
    up = max(1, -(-span.bit_length() // FANOUT_BITS))
    above, below = a.levels(up), b.levels(up)
    wrong = materialize(_differ(above[up], below[up], ["node"]), "warc-wrong")
    for level in range(up - 1, -1, -1):
        parent = F.lit(0).cast("long") if level + 1 == up else F.shiftright("node", FANOUT_BITS)
        wrong = _differ(_under(above[level], wrong, parent, "node"), _under(below[level], wrong, parent, "node"), ["node"])
        wrong = materialize(wrong, "warc-wrong")
    wrong = _differ(_under(a.ranges, wrong, F.col("file"), "node"), _under(b.ranges, wrong, F.col("file"), "node"), ["file", "range"])
    wrong = materialize(wrong, "warc-wrong")
    return _records(a.records, b.records, wrong)


def _records(a: DataFrame, b: DataFrame, wrong: DataFrame) -> DataFrame:
    names = wrong.withColumnsRenamed({"file": "w_file", "range": "w_range"})

    def inside(records: DataFrame) -> DataFrame:
        hit = F.col("file").eqNullSafe(F.col("w_file")) & F.col("range").eqNullSafe(F.col("w_range"))
        return records.join(names, hit, "left_semi")

    other = inside(b).select(F.col("file").alias("r_file"), F.col("page_id").alias("r_page"), F.col("offset").alias("replica_offset"), F.col("digest").alias("r_digest"))
    both = inside(a).join(other, F.col("page_id").eqNullSafe(F.col("r_page")), "full_outer")
    status = (
        F.when(F.col("r_digest").isNull(), "missing")
        .when(F.col("digest").isNull(), "extra")
        .when(F.col("digest") != F.col("r_digest"), "changed")
        .when(F.col("offset") != F.col("replica_offset"), "moved")
    )
    found = both.select(F.coalesce("page_id", "r_page").alias("page_id"), F.coalesce("file", "r_file").alias("file"), "offset", "replica_offset", status.alias("status"))
    return found.where("status IS NOT NULL")


def damaged_replica(pages: DataFrame) -> DataFrame:
    """A replica to audit: of each hundred page ids one has the first character
    of its html changed, one lost the second half, one is gone and one appears
    once more under a new id."""
    pick = F.col("page_id") % 100
    html = F.coalesce("html", F.lit(""))
    changed = F.when(pick == 1, F.concat(F.lit("~"), F.substring(html, 2, 1 << 30))).when(pick == 2, F.substring(html, 1, F.floor(F.length(html) / 2).cast("int"))).otherwise(F.col("html"))
    rows = pages.select("page_id", "url", changed.alias("html"), pick.alias("pick")).where("pick IS NULL OR pick <> 3")
    again = rows.where("pick = 4").select((F.col("page_id") + 1_000_000_000).alias("page_id"), "url", "html")
    return rows.select("page_id", "url", "html").unionByName(again)
