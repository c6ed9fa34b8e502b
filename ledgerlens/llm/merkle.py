"""Merkle manifest of a dataset, with a proof for every row by pointer jumping.

Rows are leaves. Those of one group (a source, say) ascend by an order column,
and while several nodes remain, every ``RUN`` consecutive ones become the hash
of their digests. What remains is the group's subroot; subroots in order of
group are joined the same way into one root.

A proof lists, from the leaf upwards, the siblings to the left and right of
each node on the way. It is not collected level by level. Every node holds a
segment, the siblings on the way to one of its ancestors, and a pointer to
that ancestor: first its parent. A round joins the nodes with themselves on
the pointer, puts the ancestor's segment behind the own one and takes over its
pointer, so the distance doubles, and ways of n levels are whole after log2(n)
rounds. Leaves are nobody's ancestor: they wait, and take their parent's whole
way in the last join.

Numbering needs no window over a group: rows are range partitioned by (group,
order, digest) and sorted, a row's place is its number in its partition, and
the rows of a group that lie in earlier partitions are added from a table of
one row per partition and group. A group of any size thus spreads over tasks.
Every level of the trees is an aggregation by the parent's number with at most
``RUN`` children, and written as a table; only the root's digest and the
number of levels reach the driver.

Digests are kept as 32 bytes and hashed as lowercase hex text.

Defined cases: a null value in a leaf is ``-``, apart from the empty text; a
null group is a group of its own and the first; null order values come first;
rows that agree in group and order are ordered by their digest, equal rows are
leaves of their own; a group of one leaf has that leaf as its subroot, a
single group's subroot is the root; an empty table gives no rows; extra
columns pass through, but for ``subroot``, ``root`` and ``proof``, which are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize

#: Consecutive nodes that become one.
RUN = 3
#: Levels of the tree over subroots are numbered from here.
UPPER = 1000
STEP = "struct<left:binary,right:binary>"


def sha256_of(text: Column) -> Column:
    """SHA-256 of a text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_text(*values: Column) -> Column:
    """What a leaf hashes: each value as its length in UTF-8 bytes, a colon and
    its text, or ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def _joined(digests: Column) -> Column:
    """The digests of an array as one binary."""
    return F.concat(*[F.coalesce(F.get(digests, F.lit(i)), F.lit(b"")) for i in range(RUN)])


def _numbered(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with ``g`` (their group's number), ``pos`` (their place in it) and
    ``size`` (its leaves); and (g, group, size) of every group. leaves: columns
    group, key, digest, seq and others."""
    spark = leaves.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in ("group", "key", "digest", "seq")]
    laid = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The upper bits are the partition, the lower ones a row's number in it.
    laid = materialize(laid.withColumn("at", F.monotonically_increasing_id()), "merkle-leaves").withColumn("part", F.shiftright("at", 33))
    runs = laid.groupBy("group", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("group")
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("group", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(own).alias("size"), F.min("first").over(own).alias("start"))
    runs = materialize(runs, "merkle-runs")
    # Groups begin in their own order: number them within the partition they
    # begin in, and add those that begin in earlier ones.
    begun = runs.where("first = start")
    inside = Window.partitionBy("part").orderBy("first")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    added = begun.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("added"))
    groups = begun.withColumn("g", F.row_number().over(inside) - 1).join(added, "part")
    groups = materialize(groups.select((F.col("g") + F.col("added")).cast("long").alias("g"), F.col("group"), F.col("size").cast("long"), "start"), "merkle-groups")
    placed = runs.join(groups.select("g", F.col("start").alias("g_start")), F.col("start") == F.col("g_start"))
    placed = placed.select(F.col("group").alias("r_group"), F.col("part").alias("r_part"), "first", "before", "size", "g")
    same = F.col("group").eqNullSafe(F.col("r_group")) & (F.col("part") == F.col("r_part"))
    found = laid.join(placed, same).withColumn("pos", (F.col("before") + F.col("at") - F.col("first")).cast("long"))
    return found.drop("r_group", "r_part", "first", "before", "at", "part"), groups.drop("start")


def _levels(nodes: DataFrame, first: int, tag: str) -> tuple[list[DataFrame], DataFrame]:
    """Tables (lvl, g, pos, size, kids, digest) of the nodes above ``nodes`` (g,
    pos, size, digest), and the (g, digest) of what remains of each g."""
    most = nodes.agg(F.max("size")).first()[0] or 0
    tables, tops = [], [nodes.where("size = 1").select("g", "digest")]
    level = first
    while most > 1:
        level, most = level + 1, -(-most // RUN)
        up = F.floor(F.col("pos") / RUN).cast("long")
        kids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])
        grouped = nodes.where("size > 1").groupBy("g", "size", up.alias("up")).agg(kids.alias("kids"))
        text = F.concat(*[F.coalesce(hex_of(F.get("kids", F.lit(i))), F.lit("")) for i in range(RUN)])
        table = grouped.select(
            F.lit(level).alias("lvl"), "g", F.col("up").alias("pos"), F.ceil(F.col("size") / RUN).cast("long").alias("size"), "kids", sha256_of(text).alias("digest")
        )
        tables.append(materialize(table, f"merkle-{tag}-{level}"))
        nodes = tables[-1]
        tops.append(nodes.where("size = 1").select("g", "digest"))
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return tables, top


def _parent(lvl: Column, g: Column, pos: Column, size: Column, groups: int) -> tuple[Column, Column, Column, Column]:
    """(lvl, g, pos) of a node's parent, nulls at the root, and the node's place
    among the parent's children."""
    inside = size > 1
    above = (lvl < UPPER) & F.lit(groups > 1)
    up = F.when(inside, lvl + 1).when(above, F.lit(UPPER + 1))
    at = F.when(inside, pos).when(above, g)
    return up, F.when(inside, g).when(above, F.lit(0).cast("long")), F.floor(at / RUN).cast("long"), (at % RUN).cast("int")


def _step(kids: Column, place: Column) -> Column:
    """Siblings to the left and right of the child at ``place``."""
    left = F.filter(kids, lambda x, i: i < place)
    right = F.filter(kids, lambda x, i: i > place)
    return F.struct(_joined(left).alias("left"), _joined(right).alias("right")).cast(STEP)


def _jump(nodes: DataFrame, groups: int, height: int) -> DataFrame:
    """Nodes (lvl, g, pos, kids, digest) above the leaves, each with its whole
    ``way`` to the root."""
    at = _parent(F.col("lvl"), F.col("g"), F.col("pos"), F.col("size"), groups)
    pointed = nodes.select("lvl", "g", "pos", "kids", *[c.alias(n) for c, n in zip(at, ("p_lvl", "p_g", "p_pos", "place"), strict=True)])
    here = ["lvl", "g", "pos"]

    def ancestors(columns: DataFrame) -> DataFrame:
        return columns.withColumnsRenamed({c: f"a_{c}" for c in columns.columns})

    on = (F.col("p_lvl") == F.col("a_lvl")) & (F.col("p_g") == F.col("a_g")) & (F.col("p_pos") == F.col("a_pos"))
    parents = ancestors(nodes.select(*here, "kids"))
    own = F.when(F.col("a_kids").isNull(), F.array().cast(f"array<{STEP}>")).otherwise(F.array(_step(F.col("a_kids"), F.col("place"))))
    pointer = ["p_lvl", "p_g", "p_pos"]
    ways = materialize(pointed.drop("kids").join(parents, on, "left").select(*here, *pointer, own.alias("way")), "merkle-ways")
    reach = 1
    while reach < height:
        farther = ancestors(ways.select(*here, *pointer, "way"))
        joined = ways.join(farther, on, "left")
        way = F.when(F.col("a_way").isNull(), F.col("way")).otherwise(F.concat("way", "a_way"))
        ways = materialize(joined.select(*here, *[F.col(f"a_{c}").alias(c) for c in pointer], way.alias("way")), "merkle-ways")
        reach *= 2
    return nodes.select(*here, "kids").join(ways.select(*here, "way"), here)


def prove(df: DataFrame, group: str, order: str, digest: str) -> DataFrame:
    """``df`` with ``subroot``, ``root`` and ``proof`` of every row. digest: the
    column with a row's leaf as 32 bytes; group, order: columns that place it.
    proof: from the leaf upwards, the digests to the left and to the right of
    each node on the way (one after the other, 32 bytes each), via the subroot."""
    kept = [c for c in df.columns if c not in ("subroot", "root", "proof")]
    leaves = df.select(F.struct(*kept).alias("row"), F.col(group).alias("group"), F.col(order).alias("key"), F.col(digest).alias("digest"))
    leaves = materialize(leaves.withColumn("seq", F.monotonically_increasing_id()), "merkle-rows")
    placed, groups = _numbered(leaves)
    placed = materialize(placed.select("row", "digest", "g", "pos", "size"), "merkle-placed")
    lower, tops = _levels(placed.select("g", "pos", "size", "digest"), 0, "lower")
    subroots = materialize(tops, "merkle-subroots")
    count = groups.count()
    upper, root = _levels(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.lit(count).cast("long").alias("size"), "digest"), UPPER, "upper")
    ends = root.first()
    whole = F.lit(bytes(ends["digest"]) if ends else None).cast("binary")
    tables = lower + upper
    at = _parent(F.lit(0), F.col("g"), F.col("pos"), F.col("size"), count)
    rows = placed.select("row", "digest", "g", *[c.alias(n) for c, n in zip(at, ("p_lvl", "p_g", "p_pos", "place"), strict=True)])
    nothing = F.array().cast(f"array<{STEP}>")
    if tables:
        nodes = tables[0]
        for t in tables[1:]:
            nodes = nodes.unionByName(t)
        parents = _jump(nodes, count, len(tables)).withColumnsRenamed({c: f"a_{c}" for c in ("lvl", "g", "pos", "kids", "way")})
        on = (F.col("p_lvl") == F.col("a_lvl")) & (F.col("p_g") == F.col("a_g")) & (F.col("p_pos") == F.col("a_pos"))
        rows = rows.join(parents, on, "left")
        proof = F.when(F.col("a_kids").isNull(), nothing).otherwise(F.concat(F.array(_step(F.col("a_kids"), F.col("place"))), "a_way"))
    else:
        proof = nothing
    rows = rows.select("row", F.col("g").alias("of"), proof.alias("proof"))
    named = rows.join(subroots.select("g", F.col("digest").alias("subroot")), F.col("of") == F.col("g"))
    return named.select("row.*", "subroot", whole.alias("root"), "proof")


def fold(digest: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    def up(acc: Column, step: Column) -> Column:
        return F.sha2(F.concat(hex_of(step["left"]), acc, hex_of(step["right"])).cast("binary"), 256)

    return F.unhex(F.aggregate(proof, hex_of(digest), up))


def proof_text(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right, as hex text."""
    return F.array_join(F.transform(proof, lambda s: F.concat(hex_of(s["left"]), hex_of(s["right"]))), "")

