"""Writing marts as tables, and cutting long lineages through written tables."""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.quality import Rules
from ledgerlens.session import table_root


def _join(root: str, name: str) -> str:
    return root.rstrip("/") + "/" + name if "://" in root else os.path.join(root, name)


def save_table(df: DataFrame, name: str, root: str | None = None, mode: str = "errorifexists",
               partition_by: list[str] | None = None) -> str:
    """Write ``df`` as a new parquet table; fails if it exists (the default mode).

    Returns the table path. ``root`` defaults to the shared table folder next
    to ``spark.checkpoint.dir``.
    """
    root = root or table_root(df.sparkSession)
    path = _join(root, name)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def table_name(spark, name: str) -> str:
    """A table's name with its database, so that no temporary view is meant."""
    return f"`{spark.catalog.currentDatabase()}`.`{name}`"


def publish_table(df: DataFrame, name: str, rules: Rules | None = None, root: str | None = None) -> str:
    """Write ``df`` as the new catalog table ``name``; fails if it exists, or if a
    row breaks a rule, and then leaves no table. Returns the folder.

    The rules are the table's definition (INT, VARCHAR(n), NOT NULL): the write
    job itself casts and checks every row, in the one pass that it makes. It
    fills a staged table under another name, and renaming that is what
    publishes: readers see all rows or none, and of two writers one fails.
    """
    spark, rules = df.sparkSession, rules or Rules()
    target, label = table_name(spark, name), f"{name}_{uuid.uuid4().hex[:12]}"
    if spark.catalog.tableExists(target):
        raise AnalysisException(f"table {target} exists", errorClass="TABLE_OR_VIEW_ALREADY_EXISTS", messageParameters={"relationName": target})
    folder, staged = _join(root or table_root(spark), label), table_name(spark, label)
    columns = ", ".join(f"`{f.name}` {rules.column_type(f.name, f.dataType.simpleString())}" for f in df.schema)
    spark.sql(f"CREATE TABLE {staged} ({columns}) USING parquet LOCATION '{folder}'")
    try:
        strict = [F.col(f"`{f.name}`").cast("int").alias(f.name) if f.name in rules.ints else F.col(f"`{f.name}`") for f in df.schema]
        held = [F.when(F.col(f"`{c}`").isNull(), F.raise_error(F.lit(f"NULL in {name}.{c}"))) for c in rules.not_null]
        checked = df.where(F.coalesce(*held, F.lit(True))) if held else df
        checked.select(*strict).write.insertInto(staged)
        spark.sql(f"ALTER TABLE {staged} RENAME TO {target}")
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
        raise
    return folder


def read_table(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def materialize(df: DataFrame, name: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that
    survives executor loss (unlike a local checkpoint)."""
    label = f"{name or 'mat'}-{uuid.uuid4().hex[:12]}"
    path = save_table(df, label)
    return df.sparkSession.read.parquet(path)


def save_bucketed(df: DataFrame, name: str, bucket_col: str, buckets: int | None = None,
                  root: str | None = None) -> DataFrame:
    """Write ``df`` as a catalog table bucketed (and sorted) by ``bucket_col``
    under the shared table folder, and return it read back.

    Readers of a bucketed table see it hash partitioned by ``bucket_col``:
    aggregations and joins on that key run without a shuffle, and the data
    survives executor loss (unlike cached blocks, nothing is recomputed).
    """
    spark = df.sparkSession
    if buckets is None:
        most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
        buckets = min(most, int(spark.conf.get("spark.sql.shuffle.partitions")))
    label = f"{name}_{uuid.uuid4().hex[:12]}"
    path = _join(root or table_root(spark), label)
    (df.write.mode("errorifexists").bucketBy(buckets, bucket_col).sortBy(bucket_col)
       .option("path", path).saveAsTable(label))
    return spark.table(label)
