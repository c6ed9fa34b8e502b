"""The order-line mart as a stored table, partitioned by half-year.

``write_line_store`` writes V1's lines once, in a folder that the caller
names; ``Marts.load(..., line_store=folder)`` then reads them from there. A
slice of calendar periods names its half-years, so only their folders are
listed and read, and a join with a table of periods prunes them at run time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: The partition column: a half-year's code (see ``dates.half_code``).
HALF = "_Half"


def write_line_store(lines: DataFrame, folder: str) -> str:
    """Write lines (with column ``_Half``) as a new table in ``folder``; fails if
    one is there. Rows of a half-year are dealt to as many tasks as their size
    needs, so a large half-year is no single task, and a folder gets few files."""
    lines.hint("rebalance", HALF).write.mode("errorifexists").partitionBy(HALF).parquet(folder)
    return folder


def read_line_store(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The stored lines with the column order and types of ``schema``."""
    return spark.read.schema(schema).parquet(folder).select(*schema.names)


def new_folder(root: str, name: str) -> str:
    """A folder of its own under ``root``."""
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
