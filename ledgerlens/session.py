"""SparkSession construction and the shared lineage-cut folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults a cluster deployment would also want: adaptive execution (partition
# coalescing, skew-join splitting, runtime broadcast conversion), UTC dates,
# no web UI. Shuffle partition count is left to the caller / cluster config.
_DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Joins on (order id, product id) between two inputs that are both hash
    # partitioned by order id need no shuffle: order id has millions of
    # values, so a partial-key co-partitioning cannot concentrate data.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # A hot key (one order, product or customer holding a large share of the
    # rows) is split by AQE even where that costs an extra shuffle later.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "ledgerlens",
                  shuffle_partitions: int | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for materialised tables and checkpoints.

    On a cluster this is the shared folder named by ``spark.checkpoint.dir``.
    Only a local-mode session without that setting (tests, benchmarks) gets a
    fresh folder under the system temp directory.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)
    resolved = spark.sparkContext.getCheckpointDir() or configured
    return resolved


def table_root(spark: SparkSession) -> str:
    """Root for written tables: a sibling ``tables`` folder of the checkpoint dir."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables") if "://" not in base else base.rstrip("/") + "/tables"


def cluster_conf(fact_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Shuffle and scan sizing for a cluster run over ``fact_bytes`` of order
    lines (compressed parquet) on ``total_cores`` executor cores.

    The widest shuffle is the line table by order id, a little larger than
    the compressed input once decoded, so the partition count targets
    ``target_partition_bytes`` per post-shuffle partition (a size one task
    sorts and aggregates within its memory share, spilling rarely) and is at
    least two waves of tasks. AQE then coalesces the small shuffles of the
    aggregate marts from that starting point. Example: 100 TB of lines on
    1000 executors x 8 cores gives about 745,000 shuffle partitions of 256 MiB.
    """
    decoded = fact_bytes * 2
    partitions = max(2 * total_cores, -(-decoded // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }
