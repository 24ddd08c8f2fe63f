"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators count on.  All of them can be set on a live session.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Joins on site or area keys may be very uneven; let AQE split the hot partitions even when
    # a later step would have liked to reuse the join's partitioning.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # row_number() = 1 keeps one row per group and task before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply :data:`TUNING` to a session, leaving partition counts and memory to whoever made it."""
    for key, value in TUNING.items():
        spark.conf.set(key, value)
    return spark


#: Large tables are shuffled in at least this many pieces, which AQE puts together to tasks of about this size.  Of more than 200 pieces
#: the writer would hold its rows in memory.
PIECES = 200
TASK_BYTES = "16m"


def bounded_tasks(spark: SparkSession) -> None:
    """Let no task grow with the tables: a few shuffle partitions, or pieces or files of 64 MB, are too much where rows are wide."""
    pieces = max(PIECES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(pieces))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)
    spark.conf.set("spark.sql.files.maxPartitionBytes", TASK_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one only where none is configured (tests)."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tarnbook-"))
        current = context.getCheckpointDir()
    return current


def cut_lineage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Store ``df`` as a table in the shared folder, so that later steps read it instead of recomputing it.

    A table is computed once, read by column, and has a known size that later joins are planned by.
    """
    path = scratch_path(df.sparkSession, "stored")
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SCRATCH: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; :func:`remove_scratch` knows it."""
    path = os.path.join(shared_folder(spark), f"{name}-{os.urandom(8).hex()}")
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_scratch(spark: SparkSession) -> int:
    """Remove what this application stored so far; for the end of a job, when all its results are written.  Gives the number of paths."""
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(hadoop).delete(where, True)
    return len(paths)
