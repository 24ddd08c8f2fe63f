"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbook.session import cut_lineage

MAX_ROUNDS = 64


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    larger = both.where("b > a")
    return larger.join(least, "a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    joined = links.join(least, "b")
    smaller = joined.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return smaller.unionAll(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node in ``links`` (columns a < b): the smallest node it is connected with.

    Links stay in Spark.  Each round is stored in the shared folder; the driver sees the number of links and a
    checksum.  The rounds end when nothing changes; their number grows with the logarithm of the longest chain.
    A node with very many links is a hot key of plain joins, which adaptive execution splits.
    """
    now = cut_lineage(links.select("a", "b").distinct())
    seen = _state(now)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        now = cut_lineage(_small_star(_large_star(now)))
        state = _state(now)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components are not stable after {MAX_ROUNDS} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
