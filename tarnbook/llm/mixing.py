"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbook.operators.groups import global_rank
from tarnbook.session import cut_lineage

WEIGHTS = (3.0, 1.0, 2.0)
FACTOR = 1.5
MOST = 2
BUCKET_ROWS = 4096
SEED = 42


def word_count(text: str) -> Column:
    """Number of runs of anything but space and the characters 9 to 13; 0 for a null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, factor: float = FACTOR, most: int = MOST) -> DataFrame:
    """``source, source_size, target``: what each source of ``sizes`` (``source, source_size``) gives to the mix.

    Sources by code point, a null last, get the weights in turn.  Shares are ``factor`` times all sizes by weight; a
    source's share stops at ``most`` times its size, and what is over is shared anew by weight among the others until
    no share is above.  Sources stay in Spark: their ranks come from a range sort, and each round of sharing brings the
    driver one row of sums.
    """
    named = sizes.withColumn("__null", F.col("source").isNull())
    ranked = global_rank(named, ["__null", "source"], "rank").drop("__null")
    turn = (F.col("rank") - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    shared = cut_lineage(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")))
    # The level: target = weight * level where that is under the cap.  It only rises, so capped sources stay capped.
    total = shared.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        above = F.col("weight") * F.lit(level) >= F.col("cap")
        row = shared.agg(F.sum(F.when(above, F.col("cap"))).alias("fixed"), F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        higher = (factor * total - (row["fixed"] or 0.0)) / row["open"]
        if higher <= level:
            break
        level = higher
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    return shared.select("source", "source_size", target.alias("target"))


def mixed(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS, factor: float = FACTOR, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``doc_id, thash, size, source, source_size, target, taken``: how many words of each row the mix takes.

    Each source's documents are shuffled by a hash of id and text, ``most`` times in a row.  A document's virtual finish time is the
    number of its source's words up to and with it, divided by the source's target; all documents are taken in the order
    of that time until the budget (the sum of the targets) is reached, the last one in part.  The order is total, so that
    reruns agree.

    No source is summed up in one task: a source's shuffled order is cut by the hash into buckets of about
    ``BUCKET_ROWS`` rows, whose sums are added up first; and the global order is a range sort whose partitions' sums give
    where the budget ends.  Null texts have size 0 and are taken with 0 words; a null source is a source; rows that
    repeat an id are separate documents, and equal rows share their words evenly in ``taken`` of each.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("thash"), F.col(source).alias("source"), word_count(text).alias("size")
    )
    # Equal rows are one entry with a number of copies.
    entries = rows.groupBy("doc_id", "thash", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
    entries = cut_lineage(entries.withColumn("words", F.col("size") * F.col("copies")))
    sizes = entries.groupBy("source").agg(F.sum("words").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goals = targets(sizes.select("source", "source_size"), weights, factor, most)
    goals = goals.join(sizes.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # Buckets: a power of two for each source, by the hash's upper bits.
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(float(BUCKET_ROWS))))).cast("int")
    goals = cut_lineage(goals.withColumn("bits", bits))
    dealt = entries.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    order = F.shiftrightunsigned(F.xxhash64("doc_id", "thash", F.lit(seed)), 1)
    dealt = dealt.withColumn("order", order).withColumn("bucket", F.when(F.col("bits") > 0, F.expr("shiftright(`order`, 63 - bits)")).otherwise(F.lit(0).cast("long")))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("words").alias("bucket_words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_words").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "thash", "size").rowsBetween(Window.unboundedPreceding, 0)
    timed = dealt.withColumn("upto", F.sum("words").over(inside)).join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    turns = timed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    finish = (F.col("before") + F.col("upto") + F.col("turn") * F.col("source_size")) / F.col("target")
    queue = turns.where("words > 0 and target > 0").select("doc_id", "thash", "source", "size", "copies", "words", "turn", finish.alias("finish"))
    ranged = cut_lineage(queue.repartitionByRange("finish", "source", "turn", "doc_id", "thash", "size").withColumn("part", F.spark_partition_id()))
    # One row for each partition.
    parts = ranged.groupBy("part").agg(F.sum("words").alias("w"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part"), "w", F.coalesce(F.sum("w").over(upto), F.lit(0)).alias("start"))
    budget = goals.agg(F.sum("target")).first()[0] or 0.0
    budget = int(round(budget))
    placed = ranged.join(F.broadcast(parts), "part")
    whole = placed.where(F.col("start") + F.col("w") <= budget).withColumn("got", F.col("words"))
    along = Window.partitionBy("part").orderBy("finish", "source", "turn", "doc_id", "thash", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where((F.col("start") < budget) & (F.col("start") + F.col("w") > budget)).withColumn("end", F.col("start") + F.sum("words").over(along))
    edge = edge.withColumn("got", F.greatest(F.lit(0), F.least(F.col("words"), budget - F.col("end") + F.col("words"))))
    got = whole.select("doc_id", "thash", "source", "size", "got").unionByName(edge.select("doc_id", "thash", "source", "size", "got"))
    taken = got.groupBy("doc_id", "thash", "source", "size").agg(F.sum("got").alias("got"))
    taken = taken.select(*[F.col(c).alias(f"t_{c}") for c in ("doc_id", "thash", "source", "size")], "got")
    same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in ("doc_id", "thash", "source", "size")]
    every = entries.join(taken, same[0] & same[1] & same[2] & same[3], "left").join(
        goals.select(F.col("source").alias("g"), "source_size", "target"), F.col("source").eqNullSafe(F.col("g"))
    )
    # The words of equal rows are dealt evenly, the first ones getting the rest.
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    share = F.expr("got div copies") + (F.col("copy") <= F.expr("got % copies")).cast("long")
    return every.withColumn("got", F.coalesce("got", F.lit(0).cast("long"))).withColumn("copy", copy).select(
        "doc_id", "thash", "copy", "size", "source", "source_size", "target", share.alias("taken")
    )
