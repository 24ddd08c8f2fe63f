"""Aggregations and "first row" operators.

Everything called first or top takes an order that should end in a unique column: Spark tables have no
row order of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbook.operators.joins import left_lookup, lookup
from tarnbook.session import cut_lineage


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def distinct_count(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Number of distinct combinations."""
    return df.select(*keys).distinct().agg(F.count(F.lit(1)).alias(name))


def group_richness(df: DataFrame, keys: Sequence[str], category: str, name: str = "richness") -> DataFrame:
    """Number of distinct categories per group, nulls not counted.

    Done as a distinct followed by a count: duplicates go in the first, map-side, aggregation.
    """
    pairs = df.select(*keys, category).distinct()
    return pairs.groupBy(*keys).agg(F.count(category).alias(name))


SKETCH_BITS = 12
#: Three standard errors of a merged sketch of 2^12 registers.
RICHNESS_ERROR = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)


def richness_sketches(df: DataFrame, keys: Sequence[str], category: str, name: str = "sketch") -> DataFrame:
    """A small mergeable summary of each group's categories, nulls not counted; to be stored and merged later.

    A group of any size, however uneven, is one summary of a few kilobytes per task before the shuffle.
    """
    return df.groupBy(*keys).agg(F.hll_sketch_agg(category, SKETCH_BITS).alias(name))


def merged_richness(sketches: DataFrame, keys: Sequence[str], sketch: str = "sketch", name: str = "richness") -> DataFrame:
    """About how many categories larger groups have, from stored summaries of their parts; off by ``RICHNESS_ERROR`` at most, as a rule."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg(sketch)).alias(name))


def first_last(df: DataFrame, keys: Sequence[str], year: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"))


def first_by_category(df: DataFrame, keys: Sequence[str], category: str, focal: Mapping[str, str], year: str) -> DataFrame:
    """First year of each listed category, all in one pass; ``focal`` maps a category to its column."""
    return df.groupBy(*keys).agg(
        *[F.min(F.when(F.col(category) == value, F.col(year))).alias(name) for value, name in focal.items()]
    )


def mean_point(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(x).alias(x), F.avg(y).alias(y))


def first_non_null(df: DataFrame, keys: Sequence[str], cols: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Per group and column, the first value that is not null in the given order."""
    order = F.struct(*order_by) if len(order_by) > 1 else F.col(order_by[0])
    return df.groupBy(*keys).agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols]
    )


def top_row(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """First row of every group.

    Spark keeps the best row per group and task before it shuffles (window group limit), so a group of
    any size reaches its last task as one row per input partition.
    """
    w = Window.partitionBy(*keys).orderBy(*[_column(c) for c in order_by])
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def top_n(df: DataFrame, order_by: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows in an order that should end in a unique column; each task passes on no more than ``n``."""
    return df.orderBy(*[_column(c) for c in order_by]).limit(n)


def joined_values(df: DataFrame, keys: Sequence[str], col: str, sep: str = "+", name: str | None = None) -> DataFrame:
    """Sorted distinct values of a column as one text per group."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(col)), sep).alias(name or col))


def source_label(source: str, a: str, b: str, both="Both", unknown="Unknown") -> Column:
    """Aggregate: from which of two databases a group's rows come."""
    has_a = F.coalesce(F.bool_or(F.col(source) == a), F.lit(False))
    has_b = F.coalesce(F.bool_or(F.col(source) == b), F.lit(False))
    return F.when(has_a & has_b, both).when(has_a, f"{a} Only").when(has_b, f"{b} Only").otherwise(unknown)


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str] | None = None) -> DataFrame:
    """Counts of two categories, one column per value of the second; rows with a null are not counted."""
    counted = df.select(row, col).dropna().groupBy(row)
    pivoted = counted.pivot(col, list(values)) if values else counted.pivot(col)
    return pivoted.count().fillna(0)


def column_profile(df: DataFrame, cols: Sequence[str], quantiles: Sequence[float] = (), exact: bool = False) -> DataFrame:
    """One row per numeric column: rows, nulls, minimum, mean, maximum and, if asked for, quantiles.

    All columns are profiled in one pass.  Quantiles are Spark's approximate ones, which need a bounded summary per task;
    ``exact`` ones are interpolated between the values of two ranks, found by :func:`values_at` in a few more passes.
    """
    exact_ones = exact_quantiles(df, cols, quantiles) if exact and quantiles else {}
    stats = []
    for c in cols:
        v = F.col(c).cast("double")
        stats.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(F.lit(1)).alias("n"),
                F.count_if(v.isNull()).alias("n_null"),
                F.min(v).alias("minimum"),
                F.avg(v).alias("mean"),
                F.max(v).alias("maximum"),
                *[(F.lit(exact_ones[c, q]).cast("double") if exact else F.percentile_approx(v, q, 10000)).alias(f"q{round(q * 100)}") for q in quantiles],
            )
        )
    return df.agg(F.array(*stats).alias("stats")).select(F.inline("stats"))


FEW_VALUES = 10_000
_ACCURACY = 10_000


def exact_quantiles(df: DataFrame, cols: Sequence[str], quantiles: Sequence[float]) -> dict[tuple[str, float], float | None]:
    """The quantiles of numeric columns, interpolated between the two values around them; None for a column without values.

    No task and no row ever holds more than :data:`FEW_VALUES` values of a column, whatever their number and however often they
    repeat.
    """
    sizes = df.agg(*[F.count(F.col(c).cast("double")).alias(str(k)) for k, c in enumerate(cols)]).first()
    places = {(c, q): (sizes[k] - 1) * q for k, c in enumerate(cols) for q in quantiles if sizes[k]}
    wanted = {(c, rank) for (c, _), place in places.items() for rank in (math.floor(place), math.ceil(place))}
    found = values_at(df, wanted, dict(zip(cols, sizes)))
    out: dict[tuple[str, float], float | None] = {(c, q): None for c in cols for q in quantiles}
    for (c, q), place in places.items():
        low, high = math.floor(place), math.ceil(place)
        out[c, q] = found[c, low] if low == high else (high - place) * found[c, low] + (place - low) * found[c, high]
    return out


def values_at(df: DataFrame, wanted: Iterable[tuple[str, int]], sizes: Mapping[str, int]) -> dict[tuple[str, int], float]:
    """The value at each wanted rank (column, rank from 0) in ascending order, NaN last.

    Distributed selection: each rank lies in an open interval of which it is known how many values are below.  A round takes two values
    close to the rank on either side from a bounded sketch of the interval, and counts what is below, on and between them; the
    rank then is one of them or lies in a smaller interval.  All ranks of all columns share the passes.  Intervals of few
    values are read out.
    """
    # column, rank -> values up to the interval, values in it, its ends (None: open to that side)
    todo = {w: (0, sizes[w[0]], None, None) for w in wanted}
    done: dict[tuple[str, int], float] = {}

    def inside(c: str, low: float | None, high: float | None) -> Column:
        v = F.col(c).cast("double")
        kept = v.isNotNull()
        if low is not None:
            kept = kept & (v > F.lit(low))
        return kept if high is None else kept & (v < F.lit(high))

    while todo:
        few = {w: t for w, t in todo.items() if t[1] <= FEW_VALUES}
        many = {w: t for w, t in todo.items() if w not in few}
        if few:
            keys = list(few)
            ends = list({(w[0], *few[w][2:]) for w in keys})
            row = df.agg(*[F.sort_array(F.collect_list(F.when(inside(*e), F.col(e[0]).cast("double")))).alias(str(k)) for k, e in enumerate(ends)]).first()
            for w in keys:
                done[w] = row[ends.index((w[0], *few[w][2:]))][w[1] - few[w][0]]
        if not many:
            break
        keys = list(many)
        sketches = []
        for k, (c, rank) in enumerate(keys):
            below, n, low, high = many[c, rank]
            place, wide = (rank - below) / n, 2 / _ACCURACY
            v = F.when(inside(c, low, high), F.col(c).cast("double"))
            sketches.append(F.percentile_approx(v, [max(0.0, place - wide), min(1.0, place + wide)], _ACCURACY).alias(str(k)))
        guesses = df.agg(*sketches).first()
        counts = []
        for k, (c, rank) in enumerate(keys):
            v, (a, b), within = F.col(c).cast("double"), guesses[k], inside(c, *many[c, rank][2:])
            counts += [F.count_if(within & (v < F.lit(a))).alias(f"{k}_0"), F.count_if(within & (v == F.lit(a))).alias(f"{k}_1"), F.count_if(within & (v > F.lit(a)) & (v < F.lit(b))).alias(f"{k}_2")]
            counts.append(F.count_if(within & (v == F.lit(b)) & (v > F.lit(a))).alias(f"{k}_3"))
        row = df.agg(*counts).first()
        todo = {}
        for k, w in enumerate(keys):
            (below, n, low, high), (a, b) = many[w], guesses[k]
            under, on_a, between, on_b = (row[f"{k}_{i}"] for i in range(4))
            steps = ((under, low, a, None), (on_a, a, a, a), (between, a, b, None), (on_b, b, b, b), (n - under - on_a - between - on_b, b, high, None))
            at = below
            for size, start, end, value in steps:
                if w[1] < at + size:
                    if value is not None:
                        done[w] = value
                    else:
                        todo[w] = (at, size, start, end)
                    break
                at += size
    return done


def duplicate_groups(df: DataFrame, keys: Sequence[str], name: str = "n_rows") -> DataFrame:
    """Rows of every group that has more than one, with the size of the group."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)
    return lookup(df, sizes, keys, "inner")


def breaks(df: DataFrame, col: str, step: int = 3) -> DataFrame:
    """Break points from zero to the largest value."""
    top = df.agg(F.max(col).cast("int").alias("top"))
    return top.select(F.explode(F.sequence(F.lit(0), "top", F.lit(step))).alias("break"))


COPIES_PER_TASK = 100_000


def with_record_id(df: DataFrame, name: str = "record_id") -> DataFrame:
    """An id made from the whole content of a row, with a running number among exact copies.

    It survives a new read, another row order and a review round trip.  Copies are counted, which needs no
    more than one row per group and task, and written out again from the count; the copies of a row with very
    many of them are spread over tasks in blocks.
    """
    content = df.columns
    counted = df.groupBy(*content).agg(F.count(F.lit(1)).alias("__n"))
    few = counted.where(F.col("__n") <= COPIES_PER_TASK).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__n")))
    blocks = counted.where(F.col("__n") > COPIES_PER_TASK).withColumn(
        "__first", F.explode(F.sequence(F.lit(1).cast("long"), "__n", F.lit(COPIES_PER_TASK).cast("long")))
    )
    spread = blocks.repartition(*content, "__first")
    last = F.least(F.col("__first") + (COPIES_PER_TASK - 1), F.col("__n"))
    many = spread.withColumn("__copy", F.explode(F.sequence("__first", last)))
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    record_id = F.concat_ws("-", digest, F.col("__copy").cast("string")).alias(name)
    return few.select(record_id, *content).unionByName(many.select(record_id, *content))


def global_rank(df: DataFrame, order_by: Sequence[str], name: str = "rank") -> DataFrame:
    """Number distinct rows from 1 in a total order, without sorting the table in one task.

    The rows are range-partitioned once and stored; the partitions' sizes (one small row each) give the
    offset of every partition, and rows are numbered inside their partition.  Runs a job.
    """
    ranged = cut_lineage(
        df.repartitionByRange(*[F.col(c) for c in order_by]).withColumn("__part", F.spark_partition_id())
    )
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    # One row per partition, so this window is as small as the partition count.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__part").orderBy(*order_by)
    ranked = ranged.withColumn("__within", F.row_number().over(within))
    return ranked.join(offsets, "__part").select(
        *df.columns, (F.col("__before") + F.col("__within")).alias(name)
    )


def with_level_rank(df: DataFrame, col: str, name: str = "level_rank") -> DataFrame:
    """Position of a row's category among the sorted distinct categories; null for a null."""
    levels = global_rank(df.select(col).where(F.col(col).isNotNull()).distinct(), [col], name)
    return left_lookup(df, levels, col)


def name_diff(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Names only one side has, with the side that lacks them."""
    only_a = a.select(col).subtract(b.select(col)).withColumn("missing_in", F.lit("right"))
    only_b = b.select(col).subtract(a.select(col)).withColumn("missing_in", F.lit("left"))
    return only_a.unionByName(only_b)


def side_by_side(a: DataFrame, b: DataFrame, col: str, names=("have", "want")) -> DataFrame:
    """Two sorted lists of distinct names next to each other; the shorter one ends in nulls."""
    left, right = [
        global_rank(df.select(F.col(col).alias(n)).where(F.col(n).isNotNull()).distinct(), [n], "line")
        for df, n in zip((a, b), names)
    ]
    return left.join(right, "line", "full")
