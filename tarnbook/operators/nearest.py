"""Nearest-site join: every point gets its closest site, exactly, however far away that is.

The sites are summed up in a grid of nested cells (16 to a cell and level).  A point starts with the whole
extent and, level by level, replaces each cell it still considers by the occupied cells inside; cells that
cannot hold anything closer than a site already seen are dropped.  Each step is an equi join on the cell, so
neither all pairs nor all pairs of a crowded spot are ever formed: a cell that is still crowded gets a grid of
its own, laid over the tight box of its sites, and so on without an end given in advance.  A few far away sites
thus cost one more grid and nothing else.  Points and sites that share coordinates are searched once.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnbook.operators.joins import left_lookup
from tarnbook.session import cut_lineage

LEAF_SITES = 16  # refine until a cell holds no more sites than this
FIRST_LEVELS = 12  # most levels of the grid over the whole extent
MORE_LEVELS = 3  # levels of the grid over a cell that is still crowded
BROADCAST_ROWS = 200_000  # a level with no more cells than this is sent to all tasks


def nearest_join(
    points: DataFrame,
    sites: DataFrame,
    site_id: str,
    xy: tuple[str, str] = ("x", "y"),
    site_xy: tuple[str, str] | None = None,
    max_distance_m: float | None = None,
    distance_col: str = "distance_m",
    how: str = "left",
    k: int = 1,
    rank_col: str = "nearest_rank",
) -> DataFrame:
    """Columns of ``points``, the distance, and the columns of the nearest site (without coordinates).

    ``site_id`` is unique; the lowest one wins a tie.  With ``max_distance_m`` (inclusive) sites beyond it do
    not count.  Points without a site, or without coordinates, keep nulls (``how="left"``) or go
    (``how="inner"``).  With ``k`` over 1 a point has a row for each of its ``k`` nearest sites (all, if there are fewer), numbered
    in ``rank_col``.  Runs jobs on the sites that size and store the grid.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    site_xy = site_xy or xy
    payload = sites.drop(*site_xy)
    clash = sorted((set(payload.columns) | ({rank_col} if k > 1 else set())) & set(points.columns))
    if clash:
        raise ValueError(f"both sides have {clash}")

    px, py = (F.col(c).cast("double") for c in xy)
    places = points.select(px.alias("px"), py.alias("py"))
    named = sites.select(F.col(site_xy[0]).alias("x"), F.col(site_xy[1]).alias("y"), F.col(site_id).alias("site"))
    hits = nearest_sites(places, named, max_distance_m) if k == 1 else k_nearest_sites(places, named, k, max_distance_m)
    ranks = [F.col("rank").alias(rank_col)] if k > 1 else []
    hits = hits.select(F.col("px").alias("__x"), F.col("py").alias("__y"), F.col("site").alias("__site"), F.col("distance").alias(distance_col), *ranks)
    located = points.join(hits, (px == F.col("__x")) & (py == F.col("__y")), how).drop("__x", "__y")
    if payload.columns == [site_id]:
        return located.withColumnRenamed("__site", site_id)
    target = payload.withColumn("__id", F.col(site_id))
    return located.join(target, F.col("__site") == F.col("__id"), "left").drop("__site", "__id")


def nearest_sites(points: DataFrame, sites: DataFrame, max_distance: float | None = None) -> DataFrame:
    """(px, py, site, distance) for the distinct coordinates of ``points`` (px, py)."""
    targets = cut_lineage(_real(sites).groupBy("x", "y").agg(F.min("site").alias("site")))
    box = _extent(targets)
    probes = points.dropna().distinct()
    if box.n == 0:
        return probes.limit(0).select("px", "py", F.lit(None).alias("site"), F.lit(0.0).alias("distance"))

    tree = _tree(targets, box)
    beyond = F.lit(float("inf") if max_distance is None else float(max_distance))
    nothing = F.lit(None)
    # Cell 0 is everything.  It is computed rather than a literal, so that the first step is an equi join too.
    everything = F.pmod(F.xxhash64("px"), F.lit(1))
    found = probes.select(
        "px", "py", everything.alias("cell"), F.lit(2).cast("long").alias("n"),
        F.lit(0.0).alias("gap"), beyond.alias("reach"), nothing.cast(targets.schema["site"].dataType).alias("site"),
    )
    per_point = Window.partitionBy("px", "py")
    for cells, n_cells in tree.levels:
        cells = F.broadcast(cells) if n_cells <= BROADCAST_ROWS else cells.hint("merge")
        # A cell with a single site is settled: it has no inner cells and is carried along.
        step = found.join(cells, F.expr("cell = c_parent AND n > 1"), "left").selectExpr(
            "px", "py",
            "coalesce(c_cell, cell) AS cell",
            "coalesce(c_n, n) AS n",
            # Closest the cell's box comes to the point, and the distance of a site known to be in it.
            f"if(c_n IS NULL, gap, {_distance('greatest(c_xmin - px, px - c_xmax, 0D)', 'greatest(c_ymin - py, py - c_ymax, 0D)')}) AS gap",
            f"if(c_n IS NULL, reach, {_distance('c_x - px', 'c_y - py')}) AS reach",
            "coalesce(c_site, site) AS site",
        )
        # No point keeps more than a few cells, however dense points or sites are.
        step = step.withColumn("bound", F.least(F.min("reach").over(per_point), beyond))
        found = step.where("gap <= bound").drop("bound")

    last = tree.leaves.selectExpr("leaf AS t_cell", "x AS t_x", "y AS t_y", "site AS t_site")
    last = F.broadcast(last) if box.n <= BROADCAST_ROWS else last.hint("merge")
    pairs = found.join(last, F.expr("cell = t_cell AND n > 1"), "left").selectExpr(
        "px", "py", "coalesce(t_site, site) AS site", f"if(t_site IS NULL, reach, {_distance('t_x - px', 't_y - py')}) AS distance"
    )
    best = pairs.where(F.col("distance") <= beyond).groupBy("px", "py").agg(F.min(F.struct("distance", "site")).alias("best"))
    return best.select("px", "py", "best.site", "best.distance")


def _real(sites: DataFrame) -> DataFrame:
    """Sites with an id and finite coordinates."""
    rows = sites.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "site").dropna()
    return rows.where(F.greatest(F.abs("x"), F.abs("y")) < float("inf"))


def _extent(targets: DataFrame):
    return targets.agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x"), F.min("y").alias("y"),
        F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"),
    ).first()


def k_nearest_sites(points: DataFrame, sites: DataFrame, k: int, max_distance: float | None = None) -> DataFrame:
    """(px, py, rank, site, distance) of the ``k`` nearest sites of the distinct coordinates of ``points`` (px, py).

    The tree is descended as for one site.  A cell's number of places, all of them no farther than its far corner, bounds the
    k-th distance: of the cells a point still considers, taken by their far corners, the first that bring the number to ``k``.
    Sites that share a place are searched once; of each place the ``k`` lowest ids are kept.
    """
    lowest = Window.partitionBy("x", "y").orderBy("site")
    ranked = _real(sites).distinct().withColumn("rank", F.row_number().over(lowest)).where(F.col("rank") <= k)
    targets = cut_lineage(ranked.groupBy("x", "y").agg(F.min("site").alias("site"), F.sort_array(F.collect_list("site")).alias("ids")))
    box = _extent(targets)
    probes = points.dropna().distinct()
    kind = targets.schema["site"].dataType
    if box.n == 0:
        return probes.limit(0).select("px", "py", F.lit(0).alias("rank"), F.lit(None).cast(kind).alias("site"), F.lit(0.0).alias("distance"))
    tree = _tree(targets.drop("ids"), box)
    beyond = F.lit(float("inf") if max_distance is None else float(max_distance))
    everything = F.pmod(F.xxhash64("px"), F.lit(1))
    none = F.lit(None).cast("double")
    found = probes.select(
        "px", "py", everything.alias("cell"), F.lit(2).cast("long").alias("n"), F.lit(0.0).alias("gap"), F.lit(float("inf")).alias("far"), none.alias("sx"), none.alias("sy")
    )
    by_far = Window.partitionBy("px", "py").orderBy("far", "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_point = Window.partitionBy("px", "py")
    for cells, n_cells in tree.levels:
        cells = F.broadcast(cells) if n_cells <= BROADCAST_ROWS else cells.hint("merge")
        step = found.join(cells, F.expr("cell = c_parent AND n > 1"), "left").selectExpr(
            "px", "py",
            "coalesce(c_cell, cell) AS cell",
            "coalesce(c_n, n) AS n",
            f"if(c_n IS NULL, gap, {_distance('greatest(c_xmin - px, px - c_xmax, 0D)', 'greatest(c_ymin - py, py - c_ymax, 0D)')}) AS gap",
            f"if(c_n IS NULL, far, {_distance('greatest(abs(px - c_xmin), abs(px - c_xmax))', 'greatest(abs(py - c_ymin), abs(py - c_ymax))')}) AS far",
            "coalesce(c_x, sx) AS sx", "coalesce(c_y, sy) AS sy",
        )
        step = step.withColumn("upto", F.sum("n").over(by_far))
        reached = F.min(F.when(F.col("upto") >= k, F.col("far"))).over(per_point)
        found = step.withColumn("bound", F.least(F.coalesce(reached, F.lit(float("inf"))), beyond)).where("gap <= bound").drop("bound", "upto")
    last = tree.leaves.selectExpr("leaf AS t_cell", "x AS t_x", "y AS t_y")
    last = F.broadcast(last) if box.n <= BROADCAST_ROWS else last.hint("merge")
    places = found.join(last, F.expr("cell = t_cell AND n > 1"), "left").selectExpr("px", "py", "coalesce(t_x, sx) AS x", "coalesce(t_y, sy) AS y")
    measured = places.selectExpr("px", "py", "x", "y", f"{_distance('x - px', 'y - py')} AS distance").where(F.col("distance") <= beyond)
    # At most k places count, so no more of them get their ids.
    near = measured.withColumn("place", F.rank().over(per_point.orderBy("distance"))).where(F.col("place") <= k)
    pairs = near.join(targets.select(F.col("x").alias("t_x"), F.col("y").alias("t_y"), "ids"), F.expr("x = t_x AND y = t_y")).select("px", "py", "distance", F.explode("ids").alias("site"))
    order = per_point.orderBy("distance", "site")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("px", "py", "rank", "site", "distance")


def _distance(dx: str, dy: str) -> str:
    return f"sqrt(({dx}) * ({dx}) + ({dy}) * ({dy}))"


class Tree(NamedTuple):
    """Stored cells and their number, level by level, and every site's cell on the last level it has."""

    levels: list[tuple[DataFrame, int]]
    leaves: DataFrame


def _placed(sites: DataFrame, levels: int) -> DataFrame:
    """Sites with their column and row in the grid of their root, a box with a corner (x0, y0) and a side (span)."""
    side = 4**levels
    return sites.withColumns(
        {
            name: F.when(F.col("span") > 0, F.least(F.floor((F.col(c) - F.col(low)) / F.col("span") * side), F.lit(side - 1))).otherwise(F.lit(0).cast("long"))
            for name, c, low in (("col", "x", "x0"), ("row", "y", "y0"))
        }
    )


def _cell(level: int, levels: int) -> str:
    """A cell's number: of the root itself on level 0, else made from the root and the place in its grid."""
    if level == 0:
        return "root"
    shift = 2 * (levels - level)
    return f"xxhash64(root, {level}, shiftright(col, {shift}), shiftright(row, {shift}))"


def _tree(targets: DataFrame, box) -> Tree:
    levels = min(FIRST_LEVELS, 1 + max(1, math.ceil(math.log(max(box.n / LEAF_SITES, 1), 16))))
    # Computed rather than a literal, like the cell the points start in.
    roots = targets.withColumns({"root": F.pmod(F.xxhash64("x"), F.lit(1)), "x0": F.lit(box.x), "y0": F.lit(box.y), "span": F.lit(float(box.span))})
    found, leaves = [], []
    while True:
        keyed = _placed(roots, levels)
        stored = cut_lineage(reduce(DataFrame.unionByName, [_cells(keyed, k, levels) for k in range(1, levels + 1)]), "level")
        # One row per level.
        seen = {r.level: r for r in stored.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.max("c_n").alias("crowd")).collect()}
        found += [(stored.where(F.col("level") == k).drop("level"), seen[k].n) for k in sorted(seen)]
        placed = keyed.selectExpr("x", "y", "site", f"{_cell(levels, levels)} AS leaf")
        if levels not in seen or seen[levels].crowd <= LEAF_SITES:
            return Tree(found, reduce(DataFrame.unionByName, [*leaves, placed]))
        # Cells that are still crowded are roots of their own.
        crowded = stored.where((F.col("level") == levels) & (F.col("c_n") > LEAF_SITES)).selectExpr(
            "c_cell AS crowded", "c_xmin", "c_ymin", "greatest(c_xmax - c_xmin, c_ymax - c_ymin) AS width"
        )
        leaves.append(placed.join(crowded, F.col("leaf") == F.col("crowded"), "left_anti"))
        roots = cut_lineage(
            placed.join(crowded, F.col("leaf") == F.col("crowded")).selectExpr(
                "x", "y", "site", "crowded AS root", "c_xmin AS x0", "c_ymin AS y0", "width AS span"
            )
        )
        levels = MORE_LEVELS


def _cells(keyed: DataFrame, level: int, levels: int) -> DataFrame:
    """Occupied cells of a level: parent, number of sites, tight box, and one site as a witness.

    A cell whose parent holds a single site says nothing new and is left out, so that deep levels list only
    crowded places.
    """
    cells = keyed.selectExpr("x", "y", "site", f"{_cell(level - 1, levels)} AS c_parent", f"{_cell(level, levels)} AS c_cell").groupBy("c_parent", "c_cell").agg(
        *[
            F.expr(e)
            for e in (
                "count(1) AS c_n", "min(x) AS c_xmin", "max(x) AS c_xmax", "min(y) AS c_ymin", "max(y) AS c_ymax",
                "min_by(x, site) AS c_x", "min_by(y, site) AS c_y", "min(site) AS c_site",
            )
        ]
    )
    siblings = Window.partitionBy("c_parent")  # at most 16 rows
    return (
        cells.withColumn("together", F.sum("c_n").over(siblings))
        .where("together > 1" if level > 1 else "true")
        .drop("together")
        .withColumn("level", F.lit(level))
    )
