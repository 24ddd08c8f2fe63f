"""Spatial joins of points and polygon layers.

A layer is a table ``(layer_id, attributes…, rings, xmin, ymin, xmax, ymax)`` with
``rings array<array<struct<x,y>>>``; inner rings are holes, edges belong to the shape.

Every polygon is entered under the few grid cells its box covers, on the grid level that fits its size, so
that big and small shapes cost alike and a cell lists only shapes of about its own size.  Points look up
their cell on each level in use; the exact test runs on what is left after the boxes are compared.  Polygons of many
edges are cut into cells of few edges, so that a point is never tested against a whole coast line.

Whether a place lies in some polygon, or a polygon holds some place, is settled without a row for every pair, since both may be
dense: polygons of few edges are sorted out cell by cell, and one that holds a whole cell holds all its points.  Where all pairs are
wanted and points have places of their own, the pairs are made in one join of points and such cells, and never moved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbook.operators.joins import lookup
from tarnbook.session import PIECES, cut_lineage

RING_TYPE = "array<array<struct<x:double,y:double>>>"
BOX = ("xmin", "ymin", "xmax", "ymax")
CELL = ("lv", "cx", "cy")
_SPAN = 4  # a box is at most this many cells of its level wide
_FINEST = -10  # smallest cell is 4^-10
#: Edges from which on a polygon, or a cell of one, is cut into smaller cells.
CELL_EDGES = 64
_IN_VAIN = 4
#: Cells are cut again while the pairs left to test are more than this many times the rows, but not more often than _CUTS.
PAIRS_A_ROW = 8
_CUTS = 6
#: So many points of a cell are tested by a polygon's edges before it pays to cut the cell: a test that Spark compiles costs little.
POINTS_A_CUT = 1000
#: Edges that are tested by compiled code.
SLOTS = 4
PAIRS_A_TASK = 10_000_000
#: Points a place from which on places are searched once for all their points.
SHARED_PLACES = 4
FEW_PAIRS = 20_000_000
POINTS_A_BLOCK = 10_000
BROADCAST_CELLS = 10_000  # crowded cells sent to all tasks are no more


def flatten_rings(rings: Column) -> Column:
    """Rings with plain x and y; height and measure values are dropped."""
    return F.transform(
        rings,
        lambda ring: F.transform(
            ring, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))
        ),
    )


def with_box(df: DataFrame, rings: str = "rings") -> DataFrame:
    """Add the bounding box of the rings."""
    points = F.flatten(F.col(rings))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return df.withColumns(
        {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}
    )


def _edges_of_ring(ring: Column) -> Column:
    return F.zip_with(
        ring,
        F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def ring_edges(rings: Column) -> Column:
    """All edges of all rings; a ring that is not closed is closed."""
    return F.flatten(F.transform(rings, _edges_of_ring))


def _side(px: Column, py: Column, e: Column) -> Column:
    """Positive left of the edge, negative right of it, zero on its line."""
    return (e["x2"] - e["x1"]) * (py - e["y1"]) - (px - e["x1"]) * (e["y2"] - e["y1"])


def _on(px: Column, py: Column, e: Column) -> Column:
    """Whether a point lies on an edge."""
    return (
        (_side(px, py, e) == 0)
        & px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )


def covers(edges: Column, px: Column, py: Column) -> Column:
    """Whether the shape with these edges holds the point: odd number of crossings, or on an edge."""
    on_edge = F.exists(edges, lambda e: _on(px, py, e))
    crossed = F.filter(
        edges,
        lambda e: ((e["y1"] > py) != (e["y2"] > py)) & ((_side(px, py, e) > 0) == (e["y2"] > e["y1"])),
    )
    return on_edge | (F.size(crossed) % 2 == 1)


def _edges_meet(a: Column, b: Column) -> Column:
    def between(v, p, q):
        return v.between(F.least(p, q), F.greatest(p, q))

    def touches(x, y, e):
        return (_side(x, y, e) == 0) & between(x, e["x1"], e["x2"]) & between(y, e["y1"], e["y2"])

    apart = (F.signum(_side(b["x1"], b["y1"], a)) * F.signum(_side(b["x2"], b["y2"], a)) < 0) & (
        F.signum(_side(a["x1"], a["y1"], b)) * F.signum(_side(a["x2"], a["y2"], b)) < 0
    )
    return (
        apart
        | touches(b["x1"], b["y1"], a)
        | touches(b["x2"], b["y2"], a)
        | touches(a["x1"], a["y1"], b)
        | touches(a["x2"], a["y2"], b)
    )


def _cell_size(level: Column) -> Column:
    return F.pow(F.lit(4.0), level)


def _level(df: DataFrame) -> Column:
    width = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    fitted = F.ceil(F.log(F.greatest(width / _SPAN, F.lit(4.0**_FINEST))) / F.log(F.lit(4.0)))
    return F.greatest(fitted.cast("int"), F.lit(_FINEST))


def _cells(low_x, low_y, high_x, high_y, level: Column) -> Column:
    size = _cell_size(level)

    def span(low, high):
        return F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))

    return F.flatten(
        F.transform(
            span(low_x, high_x),
            lambda cx: F.transform(span(low_y, high_y), lambda cy: F.struct(level.alias("lv"), cx.alias("cx"), cy.alias("cy"))),
        )
    )


def _index(layer: DataFrame) -> DataFrame:
    """One small row per polygon and covered cell: the cell, the polygon's id and its box."""
    entries = layer.where("xmin IS NOT NULL").select(F.col("layer_id").alias("__layer"), *BOX, _level(layer).alias("__level"))
    cells = _cells(*[F.col(c) for c in BOX], F.col("__level"))
    split = [F.col(f"__cell.{c}").alias(f"__{c}") for c in CELL]
    return entries.withColumn("__cell", F.explode(cells)).select("__layer", *[F.col(c).alias(f"__{c}") for c in BOX], *split)


def _place_hits(places: DataFrame, layer: DataFrame, x: str, y: str) -> DataFrame:
    """``x, y, layer_id`` for every distinct place of ``places`` and polygon holding it.

    Only places and ids are searched.  Polygons of few edges are tested whole; those of more than :data:`CELL_EDGES` are cut into cells
    beforehand, and a place meets the edges of its own cell.
    """
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    real = (F.abs(px) < F.lit(float("inf"))) & (F.abs(py) < F.lit(float("inf")))  # neither null, NaN nor infinite
    # Many pairs come of few bytes, which would otherwise be searched in one task: Spark drops a second shuffle by the same columns,
    # and puts together the pieces of the first.
    asked = places.where(real).select(x, y).repartition(_tasks(layer), x, y).distinct()
    shapes = layer.where("xmin IS NOT NULL").select("layer_id", "rings", *BOX)
    levels, most = _profile(shapes)
    n_edges = F.aggregate("rings", F.lit(0), lambda n, ring: n + F.size(ring))
    few = n_edges <= CELL_EDGES
    found = _whole_hits(asked, shapes.where(few) if most > CELL_EDGES else shapes, levels, x, y)
    if most <= CELL_EDGES:
        return found
    return found.unionByName(_cell_hits(asked, cell_table(shapes.where(~few)), x, y))


def _tasks(df: DataFrame) -> int:
    """Partitions of a shuffle; those asked for by number are not put together, however few bytes they hold."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _profile(shapes: DataFrame) -> tuple[list[int], int]:
    """Grid levels the layer's polygons of few edges use (a few dozen small numbers at most), and the largest number of edges."""
    edges = F.aggregate("rings", F.lit(0), lambda n, ring: n + F.size(ring))
    rows = shapes.select(_level(shapes).alias("lv"), edges.alias("n")).groupBy("lv").agg(F.min("n").alias("least"), F.max("n").alias("most")).collect()
    return sorted(r["lv"] for r in rows if r["least"] <= CELL_EDGES) or [_FINEST], max((r["most"] for r in rows), default=0)


def _whole_hits(places: DataFrame, layer: DataFrame, levels: list[int], x: str, y: str) -> DataFrame:
    """Places in polygons of few edges: cell and box first, then the polygon's edges."""
    px, py = F.col(x).cast("double"), F.col(y).cast("double")

    def cell(level: int) -> Column:
        size = 4.0**level
        return F.struct(
            F.lit(level).alias("lv"), F.floor(px / size).cast("long").alias("cx"), F.floor(py / size).cast("long").alias("cy")
        )

    placed = places.withColumn("__point_cell", F.explode(F.array(*[cell(v) for v in levels])))
    in_box = px.between(F.col("__xmin"), F.col("__xmax")) & py.between(F.col("__ymin"), F.col("__ymax"))
    same_cell = reduce(lambda a, b: a & b, [F.col(f"__point_cell.{c}") == F.col(f"__{c}") for c in CELL])
    # The index is dealt by polygon, so that no task has all entries of a crowded cell while the places are few enough to be sent.
    index = _index(layer).repartition(_tasks(layer), "__layer")
    near = placed.join(index, same_cell & in_box).select(x, y, "__layer")
    # A polygon's shape is fetched once its box holds the point; it isn't copied into the cells.
    shapes = layer.select("layer_id", ring_edges(F.col("rings")).alias("__edges"))
    return near.join(shapes, F.col("__layer") == F.col("layer_id")).where(covers(F.col("__edges"), px, py)).select(x, y, "layer_id")


# --- polygons of many edges, cut into cells ---------------------------------------------------------------------------
#
# A cell is a square of side 2^lv.  For each polygon a cell knows the edges that meet it and whether its lower left corner is inside.
# Inside or not then changes with every edge crossed on the way from that corner to a point: first straight up, then to the
# right, never leaving the cell.  So that nothing depends on edges that run through corners, a corner stands for a point
# shifted to the right by next to nothing, and up by more than that: an end of an edge at its height is below it, one at its
# x is left of it, and an edge through it is right of it if it leans to the right.


def _crossed(e: Column, fx: Column, fy: Column, tx: Column, ty: Column) -> Column:
    """Whether an edge is crossed an odd number of times on the way from (fx, fy) up (or down) to ty, then aside to tx."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]

    def below(x, y):
        return _side(x, y, e) * F.signum(dx) < 0

    def left(x, y):
        side = _side(x, y, e) * F.signum(dy)
        return (side > 0) | ((side == 0) & (dx * dy > 0))

    up = ((e["x1"] > fx) != (e["x2"] > fx)) & (below(fx, ty) != below(fx, fy))
    aside = ((e["y1"] > ty) != (e["y2"] > ty)) & (left(fx, ty) != left(tx, ty))
    return up != aside


def _cell(lv: Column, cx: Column, cy: Column) -> Column:
    return F.named_struct(F.lit("lv"), lv, F.lit("cx"), cx, F.lit("cy"), cy)


def _corner(cell: Column) -> tuple[Column, Column, Column]:
    """Side length and lower left corner of a cell; exact, since all are whole multiples of a power of two."""
    size = F.pow(F.lit(2.0), cell["lv"])
    return size, cell["cx"] * size, cell["cy"] * size


def _meets(e: Column, cell: Column) -> Column:
    """Whether an edge may meet the closed cell; drawn a little wider, since an edge too many does no harm."""
    size, x, y = _corner(cell)
    wide = size * 1e-9
    x1, y1, x2, y2 = x - wide, y - wide, x + size + wide, y + size + wide
    boxes = (F.greatest(e["x1"], e["x2"]) >= x1) & (F.least(e["x1"], e["x2"]) <= x2) & (F.greatest(e["y1"], e["y2"]) >= y1) & (F.least(e["y1"], e["y2"]) <= y2)
    sides = [_side(a, b, e) for a in (x1, x2) for b in (y1, y2)]
    return boxes & (F.greatest(*sides) >= 0) & (F.least(*sides) <= 0)


def _parts(cell: Column) -> Column:
    """The sixteen cells a cell is cut into."""
    step = F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))
    lv = cell["lv"] - 2
    return F.flatten(
        F.transform(step, lambda i: F.transform(step, lambda j: _cell(lv, cell["cx"] * 4 + i, cell["cy"] * 4 + j)))
    )


def _near_parts(cell: Column, e: Column) -> Column:
    """Those of a cell's parts that an edge's box may meet."""
    size, x, y = _corner(cell)

    def span(a: Column, b: Column, low: Column) -> Column:
        def at(v: Column, wide: float) -> Column:
            return F.greatest(F.lit(0), F.least(F.lit(3), F.floor((v - low) / size * 4 + wide))).cast("long")

        return F.sequence(at(F.least(a, b), -1e-6), at(F.greatest(a, b), 1e-6))

    columns, rows = span(e["x1"], e["x2"], x), span(e["y1"], e["y2"], y)
    return F.flatten(F.transform(columns, lambda i: F.transform(rows, lambda j: _cell(cell["lv"] - 2, cell["cx"] * 4 + i, cell["cy"] * 4 + j))))


def _cut(rows: DataFrame, fx: Column, fy: Column, kids: Column, near: Column, rows_at: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Cut cells into parts: ``rows`` has a row per parent and edge (``layer_id, parent, inside, bottom, stuck, n_parent, e`` and more).

    Gives the parts (``layer_id, cell, inside, n, bottom, stuck``) and the edges in them (``layer_id, cell, e``).  Which parts' corners
    an edge toggles, on the way there from (``fx``, ``fy``), is a number with a bit for each part; the exclusive or over all edges
    tells where each corner lies.  Most edges are short and toggle nothing: those that cross neither the line of ``fx`` nor one of the
    parts' lower sides (``rows_at``).  ``near`` are the parts an edge's box may meet.
    """
    e = F.col("e")
    toggles = F.transform(kids, lambda k, i: F.when(_crossed(e, fx, fy, _corner(k)[1], _corner(k)[2]), F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long")))
    crosses = reduce(lambda a, b: a | b, [(e["y1"] > y) != (e["y2"] > y) for y in rows_at], (e["x1"] > fx) != (e["x2"] > fx))
    mask = F.when(crosses, F.aggregate(toggles, F.lit(0).cast("long"), lambda a, b: a + b)).otherwise(F.lit(0).cast("long"))
    met = F.filter(near, lambda k: _meets(e, k))
    of_parent = ["inside", "bottom", "stuck", "n_parent", *(["kids"] if "kids" in rows.columns else [])]
    staged = cut_lineage(rows.select("layer_id", "parent", *of_parent, mask.alias("mask"), met.alias("met"), "e"))
    edges = staged.select("layer_id", F.explode("met").alias("cell"), "e")
    counts = edges.groupBy(F.col("layer_id").alias("__id"), F.col("cell").alias("__cell")).agg(F.count(F.lit(1)).alias("n"))
    parents = staged.groupBy("layer_id", "parent").agg(F.bit_xor("mask").alias("mask"), *[F.any_value(c).alias(c) for c in of_parent])
    parts = parents.select("layer_id", *of_parent[:4], "mask", F.posexplode(kids).alias("place", "cell"))
    toggled = F.expr("shiftright(mask, place) & 1") == 1
    parts = parts.select("layer_id", "cell", (F.col("inside") != toggled).alias("inside"), *of_parent[1:4])
    cells = parts.join(counts, (F.col("layer_id") == F.col("__id")) & (F.col("cell") == F.col("__cell")), "left").drop("__id", "__cell")
    cells = cells.withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).where("inside or n > 0")
    stuck = F.when(F.col("n") * 4 > F.col("n_parent") * 3, F.col("stuck") + 1).otherwise(0)
    return cut_lineage(cells.withColumn("stuck", stuck).drop("n_parent")), edges


def cell_table(shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of polygons (``layer_id, rings`` and box): ``layer_id, cell, inside, n``, and ``layer_id, cell, edges`` for those with edges.

    A polygon starts with the cells its box meets on the grid of its own size (four at most), and a cell with more than
    :data:`CELL_EDGES` edges is cut into sixteen, level by level, until :data:`_IN_VAIN` cuts in a row left most of its edges in one part
    (edges that meet in one spot).  Cells without edges stay whole; those outside are dropped.  No row holds more than about
    ``CELL_EDGES`` edges: a cell that keeps more has several rows.
    """
    size = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    far = F.greatest(*[F.abs(F.col(c)) for c in BOX])
    # Cells are never so small that their numbers would not be exact.
    bottom = F.greatest(F.ceil(F.log2(F.greatest(far, F.lit(1e-200)))).cast("int") - 48, F.lit(-600))
    lv = F.greatest(F.ceil(F.log2(F.greatest(size, F.lit(1e-200)))).cast("int"), F.col("bottom"))
    placed = shapes.withColumn("bottom", bottom).withColumn("lv", lv).withColumn("size", F.pow(F.lit(2.0), F.col("lv")))

    def span(low: str, high: str) -> Column:
        return F.sequence(F.floor(F.col(low) / F.col("size")).cast("long"), F.floor(F.col(high) / F.col("size")).cast("long"))

    first = F.flatten(F.transform(span("xmin", "xmax"), lambda cx: F.transform(span("ymin", "ymax"), lambda cy: _cell(F.col("lv"), cx, cy))))
    rows = placed.select(
        "layer_id", _cell(F.col("lv"), F.lit(0).cast("long"), F.lit(0).cast("long")).alias("parent"), "bottom", first.alias("kids"), F.lit(False).alias("inside"),
        F.lit(0).alias("stuck"), F.lit(1 << 60).alias("n_parent"), "size",
        # From a place left of the box and below it, which is outside.
        *[((F.floor(F.col(c) / F.col("size")) - 1) * F.col("size")).alias(n) for c, n in (("xmin", "fx"), ("ymin", "fy"))],
        F.explode(ring_edges(F.col("rings"))).alias("e"),
    )
    # One shape may hold most edges: they are spread over all tasks before anything is computed.
    rows = rows.repartition(_tasks(shapes), "layer_id", "e")
    # The first corners are one and two cells above the outside place.
    cells, edges = _cut(rows, F.col("fx"), F.col("fy"), F.col("kids"), F.col("kids"), [F.col("fy") + F.col("size") * j for j in (1, 2)])
    same = (F.col("layer_id") == F.col("__id")) & (F.col("cell") == F.col("__cell"))
    done_cells, done_edges = [], []
    while True:
        crowded = (F.col("n") > CELL_EDGES) & (F.col("stuck") < _IN_VAIN) & (F.col("cell.lv") - 2 >= F.col("bottom"))
        done_cells.append(cells.where(~crowded).drop("bottom", "stuck"))
        own = cells.where(~crowded & (F.col("n") > 0)).select(F.col("layer_id").alias("__id"), F.col("cell").alias("__cell"), "n")
        done_edges.append(edges.join(own, same).select("layer_id", "cell", "n", "e"))
        left = cells.where(crowded)
        if left.isEmpty():
            break
        parents = left.select(F.col("layer_id").alias("__id"), F.col("cell").alias("__cell"), "bottom", "inside", "stuck", F.col("n").alias("n_parent"))
        rows = edges.join(parents, same).withColumnRenamed("cell", "parent").drop("__id", "__cell")
        size, fx, fy = _corner(F.col("parent"))
        cells, edges = _cut(rows, fx, fy, _parts(F.col("parent")), _near_parts(F.col("parent"), F.col("e")), [fy + size * (j / 4) for j in range(4)])
    cells, edges = (reduce(DataFrame.unionByName, parts) for parts in (done_cells, done_edges))
    chunk = F.when(F.col("n") > CELL_EDGES, F.pmod(F.xxhash64("e"), F.ceil(F.col("n") / CELL_EDGES))).otherwise(0)
    lists = edges.groupBy("layer_id", "cell", chunk.alias("chunk")).agg(F.collect_list("e").alias("edges"))
    return cut_lineage(cells), cut_lineage(lists)


def _cell_hits(places: DataFrame, table: tuple[DataFrame, DataFrame], x: str, y: str) -> DataFrame:
    """Places in polygons that were cut into cells."""
    cells, lists = table
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    levels = sorted(r[0] for r in cells.select("cell.lv").distinct().collect())
    # A place on the upper or right side of a cell is in the next one, whose edges include those on the common side.
    own = [_cell(F.lit(v), F.floor(px / 2.0**v).cast("long"), F.floor(py / 2.0**v).cast("long")) for v in levels]
    placed = places.select(x, y, F.explode(F.array(*own)).alias("__cell"))
    found = placed.join(cells, F.col("__cell") == F.col("cell")).select(x, y, "layer_id", "cell", "inside", "n")
    _, fx, fy = _corner(F.col("cell"))
    edges = lists.select(F.col("layer_id").alias("__id"), F.col("cell").alias("__cell"), "edges")
    met = found.where(F.col("n") > 0).join(edges, (F.col("layer_id") == F.col("__id")) & (F.col("cell") == F.col("__cell")))
    toggles = F.size(F.filter("edges", lambda e: _crossed(e, fx, fy, px, py))) % 2
    tested = met.select(x, y, "layer_id", "n", "inside", F.exists("edges", lambda e: _on(px, py, e)).alias("on"), toggles.alias("odd"))
    whole = tested.where((F.col("n") <= CELL_EDGES) & (F.col("on") | ((F.col("odd") == 1) != F.col("inside"))))
    # The few cells whose edges are in several rows.
    parts = tested.where(F.col("n") > CELL_EDGES).groupBy(x, y, "layer_id", "inside").agg(F.bool_or("on").alias("on"), F.bit_xor("odd").alias("odd"))
    parts = parts.where(F.col("on") | ((F.col("odd") == 1) != F.col("inside")))
    return reduce(DataFrame.unionByName, [df.select(x, y, "layer_id") for df in (found.where("n = 0"), whole, parts)])


# --- polygons of few edges, sorted out cell by cell -----------------------------------------------------------------------


def _few(layer: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Polygons of few edges, and those of many (none: there are none)."""
    shapes = layer.where("xmin IS NOT NULL AND layer_id IS NOT NULL")
    n_edges = F.aggregate("rings", F.lit(0), lambda n, ring: n + F.size(ring))
    few = n_edges <= CELL_EDGES
    if shapes.where(~few).isEmpty():
        return shapes, None
    return shapes.where(few), shapes.where(~few)


def _sorted_out(rows: DataFrame) -> DataFrame:
    """Cells of polygons (``__cell, __edges`` and more): ``__whole`` if no edge meets the cell, which is all inside.

    Cells outside are dropped.  Of the edges those are kept that tell, by :func:`covers`, where a point of the cell lies: those that are
    level with the cell and not left of it, and of those right of it that pass its whole height one if their number is odd.
    """
    def low(e, c):
        return F.least(e[f"{c}1"], e[f"{c}2"])

    def high(e, c):
        return F.greatest(e[f"{c}1"], e[f"{c}2"])

    x1, y1, x2, y2 = (F.col(f"__sides.{c}") for c in ("x1", "y1", "x2", "y2"))

    def meets(e):
        corners = [_side(a, b, e) for a in (x1, x2) for b in (y1, y2)]
        # An edge along an axis is its box; the edges are level with the cell and not left of it already.
        along = (e["x1"] == e["x2"]) | (e["y1"] == e["y2"])
        return (low(e, "x") <= x2) & (along | ((F.greatest(*corners) >= 0) & (F.least(*corners) <= 0)))

    def passes(e):
        return (low(e, "x") > x2) & (low(e, "y") < y1) & (high(e, "y") > y2)

    # What an explode gives is computed once; the optimizer would copy the same into every use of it.
    def once(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.withColumn(name, F.explode(F.array(value)))

    rows = once(rows, "__sides", _sides(F.col("__cell")))
    level = F.filter("__edges", lambda e: (high(e, "y") >= y1) & (low(e, "y") <= y2) & (high(e, "x") >= x1))
    rows = once(rows, "__edges", level)
    rows = once(rows, "__met", F.exists("__edges", meets))
    rows = rows.where(F.col("__met") | covers(F.col("__edges"), (x1 + x2) / 2, (y1 + y2) / 2))
    # An edge along x that is right of the cell tells nothing.
    near = F.filter("__edges", lambda e: (low(e, "x") <= x2) | ((e["y1"] != e["y2"]) & ~passes(e)))
    beyond = F.filter("__edges", passes)
    told = F.when(F.col("__met"), F.concat(near, F.slice(beyond, F.lit(1), F.size(beyond) % 2))).otherwise(F.slice("__edges", 1, 0))
    return rows.withColumns({"__edges": told, "__whole": ~F.col("__met")}).drop("__sides", "__met")


def _sides(cell: Column) -> Column:
    """A cell's sides, drawn a little wider."""
    def sides(size: Column, x: Column, y: Column) -> Column:
        wide = size * 1e-9 + (F.abs(x) + F.abs(y)) * 1e-14
        return F.struct((x - wide).alias("x1"), (y - wide).alias("y1"), (x + size + wide).alias("x2"), (y + size + wide).alias("y2"))

    return sides(*_corner(cell))


def _fine_cells(shapes: DataFrame, layer_id: str = "layer_id") -> DataFrame:
    """Polygons with their attributes, a row for every cell: ``__cell, __whole, __edges``; a box is up to sixteen cells wide.

    Cells are squares of side 2^lv here, as those of polygons of many edges.
    """
    # A polygon has many cells, so that few bytes are much work: they are spread over all tasks beforehand.
    boxed = shapes.repartition(_tasks(shapes), layer_id, *BOX).withColumn("__lv", F.greatest(_level(shapes) - 1, F.lit(_FINEST)))
    cells = F.transform(_cells(*[F.col(c) for c in BOX], F.col("__lv")), lambda c: _cell(c["lv"] * 2, c["cx"], c["cy"]))
    dealt = boxed.withColumns({"__cells": cells, "__edges": ring_edges(F.col("rings"))}).drop("rings", "__lv")
    # The outer form keeps Spark from computing the cells once more, before they are spread, for an inferred filter.
    return _sorted_out(dealt.withColumn("__cell", F.explode_outer("__cells")).drop("__cells", *BOX))


def _cut_again(rows: DataFrame) -> DataFrame:
    """Cells cut into sixteen parts each; the smallest stay as they are."""
    cell = F.col("__cell")
    parts = F.when(cell["lv"] > 2 * _FINEST, _parts(cell)).otherwise(F.array(cell))
    return _sorted_out(rows.drop("__whole").withColumn("__cell", F.explode(parts)))


def _levels(cells: DataFrame) -> list[int]:
    """Levels in use, a few dozen small numbers at most."""
    return sorted(r[0] for r in cells.select("__cell.lv").distinct().collect())


def _in_cells(places: DataFrame, levels: list[int], x: str, y: str) -> DataFrame:
    """Places, those at real coordinates, in their cell of every level: ``__lv, __cx, __cy``, and ``__px, __py``."""
    px, py = F.col("__px"), F.col("__py")
    finite = F.lit(float("inf"))
    cells = F.array(*[_cell(F.lit(v), F.floor(px / 2.0**v).cast("long"), F.floor(py / 2.0**v).cast("long")) for v in levels])
    numbers = places.withColumns({"__px": F.col(x).cast("double"), "__py": F.col(y).cast("double")})
    placed = numbers.where((F.abs(px) < finite) & (F.abs(py) < finite)).withColumn("__at", F.explode(cells.cast("array<struct<lv:int,cx:long,cy:long>>")))
    return placed.select("*", *[F.col(f"__at.{c}").alias(f"__{c}") for c in CELL]).drop("__at")


def _met_in(placed: DataFrame, cells: DataFrame, how: str = "inner") -> DataFrame:
    """Join of places and cells.  Many pairs come of few bytes, so neither side is sent to where the other happens to be."""
    keyed = cells.select("*", *[F.col(f"__cell.{c}").alias(f"__c_{c}") for c in CELL]).drop("__cell")
    same = reduce(lambda a, b: a & b, [F.col(f"__{c}") == F.col(f"__c_{c}") for c in CELL])
    return placed.join(keyed.hint("merge"), same, how)


def _some_hits(places: DataFrame, layer: DataFrame, x: str, y: str, of: str) -> DataFrame:
    """The distinct places in some polygon (``of="place"``: x, y), or polygons with some place (``of="layer"``: layer_id).

    What is settled by whole cells goes.  While there would still be many pairs to test, the cells that are left are cut again;
    then the pairs are tested.
    """
    key = [x, y] if of == "place" else ["layer_id"]
    few, many = _few(layer.select("layer_id", "rings", *BOX))
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    real = (F.abs(px) < F.lit(float("inf"))) & (F.abs(py) < F.lit(float("inf")))
    asked = places.where(real).select(x, y).distinct()
    found = []
    if many is not None:
        found.append(_cell_hits(asked, cell_table(many.select("layer_id", "rings", *BOX)), x, y).select(*key).distinct())
    cells = cut_lineage(_fine_cells(few))
    for again in range(_CUTS + 1):
        placed = _in_cells(asked, _levels(cells), x, y)
        whole, edged = cells.where("__whole"), cells.where(~F.col("__whole"))
        if of == "place":
            settled = cut_lineage(_met_in(placed, whole.select("__cell").distinct(), "left_semi").select(x, y).distinct())
            asked = cut_lineage(lookup(asked, settled, [x, y], "left_anti"))
        else:
            occupied = placed.select(F.struct(*[F.col(f"__{c}").alias(c) for c in CELL]).alias("__cell")).distinct()
            keyed = whole.select("layer_id", *[F.col(f"__cell.{c}").alias(f"__{c}") for c in CELL])
            settled = cut_lineage(_met_in(keyed, occupied, "left_semi").select("layer_id").distinct())
            edged = lookup(edged, settled, "layer_id", "left_anti")
        found.append(settled)
        placed = _in_cells(asked, _levels(cells), x, y)
        # Cells of both kinds of rows, counted: how many pairs there are to test.
        counts = placed.groupBy(*[F.col(f"__{c}").alias(c) for c in CELL]).agg(F.count(F.lit(1)).alias("__n"))
        edged = cut_lineage(edged.join(counts.select(F.struct(*CELL).alias("__cell"), "__n"), "__cell"))
        rows, pairs, least = edged.agg(F.count(F.lit(1)), F.sum("__n"), F.max("__cell.lv")).first()
        if again == _CUTS or not rows or pairs <= PAIRS_A_ROW * (rows + asked.count()) or least <= 2 * _FINEST:
            break
        cells = cut_lineage(_cut_again(edged.drop("__n")))
    tested = _met_in(placed, edged.drop("__n")).where(covers(F.col("__edges"), F.col("__px"), F.col("__py")))
    return reduce(DataFrame.unionByName, [*found, tested.select(*key)]).distinct()


def located_places(points: DataFrame, layer: DataFrame, xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """The distinct places that lie in some polygon."""
    return _some_hits(points, layer, *xy, "place")


def sampled_shapes(layer: DataFrame, points: DataFrame, xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """The ``layer_id`` of polygons that hold some point."""
    return _some_hits(points, layer, *xy, "layer")


def _point_hits(points: DataFrame, layer: DataFrame, x: str, y: str) -> DataFrame:
    """Columns of points and of polygons, without the geometry, for every (point, polygon holding it).

    There may be as many rows as points times polygons, so no row of the result is shuffled or joined again.  Where points have places of
    their own all rows are made in one join, by cell.  Where places are shared they are searched once and get all columns of
    their polygons, and their points come last; so are polygons of more than :data:`CELL_EDGES` edges, those that share their id, and
    tables so small that there are no more than :data:`FEW_PAIRS` pairs in any case.
    """
    told = [c for c in layer.columns if c not in ("rings", *BOX)]
    names = {c: f"__told_{i}" for i, c in enumerate(told)}
    places = cut_lineage(points.groupBy(x, y).agg(F.count(F.lit(1)).alias("__n")))
    n_places, n_points = places.agg(F.count(F.lit(1)), F.sum("__n")).first()
    rest, found = layer, []
    if n_points and n_points < SHARED_PLACES * n_places and n_places * layer.count() > FEW_PAIRS:
        n_edges = F.aggregate("rings", F.lit(0), lambda n, ring: n + F.size(ring))
        boxed = layer.where("xmin IS NOT NULL AND layer_id IS NOT NULL")
        by_id = boxed.groupBy("layer_id").agg(F.count(F.lit(1)).alias("n"), F.max(n_edges).alias("most"))
        by_id = cut_lineage(by_id.where((F.col("n") > 1) | (F.col("most") > CELL_EDGES)).select("layer_id"))
        rest = None if by_id.isEmpty() else lookup(layer, by_id, "layer_id", "left_semi")
        few = boxed if rest is None else lookup(boxed, by_id, "layer_id", "left_anti")
        shapes = few.select("rings", *BOX, *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
        found.append(_cell_pairs(points, shapes, x, y, names["layer_id"]))
    if rest is not None:
        hits = _place_hits(points, rest, x, y).select(F.col(x).alias("__x"), F.col(y).alias("__y"), F.col("layer_id").alias("__layer"))
        shown = rest.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
        described = hits.join(shown, F.col("__layer") == F.col(names["layer_id"])).drop("__layer")
        found.append(_place_pairs(points, places, n_points or 0, described, x, y))
    columns = [F.col(f"`{c}`") for c in points.columns]
    found = reduce(DataFrame.unionByName, [df.select(*columns, *names.values()) for df in found])
    return found.select(*columns, *[F.col(n).alias(c) for c, n in names.items()])


def _place_pairs(points: DataFrame, places: DataFrame, n_points: int, hits: DataFrame, x: str, y: str) -> DataFrame:
    """Points joined to what was found for their places (``__x, __y`` and more); places of very many points are dealt in blocks of them.

    By a merge, since Spark makes many rows of a key fastest that way.
    """
    block = max(POINTS_A_BLOCK, n_points // BROADCAST_CELLS)
    # No more than BROADCAST_CELLS.
    crowded = cut_lineage(places.where(F.col("__n") > block).select(F.col(x).alias("__cx"), F.col(y).alias("__cy"), F.ceil(F.col("__n") / block).alias("__blocks")))

    def dealt(df: DataFrame, x: str, y: str, to: str) -> DataFrame:
        return df.withColumn(to, F.xxhash64(*[F.col(c).cast("double") + 0.0 for c in (x, y)]))

    points, hits, keys, others = dealt(points, x, y, "__deal"), dealt(hits, "__x", "__y", "__h_deal"), ["__deal"], ["__h_deal"]
    if not crowded.isEmpty():
        own = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in points.columns]), "__blocks")
        points = points.join(F.broadcast(crowded), (F.col(x) == F.col("__cx")) & (F.col(y) == F.col("__cy")), "left")
        points = points.withColumn("__block", F.coalesce(own, F.lit(0).cast("long"))).drop("__cx", "__cy", "__blocks")
        hits = hits.join(F.broadcast(crowded), (F.col("__x") == F.col("__cx")) & (F.col("__y") == F.col("__cy")), "left")
        every = F.sequence(F.lit(0).cast("long"), F.coalesce("__blocks", F.lit(1).cast("long")) - 1)
        hits = hits.withColumn("__h_block", F.explode(every)).drop("__cx", "__cy", "__blocks")
        keys, others = [*keys, "__block"], [*others, "__h_block"]
    same = reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in zip(keys, others)])
    # Not written as equalities, which Spark would shuffle by: it takes no partitions by number for columns of floating point.
    for a, b in ((x, "__x"), (y, "__y")):
        same = same & (F.col(a) <= F.col(b)) & (F.col(a) >= F.col(b))
    tasks = max(_tasks(hits), min(PIECES, n_points // POINTS_A_BLOCK))
    return points.repartition(tasks, *keys).join(hits.repartition(tasks, *others).hint("merge"), same)


def _cell_pairs(points: DataFrame, shapes: DataFrame, x: str, y: str, layer_id: str) -> DataFrame:
    """Columns of points and attributes of polygons of few edges (``rings``, box and attributes), for every point in a polygon.

    A cell's polygons either hold it whole, or are tested by the edges that tell.  Cells are cut again where a polygon's edges would be
    tested for many points.  The cells of most pairs are dealt in blocks of points, so that no task has all pairs of a crowded spot.
    """
    attributes = [c for c in shapes.columns if c not in ("rings", *BOX)]
    at, cell = [f"__{c}" for c in CELL], F.struct(*[F.col(f"__{c}").alias(c) for c in CELL]).alias("__cell")
    left, done, in_use, total, lists = cut_lineage(_fine_cells(shapes, layer_id)), [], set(), 0, False
    for again in range(_CUTS + 1):
        crowds = _in_cells(points, _levels(left), x, y).groupBy(*at).agg(F.count(F.lit(1)).alias("__n")).select(cell, "__n")
        # Cells without points go.
        met_by = cut_lineage(left.join(crowds, "__cell"))
        listed = F.size("__edges") > SLOTS
        often = F.when(listed, POINTS_A_CUT // 10).otherwise(POINTS_A_CUT)
        crowded = ~F.col("__whole") & (F.col("__n") > often) & (F.col("__cell.lv") > 2 * _FINEST)
        crowded = F.lit(False) if again == _CUTS else crowded
        done.append(met_by.where(~crowded))
        lv, some_listed, n = done[-1].agg(F.collect_set("__cell.lv"), F.bool_or(listed), F.sum("__n")).first()
        in_use, lists, total = in_use | set(lv), lists or bool(some_listed), total + (n or 0)
        left = met_by.where(crowded).drop("__n")
        if again == _CUTS or left.isEmpty():
            break
        left = cut_lineage(_cut_again(left))
    cells, levels = reduce(DataFrame.unionByName, done), sorted(in_use)

    tasks = max(_tasks(shapes), min(PIECES, total // PAIRS_A_TASK))
    blocks = None
    if total > PAIRS_A_TASK:
        # The cells of so many pairs are no more than BROADCAST_CELLS.
        most = max(PAIRS_A_TASK // 4, total // BROADCAST_CELLS)
        sizes = cells.groupBy("__cell").agg(F.sum("__n").alias("__pairs")).where(F.col("__pairs") > most)
        blocks = cut_lineage(sizes.select("__cell", F.ceil(F.col("__pairs") / most).alias("__blocks")))
    placed, keys = _in_cells(points, levels, x, y), [*at]
    if blocks is not None:
        own = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in points.columns]), "__blocks")
        placed = placed.withColumn("__cell", cell).join(F.broadcast(blocks), "__cell", "left").withColumn("__block", F.coalesce(own, F.lit(0).cast("long")))
        every = F.sequence(F.lit(0).cast("long"), F.coalesce("__blocks", F.lit(1).cast("long")) - 1)
        cells = cells.join(F.broadcast(blocks), "__cell", "left").withColumn("__c_block", F.explode(every))
        keys.append("__block")
    placed = placed.select(*[F.col(f"`{c}`") for c in points.columns], "__px", "__py", *keys).repartition(tasks, *keys)

    def met(rows: DataFrame, edges: list[Column]) -> DataFrame:
        """Join of places and cells, sorted, since Spark makes many rows of a key fastest by a merge; as many tasks as asked for by number."""
        named = [F.col(f"__cell.{c}").alias(f"__c_{c}") for c in CELL] + [F.col("__c_block")] * (len(keys) > len(at))
        others = [f"__c_{c.removeprefix('__')}" for c in keys]
        same = reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in zip(keys, others)])
        return placed.join(rows.select(*attributes, "__whole", *edges, *named).repartition(tasks, *others).hint("merge"), same)

    def shown(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"`{c}`") for c in points.columns], *attributes)

    px, py = F.col("__px"), F.col("__py")
    found = shown(met(cells.where(~listed), _slots(F.col("__edges"))).where(F.col("__whole") | _in_slots(px, py)))
    if not lists:
        return found
    return found.unionByName(shown(met(cells.where(listed), [F.col("__edges")]).where(covers(F.col("__edges"), px, py))))


def _slots(edges: Column) -> list[Column]:
    """The first :data:`SLOTS` edges as plain numbers, none of them null; an edge that isn't there is NaN."""
    nothing = F.lit(float("nan"))
    return [F.coalesce(F.get(edges, F.lit(k))[c], nothing).alias(f"__{c}_{k}") for k in range(SLOTS) for c in ("x1", "y1", "x2", "y2")]


def _in_slots(px: Column, py: Column) -> Column:
    """:func:`covers` for the edges in slots, spelled out: short enough for the compiler, and nothing lies in NaN."""
    on, odd = [], []
    for k in range(SLOTS):
        e = {c: F.col(f"__{c}_{k}") for c in ("x1", "y1", "x2", "y2")}
        side = _side(px, py, e)
        odd.append(((e["y1"] > py) != (e["y2"] > py)) & ((side > 0) == (e["y2"] > e["y1"])))
        within = [F.signum(p - e[f"{c}1"]) * F.signum(p - e[f"{c}2"]) <= 0 for p, c in ((px, "x"), (py, "y"))]
        on.append((side == 0) & within[0] & within[1])
    return reduce(lambda a, b: a | b, on) | reduce(lambda a, b: a != b, odd)


def spatial_join(
    left: DataFrame,
    right: DataFrame,
    how: str = "inner",
    xy: tuple[str, str] = ("x", "y"),
    point_id: str | None = None,
) -> DataFrame:
    """Join by location; the kind follows from the sides and ``how``.

    * points, layer, ``inner``: every (point, polygon holding it), without the geometry
    * layer, points, ``semi``: polygons that hold a point
    * points, layer, ``semi`` or ``anti``: points that lie in some polygon, or in none (by ``point_id``)
    * layer, boundary layer, ``semi``: polygons that touch or overlap a polygon of the boundary

    Runs small jobs on the layer; polygons are cut into stored cells first.  Places that are null, NaN or infinite lie in no polygon.
    """
    left_is_layer, right_is_layer = "rings" in left.columns, "rings" in right.columns
    if left_is_layer and right_is_layer and how == "semi":
        return _touching(left, right)
    if left_is_layer and how == "semi":
        return lookup(left, sampled_shapes(left, right, xy), "layer_id", "left_semi")
    if right_is_layer and how == "inner":
        return _point_hits(left, right, *xy)
    if right_is_layer and how in ("semi", "anti"):
        # Search distinct places, then keep the points whose place was found (or was not).
        return lookup(left, located_places(left, right, xy), list(xy), f"left_{how}")
    raise ValueError(f"no {how} join of these sides")


def _touching(layer: DataFrame, boundary: DataFrame) -> DataFrame:
    """Shapes that share a point with a shape of the boundary.

    Either two edges meet, or one shape lies inside the other: then each of its rings does, or (several parts, holes) one of
    them, so one vertex of every ring is looked up in the other layer.  Edges are entered in grid cells of their own
    size and meet by an equi join; no row holds more than one edge of each side.
    """
    a, b = _edges(layer.select("layer_id", "rings"), "a"), _edges(boundary.select("layer_id", "rings"), "b")
    levels = sorted({r[0] for side in (a, b) for r in side.select("lv").distinct().collect()})
    pairs = _entered(a, "a", levels).join(_entered(b, "b", levels), ["cell"]).where(
        (F.col("own") == F.greatest("a_lv", "b_lv")) & (F.col("b_own") == F.col("own"))
    )
    crossing = pairs.where(_edges_meet(F.col("a_e"), F.col("b_e"))).select(F.col("a_id").alias("layer_id"))
    inside = _point_hits(_corners(layer, "__id"), boundary.select("layer_id", "rings", *BOX), "x", "y").select(F.col("__id").alias("layer_id"))
    around = _place_hits(_corners(boundary, "__id"), layer, "x", "y").select("layer_id")
    return lookup(layer, crossing.unionByName(inside).unionByName(around).distinct(), "layer_id", "left_semi")


def _corners(layer: DataFrame, name: str) -> DataFrame:
    """One vertex of every ring."""
    first = layer.select(F.col("layer_id").alias(name), F.explode("rings").alias("ring")).where(F.size("ring") > 0)
    return first.select(name, F.col("ring")[0]["x"].alias("x"), F.col("ring")[0]["y"].alias("y"))


def _edges(layer: DataFrame, side: str) -> DataFrame:
    """A row for every edge, with the grid level that fits its size."""
    edges = layer.select(F.col("layer_id").alias(f"{side}_id"), F.explode(ring_edges(F.col("rings"))).alias("e"))
    low, high = (f(F.col(f"e.{c}1"), F.col(f"e.{c}2")).alias(n) for f, c, n in ((F.least, "x", "xmin"), (F.greatest, "x", "xmax")))
    boxed = edges.select("*", low, F.least("e.y1", "e.y2").alias("ymin"), high, F.greatest("e.y1", "e.y2").alias("ymax"))
    return boxed.withColumn("lv", _level(boxed))


def _entered(edges: DataFrame, side: str, levels: list[int]) -> DataFrame:
    """Edges in the cells of their box, on their own level and all coarser ones in use."""
    every = F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<int>")
    on_level = edges.withColumn("own", F.explode(F.filter(every, lambda v: v >= F.col("lv"))))
    cells = on_level.withColumn("cell", F.explode(_cells(*[F.col(c) for c in BOX], F.col("own"))))
    return cells.select("cell", F.col("own").alias("own" if side == "a" else "b_own"), f"{side}_id", F.col("lv").alias(f"{side}_lv"), F.col("e").alias(f"{side}_e"))


def _half(rings: Column, axis: str, at: float, sign: int) -> Column:
    """The parts of rings on one side of a line across ``axis``: every edge gives where it enters, and its end if that is inside."""

    def inside(v: Column) -> Column:
        return v >= at if sign > 0 else v <= at

    def corner(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    def kept(e: Column) -> Column:
        a, b = e[f"{axis}1"], e[f"{axis}2"]
        if axis == "x":
            crossing = corner(F.lit(float(at)), e["y1"] + (at - e["x1"]) * (e["y2"] - e["y1"]) / (e["x2"] - e["x1"]))
        else:
            crossing = corner(e["x1"] + (at - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"]), F.lit(float(at)))
        end = corner(e["x2"], e["y2"])
        return (
            F.when(inside(a) & inside(b), F.array(end))
            .when(inside(a), F.array(crossing))
            .when(inside(b), F.array(crossing, end))
            .otherwise(F.array().cast("array<struct<x:double,y:double>>"))
        )

    return F.transform(rings, lambda ring: F.flatten(F.transform(_edges_of_ring(ring), kept)))


def ring_area(ring: Column) -> Column:
    """Area of one ring, whichever way it turns.  Heights count from the first corner, so that large coordinates cost no digits."""
    terms = F.transform(_edges_of_ring(ring), lambda e: (e["x2"] - e["x1"]) * ((e["y1"] - ring[0]["y"]) + (e["y2"] - ring[0]["y"])))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)) / 2


def clip_to_window(layer: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """The layer cut to a rectangle: rings are cut at its four sides, boxes made anew, shapes of which no area is left go.

    Shapes whose boxes miss the window are dropped before anything is cut, and shapes inside it stay as they are.  A ring that
    leaves the window and comes back stays one ring, which runs along the window's side.  Rings that become the whole window cancel out
    in pairs (a window in the hole of a shape).  An empty or null list of rings gives no row.
    """
    near = layer.where((F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin))
    within = (F.col("xmin") >= xmin) & (F.col("xmax") <= xmax) & (F.col("ymin") >= ymin) & (F.col("ymax") <= ymax)
    cut = flatten_rings(F.col("rings"))
    for axis, at, sign in (("x", xmin, 1), ("x", xmax, -1), ("y", ymin, 1), ("y", ymax, -1)):
        cut = _half(cut, axis, at, sign)
    window = (xmax - xmin) * (ymax - ymin)
    sized = F.transform(cut, lambda ring: F.struct(ring.alias("ring"), ring_area(ring).alias("area")))
    sized = F.filter(sized, lambda r: r["area"] > 0)
    whole = F.filter(F.col("__sized"), lambda r: r["area"] >= window)
    part = F.filter(F.col("__sized"), lambda r: r["area"] < window)
    left = F.concat(F.slice(whole, F.lit(1), F.size(whole) % 2), part)
    clipped = near.withColumn("__sized", F.when(~within, sized)).withColumn(
        "rings", F.when(within, flatten_rings(F.col("rings"))).otherwise(F.transform(left, lambda r: r["ring"]))
    )
    return with_box(clipped.drop("__sized", *BOX).where(F.size("rings") > 0))
