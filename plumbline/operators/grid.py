"""Grid cells that lines and boxes touch: what the spatial joins list their rows under.

A line is listed under the cells along it, not under those of its whole box, so that it takes rows in proportion to its
length. A box is listed on the level of a pyramid of grids whose cells are at least as wide as the box, so that it takes
four rows at most, and a point is looked up once on each level that any box of the table uses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENDS = ("x0", "y0", "x1", "y1")
#: A line also lists the cells that it misses by this part of a cell, more than rounding can move it.
SLACK = 1e-9


def cell_of(v: Column, size: float | Column) -> Column:
    return F.floor(v / size).cast("long")


def along(lines: DataFrame, cell: float, margin: float = 0.0, ends: Sequence[str] = ENDS, cx: str = "__cx", cy: str = "__cy", level: str | None = None) -> DataFrame:
    """The lines' rows under each cell that the line, widened by ``margin``, touches: about length / cell * 2 rows.

    With ``level``, a column, the cells are those of that level of the pyramid. A line without all its coordinates has no row.
    """
    x0, y0, x1, y1 = (F.col(c) for c in ends)
    size = F.lit(float(cell)) if level is None else F.lit(float(cell)) * F.pow(F.lit(2.0), F.col(level))
    pad = F.lit(margin) + size * SLACK
    span = lambda low, high: F.explode(F.sequence(cell_of(low - pad, size), cell_of(high + pad, size)))
    columns = lines.where(x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull()).withColumn(cx, span(F.least(x0, x1), F.greatest(x0, x1)))
    inside = lambda x: F.least(F.greatest(x, F.least(x0, x1)), F.greatest(x0, x1))
    height = lambda x: y0 + (x - x0) / F.nullif(x1 - x0, F.lit(0.0)) * (y1 - y0)
    left, right = F.col(cx) * size - pad, (F.col(cx) + 1) * size + pad
    one, two = F.coalesce(height(inside(left)), y0), F.coalesce(height(inside(right)), y1)
    return columns.withColumn(cy, span(F.least(one, two), F.greatest(one, two)))


def _level(box: Column, cell: float) -> Column:
    """The level of a box: cells of ``cell`` doubled so often that none of its sides is longer."""
    side = F.greatest(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"]) / F.lit(float(cell))
    return F.greatest(F.ceil(F.log2(F.greatest(side, F.lit(1.0)))), F.lit(0)).cast("int")


def boxes_at(boxes: DataFrame, cell: float, box: str = "box") -> DataFrame:
    """The rows under (__level, __cx, __cy), up to four for each box."""
    b = F.col(box)
    listed = boxes.where(b["min_x"].isNotNull() & b["min_y"].isNotNull() & b["max_x"].isNotNull() & b["max_y"].isNotNull()).withColumn("__level", _level(b, cell))
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("__level"))
    for v in "xy":
        listed = listed.withColumn(f"__c{v}", F.explode(F.sequence(cell_of(b[f"min_{v}"], size), cell_of(b[f"max_{v}"], size))))
    return listed


def levels_of(boxes: DataFrame, cell: float, box: str = "box") -> DataFrame:
    """(__level): the levels that the boxes are listed on, some tens at most."""
    return boxes.select(_level(F.col(box), cell).alias("__level")).where("__level is not null").distinct()


def points_at(points: DataFrame, levels: DataFrame, cell: float) -> DataFrame:
    """The points (x, y) under (__level, __cx, __cy) on each of the levels."""
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("__level"))
    met = points.crossJoin(F.broadcast(levels))
    return met.withColumn("__cx", cell_of(F.col("x"), size)).withColumn("__cy", cell_of(F.col("y"), size))


def ring_lines(rings: DataFrame, keys: Sequence[str], ring: str = "ring") -> DataFrame:
    """(keys, edge, ax, ay, bx, by): the edges of rings as rows, numbered, the closing one too."""
    r = F.col(ring)
    following = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    pairs = F.zip_with(r, following, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    return rings.select(*keys, F.posexplode(pairs).alias("edge", "__e")).select(*keys, "edge", "__e.*")


def inside_rows(candidates: DataFrame, edges: DataFrame, point: Sequence[str], ring: Sequence[str], band: float) -> DataFrame:
    """(point, ring) of the candidates (point, ring, x, y) whose ring holds the point, its boundary included.

    edges: as ``ring_lines`` makes them, with the ring columns. A point meets those edges only that reach its row of height ``band``.
    """
    size = F.lit(float(band))
    listed = edges.withColumn("__row", F.explode(F.sequence(cell_of(F.least("ay", "by"), size), cell_of(F.greatest("ay", "by"), size))))
    met = candidates.withColumn("__row", cell_of(F.col("y"), size)).join(listed, [*ring, "__row"])
    c = F.col
    cross = (c("bx") - c("ax")) * (c("y") - c("ay")) - (c("by") - c("ay")) * (c("x") - c("ax"))
    on = (cross == 0) & c("x").between(F.least("ax", "bx"), F.greatest("ax", "bx")) & c("y").between(F.least("ay", "by"), F.greatest("ay", "by"))
    at = (c("bx") - c("ax")) * (c("y") - c("ay")) / F.nullif(c("by") - c("ay"), F.lit(0.0)) + c("ax")
    crosses = ((c("ay") > c("y")) != (c("by") > c("y"))) & (c("x") < at)
    counted = met.groupBy(*dict.fromkeys([*point, *ring])).agg(F.count_if(crosses).alias("__n"), F.max(on).alias("__on"))
    return counted.where("__on or __n % 2 = 1").drop("__n", "__on")
