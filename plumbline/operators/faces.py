"""Closed faces of wall lines: noding at crossings, face tracing by half-edges, scoring of layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import grid_cell
from plumbline.operators.graph import min_label_components
from plumbline.operators.grid import along
from plumbline.sources.tables import written


def split_at_crossings(segments: DataFrame, cell: float, segment_id: str = "segment_id", group: Sequence[str] = ()) -> DataFrame:
    """(group, segment_id, x0, y0, x1, y1): the parts of every segment between its meetings with others of its group.

    Segments meet others in the grid cells along them. Parallel segments cut each other only
    through third ones.
    """
    listed = along(segments, cell, cx="cx", cy="cy")
    other = listed.select(*group, "cx", "cy", F.col(segment_id).alias("o"), *[F.col(c).alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")])
    dx, dy, ex, ey = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("o_x1") - F.col("o_x0"), F.col("o_y1") - F.col("o_y0")
    across = dx * ey - dy * ex
    t = ((F.col("o_x0") - F.col("x0")) * ey - (F.col("o_y0") - F.col("y0")) * ex) / across
    u = ((F.col("o_x0") - F.col("x0")) * dy - (F.col("o_y0") - F.col("y0")) * dx) / across
    one = [*group, segment_id]
    met = listed.join(other, [*group, "cx", "cy"]).where(F.col(segment_id) != F.col("o")).where(across != 0).select(*one, t.alias("t"), u.alias("u"))
    cuts = met.where("t between 0 and 1 and u between 0 and 1").groupBy(*one).agg(F.collect_set("t").alias("cuts"))
    whole = segments.join(cuts, one, "left")
    ends = F.array_sort(F.array_distinct(F.concat(F.coalesce("cuts", F.array().cast("array<double>")), F.array(F.lit(0.0), F.lit(1.0)))))
    whole = whole.withColumn("ends", ends)
    parts = F.transform(F.sequence(F.lit(1), F.size("ends") - 1), lambda i: F.struct(F.element_at("ends", i).alias("a"), F.element_at("ends", i + 1).alias("b")))
    cut = whole.withColumn("p", F.explode(parts))
    at = lambda axis, end: (F.col(f"{axis}0") + F.col(f"p.{end}") * (F.col(f"{axis}1") - F.col(f"{axis}0"))).alias(f"{axis}{'0' if end == 'a' else '1'}")
    return cut.select(*one, at("x", "a"), at("y", "a"), at("x", "b"), at("y", "b"))


def trace_faces(parts: DataFrame, tolerance: float, min_area: float, group: Sequence[str] = ()) -> DataFrame:
    """(group, face_id, area, n_edges, n_holes, min_x, min_y, max_x, max_y) of the bounded faces of noded lines.

    Ends snap to grid cells. At each node the outgoing half-edges are ordered by angle; arriving from u, a
    face goes on along the edge just clockwise of the way back. Half-edges joined to their next are the
    faces, so components give them without walking. A ring walked clockwise is the outside of its lines: where it lies
    inside a face of other lines (the smallest that holds one of its points), it is that face's hole and its area is
    subtracted.
    """
    cell = lambda x, y: F.concat_ws(":", *[F.col(g).cast("string") for g in group], grid_cell(F.col(x), tolerance).cast("string"), grid_cell(F.col(y), tolerance).cast("string"))
    ends = [(F.bround(F.col(c) / tolerance) * tolerance).alias(n) for c, n in (("x0", "ux"), ("y0", "uy"), ("x1", "vx"), ("y1", "vy"))]
    one = parts.select(*group, cell("x0", "y0").alias("u"), cell("x1", "y1").alias("v"), *ends)
    back = one.select(*group, F.col("v").alias("u"), F.col("u").alias("v"), F.col("vx").alias("ux"), F.col("vy").alias("uy"), F.col("ux").alias("vx"), F.col("uy").alias("vy"))
    half = one.union(back).where("u <> v").dropDuplicates(["u", "v"])
    half = half.withColumn("angle", F.atan2(F.col("vy") - F.col("uy"), F.col("vx") - F.col("ux")))
    node = Window.partitionBy("u").orderBy("angle")
    everyone = node.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turned = half.withColumn("next", F.coalesce(F.lag("v").over(node), F.last("v").over(everyone)))
    edge = lambda a, b: F.concat_ws("|", a, b)
    links = turned.select(edge("v", "u").alias("u"), edge("u", "next").alias("v"))
    met = half.withColumn("node", edge("u", "v")).join(min_label_components(links), "node").withColumnRenamed("component", "face_id")
    doubled = F.sum(F.col("ux") * F.col("vy") - F.col("vx") * F.col("uy"))
    rings, _ = written(met.select(*group, "face_id", "ux", "uy", "vx", "vy"), "rings")
    found = rings.groupBy(*group, "face_id").agg(
        (doubled / 2).alias("area"), F.count("*").alias("n_edges"), F.min("ux").alias("min_x"), F.min("uy").alias("min_y"), F.max("ux").alias("max_x"), F.max("uy").alias("max_y"),
        F.min(F.struct("ux", "uy")).alias("corner"),
    )
    found, _ = written(found, "faces")
    inner, outer = found.where("area > 0"), found.where("area < 0")
    # An outside ring's leftmost corner lies in a face where an odd number of the face's edges pass below it.
    at = outer.select(*group, F.col("face_id").alias("hole"), (-F.col("area")).alias("hole_area"), F.col("corner.ux").alias("px"), F.col("corner.uy").alias("py"))
    within = (F.col("px") > F.col("min_x")) & (F.col("px") < F.col("max_x")) & (F.col("py") > F.col("min_y")) & (F.col("py") < F.col("max_y"))
    middle = inner.agg(F.percentile_approx(F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")), 0.5)).first()[0]
    size = F.lit(max(tolerance, middle or 1.0))
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / size).cast("long"), F.floor(F.col(high) / size).cast("long")))
    boxes = inner.select(*group, "face_id", "area", "min_x", "max_x", "min_y", "max_y").withColumn("cx", cells("min_x", "max_x")).withColumn("cy", cells("min_y", "max_y"))
    at = at.withColumn("cx", F.floor(F.col("px") / size).cast("long")).withColumn("cy", F.floor(F.col("py") / size).cast("long"))
    near = at.join(boxes, [*group, "cx", "cy"]).where(within).select(*group, "hole", "hole_area", "px", "py", "face_id", "area")
    y = F.col("uy") + (F.col("px") - F.col("ux")) / (F.col("vx") - F.col("ux")) * (F.col("vy") - F.col("uy"))
    passes = ((F.col("ux") > F.col("px")) != (F.col("vx") > F.col("px"))) & (y < F.col("py"))
    held = near.join(rings, [*group, "face_id"]).groupBy(*group, "hole", "hole_area", "face_id", "area").agg((F.count_if(passes) % 2).alias("odd")).where("odd = 1")
    owner = held.groupBy(*group, "hole").agg(F.min_by(F.struct("face_id", "hole_area"), F.struct("area", "face_id")).alias("o"))
    holes = owner.groupBy(*group, F.col("o.face_id").alias("face_id")).agg(F.sum("o.hole_area").alias("holes"), F.count("*").alias("n_holes"))
    out = inner.join(holes, [*group, "face_id"], "left").withColumn("area", F.col("area") - F.coalesce("holes", F.lit(0.0)))
    return out.where(F.col("area") >= min_area).select(*group, "face_id", "area", "n_edges", F.coalesce("n_holes", F.lit(0).cast("long")).alias("n_holes"), "min_x", "min_y", "max_x", "max_y")


def wall_rooms(walls: DataFrame, cell: float, tolerance: float = 0.1, min_area: float = 1.0, group: Sequence[str] = ()) -> DataFrame:
    """Room faces of wall lines, numbered in each group by bounds and area."""
    found = trace_faces(split_at_crossings(walls, cell, group=group), tolerance, min_area, group)
    order = Window.partitionBy(*group, "min_x").orderBy("min_y", "max_x", "max_y", "area")
    return found.withColumn("room_id", F.concat_ws("-", F.lit("wall-room"), F.col("min_x").cast("string"), F.row_number().over(order).cast("string")))
