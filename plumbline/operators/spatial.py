"""2-D joins by grid cells: nearest neighbour, point in box and polygon, Voronoi, length splitting.

Radius joins put both sides on a grid of cells as wide as the radius; the smaller-cardinality side is
listed under its nine neighbouring cells and the join is an equi-join on the cell. Lines are listed under the
cells along them, boxes on the level of a pyramid of grids that fits their size (``grid``). No cross join of
sides that grow, and no broadcast of one: what is listed under several cells is larger than Spark reckons, so such
joins ask for a merge. Rows at one place have one answer: a search is made once for each place, and of the others at
one place only the first can win. ``group``
columns (a revision, a sheet) keep drawings apart: rows meet only within their group, and results carry it.
Rows with a null group or without coordinates meet nothing; left sides keep them with nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import box_distance_squared, distance, inside_ring, point_segment_distance
from plumbline.operators.grid import along, boxes_at, levels_of, points_at, ring_lines
from plumbline.sources.tables import Scratch

#: Rooms listed under one cell that are tried at once; of more, the smallest come first, four times as many in each round.
ROOMS_AT_ONCE = 64


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size)).cast("long")


def _around(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    spread = lambda v: F.explode(F.array(*[_cell(v, size) + d for d in (-1, 0, 1)]))
    return spread(x), spread(y)


def within_radius(points: DataFrame, others: DataFrame, radius: float, group: Sequence[str] = ()) -> DataFrame:
    """Pairs at most radius apart: points' columns, others' columns, ``distance``.

    Both sides have x, y and the group columns; other column names must differ.
    """
    left = points.withColumn("__cx", _cell(F.col("x"), radius)).withColumn("__cy", _cell(F.col("y"), radius))
    right = others.withColumnsRenamed({"x": "other_x", "y": "other_y"})
    cx, cy = _around(F.col("other_x"), F.col("other_y"), radius)
    right = right.withColumn("__cx", cx).withColumn("__cy", cy)
    met = left.join(right.hint("merge"), [*group, "__cx", "__cy"]).withColumn("distance", distance(F.col("x"), F.col("y"), F.col("other_x"), F.col("other_y")))
    return met.where(F.col("distance") <= radius).drop("__cx", "__cy")


def _places(points: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, x, y): the places of the points, each once."""
    return points.select(*group, "x", "y").where("x is not null and y is not null").distinct()


def nearest_within(points: DataFrame, others: DataFrame, radius: float, point_id: str, order: Sequence[str], pick: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """The nearest other of each point (ties by order); points with none in reach have nulls."""
    at = [*group, "x", "y"]
    firsts = others.groupBy(*at).agg(F.min(F.struct(*order)).alias("__o"), F.min_by(F.struct(*pick), F.struct(*order)).alias("__p"))
    met = within_radius(_places(points, group), firsts, radius, group)
    best = met.groupBy(*at).agg(F.min_by(F.struct("__p", "distance"), F.struct("distance", "__o")).alias("__b"))
    return points.join(best.hint("merge"), at, "left").select(*points.columns, *[F.col(f"__b.__p.{c}").alias(c) for c in pick], F.col("__b.distance").alias("distance"))


def nearest_with_ties(
    points: DataFrame, others: DataFrame, radius: float, point_id: str, choose: Sequence[str], eps: float = 1e-9, group: Sequence[str] = ()
) -> DataFrame:
    """As nearest_within, where all within eps of the true minimum tie and the smallest in ``choose`` wins; ``tied`` says so."""
    at = [*group, "x", "y"]
    firsts = others.groupBy(*at).agg(F.min(F.struct(*choose)).alias("__c"), F.count("*").alias("__n"))
    met = within_radius(_places(points, group), firsts, radius, group).withColumn("__low", F.min("distance").over(Window.partitionBy(*at)))
    ties = met.where(F.col("distance") <= F.col("__low") + eps)
    best = ties.groupBy(*at).agg(F.min("__c").alias("__c"), F.min("distance").alias("distance"), (F.sum("__n") > 1).alias("tied"))
    return points.join(best.hint("merge"), at, "left").select(*[points[c] for c in points.columns], *[F.col(f"__c.{c}").alias(c) for c in choose], "distance", "tied")


def nearest_run(tags: DataFrame, segments: DataFrame, radius: float, tag_id: str, run: str, eps: float = 1e-9, group: Sequence[str] = ()) -> DataFrame:
    """Tag to run by the smallest point-to-segment distance; the lowest run wins a tie, which is flagged ambiguous.

    Segments (x0, y0, x1, y1) are listed under the cells along them that the radius reaches.
    """
    one = [*group, "x", "y"]
    s = along(segments, radius, radius)
    t = _places(tags, group).withColumn("__cx", _cell(F.col("x"), radius)).withColumn("__cy", _cell(F.col("y"), radius))
    d = point_segment_distance(*[F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")])
    per_run = t.join(s, [*group, "__cx", "__cy"]).withColumn("distance", d).where(F.col("distance") <= radius).groupBy(*one, run).agg(F.min("distance").alias("distance"))
    w = Window.partitionBy(*one)
    near = per_run.withColumn("__low", F.min("distance").over(w)).where(F.col("distance") <= F.col("__low") + eps)
    best = near.groupBy(*one).agg(F.min(run).alias(run), F.min("distance").alias("distance"), (F.count("*") > 1).alias("ambiguous"))
    return tags.join(best.hint("merge"), one, "left").select(*tags.columns, run, "distance", "ambiguous")


def in_boxes(points: DataFrame, boxes: DataFrame, cell: float, group: Sequence[str] = ()) -> DataFrame:
    """Point and box pairs, edges included; boxes have a ``box`` struct of min_x, min_y, max_x, max_y."""
    b, p = boxes_at(boxes, cell), points_at(points, levels_of(boxes, cell), cell)
    inside = F.col("x").between(F.col("box.min_x"), F.col("box.max_x")) & F.col("y").between(F.col("box.min_y"), F.col("box.max_y"))
    return p.join(b.hint("merge"), [*group, "__level", "__cx", "__cy"]).where(inside).drop("__level", "__cx", "__cy")


def ring_box(ring: Column) -> Column:
    """The box of an array of points; its sides are null for an empty one."""
    ends = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    return F.struct(
        ends(F.array_min, "x").alias("min_x"), ends(F.array_min, "y").alias("min_y"), ends(F.array_max, "x").alias("max_x"), ends(F.array_max, "y").alias("max_y")
    )


def smallest_room(points: DataFrame, rooms: DataFrame, cell: float, point_id: str, room: str = "room_id", group: Sequence[str] = ()) -> DataFrame:
    """The smallest room (area, then id) whose ring contains the point, its boundary included; null outside all rooms.

    Points meet rooms by their boxes; rings are fetched for those that meet, so a ring isn't copied for each of its cells.
    Rooms are written first, since they are read several times. Where a cell lists many rooms, they are tried by size in rounds, and a place that has a room meets no larger ones.
    """
    one = [*group, point_id]
    with Scratch(rooms.sparkSession) as s:
        rooms = s.table(rooms.select(*group, room, "area", "ring", ring_box(F.col("ring")).alias("box")), "rooms", keep=True)
    boxed = rooms.select(*group, room, "area", "box")
    lists = [*group, "__level", "__cx", "__cy"]
    if not boxes_at(boxed, cell).groupBy(*lists).count().where(F.col("count") > ROOMS_AT_ONCE).isEmpty():
        best = _rooms_by_size(_places(points, group), boxed, rooms.select(*group, room, "ring"), cell, room, group)
        return points.join(best.hint("merge"), [*group, "x", "y"], "left").select(*points.columns, room)
    near = in_boxes(points.select(*one, "x", "y"), boxed, cell, group)
    met = near.join(rooms.select(*group, room, "ring").hint("merge"), [*group, room]).where(inside_ring(F.col("x"), F.col("y"), F.col("ring")))
    best = met.groupBy(*one).agg(F.min_by(F.col(room), F.struct("area", room)).alias(room))
    return points.join(best.hint("merge"), one, "left").select(*points.columns, room)


def _rooms_by_size(places: DataFrame, boxed: DataFrame, rings: DataFrame, cell: float, room: str, group: Sequence[str]) -> DataFrame:
    """(group, x, y, room): the smallest room of the places that one holds.

    The rooms of a cell's list are cut by size into blocks; in its round a block meets the places that have no room or one that is larger than the
    block's smallest.
    """
    lists, at = [*group, "__level", "__cx", "__cy"], [*group, "x", "y"]
    size = F.struct("area", room)
    with Scratch(places.sparkSession) as s:
        rank = F.row_number().over(Window.partitionBy(*lists).orderBy("area", room))
        block = F.ceil(F.log2(F.greatest(rank / ROOMS_AT_ONCE, F.lit(1.0))) / 2).cast("int")
        listed = s.table(boxes_at(boxed, cell).withColumn("__block", block), "listed")
        rings = s.table(rings, "rings")
        smallest = s.table(listed.groupBy(*lists, "__block").agg(F.min(size).alias("__low")), "blocks")
        last = smallest.agg(F.max("__block")).first()[0]
        known = s.table(places.withColumn("__best", F.lit(None).cast(smallest.schema["__low"].dataType)), "places", keep=last is None)
        levels = levels_of(boxed, cell)
        for i in range(-1 if last is None else last + 1):
            own, first = listed.where(F.col("__block") == i).drop("__block"), smallest.where(F.col("__block") == i).drop("__block")
            open_ = points_at(known, levels, cell).join(first.hint("merge"), lists).where(F.col("__best").isNull() | (F.col("__low") < F.col("__best")))
            inside = F.col("x").between(F.col("box.min_x"), F.col("box.max_x")) & F.col("y").between(F.col("box.min_y"), F.col("box.max_y"))
            near = open_.join(own.hint("merge"), lists).where(inside & (F.col("__best").isNull() | (size < F.col("__best")))).select(*at, room, "area")
            met = near.join(rings.hint("merge"), [*group, room]).where(inside_ring(F.col("x"), F.col("y"), F.col("ring")))
            found = met.groupBy(*at).agg(F.min(size).alias("__found"))
            known = s.table(known.join(found.hint("merge"), at, "left").select(*at, F.least("__best", "__found").alias("__best")), "places", keep=i == last)
    return known.where("__best is not null").select(*at, F.col(f"__best.{room}").alias(room))


def box_filter(rows: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float, box: str = "box") -> DataFrame:
    """Rows whose box meets the query box; rows without a box don't."""
    b = F.col(box)
    return rows.where((b["min_x"] <= max_x) & (b["max_x"] >= min_x) & (b["min_y"] <= max_y) & (b["max_y"] >= min_y))


def near_point(rows: DataFrame, x: float, y: float, radius: float, box: str = "box") -> DataFrame:
    """Rows whose box lies at most radius from the point; rows without a box don't."""
    return rows.where(box_distance_squared(F.lit(x), F.lit(y), F.col(box)) <= radius * radius)


def contained_or_nearest(points: DataFrame, devices: DataFrame, radius: float, point_id: str, device_id: str, group: Sequence[str] = ()) -> DataFrame:
    """Device whose box contains the point, else the nearest box within radius; lowest id on ties."""
    grown = devices.withColumn(
        "__box",
        F.struct(
            (F.col("box.min_x") - radius).alias("min_x"), (F.col("box.min_y") - radius).alias("min_y"),
            (F.col("box.max_x") + radius).alias("max_x"), (F.col("box.max_y") + radius).alias("max_y"),
        ),
    ).withColumnRenamed("box", "__own").withColumnRenamed("__box", "box")
    one = [*group, "x", "y"]
    met = in_boxes(_places(points, group), grown, radius * 4, group).withColumn("__d", box_distance_squared(F.col("x"), F.col("y"), F.col("__own"))).where(F.col("__d") <= radius * radius)
    best = met.groupBy(*one).agg(F.min(F.struct((F.col("__d") > 0).alias("outside"), F.col("__d").alias("d"), F.col(device_id))).alias("__b"))
    return points.join(best.hint("merge"), one, "left").select(*points.columns, F.col(f"__b.{device_id}").alias(device_id), (~F.col("__b.outside")).alias("contained"))


def bounded_voronoi(points: DataFrame, anchors: DataFrame, margin: float, point_id: str, number: str, group: Sequence[str], radius: float) -> DataFrame:
    """Nearest anchor (ties by number) of points inside the anchors' box grown by margin; radius bounds the search.

    With a radius of at least the box's diagonal the search is unbounded.
    """
    box = anchors.groupBy(*group).agg(*[f(c).alias(f"__{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])
    held = points.join(box, list(group)).where(
        F.col("x").between(F.col("__min_x") - margin, F.col("__max_x") + margin) & F.col("y").between(F.col("__min_y") - margin, F.col("__max_y") + margin)
    ).select(*points.columns)
    found = nearest_within(held, anchors, radius, point_id, [number], [number], group)
    one = [*group, point_id]
    return points.join(found.select(*one, number), one, "left")


def box_ring(box: Column) -> Column:
    """The four corners of a box."""
    corner = lambda x, y: F.struct(box[x].alias("x"), box[y].alias("y"))
    return F.array(corner("min_x", "min_y"), corner("max_x", "min_y"), corner("max_x", "max_y"), corner("min_x", "max_y"))


def ring_parts(segments: DataFrame, rooms: DataFrame, segment_id: str, room: str, cell: float, group: Sequence[str] = ()) -> DataFrame:
    """(group, segment, t, x, y, length, room): the parts of segments between the edges of rings, with their middle and the smallest room
    (area, then id) whose ring holds it, else null.

    Segments and the rings' edges meet as lines, in the cells along them. Parts cover the segment exactly. Cuts and parts are rows: no array
    grows with the number of rooms, and no ring is copied for each of its cells. A segment without length is one part, without coordinates it is none that any room holds.
    """
    one = [*group, segment_id]
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    ends = segments.select(*one, "x0", "y0", "x1", "y1")
    edges = along(ring_lines(rooms, list(group)), cell, ends=("ax", "ay", "bx", "by"))
    ex, ey, fx, fy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("ax") - F.col("x0"), F.col("ay") - F.col("y0")
    across = F.nullif(dx * ey - dy * ex, F.lit(0.0))
    met = along(ends, cell).join(edges.hint("merge"), [*group, "__cx", "__cy"]).select(*one, ((fx * ey - fy * ex) / across).alias("t"), ((fx * dy - fy * dx) / across).alias("u"))
    cuts = met.where("t > 0 and t < 1 and u >= 0 and u <= 1").select(*one, "t").union(ends.select(*one, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))).distinct()
    w = Window.partitionBy(*one).orderBy("t")
    parts = cuts.withColumn("__b", F.lead("t").over(w)).where("__b is not null").join(ends.hint("merge"), one)
    middle = lambda v: (F.col(f"{v}0") + (F.col("t") + F.col("__b")) / 2 * (F.col(f"{v}1") - F.col(f"{v}0"))).alias(v)
    parts = parts.select(*one, "t", middle("x"), middle("y"), ((F.col("__b") - F.col("t")) * F.sqrt(dx * dx + dy * dy)).alias("length"), F.struct(segment_id, "t").alias("__part"))
    with Scratch(segments.sparkSession) as s:
        parts = s.table(parts, "parts", keep=True)
    held = smallest_room(parts, rooms.select(*group, F.col(room).alias("room_id"), "area", "ring"), cell, "__part", group=group)
    return held.select(*one, "t", "x", "y", "length", F.col("room_id").alias(room))


def split_by_rings(segments: DataFrame, rooms: DataFrame, segment_id: str, room: str, cell: float, group: Sequence[str] = ()) -> DataFrame:
    """(group, segment, room, length): each part of a segment goes to the smallest room (area, then id) whose ring holds it, the rest to null.

    Rooms have a ring and an area. A segment is cut wherever it crosses the edge of a ring; the middle of each part decides.
    """
    return ring_parts(segments, rooms, segment_id, room, cell, group).groupBy(*group, segment_id, room).agg(F.sum("length").alias("length"))


def split_by_boxes(segments: DataFrame, boxes: DataFrame, segment_id: str, room: str, cell: float, group: Sequence[str] = ()) -> DataFrame:
    """``split_by_rings`` for rooms that are boxes."""
    area = (F.col("box.max_x") - F.col("box.min_x")) * (F.col("box.max_y") - F.col("box.min_y"))
    return split_by_rings(segments, boxes.select(*group, room, box_ring(F.col("box")).alias("ring"), area.alias("area")), segment_id, room, cell, group)


def band_attribution(
    overlaps: DataFrame, segment_id: str, band: str, min_share: float = 0.3, near: float = 0.1, margin: float = 0.02, group: Sequence[str] = ()
) -> DataFrame:
    """(group, segment, band, basis) from (group, segment, band, overlap share, distance): the widest overlap of at least
    min_share wins (ties by band); else the nearest band within near whose lead over the second is margin, or the only
    candidate band; else the segment is shared (null band)."""
    one = [*group, segment_id]
    ranked = overlaps.withColumn("__r", F.row_number().over(Window.partitionBy(*one).orderBy(F.asc("distance"), F.asc(band))))
    met = ranked.groupBy(*one).agg(
        F.min(F.struct((-F.col("overlap")).alias("o"), F.col(band).alias("band"))).alias("top"), F.count("*").alias("n"),
        *[F.max(F.when(F.col("__r") == i, F.col(c))).alias(f"{n}{i}") for i, n, c in ((1, "band", band), (1, "distance", "distance"), (2, "distance", "distance"))],
    )
    by_overlap = -F.col("top.o") >= min_share
    by_distance = (F.col("distance1") < near) & ((F.col("n") == 1) | (F.col("distance2") - F.col("distance1") >= margin))
    return met.select(
        *one,
        F.when(by_overlap, F.col("top.band")).when(by_distance, F.col("band1")).alias(band),
        F.when(by_overlap, "overlap").when(by_distance, "nearest").otherwise("shared").alias("basis"),
    )


def sheet_membership(entities: DataFrame, windows: DataFrame, entity_id: str, window_index: str, cell: float, group: Sequence[str] = ()) -> DataFrame:
    """(entity columns, on_sheet, viewports): windows whose box meets the entity's; on_sheet is null without an extent.

    Equal boxes are looked up once: each different box of windows meets each different box of entities in the first cell that
    both are listed under, and a list of windows is made for each different box of entities.
    """
    low = lambda b, axis: _cell(b[f"min_{axis}"], cell)
    cells = lambda axis: F.explode(F.sequence(low(F.col("box"), axis), _cell(F.col(f"box.max_{axis}"), cell)))
    listed = lambda df: df.withColumn("__cx", cells("x")).withColumn("__cy", cells("y"))
    sides = ("min_x", "min_y", "max_x", "max_y")
    # Zeros of both signs are one side, so that equal boxes are equal keys.
    flat = lambda df: df.select(*df.columns, *[(F.col(f"box.{side}") + 0.0).alias(f"__{side}") for side in sides])
    at = [*group, *[f"__{side}" for side in sides]]
    boxes = lambda df: flat(df.where(F.col("box").isNotNull()).select(*group, "box")).select(*at).distinct().select(*at, F.struct(*[F.col(f"__{side}").alias(side) for side in sides]).alias("box"))
    e = listed(boxes(entities))
    w = listed(boxes(windows)).select(*group, "__cx", "__cy", F.col("box").alias("__w"))
    a, b = F.col("box"), F.col("__w")
    meets = (a["min_x"] <= b["max_x"]) & (a["max_x"] >= b["min_x"]) & (a["min_y"] <= b["max_y"]) & (a["max_y"] >= b["min_y"])
    first = (F.col("__cx") == F.greatest(low(a, "x"), low(b, "x"))) & (F.col("__cy") == F.greatest(low(a, "y"), low(b, "y")))
    met = e.join(w.hint("merge"), [*group, "__cx", "__cy"]).where(meets & first).select(*at, "__w")
    of_window = flat(windows.select(*group, window_index, "box")).select(*group, window_index, F.struct(*[F.col(f"__{side}").alias(side) for side in sides]).alias("__w"))
    hits = met.join(of_window.hint("merge"), [*group, "__w"]).groupBy(*at).agg(F.array_sort(F.collect_set(window_index)).alias("viewports"))
    located = F.col("box").isNotNull()
    out = flat(entities).join(hits.hint("merge"), at, "left").select(*entities.columns, "viewports").withColumn("on_sheet", F.when(located, F.col("viewports").isNotNull()))
    return out.withColumn("viewports", F.when(located, F.coalesce("viewports", F.array().cast(hits.schema["viewports"].dataType))))
