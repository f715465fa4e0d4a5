"""Rooms: rings as rooms, names and numbers, devices and lengths by room, and the pipeline over them.

All inputs may hold many drawings at once; ``group`` columns keep them apart. Rooms have room_id, ring, area and, after
naming, number and name. Ties go to the smallest area, then id. Rows without coordinates belong to no room.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import inside_ring, ring_area, room_number
from plumbline.operators import room_arrays
from plumbline.operators.arrays import IN_A_TASK, LARGE, of_drawings, passes
from plumbline.operators.normalize import valid_polygon
from plumbline.operators.spatial import in_boxes, nearest_within, ring_box, smallest_room, split_by_rings, within_radius
from plumbline.sources.tables import Scratch
from plumbline.sources.workers import ready_workers

#: Most rounds of a pairing that are one plan's union; then they are written as one table.
PLAN_STEPS = 16


def rooms_from_rings(entities: DataFrame, entity_id: str, source: str, group: Sequence[str] = (), layers: Column | None = None, closed: str = "closed") -> DataFrame:
    """(group, room_id, ring, area, box, source) of the closed, valid rings among entities (points, closed), on the given layers if any.

    An entity that is explicitly open, has fewer than three points, a point that isn't finite or no area isn't a room.
    """
    kept = entities if layers is None else entities.where(layers)
    ring = kept.where(~F.col(closed).eqNullSafe(False)).where(valid_polygon(F.col("points")))
    return ring.select(*group, F.col(entity_id).alias("room_id"), F.col("points").alias("ring"), F.abs(ring_area(F.col("points"))).alias("area"), ring_box(F.col("points")).alias("box"), F.lit(source).alias("source"))


def first_strategy(candidates: DataFrame, group: Sequence[str], rank: str) -> DataFrame:
    """The rooms of each group's first strategy that found any."""
    best = candidates.groupBy(*group).agg(F.min(rank).alias("__r"))
    return candidates.join(best, list(group)).where(F.col(rank) == F.col("__r")).drop("__r")


def named_rooms(rooms: DataFrame, labels: DataFrame, cell: float, group: Sequence[str] = ()) -> DataFrame:
    """Rooms with number and name from the labels (label_id, x, y, text) inside them: the first label by id that is a number,
    and the first that isn't; a label names the smallest room that holds it, and a name that a room has stays."""
    held = smallest_room(labels, rooms, cell, "label_id", group=group).where("room_id is not null")
    number = room_number(F.col("text"))
    found = held.groupBy(*group, "room_id").agg(
        F.min_by(F.when(number.isNotNull(), number), F.when(number.isNotNull(), F.col("label_id"))).alias("__number"),
        F.min_by(F.when(number.isNull(), F.trim("text")), F.when(number.isNull(), F.col("label_id"))).alias("__name"),
    )
    met = rooms.join(found, [*group, "room_id"], "left")
    known = lambda c: F.col(c) if c in rooms.columns else F.lit(None).cast("string")
    return met.select(*[c for c in rooms.columns if c not in ("number", "name")], F.coalesce(known("number"), "__number").alias("number"), F.coalesce(known("name"), "__name").alias("name"))


def entities_in_room(entities: DataFrame, rooms: DataFrame, room_id: Column | str, entity_id: str, cell: float, group: Sequence[str] = ()) -> DataFrame:
    """(group, room_id, entity): entities (box) whose box's middle lies in the asked room and in no smaller one."""
    at = entities.where(F.col("box").isNotNull()).select(*group, entity_id, ((F.col("box.min_x") + F.col("box.max_x")) / 2).alias("x"), ((F.col("box.min_y") + F.col("box.max_y")) / 2).alias("y"))
    asked = rooms.where(F.col("room_id") == room_id)
    box = lambda f, c: f(F.transform(F.col("ring"), lambda p: p[c]))
    near = asked.select(*group, F.struct(box(F.array_min, "x").alias("min_x"), box(F.array_min, "y").alias("min_y"), box(F.array_max, "x").alias("max_x"), box(F.array_max, "y").alias("max_y")).alias("box"))
    with Scratch(rooms.sparkSession) as s:
        some = s.table(in_boxes(at, near, cell, group).select(*group, entity_id, "x", "y").distinct(), "points", keep=True)
    return smallest_room(some, rooms, cell, entity_id, group=group).where(F.col("room_id") == room_id).select(*group, "room_id", entity_id)


def pair_in_order(candidates: DataFrame, actor: str, other: str, distance: str, group: Sequence[str] = (), eps: float | None = None) -> DataFrame:
    """(group, actor, other): each actor in order takes the nearest other that no earlier actor took (ties by other).

    With ``eps``, an actor whose two nearest free others are that close takes none, and is done. Rounds settle the actors none of
    whose candidates an earlier pending actor has too; every round settles the first pending actor of each group at least.
    """
    keys = [*group, other]
    with Scratch(candidates.sparkSession) as s:
        rest, taken, rounds = s.table(candidates.select(*group, actor, other, distance).distinct(), "pairs"), None, 0
        while not rest.isEmpty():
            first = rest.groupBy(*keys).agg(F.min(actor).alias("__first"))
            marked = rest.join(first.hint("merge"), keys).groupBy(*group, actor).agg(F.max("__first").alias("__last"), F.sort_array(F.collect_list(F.struct(distance, other))).alias("__c"), F.count_if(F.col("__first") < F.col(actor)).alias("__blocked"))
            ready = s.table(marked.where("__blocked = 0").select(*group, actor, F.col("__c")[0].alias("__best"), F.get("__c", F.lit(1)).alias("__next")), "ready")
            clear = F.lit(True) if eps is None else F.col("__next").isNull() | (F.col(f"__next.{distance}") - F.col(f"__best.{distance}") > eps)
            won = ready.where(clear).select(*group, actor, F.col(f"__best.{other}").alias(other))
            taken, rounds = won if taken is None else taken.union(won), rounds + 1
            if rounds % PLAN_STEPS == 0:
                taken = s.table(taken, "taken")
            left = rest.join(ready.select(*group, actor).hint("merge"), [*group, actor], "left_anti").join(won.select(*keys).hint("merge"), keys, "left_anti")
            rest = s.table(left.select(*group, actor, other, distance), "pairs")
        return s.table(candidates.select(*group, actor, other).limit(0) if taken is None else taken, "taken", keep=True)


def label_rooms(labels: DataFrame, radius: float, group: Sequence[str] = ()) -> DataFrame:
    """(group, label_id, number, name, x, y): a room for each number label, with the nearest name label within the radius.

    Labels have label_id, x, y, text. Numbers act in order of their ids and a name serves one number only.
    """
    number = room_number(F.col("text"))
    numbers = labels.where(number.isNotNull()).withColumn("number", number)
    names = labels.where(number.isNull() & (F.trim("text") != "")).select(*group, F.col("label_id").alias("name_id"), F.trim("text").alias("name"), "x", "y")
    near = within_radius(numbers.select(*group, "label_id", "x", "y"), names, radius, group)
    pairs = pair_in_order(near, "label_id", "name_id", "distance", group).join(names.select(*group, "name_id", "name").hint("merge"), [*group, "name_id"])
    return numbers.join(pairs.drop("name_id").hint("merge"), [*group, "label_id"], "left").select(*group, "label_id", "number", "name", "x", "y")


def assigned(points: DataFrame, rooms: DataFrame, anchors: DataFrame, cell: float, radius: float, point_id: str, group: Sequence[str] = ()) -> DataFrame:
    """Points with room, basis: the smallest room that holds them (polygon), else the nearest label room's anchor within the
    radius (label; anchors: room, x, y), else unassigned (null)."""
    held = smallest_room(points, rooms, cell, point_id, group=group)
    loose = held.where("room_id is null").select(*group, point_id, "x", "y")
    near = nearest_within(loose, anchors.select(*group, "room", "x", "y"), radius, point_id, ["room"], ["room"], group).select(*group, point_id, "room")
    met = held.join(near, [*group, point_id], "left")
    basis = F.when(F.col("room_id").isNotNull(), "polygon").when(F.col("room").isNotNull(), "label").otherwise("unassigned")
    return met.select(*points.columns, F.coalesce(F.col("room_id").cast("string"), F.col("room").cast("string")).alias("room"), basis.alias("basis"))


def room_pipeline(
    candidates: DataFrame, labels: DataFrame, devices: DataFrame, zones: DataFrame, cell: float, name_radius: float, device_radius: float, group: Sequence[str], most: int = IN_A_TASK
) -> tuple[DataFrame, DataFrame]:
    """(rooms, devices) of drawings: strategy, zones, names, label rooms, device assignment and review flags.

    candidates: rooms of all strategies with their rank; the first that found any serves each group. Labels (label_id, x, y,
    text) inside a zone's box are left out. Polygon rooms take number and name from the labels in them; number labels in no room
    are rooms of their own, unless a polygon has their number. Devices (device_id, x, y) go to the smallest room that
    holds them, else to the nearest label room. A number that several polygons have sends them to review.

    Rows are dealt by drawing once and a drawing of at most ``most`` of them is done over arrays within a task (``room_arrays``). Larger ones, label ids that
    are neither whole numbers nor texts, and devices with other columns go through joins.
    """
    keys, joins = list(group), (cell, name_radius, device_radius, group)
    plain = isinstance(labels.schema["label_id"].dataType, (T.IntegralType, T.StringType)) and set(devices.columns) == {*keys, "device_id", "x", "y"} and len(keys)
    if not plain:
        return room_pipeline_in_joins(candidates, labels, devices, zones, *joins)
    ready_workers(candidates.sparkSession)
    real = lambda c, name: c.cast("double").alias(name)
    known = lambda c: (F.col(c) if c in candidates.columns else F.lit(None)).cast("string").alias(c)
    kind = lambda k: F.lit(k).alias("__k")
    sides = [F.transform("ring", lambda p: p[v].cast("double")).alias(f"{v}s") for v in "xy"]
    place = [real(F.col(v), v) for v in "xy"]
    parts = [
        candidates.select(*keys, kind(room_arrays.ROOM), "room_id", "rank", real(F.col("area"), "area"), *sides, "source", known("number"), known("name")),
        labels.select(*keys, kind(room_arrays.LABEL), "label_id", *place, room_number(F.col("text")).alias("number"), F.trim("text").alias("name")),
        devices.select(*keys, kind(room_arrays.DEVICE), "device_id", *place),
        zones.select(*keys, kind(room_arrays.ZONE), *[real(F.col(f"box.{b}_{v}"), name) for b, v, name in (("min", "x", "x"), ("min", "y", "y"), ("max", "x", "x1"), ("max", "y", "y1"))]),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).repartition(*keys).sortWithinPartitions(*keys)
    type_of = lambda df, c: df.schema[c].dataType.simpleString()
    own = [f"`{k}` {type_of(candidates, k)}" for k in keys]
    made = f"{', '.join(own)}, __o int, room_id {type_of(candidates, 'room_id')}, label_id {type_of(labels, 'label_id')}, device_id {type_of(devices, 'device_id')}, x double, y double, number string, name string, source string, needs_review boolean"
    with Scratch(candidates.sparkSession) as s:
        work = partial(room_arrays.match, keys=keys, name_radius=name_radius, device_radius=device_radius)
        out = s.table(rows.mapInArrow(passes(keys, most, room_arrays.fields, work), made), "pipeline", keep=True)
        large = out.where(F.col("__o") == LARGE).select(*keys)
        of = lambda k: out.where(F.col("__o") == k)
        by_label = F.concat(F.lit("label-"), F.col("label_id").cast("string"))
        polygon = F.col("room_id").isNotNull()
        found = of(room_arrays.ROOM).select(*keys, F.col("room_id").cast("string").alias("room"), "number", "name", "source", "needs_review")
        found = found.union(of(room_arrays.LABEL).select(*keys, by_label, "number", "name", F.lit("label"), F.lit(False)))
        basis = F.when(polygon, "polygon").when(F.col("label_id").isNotNull(), "label").otherwise("unassigned")
        given = [F.col(c).cast(devices.schema[c].dataType).alias(c) for c in devices.columns]
        placed = of(room_arrays.DEVICE).select(*given, F.coalesce(F.col("room_id").cast("string"), by_label).alias("room"), basis.alias("basis"))
        if large.isEmpty():
            return found, placed
        rest = room_pipeline_in_joins(*[of_drawings(df, large, keys) for df in (candidates, labels, devices, zones)], *joins)
        return found.union(rest[0]), placed.union(rest[1].select(placed.columns))


def room_pipeline_in_joins(
    candidates: DataFrame, labels: DataFrame, devices: DataFrame, zones: DataFrame, cell: float, name_radius: float, device_radius: float, group: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """``room_pipeline`` in joins, for drawings of any size."""
    polygons = first_strategy(candidates, group, "rank")
    inside = in_boxes(labels, zones.select(*group, "box"), cell, group).select(*group, "label_id").distinct()
    clean = labels.join(inside, [*group, "label_id"], "left_anti")
    named = named_rooms(polygons, clean, cell, group)
    repeated = named.where("number is not null").groupBy(*group, "number").agg((F.count("*") > 1).alias("__again"))
    named = named.join(repeated, [*group, "number"], "left").withColumn("needs_review", F.coalesce("__again", F.lit(False)))
    loose = smallest_room(label_rooms(clean, name_radius, group), polygons, cell, "label_id", group=group).where("room_id is null")
    loose = loose.join(named.select(*group, "number"), [*group, "number"], "left_anti")
    by_label = loose.select(*group, F.concat(F.lit("label-"), F.col("label_id").cast("string")).alias("room"), "number", "name", F.lit("label").alias("source"), F.lit(False).alias("needs_review"), "x", "y")
    placed = assigned(devices, polygons, by_label, cell, device_radius, "device_id", group)
    rooms = named.select(*group, F.col("room_id").cast("string").alias("room"), "number", "name", "source", "needs_review").union(by_label.drop("x", "y"))
    return rooms, placed


def counted_by_room(devices: DataFrame, kind: str, room: str, excluded: Sequence[str], group: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """((group, room, kind, n), (group, kind, n)): devices of each kind by room, and how many of the excluded kinds were left out."""
    out = F.coalesce(F.col(kind).isin(list(excluded)), F.lit(False))
    return devices.where(~out).groupBy(*group, room, kind).agg(F.count("*").alias("n")), devices.where(out).groupBy(*group, kind).agg(F.count("*").alias("n"))


def estimated_by_room(drops: DataFrame, home_runs: DataFrame, room: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, room, drops, home_runs, n_circuits): drops (room, circuit_id, drop) in their device's room and home runs (room,
    circuit_id, home_run) in their anchor's; n_circuits counts the circuits that touch the room. Null rooms are a row."""
    parts = drops.select(*group, room, "circuit_id", F.col("drop").cast("decimal(28,6)").alias("d"), F.lit(None).cast("decimal(28,6)").alias("h"))
    parts = parts.union(home_runs.select(*group, room, "circuit_id", F.lit(None).cast("decimal(28,6)"), F.col("home_run").cast("decimal(28,6)")))
    zero = F.lit(0).cast("decimal(28,6)")
    return parts.groupBy(*group, room).agg(F.coalesce(F.sum("d"), zero).alias("drops"), F.coalesce(F.sum("h"), zero).alias("home_runs"), F.count_distinct("circuit_id").alias("n_circuits"))


def measured_by_room(segments: DataFrame, rooms: DataFrame, anchors: DataFrame, segment_id: str, cell: float, radius: float, group: Sequence[str] = ()) -> DataFrame:
    """(group, room, basis, length): length inside each polygon room, and what lies outside all of them by the nearest label room
    within the radius of the segment's middle, else unassigned (null room)."""
    split = split_by_rings(segments, rooms, segment_id, "room_id", cell, group)
    middle = segments.select(*group, segment_id, ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    near = nearest_within(middle, anchors.select(*group, "room", "x", "y"), radius, segment_id, ["room"], ["room"], group).select(*group, segment_id, "room")
    met = split.join(near, [*group, segment_id], "left")
    inside = F.col("room_id").isNotNull()
    basis = F.when(inside, "polygon").when(F.col("room").isNotNull(), "label").otherwise("unassigned")
    room = F.when(inside, F.col("room_id").cast("string")).otherwise(F.col("room").cast("string"))
    return met.groupBy(*group, room.alias("room"), basis.alias("basis")).agg(F.sum(F.col("length").cast("decimal(28,9)")).alias("length"))


def stamped(points: DataFrame, rooms: DataFrame, cell: float, point_id: str, group: Sequence[str] = ()) -> DataFrame:
    """Points with every room that holds them, smallest first, as rows."""
    boxed = rooms.select(*group, "room_id", "area", "ring", ring_box(F.col("ring")).alias("box"))
    return in_boxes(points, boxed, cell, group).where(inside_ring(F.col("x"), F.col("y"), F.col("ring"))).select(*group, point_id, "room_id", "area")
