"""Routed services and rooms: runs, buckets, bundles, cables, registration, floor totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import fraction_band, grid_cell
from plumbline.operators.hull import widest_pairs


def group_runs(entities: DataFrame, group: Sequence[str], member: str, order: str) -> DataFrame:
    """One row per group with its members in order."""
    members = F.array_sort(F.collect_list(F.struct(order, member)))
    return entities.groupBy(*group).agg(F.transform(members, lambda m: m[member]).alias("members"), F.count("*").alias("n_members"))


def drawn_lengths(segments: DataFrame, group: Sequence[str]) -> DataFrame:
    """Summed length of each group's segments (x0, y0, x1, y1); zero and non-finite ones add nothing."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    size = F.sqrt(dx * dx + dy * dy)
    finite = ~F.isnan(size) & (size < float("inf")) & (size > 0)
    return segments.groupBy(*group).agg(F.sum(F.when(finite, size.cast("decimal(28,9)"))).alias("length"), F.count_if(finite).alias("n_segments"))


def service_buckets(rows: DataFrame, key: Sequence[str], run: str, length: str, entity: str, status_rank: str, conflict: str) -> DataFrame:
    """Attribution rows to buckets: length, distinct runs and entities, worst status, any conflict. Null keys are a bucket."""
    return rows.groupBy(*key).agg(
        F.sum(F.col(length).cast("decimal(28,6)")).alias("length"),
        F.count_distinct(run).alias("n_runs"),
        F.count_distinct(entity).alias("n_entities"),
        F.max(status_rank).alias("worst_status"),
        F.max(conflict).alias("any_conflict"),
    )


def tallies(rows: DataFrame, key: str, length: str) -> DataFrame:
    """Length by key, null as ``shared``, with each key's part of the total."""
    sums = rows.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("shared")).alias(key)).agg(F.sum(F.col(length).cast("decimal(28,6)")).alias("length"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("length").alias("total"))))


def symbol_clusters(symbols: DataFrame, group: Sequence[str], cell: float) -> DataFrame:
    """One symbol per grid cell: mean anchor, count, smallest colour."""
    return symbols.groupBy(*group, grid_cell(F.col("x"), cell).alias("cell_x"), grid_cell(F.col("y"), cell).alias("cell_y")).agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"), F.min("colour").alias("colour")
    )


def merge_rooms(rooms: DataFrame, group: Sequence[str], number: str, room: str, anchors: str, review: str) -> DataFrame:
    """Rooms of one number as one: lowest id, union of anchors, any review."""
    return rooms.groupBy(*group, number).agg(
        F.min(room).alias(room), F.array_sort(F.array_distinct(F.flatten(F.collect_list(anchors)))).alias(anchors), F.max(review).alias(review)
    )


def repeated_numbers(rooms: DataFrame, group: Sequence[str], number: str, room: str) -> DataFrame:
    """(group, number, n_rooms) of the numbers that several rooms of a group have; null numbers count as one."""
    return rooms.groupBy(*group, number).agg(F.count_distinct(room).alias("n_rooms")).where("n_rooms > 1")


def strategy_cascade(candidates: DataFrame, group: str, rank: str) -> DataFrame:
    """The rows of each group's best strategy that has any."""
    best = candidates.groupBy(group).agg(F.min(rank).alias("__r"))
    return candidates.join(best, group).where(F.col(rank) == F.col("__r")).drop("__r")


def room_union(stamped: DataFrame, labelled: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stamped rooms and the labelled ones that no stamped room matches."""
    return stamped.unionByName(labelled.join(stamped.select(*key), list(key), "left_anti"), allowMissingColumns=True)


def circuit_roll_up(claims: DataFrame, drops: DataFrame, circuits: DataFrame) -> DataFrame:
    """(circuit, in_plan, drop_length, n_devices): each device counts in the lowest circuit that lists it;
    devices of no circuit make the null row.

    claims: circuit_id, device_id; drops: device_id, drop; circuits: circuit_id, in_plan.
    """
    owner = claims.groupBy("device_id").agg(F.min("circuit_id").alias("circuit_id"))
    sums = drops.join(owner, "device_id", "left").groupBy("circuit_id").agg(F.sum(F.col("drop").cast("decimal(28,6)")).alias("drop_length"), F.count("*").alias("n_devices"))
    met = circuits.join(sums.where("circuit_id is not null"), "circuit_id", "left").select(
        "circuit_id", "in_plan", F.coalesce("drop_length", F.lit(0).cast("decimal(38,6)")).alias("drop_length"), F.coalesce("n_devices", F.lit(0).cast("long")).alias("n_devices")
    )
    return met.union(sums.where("circuit_id is null").select("circuit_id", F.lit(None).cast(circuits.schema["in_plan"].dataType), "drop_length", "n_devices"))


def assembly_totals(rolled: DataFrame, home_runs: DataFrame, spare: str = "0.10") -> DataFrame:
    """Totals with spare; circuits without a home run are counted as no_anchor."""
    met = rolled.join(home_runs, "circuit_id", "left")
    sums = met.agg(
        F.sum(F.col("in_plan").cast("decimal(28,6)")).alias("in_plan"), F.sum(F.col("drop_length").cast("decimal(28,6)")).alias("drops"),
        F.sum(F.col("home_run").cast("decimal(28,6)")).alias("home_runs"), F.count_if(F.col("home_run").isNull()).alias("no_anchor"),
    )
    total = F.col("in_plan") + F.col("drops") + F.col("home_runs")
    return sums.withColumn("with_spare", F.round(total.cast("decimal(28,6)") * (F.lit(1) + F.lit(spare).cast("decimal(9,6)")), 6))


def register_sheets(source: DataFrame, target: DataFrame, group: str, label: str = "label", warn: float = 1.0, fail: float = 3.0) -> DataFrame:
    """(group, n_matches, dx, dy, residual_max, residual_median, quality) from labelled points on both sheets.

    Labels that occur twice on a side are dropped. The shift is the componentwise exact median of the deltas.
    """
    once = lambda df: df.join(df.groupBy(group, label).agg(F.count("*").alias("__n")).where("__n = 1"), [group, label], "left_semi")
    s, t = once(source), once(target).withColumnsRenamed({"x": "tx", "y": "ty"})
    met = s.select(group, label, "x", "y").join(t.select(group, label, "tx", "ty"), [group, label])
    deltas = met.select(group, (F.col("tx") - F.col("x")).alias("dx"), (F.col("ty") - F.col("y")).alias("dy"))
    shift = deltas.groupBy(group).agg(F.percentile("dx", 0.5).alias("dx"), F.percentile("dy", 0.5).alias("dy"), F.count("*").alias("n_matches"))
    d = deltas.alias("d").join(shift.alias("s"), group)
    rx, ry = F.col("d.dx") - F.col("s.dx"), F.col("d.dy") - F.col("s.dy")
    residual = d.select(group, F.sqrt(rx * rx + ry * ry).alias("r")).groupBy(group).agg(F.max("r").alias("residual_max"), F.percentile("r", 0.5).alias("residual_median"))
    out = shift.join(residual, group)
    quality = F.when((F.col("n_matches") < 2) | (F.col("residual_max") > fail), "failed").when((F.col("n_matches") >= 3) & (F.col("residual_max") <= warn), "good").otherwise("degraded")
    return out.withColumn("quality", quality)


def shifted(points: DataFrame, transforms: DataFrame, group: str) -> DataFrame:
    """Points moved by their group's dx, dy; groups without a transform are left out."""
    met = points.join(transforms.select(group, F.col("dx").alias("__dx"), F.col("dy").alias("__dy")), group)
    return met.withColumn("x", F.col("x") + F.col("__dx")).withColumn("y", F.col("y") + F.col("__dy")).drop("__dx", "__dy")


def room_totals(measured: DataFrame, counted: DataFrame, estimated: DataFrame, room: str) -> DataFrame:
    """(room, measured, counted, estimated) over the rooms of any of the three; each input has room and value."""
    parts = [df.select(room, F.lit(k).alias("kind"), F.col("value").cast("decimal(28,6)").alias("value")) for k, df in (("measured", measured), ("counted", counted), ("estimated", estimated))]
    rows = parts[0].union(parts[1]).union(parts[2])
    return rows.groupBy(room).agg(*[F.sum(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in ("measured", "counted", "estimated")])


def floor_summary(home_runs: DataFrame, length: str, anchor: str) -> DataFrame:
    """Share of home-run length without an anchor, four places, with its band."""
    total, loose = F.sum(F.col(length).cast("decimal(28,6)")), F.sum(F.when(F.col(anchor).isNull(), F.col(length).cast("decimal(28,6)")))
    out = home_runs.agg(F.round(F.coalesce(loose, F.lit(0)) / total, 4).cast("double").alias("no_anchor_fraction"), F.count("*").alias("n_circuits"))
    return out.withColumn("band", fraction_band(F.col("no_anchor_fraction")))


def text_above(numbers: DataFrame, names: DataFrame, group: Sequence[str], align: float, reach: float, number_id: str, name_id: str) -> DataFrame:
    """(number_id, name): the texts stacked above a number within reach and align, top first, joined by spaces.

    Names fall into cells as wide as align and as high as reach; a place of numbers, each looked up once, meets the cells beside its own and above.
    """
    at = [*group, "x", "y"]
    band, side = F.floor(F.col("y") / reach), F.floor(F.col("x") / align)
    n = numbers.select(*at).distinct().withColumn("__b", F.explode(F.array(band, band + 1))).withColumn("__a", F.explode(F.array(side - 1, side, side + 1)))
    t = names.select(*group, F.col("x").alias("tx"), F.col("y").alias("ty"), "text", name_id).withColumns({"__b": F.floor(F.col("ty") / reach), "__a": F.floor(F.col("tx") / align)})
    met = n.join(t.hint("merge"), [*group, "__b", "__a"]).where((F.abs(F.col("tx") - F.col("x")) <= align) & (F.col("ty") > F.col("y")) & (F.col("ty") - F.col("y") <= reach))
    lines = F.array_sort(F.collect_list(F.struct((-F.col("ty")).alias("o"), name_id, "text")))
    found = met.groupBy(*at).agg(F.array_join(F.transform(lines, lambda x: x["text"]), " ").alias("name"))
    return numbers.select(*at, number_id).join(found.hint("merge"), at).select(number_id, "name")


def mutual_pairs(pairs: DataFrame, left: str, right: str, distance: str) -> DataFrame:
    """Pairs each of whose ends is the other's nearest, ties by id; each end's nearest is found before the shuffle."""
    near = lambda k, o: pairs.groupBy(F.col(k).alias(f"__{k}")).agg(F.min(F.struct(distance, o)).alias(f"__best_{k}"))
    met = pairs.join(near(left, right), F.col(left) == F.col(f"__{left}")).join(near(right, left), F.col(right) == F.col(f"__{right}"))
    met = met.where((F.col(f"__best_{left}.{right}") == F.col(right)) & (F.col(f"__best_{right}.{left}") == F.col(left)) & (F.col(f"__best_{left}.{distance}") == F.col(distance)))
    return met.select(*[pairs[c] for c in pairs.columns])


def widest_baseline(points: DataFrame, group: str, point_id: str) -> DataFrame:
    """(group, i, j, bearing, baseline) of the two points of each group that lie farthest apart (ties by id), i before j, by their convex hull."""
    at = points.select(group, F.col(point_id).alias("i"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    met = widest_pairs(points, [group], point_id).join(at, [group, "i"]).join(at.withColumnsRenamed({"i": "j", "x": "x2", "y": "y2"}), [group, "j"])
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    return met.select(group, "i", "j", F.degrees(F.atan2(dy, dx)).alias("bearing"), F.sqrt(dx * dx + dy * dy).alias("baseline"))


def tiered(entities: DataFrame, components: DataFrame, entity: str, kind: str, length: str, layer: str, consumed: Sequence[str], shortest: float = 0.01, crowd: int = 50) -> DataFrame:
    """Entities with their materialization tier: ``fill_noise`` for a line shorter than ``shortest`` in a component of ``crowd`` rows or
    more, unless a token of a consumed layer is in its layer's name; else ``normal``. components: entity, size; a missing one counts as alone."""
    noise = (F.col(kind) == "line") & (F.col(length) < shortest) & (F.coalesce("size", F.lit(1)) >= crowd)
    if consumed:
        noise &= ~F.coalesce(F.lower(layer).rlike("|".join(consumed)), F.lit(False))
    met = entities.join(components.select(entity, "size"), entity, "left")
    return met.withColumn("tier", F.when(noise, "fill_noise").otherwise("normal")).drop("size")


def selected_layers(faces: DataFrame, group: Sequence[str], layer: str, ratio: float = 0.8) -> DataFrame:
    """(group, layer, score): the layers whose number of faces is at least ``ratio`` of the group's best one's."""
    scores = faces.groupBy(*group, layer).agg(F.count("*").alias("score"))
    best = scores.groupBy(*group).agg(F.max("score").alias("__best"))
    return scores.join(best, list(group)).where(F.col("score") >= ratio * F.col("__best")).drop("__best")


def revision_summary(revisions: DataFrame, entities: DataFrame, layers: DataFrame, rooms: DataFrame, devices: DataFrame, key: str) -> DataFrame:
    """One row per revision: n_entities, n_layers, layers by role (a map), n_rooms, n_named, n_review, n_devices and their types (a map).

    layers: key, role. rooms: key, name, needs_review. devices: key, device_type. A revision without rows of a table has zero of it.
    """
    n = lambda df, name, *more: df.groupBy(key).agg(F.count("*").alias(name), *more)

    def by(df: DataFrame, column: str, name: str) -> DataFrame:
        counts = df.groupBy(key, F.coalesce(column, F.lit("unknown")).alias("k")).agg(F.count("*").alias("c"))
        return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "c")))).alias(name))

    parts = [
        n(entities, "n_entities"), n(layers, "n_layers"), by(layers, "role", "roles"), n(rooms, "n_rooms", F.count("name").alias("n_named"), F.count_if("needs_review").alias("n_review")),
        n(devices, "n_devices"), by(devices, "device_type", "types"),
    ]
    out = revisions.select(key)
    for part in parts:
        out = out.join(part, key, "left")
    return out.fillna(0, ["n_entities", "n_layers", "n_rooms", "n_named", "n_review", "n_devices"])


def home_run_statuses(circuits: DataFrame, home_runs: DataFrame, circuit: str = "circuit_id") -> DataFrame:
    """In-plan circuits with their home run and its status: ``no_anchor`` where there is none."""
    met = circuits.join(home_runs, circuit, "left")
    return met.withColumn("status", F.when(F.col("home_run").isNull(), "no_anchor").otherwise("ok"))


def drop_parameters(spark) -> DataFrame:
    """(category, drop): metres of vertical cable by device category, as the estimate assumes them."""
    return spark.createDataFrame([("luminaire", 2.0), ("switch", 1.2), ("socket", 1.2), ("board", 0.0)], "category string, drop double")
