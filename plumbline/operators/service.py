"""Routed services of drawings to totals by service, size and room.

A run is one routed line work of a group (a revision, a sheet). Its tags give it services; a run whose services share two
with the services of *one* confirmed tag stack is a bundle and gives its whole length to each of them. Every other
run is apportioned segment by segment to the label that is nearest to the segment's middle, so that its lengths add
up to its own. Rise and drop symbols are counted in the room that holds them. No run is left out: what no label or room claims
is a row with a null service or room.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import round_tag
from plumbline.operators.spatial import nearest_run, nearest_with_ties, nearest_within, ring_parts, smallest_room
from plumbline.sources.tables import Scratch

#: States of a run's identity from the worst to the best.
STATUS_RANK = ("unknown", "partial", "resolved")


def collapsed_services(tags: DataFrame, run: Sequence[str]) -> DataFrame:
    """(run, service, size, kind): one size for each service of a run, the most frequent of its tags' (service, size, kind).

    Of equally frequent sizes the smallest counts, a missing one before all others; so does the smallest kind of a size.
    """
    kinds = tags.groupBy(*run, "service", "size").agg(F.count("*").alias("__n"), F.min("kind").alias("kind"))
    best = F.min_by(F.struct("size", "kind"), F.struct(-F.col("__n"), F.coalesce("size", F.lit(""))))
    return kinds.groupBy(*run, "service").agg(best.alias("__b")).select(*run, "service", "__b.size", "__b.kind")


def _service_pairs(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, a, b): pairs of different services of a key, a before b."""
    one = rows.select(*key, F.col("service").alias("a")).distinct()
    return one.join(one.withColumnRenamed("a", "b").hint("merge"), list(key)).where("a < b")


def confirmed_bundles(services: DataFrame, evidence: DataFrame, run: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, run) of the runs that share two services with one stack's set. evidence: group, stack, service.

    Two services of one stack are a pair; runs meet the group's different pairs, of which there are as many as services
    squared, however many stacks say the same.
    """
    known = _service_pairs(evidence, [*group, "stack"]).select(*group, "a", "b").distinct()
    return _service_pairs(services, [*group, run]).join(known.hint("merge"), [*group, "a", "b"], "left_semi").select(*group, run).distinct()


def bundle_shares(runs: DataFrame, evidence: DataFrame, run: str, length: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, run, service, length, basis) of runs without segments (group, run, service, length): a ``bundle`` gives its whole
    length to each service, a ``single`` service takes it, and several without evidence leave it to none (null service, once)."""
    one = [*group, run]
    per = runs.groupBy(*one).agg(F.count_distinct("service").alias("__n"), F.max(length).alias(length))
    found = confirmed_bundles(runs, evidence, run, group).withColumn("__yes", F.lit(True))
    met = runs.select(*one, "service").distinct().join(per, one).join(found, one, "left")
    basis = F.when(F.col("__yes"), "bundle").when(F.col("__n") == 1, "single").otherwise("bundle_evidence_absent")
    kept = F.when(F.col("__yes") | (F.col("__n") == 1), F.col("service"))
    return met.select(*one, kept.alias("service"), length, basis.alias("basis")).distinct()


def _roomed(s: Scratch, points: DataFrame, rooms: DataFrame, anchors: DataFrame, cell: float, radius: float | None, key: str, group: Sequence[str]) -> DataFrame:
    """Points with room: the smallest polygon that holds them, else the nearest label room's anchor within the radius."""
    held = smallest_room(points, rooms, cell, key, group=group)
    return held if radius is None else _by_label(s.table(held, "held", keep=True), anchors, radius, key, group)


def _by_label(held: DataFrame, anchors: DataFrame, radius: float, key: str, group: Sequence[str]) -> DataFrame:
    """Points with room_id, where it is null the nearest anchor's (room, x, y) within the radius."""
    loose = held.where("room_id is null").select(*group, key, "x", "y")
    near = nearest_within(loose, anchors.select(*group, F.col("room").alias("__room"), "x", "y"), radius, key, ["__room"], ["__room"], group).select(*group, key, "__room")
    met = held.join(near.hint("merge"), [*group, key], "left")
    return met.withColumn("room_id", F.coalesce("room_id", "__room")).drop("__room")


def takeoff_parts(
    runs: DataFrame, segments: DataFrame, tags: DataFrame, labels: DataFrame, evidence: DataFrame, rooms: DataFrame, anchors: DataFrame,
    cell: float, label_reach: float, room_reach: float | None, group: Sequence[str] = (),
) -> DataFrame:
    """(group, run, service, size, kind, room_id, length, bundle, evidence_absent): every part of every run, once for each service that has it.

    runs: run, x, y (anchor), length (of runs without segments). segments: segment_id, run, x0 to y1. tags: run, service, size, kind.
    labels: x, y, service, size, kind. rooms: room_id, ring, area; anchors: room, x, y of rooms that are only a label.

    A bundle's segments are cut at the rooms' edges; another run's segments go whole to the room of their middle. A run
    without segments is one part at its anchor: a bundle's, its only service's, or with several services none's.
    """
    one = [*group, "run"]
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    out = [*one, "service", "size", "kind", "room_id", "length", "bundle", "evidence_absent"]
    nothing = F.lit(None).cast("string")
    # Each step that later ones read twice is written, so that no plan holds another's copies; nothing that grows with the runs is broadcast.
    with Scratch(runs.sparkSession) as scratch:
        services = scratch.table(collapsed_services(tags, one), "services", keep=True)
        per = services.groupBy(*one).agg(F.count("*").alias("__n"))
        bundles = confirmed_bundles(services, evidence, "run", group).withColumn("__bundle", F.lit(True))
        known = runs.join(per.hint("merge"), one, "left").join(bundles.hint("merge"), one, "left").select(
            *one, "x", "y", "length", F.coalesce("__n", F.lit(0)).alias("__n"), F.coalesce("__bundle", F.lit(False)).alias("__bundle")
        )
        known = scratch.table(known, "runs", keep=True)
        state = known.select(*one, "__n", "__bundle")
        drawn = scratch.table(segments.where((dx != 0) | (dy != 0)).join(state.hint("merge"), one), "drawn", keep=True)
        rooms = scratch.table(rooms, "rooms", keep=True)

        cut = ring_parts(drawn.where("__bundle"), rooms, "segment_id", "room_id", cell, group)
        cut = cut.withColumn("__part", F.struct("segment_id", "t"))
        if room_reach is not None:
            cut = _by_label(scratch.table(cut, "cut", keep=True), anchors, room_reach, "__part", group)
        whole = cut.join(drawn.where("__bundle").select(*group, "segment_id", "run").hint("merge"), [*group, "segment_id"]).join(services.hint("merge"), one)
        bundled = whole.select(*one, "service", "size", "kind", "room_id", "length", F.lit(True).alias("bundle"), F.lit(False).alias("evidence_absent"))

        middle = drawn.where("not __bundle").select(*one, "segment_id", "__n", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), F.sqrt(dx * dx + dy * dy).alias("length"))
        named = nearest_with_ties(middle, labels.select(*group, "x", "y", "service", "size", "kind"), label_reach, "segment_id", ["service", "size", "kind"], group=group)
        placed = _roomed(scratch, scratch.table(named, "named", keep=True), rooms, anchors, cell, room_reach, "segment_id", group)
        apart = placed.select(*one, "service", "size", "kind", "room_id", "length", F.lit(False).alias("bundle"), (F.col("__n") > 1).alias("evidence_absent"))

        bare = known.join(drawn.select(*one).distinct().hint("merge"), one, "left_anti").withColumn("__run", F.struct("run"))
        at = _roomed(scratch, scratch.table(bare, "bare", keep=True), rooms, anchors, cell, room_reach, "__run", group)
    takes = F.col("__bundle") | (F.col("__n") == 1)
    given = at.join(services.hint("merge"), one, "left").where(takes | (F.col("__n") == 0))
    mute = at.where(~takes & (F.col("__n") > 0)).select(at["*"], *[nothing.alias(c) for c in ("service", "size", "kind")])
    last = given.select(mute.columns).union(mute)
    alone = last.select(*one, "service", "size", "kind", "room_id", F.coalesce("length", F.lit(0.0)).alias("length"), F.col("__bundle").alias("bundle"), ((F.col("__n") > 1) & ~F.col("__bundle")).alias("evidence_absent"))
    return bundled.select(out).union(apart.select(out)).union(alone.select(out))


def _rank(status: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, STATUS_RANK)), status), F.lit(1))


def takeoff_lines(parts: DataFrame, runs: DataFrame, symbols: DataFrame, rooms: DataFrame, cell: float, group: Sequence[str] = ()) -> DataFrame:
    """(group, service, size, kind, room_id, length, n_runs, status, conflict, bundle, evidence_absent, discipline, risers, drops).

    parts: as ``takeoff_parts`` makes them. runs: run, status, conflict, discipline. symbols: symbol_id, kind (rise or drop), x, y, discipline; they are
    counted in the row without a service of the smallest polygon that holds them. The worst status of a row's runs counts, and of its
    disciplines the first in order; a row of symbols alone has the status ``unknown``.
    """
    one, row = [*group, "run"], [*group, "service", "size", "kind", "room_id"]
    met = parts.join(runs.select(*one, "status", "conflict", "discipline").hint("merge"), one)
    each = met.groupBy(*row, "run").agg(
        F.sum(F.col("length").cast("decimal(28,9)")).alias("length"), F.first("status").alias("status"), F.max("conflict").alias("conflict"),
        F.max("bundle").alias("bundle"), F.max("evidence_absent").alias("evidence_absent"), F.min("discipline").alias("discipline"),
    )
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    lines = each.select(*row, "length", F.lit(1).cast("long").alias("n"), _rank(F.col("status")).alias("rank"), "conflict", "bundle", "evidence_absent", "discipline", zero.alias("risers"), zero.alias("drops"))
    held = smallest_room(symbols, rooms, cell, "symbol_id", group=group)
    said = lambda k: (F.col("kind") == k).cast("long")
    marks = held.select(
        *group, none.alias("service"), none.alias("size"), none.alias("__kind"), F.col("room_id").cast(parts.schema["room_id"].dataType), F.lit(0).cast("decimal(28,9)").alias("length"), zero.alias("n"),
        F.lit(None).cast("long").alias("rank"), F.lit(False).alias("conflict"), F.lit(False).alias("bundle"), F.lit(False).alias("evidence_absent"), "discipline", said("rise").alias("risers"), said("drop").alias("drops"),
    ).withColumnRenamed("__kind", "kind")
    total = lines.union(marks).groupBy(*row).agg(
        F.sum("length").alias("length"), F.sum("n").alias("n_runs"), F.coalesce(F.min("rank"), F.lit(1)).alias("__rank"), *[F.max(c).alias(c) for c in ("conflict", "bundle", "evidence_absent")],
        F.min("discipline").alias("discipline"), F.sum("risers").alias("risers"), F.sum("drops").alias("drops"),
    )
    status = F.element_at(F.array(*map(F.lit, STATUS_RANK)), F.col("__rank").cast("int"))
    return total.select(*row, "length", "n_runs", status.alias("status"), "conflict", "bundle", "evidence_absent", "discipline", "risers", "drops")


def takeoff_counts(parts: DataFrame, tags: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, unassigned_runs, unknown_runs): runs with length outside all rooms, and those without any service of their own of which a part has none."""
    one = [*group, "run"]
    named = tags.select(*one).distinct().withColumn("__named", F.lit(True))
    each = parts.groupBy(*one).agg(F.max(F.col("room_id").isNull()).alias("__out"), F.max(F.col("service").isNull()).alias("__mute")).join(named, one, "left")
    return each.groupBy(*group).agg(F.count_if("__out").alias("unassigned_runs"), F.count_if(F.col("__mute") & F.col("__named").isNull()).alias("unknown_runs"))


def service_takeoff(
    runs: DataFrame, segments: DataFrame, tags: DataFrame, labels: DataFrame, evidence: DataFrame, rooms: DataFrame, anchors: DataFrame, symbols: DataFrame,
    cell: float, label_reach: float, room_reach: float | None = None, group: Sequence[str] = (),
) -> DataFrame:
    """``takeoff_lines`` of the inputs' ``takeoff_parts``."""
    parts = takeoff_parts(runs, segments, tags, labels, evidence, rooms, anchors, cell, label_reach, room_reach, group)
    return takeoff_lines(parts, runs, symbols, rooms, cell, group)


def tagged_runs(tags: DataFrame, segments: DataFrame, radius: float, group: Sequence[str] = ()) -> DataFrame:
    """(group, tag_id, run, service, size, kind, x, y) of texts that read as tags, with the run that is nearest within the radius (else null)."""
    read = tags.withColumn("t", round_tag(F.col("text"))).where("t is not null")
    size = F.coalesce(F.col("t.diameter").cast("string"), F.concat_ws("x", F.col("t.width").cast("string"), F.col("t.height").cast("string")))
    read = read.select(*group, "tag_id", "x", "y", F.col("t.service").alias("service"), size.alias("size"), F.col("t.size_kind").alias("kind"))
    found = nearest_run(read, segments.select(*group, "run", "x0", "y0", "x1", "y1"), radius, "tag_id", "run", group=group)
    return found.select(*group, "tag_id", "run", "service", "size", "kind", "x", "y")


def run_anchors(segments: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, run, x, y): the mean middle of each run's segments."""
    return segments.groupBy(*group, "run").agg(F.avg((F.col("x0") + F.col("x1")) / 2).alias("x"), F.avg((F.col("y0") + F.col("y1")) / 2).alias("y"))

