"""Stacks of pipe tags matched to the coloured bands that scan lines cross: services of colours, and what stacks confirm.

Everything is per drawing (the ``group`` columns). Tags that stand in a column (or, where a drawing has no columns, in a row) are a stack; the
nearest header says how it is read. Joins ask for a merge: their sides are larger than the files that Spark reckons by. Scan lines run through the middles of all bands, across them; what a line crosses is cut into
bundles at gaps, and a bundle is read as runs of one colour with their numbers of levels. A stack matches a bundle whose numbers are
those of its own runs of one service, on neighbouring lines. Where anything is open, nothing is assigned, and the verdict says why.

Rows are dealt by drawing once and matched over arrays, many drawings at once (``stack_arrays``); a drawing that is too large for a task goes through joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import stack_arrays
from plumbline.operators.arrays import IN_A_TASK, LARGE, of_drawings, passes
from plumbline.operators.spatial import ring_box, within_radius
from plumbline.operators.windows import spaced
from plumbline.sources.tables import Scratch
from plumbline.sources.workers import ready_workers

#: The phrases of headers; the axis of a phrase's scan lines is x for the first two.
ORIENTATIONS = ("TOP TO BOTTOM", "BOTTOM TO TOP", "LEFT TO RIGHT", "RIGHT TO LEFT")


class Tolerances(NamedTuple):
    """Metres, and lines in a row that make a match stable."""

    axis: float = 0.10
    level: float = 0.03
    header: float = 1.0
    position: float = 0.03
    gap: float = 0.5
    stable: int = 2


def orientation(text: Column) -> Column:
    """The one phrase that a header contains; null with none or several."""
    said = F.upper(F.trim(F.regexp_replace(text, r"\s+", " ")))
    found = F.filter(F.array(*map(F.lit, ORIENTATIONS)), lambda p: F.contains(said, p))
    return F.when(F.size(found) == 1, found[0])


def tag_clusters(tags: DataFrame, tolerance: float, group: Sequence[str]) -> DataFrame:
    """(tags' columns, stack): tags in columns of two and more, or where a drawing has no column in such rows; stacks are numbered along the axis."""
    def clustered(axis: str) -> DataFrame:
        along = Window.partitionBy(*group).orderBy(axis, "tag_id")
        step = F.coalesce((F.col(axis) - F.lag(axis).over(along) > tolerance).cast("int"), F.lit(0))
        numbered = tags.withColumn("__step", step).withColumn("stack", F.sum("__step").over(along)).drop("__step")
        return numbered.withColumn("__n", F.count("*").over(Window.partitionBy(*group, "stack"))).where("__n > 1").drop("__n")

    columns = clustered("x")
    return columns.union(clustered("y").join(columns.select(*group).distinct().hint("merge"), list(group), "left_anti"))


def read_stacks(clusters: DataFrame, headers: DataFrame, reach: float, group: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """((group, stack, header), (group, stack, run, service, levels, sizes, kind)): each cluster's orientation, null without a readable one, and its runs.

    The header nearest to one of the cluster's tags counts, if it is within reach, ties by header_id. Tags without a service are skipped.
    """
    one = [*group, "stack"]
    near = within_radius(clusters.select(*one, "tag_id", "x", "y"), headers.select(*group, "header_id", "text", "x", "y"), reach, group)
    best = near.groupBy(*one).agg(F.min_by("text", F.struct("distance", "header_id")).alias("__text"))
    read = clusters.select(*one).distinct().join(best.hint("merge"), one, "left").select(*one, orientation(F.col("__text")).alias("header"))
    turned = F.when(F.col("header") == ORIENTATIONS[0], -F.col("y")).when(F.col("header") == ORIENTATIONS[1], F.col("y")).when(F.col("header") == ORIENTATIONS[2], F.col("x")).otherwise(-F.col("x"))
    entries = clusters.where("service is not null").join(read.where("header is not null").hint("merge"), one).withColumn("__at", turned)
    w = Window.partitionBy(*one).orderBy("__at", "tag_id")
    fresh = (~F.col("service").eqNullSafe(F.lag("service").over(w))).cast("int")
    runs = entries.withColumn("__new", fresh).withColumn("run", F.sum("__new").over(w))
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("__at", "tag_id", "size"))), lambda e: e["size"])
    kind = F.when(F.coalesce(F.count_distinct(F.coalesce("kind", F.lit(""))), F.lit(0)) == 1, F.first("kind"))
    return read, runs.groupBy(*one, "run").agg(F.first("service").alias("service"), F.count("*").alias("levels"), sizes.alias("sizes"), kind.alias("kind"))


def scan_lines(bands: DataFrame, step: float, group: Sequence[str]) -> DataFrame:
    """(group, axis, line, at): the scan lines of each drawing through its bands' middles, no two closer than ``step``, numbered along x and y."""
    b = F.col("box")
    middles = bands.select(*group, F.explode(F.array(*[F.struct(F.lit(v).alias("axis"), ((b[f"min_{v}"] + b[f"max_{v}"]) / 2).alias("at")) for v in "xy"])).alias("__m")).select(*group, "__m.*").distinct()
    kept = spaced(middles, [*group, "axis"], "at", step)
    return kept.withColumn("line", F.row_number().over(Window.partitionBy(*group, "axis").orderBy("at")))


def bundle_readings(bands: DataFrame, lines: DataFrame, cell: float, gap: float, level: float, group: Sequence[str]) -> DataFrame:
    """(group, axis, line, bundle, colours, levels): the runs of colours of every bundle that a scan line crosses, in ascending order.

    A line meets a band in the cells along the axis that the band's box spans.
    """
    b = F.col("box")
    turned = [F.struct(F.lit(v).alias("axis"), b[f"min_{v}"].alias("lo"), b[f"max_{v}"].alias("hi"), b[f"min_{o}"].alias("low"), b[f"max_{o}"].alias("high")) for v, o in ("xy", "yx")]
    spans = bands.select(*group, "colour", F.explode(F.array(*turned)).alias("__s")).select(*group, "colour", "__s.*")
    spans = spans.withColumn("__c", F.explode(F.sequence(F.floor(F.col("lo") / cell).cast("long"), F.floor(F.col("hi") / cell).cast("long"))))
    met = lines.withColumn("__c", F.floor(F.col("at") / cell).cast("long")).join(spans.hint("merge"), [*group, "axis", "__c"]).where("at between lo and hi")
    met = met.withColumn("__mid", (F.col("low") + F.col("high")) / 2)
    one = [*group, "axis", "line"]
    w = Window.partitionBy(*one).orderBy("__mid", "colour", "low", "high")
    met = met.withColumn("__cut", F.coalesce((F.col("low") - F.lag("high").over(w) > gap).cast("int"), F.lit(0))).withColumn("bundle", F.sum("__cut").over(w))
    inner = Window.partitionBy(*one, "bundle").orderBy("__mid", "colour", "low", "high")
    same = F.coalesce(F.col("colour") == F.lag("colour").over(inner), F.lit(False))
    met = met.withColumn("__new", (~same).cast("int")).withColumn("__level", (~(same & F.coalesce(F.abs(F.col("__mid") - F.lag("__mid").over(inner)) <= level, F.lit(False)))).cast("int"))
    met = met.withColumn("run", F.sum("__new").over(inner))
    runs = met.groupBy(*one, "bundle", "run").agg(F.first("colour").alias("colour"), F.sum("__level").alias("levels"))
    listed = F.array_sort(F.collect_list(F.struct("run", "colour", "levels")))
    read = runs.groupBy(*one, "bundle").agg(listed.alias("__r"))
    return read.select(*one, "bundle", F.transform("__r", lambda r: r["colour"]).alias("colours"), F.transform("__r", lambda r: r["levels"]).alias("levels"))


class Matched(NamedTuple):
    """assigned: group, colour, service, sizes, kind. evidence: group, stack, service. verdicts: group, stack, verdict."""

    assigned: DataFrame
    evidence: DataFrame
    verdicts: DataFrame


def match_stacks(tags: DataFrame, headers: DataFrame, bands: DataFrame, cell: float, group: Sequence[str], tolerances: Tolerances = Tolerances(), most: int = IN_A_TASK) -> Matched:
    """Services of colours by the stacks of each drawing.

    tags: tag_id, x, y, service (null where the text isn't a tag), size, kind. headers: header_id, text, x, y. bands: colour, ring.

    Verdicts: ``no_header``, ``no_tags`` (none with a service), ``degenerate`` (fewer than two runs, or one service only), ``no_match``, ``unstable`` (on no ``stable`` neighbouring
    lines), ``ambiguous`` (two stable assignments), ``conflict`` (the drawing's matched stacks, or one of them, give a colour two services: then
    all of the drawing abstain), ``matched``. A colour's sizes are those of its first run in the first stack that has it.

    A drawing of at most ``most`` tags, headers and bands is matched within a task, larger ones by joins.
    """
    ready_workers(tags.sparkSession)
    keys, box = list(group), ring_box(F.col("ring"))
    real = lambda c: F.col(c).cast("double").alias(c)
    read = F.coalesce(F.array_position(F.array(*map(F.lit, ORIENTATIONS)), orientation(F.col("text"))).cast("int") - 1, F.lit(-1))
    kind = lambda k: F.lit(k).alias("__k")
    rows = tags.select(*keys, kind(stack_arrays.TAG), "tag_id", real("x"), real("y"), "service", "size", "kind")
    rows = rows.unionByName(headers.select(*keys, kind(stack_arrays.HEADER), "header_id", real("x"), real("y"), read.alias("said")), allowMissingColumns=True)
    sides = bands.where(F.size("ring") >= 3).select(*keys, kind(stack_arrays.BAND), "colour", box.alias("box"))
    rows = rows.unionByName(sides.select(*keys, "__k", "colour", *[F.col(f"box.{c}").cast("double").alias(c) for c in ("min_x", "min_y", "max_x", "max_y")]), allowMissingColumns=True)
    rows = rows.repartition(*keys).sortWithinPartitions(*keys) if keys else rows.repartition(1)
    type_of = lambda df, c: df.schema[c].dataType.simpleString()
    made = ", ".join([*[f"`{k}` {type_of(tags, k)}" for k in keys], "__o int, stack long, verdict string", f"colour {type_of(bands, 'colour')}, service {type_of(tags, 'service')}", f"sizes array<{type_of(tags, 'size')}>, kind {type_of(tags, 'kind')}"])
    with Scratch(tags.sparkSession) as s:
        out = s.table(rows.mapInArrow(passes(keys, most, stack_arrays.fields, partial(stack_arrays.match, tolerances=tolerances, keys=keys)), made), "matched", keep=True)
        large = out.where(F.col("__o") == LARGE).select(*keys)
        of = lambda k: out.where(F.col("__o") == k)
        found = Matched(
            of(stack_arrays.ASSIGNED).select(*keys, "colour", "service", "sizes", "kind"), of(stack_arrays.EVIDENCE).select(*keys, "stack", "service"), of(stack_arrays.VERDICT).select(*keys, "stack", "verdict")
        )
        if large.isEmpty():
            return found
        rest = match_large_stacks(*[of_drawings(df, large, keys) if keys else df for df in (tags, headers, bands)], cell, group, tolerances)
        return Matched(*[a.union(b) for a, b in zip(found, rest)])


def match_large_stacks(tags: DataFrame, headers: DataFrame, bands: DataFrame, cell: float, group: Sequence[str], tolerances: Tolerances = Tolerances()) -> Matched:
    """``match_stacks`` in joins and windows, for drawings of any size."""
    one = [*group, "stack"]
    with Scratch(tags.sparkSession) as s:
        clusters = s.table(tag_clusters(tags, tolerances.axis, group), "clusters")
        read, runs = read_stacks(clusters, headers, tolerances.header, group)
        runs = s.table(runs, "runs", keep=True)
        per = runs.groupBy(*one).agg(F.count("*").alias("__n"), F.count_distinct("service").alias("__services"), F.array_sort(F.collect_list(F.struct("run", "service", "levels"))).alias("__runs"))
        stacks = s.table(read.join(per.hint("merge"), one, "left"), "stacks", keep=True)
        usable = stacks.where("header is not null and __n >= 2 and __services >= 2")
        down = F.col("header").isin(ORIENTATIONS[0], ORIENTATIONS[3])
        ordered = F.when(down, F.reverse("__runs")).otherwise(F.col("__runs"))
        axis = F.when(F.col("header").isin(*ORIENTATIONS[:2]), "x").otherwise("y")
        usable = usable.select(*one, down.alias("__down"), axis.alias("axis"), F.transform("__runs", lambda r: r["service"]).alias("services"), F.transform(ordered, lambda r: r["levels"]).alias("levels"))
        boxed = bands.where(F.size("ring") >= 3).select(*group, "colour", ring_box(F.col("ring")).alias("box")).join(usable.select(*group).distinct().hint("merge"), list(group), "left_semi")
        lines = s.table(scan_lines(boxed, tolerances.position, group), "lines")
        readings = bundle_readings(boxed, lines, cell, tolerances.gap, tolerances.level, group)
        hits = usable.join(readings.hint("merge"), [*group, "axis", "levels"])
        colours = F.when(F.col("__down"), F.reverse("colours")).otherwise(F.col("colours"))
        hits = hits.withColumn("colours", colours).withColumn("pairs", F.array_sort(F.zip_with("colours", "services", lambda c, v: F.struct(c.alias("colour"), v.alias("service")))))
        hits = s.table(hits.groupBy(*one, "pairs", "line").agg(F.min_by("colours", "bundle").alias("colours")), "hits", keep=True)
        w = Window.partitionBy(*one, "pairs").orderBy("line")
        islands = hits.withColumn("__island", F.col("line") - F.row_number().over(w)).groupBy(*one, "pairs", "__island").agg(F.count("*").alias("__l"), F.min("line").alias("__first"))
        found = islands.groupBy(*one, "pairs").agg(F.max("__l").alias("__l"), F.min("__first").alias("line"))
        chosen = found.groupBy(*one).agg(F.count_if(F.col("__l") >= tolerances.stable).alias("__stable"), F.min_by(F.struct("pairs", "line"), (F.col("__l") < tolerances.stable).cast("int")).alias("__best"))
        won = chosen.where("__stable = 1").select(*one, "__best.pairs", "__best.line").join(hits.hint("merge"), [*one, "pairs", "line"]).select(*one, "pairs", "colours")
        won = s.table(won, "won", keep=True)
        chosen = s.table(chosen.select(*one, "__stable"), "chosen", keep=True)
    told = won.select(*group, F.explode("pairs").alias("p")).groupBy(*group, "p.colour").agg(F.min("p.service").alias("service"), F.max("p.service").alias("__high"))
    clash = told.where("service <> __high").select(*group).distinct()
    kept = won.join(clash.hint("merge"), list(group), "left_anti")
    places = kept.select(*one, F.posexplode("colours").alias("__i", "colour")).withColumn("run", F.col("__i") + 1)
    sized = places.join(runs.hint("merge"), [*one, "run"])
    assigned = sized.groupBy(*group, "colour").agg(F.min_by(F.struct("service", "sizes", "kind"), F.struct("stack", "run")).alias("__b")).select(*group, "colour", "__b.service", "__b.sizes", "__b.kind")
    evidence = kept.select(*one).join(runs.hint("merge"), one).select(*one, "service").distinct()
    marked = stacks.join(chosen.hint("merge"), one, "left").join(clash.withColumn("__clash", F.lit(True)).hint("merge"), list(group), "left")
    verdict = (
        F.when(F.col("header").isNull(), "no_header").when(F.coalesce("__n", F.lit(0)) == 0, "no_tags").when((F.col("__n") < 2) | (F.col("__services") < 2), "degenerate").when(F.col("__stable").isNull(), "no_match")
        .when(F.col("__stable") == 0, "unstable").when(F.col("__stable") > 1, "ambiguous").when(F.col("__clash"), "conflict").otherwise("matched")
    )
    return Matched(assigned, evidence, marked.select(*one, verdict.alias("verdict")))
