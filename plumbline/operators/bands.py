"""Segments and coloured bands: measured overlap and distance, attribution, containment types, refinement over connectivity.

Bands are rings (arrays of x, y; closed or not) with a key; a band grown by ``buffer`` is the set of points within
that distance of its ring or inside it. A segment meets it in intervals of its length: those between the first and
second, third and fourth ... crossing of its line with the ring, and one for each edge, the part within ``buffer`` of it.
Intervals of one key are united before they are measured, so overlapping bands of a key count once. Pairs are found by
the cells along segments and the grid level of a band's box in their group (a revision, a sheet); a ring is fetched once for each
pair and measured edge by edge as rows; no cross join. Rings of fewer than
three points are left out. Segments without length are left out, since they have nothing to attribute.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import grid_cell, inside_ring, point_segment_distance
from plumbline.operators.grid import along, boxes_at
from plumbline.operators.spatial import band_attribution, nearest_with_ties, ring_box
from plumbline.sources.tables import written

ENDS = ("x0", "y0", "x1", "y1")


def ring_edges(ring: Column) -> Column:
    """The edges of a ring as structs of their ends (ax, ay, bx, by)."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def _with_edge_measures(rows: DataFrame, r: float) -> DataFrame:
    """Rows of a segment (x0 ... y1) and an edge (ax ... by) with t, lo, hi and d.

    t is the place (0 to 1 within the segment) at which the segment's line crosses the edge, whose ends lie on different sides of
    it; (lo, hi) the part of the segment within r of the edge, a capsule, so one interval: that of its discs and its slab; and d
    the distance of the two.
    """
    c = F.col
    rows = rows.withColumns({"dx": c("x1") - c("x0"), "dy": c("y1") - c("y0"), "ex": c("bx") - c("ax"), "ey": c("by") - c("ay"), "fx": c("x0") - c("ax"), "fy": c("y0") - c("ay"), "gx": c("x0") - c("bx"), "gy": c("y0") - c("by")})
    rows = rows.withColumns({
        "sa": c("dx") * -c("fy") - c("dy") * -c("fx"), "sb": c("dx") * -c("gy") - c("dy") * -c("gx"), "qa": c("dx") * c("dx") + c("dy") * c("dy"), "size": c("ex") * c("ex") + c("ey") * c("ey"),
        "across": c("dx") * c("ey") - c("dy") * c("ex"), "pa": c("fx") * c("dx") + c("fy") * c("dy"), "pb": c("gx") * c("dx") + c("gy") * c("dy"),
        "along0": c("fx") * c("ex") + c("fy") * c("ey"), "along1": c("dx") * c("ex") + c("dy") * c("ey"), "side0": c("fx") * c("ey") - c("fy") * c("ex"),
    })
    rows = rows.withColumns({
        "na": c("pa") * c("pa") - c("qa") * (c("fx") * c("fx") + c("fy") * c("fy") - r * r), "nb": c("pb") * c("pb") - c("qa") * (c("gx") * c("gx") + c("gy") * c("gy") - r * r),
        "t": F.when((c("sa") >= 0) != (c("sb") >= 0), (c("ay") - c("y0")) / F.nullif(c("across"), F.lit(0.0)) * -c("ex") + (c("ax") - c("x0")) / F.nullif(c("across"), F.lit(0.0)) * c("ey")),
        "wide": F.lit(r) * F.sqrt("size"),
    })

    def between(start: Column, step: Column, low: Column, high: Column) -> tuple[Column, Column]:
        """Where low <= start + t * step <= high."""
        one, two, always = (low - start) / F.nullif(step, F.lit(0.0)), (high - start) / F.nullif(step, F.lit(0.0)), start.between(low, high)
        return F.when(step != 0, F.least(one, two)).when(always, F.lit(float("-inf"))), F.when(step != 0, F.greatest(one, two)).when(always, F.lit(float("inf")))

    (l1, h1), (l2, h2) = between(c("along0"), c("along1"), F.lit(0.0), c("size")), between(c("side0"), c("across"), -c("wide"), c("wide"))
    rows = rows.withColumns({"l1": l1, "h1": h1, "l2": l2, "h2": h2})
    slab = (c("size") > 0) & c("l1").isNotNull() & c("l2").isNotNull() & (F.greatest("l1", "l2") <= F.least("h1", "h2"))
    lows = [F.when(c(n) >= 0, (-c(p) - F.sqrt(c(n))) / c("qa")) for n, p in (("na", "pa"), ("nb", "pb"))] + [F.when(slab, F.greatest("l1", "l2"))]
    highs = [F.when(c(n) >= 0, (-c(p) + F.sqrt(c(n))) / c("qa")) for n, p in (("na", "pa"), ("nb", "pb"))] + [F.when(slab, F.least("h1", "h2"))]
    ends = ("x0", "y0", "x1", "y1", "ax", "ay", "bx", "by")
    x0, y0, x1, y1, ax, ay, bx, by = (c(n) for n in ends)
    d = F.least(
        point_segment_distance(x0, y0, ax, ay, bx, by), point_segment_distance(x1, y1, ax, ay, bx, by), point_segment_distance(ax, ay, x0, y0, x1, y1), point_segment_distance(bx, by, x0, y0, x1, y1),
    )
    return rows.withColumns({"lo": F.least(*lows), "hi": F.greatest(*highs), "d": d})


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.explode(F.sequence(F.floor(low / cell).cast("long"), F.floor(high / cell).cast("long")))


def measured_overlaps(
    segments: DataFrame, bands: DataFrame, segment_id: str, key: str, cell: float, group: Sequence[str] = (), buffer: float = 0.011, reach: float = 0.12
) -> DataFrame:
    """(group, segment, key, overlap, distance): the share of each segment inside its grown bands of a key, and the distance
    to them, for the keys at most ``reach`` away. A band without a key (null) is a key of its own."""
    wide = buffer + reach
    sized = segments.where((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1"))).select(*group, segment_id, *ENDS)
    rings = bands.where(F.size(F.array_distinct("ring")) >= 3).select(*group, F.col(key).alias("__key"), "ring").distinct().withColumn("__band", F.xxhash64("ring"))
    # Lines under the cells along them on each level that a band's box is listed on; a pair meets in many cells and counts once.
    boxes = boxes_at(rings.select(*group, "__band", ring_box(F.col("ring")).alias("box")).distinct(), cell)
    near = along(sized.crossJoin(F.broadcast(boxes.select("__level").distinct())), cell, wide, level="__level")
    pairs = near.join(boxes, [*group, "__level", "__cx", "__cy"]).select(*group, segment_id, *ENDS, "__band").distinct()
    met = pairs.join(rings, [*group, "__band"])
    one = [*group, segment_id, "__key"]
    rows = _with_edge_measures(met.select(*one, "__band", *ENDS, F.inline(ring_edges(F.col("ring")))), buffer)
    near = F.struct(F.greatest(F.col("lo"), F.lit(0.0)).alias("lo"), F.least(F.col("hi"), F.lit(1.0)).alias("hi"))
    per = rows.groupBy(*one, "__band").agg(
        F.sort_array(F.collect_list("t")).alias("ts"), F.min("d").alias("d"), F.collect_list(F.when(F.col("lo").isNotNull() & (F.col("lo") <= 1) & (F.col("hi") >= 0), near)).alias("caps")
    )
    inner = F.transform(F.sequence(F.lit(1), F.floor(F.size("ts") / 2).cast("int")), lambda i: F.struct(F.greatest(F.element_at("ts", i * 2 - 1), F.lit(0.0)).alias("lo"), F.least(F.element_at("ts", i * 2), F.lit(1.0)).alias("hi")))
    inner = F.filter(F.when(F.size("ts") >= 2, inner).otherwise(F.array().cast("array<struct<lo:double,hi:double>>")), lambda p: p["lo"] <= p["hi"])
    per = per.withColumn("__in", inner)
    distance = F.when(F.size("__in") > 0, F.lit(0.0)).otherwise(F.greatest(F.col("d") - buffer, F.lit(0.0)))
    none = F.array(F.struct(F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")))
    pieces = per.select(*one, distance.alias("__d"), F.concat("__in", "caps", none).alias("__all")).where(F.col("__d") <= reach).select(*one, "__d", F.inline("__all"))
    w = Window.partitionBy(*one).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("__fresh", F.greatest(F.col("hi") - F.greatest("lo", F.coalesce(F.max("hi").over(w), F.col("lo"))), F.lit(0.0)))
    out = pieces.groupBy(*one).agg(F.sum("__fresh").alias("overlap"), F.min("__d").alias("distance"))
    return out.withColumnRenamed("__key", key)


def attributed(
    segments: DataFrame, bands: DataFrame, segment_id: str, key: str, cell: float, group: Sequence[str] = (), buffer: float = 0.011,
    min_share: float = 0.3, near: float = 0.1, margin: float = 0.02,
) -> DataFrame:
    """(group, segment, length, key, basis) of every segment with length: the band it lies in for at least ``min_share``, else
    the nearest within ``near`` whose lead is ``margin`` or that is alone there, else shared (null key)."""
    found = measured_overlaps(segments, bands, segment_id, key, cell, group, buffer, near + margin)
    verdict = band_attribution(found, segment_id, key, min_share, near, margin, group)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    sized = segments.select(*group, segment_id, F.sqrt(dx * dx + dy * dy).alias("length")).where("length > 0")
    return sized.join(verdict, [*group, segment_id], "left").withColumn("basis", F.coalesce("basis", F.lit("shared")))


#: Band types that no legend entry names.
UNMAPPED = "__unmapped"


def containment_lengths(
    segments: DataFrame, bands: DataFrame, legend: DataFrame, labels: DataFrame, segment_id: str, cell: float, group: Sequence[str] = (), label_reach: float = 5.0
) -> DataFrame:
    """(group, containment_type, basis, length) of a sheet's containment.

    Bands (colour, pattern, ring) take their type from the legend (colour, pattern, containment_type; a hit without a type
    counts as unmapped) and segments are attributed to types. Segments of unmapped bands take the service of the nearest
    label (x, y, service) to their middle; a service that begins with another one's whole words joins it. Bases are
    ``legend``, ``run_label``, ``unresolved`` (null type) and ``shared`` (null type); lengths add up to the segments'.
    """
    known = legend.groupBy(*group, "colour", "pattern").agg(F.min("containment_type").alias("containment_type"))
    typed = bands.join(known, [*group, "colour", "pattern"], "left").withColumn("token", F.coalesce("containment_type", F.lit(UNMAPPED)))
    verdict, _ = written(attributed(segments, typed, segment_id, "token", cell, group), "verdict")
    middle = segments.select(*group, segment_id, ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    loose = middle.join(verdict.where(F.col("token") == UNMAPPED), [*group, segment_id], "left_semi")
    named, _ = written(nearest_with_ties(loose, labels.select(*group, "x", "y", "service"), label_reach, segment_id, ["service"], group=group), "named")
    families = merged_families(named.where("service is not null").select(*group, "service").distinct(), "service", group)
    named = named.join(families, [*group, "service"], "left").select(*group, segment_id, "family")
    met = verdict.join(named, [*group, segment_id], "left")
    kind = F.when(F.col("token") == UNMAPPED, F.col("family")).otherwise(F.col("token"))
    basis = F.when(F.col("token").isNull(), "shared").when(F.col("token") != UNMAPPED, "legend").when(F.col("family").isNotNull(), "run_label").otherwise("unresolved")
    return met.groupBy(*group, kind.alias("containment_type"), basis.alias("basis")).agg(F.sum(F.col("length").cast("decimal(28,9)")).alias("length"))


def merged_families(names: DataFrame, name: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, name, family): the longest other name of the group that is a name's first whole words, else itself."""
    words = F.split(name, " ")
    heads = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    listed = names.select(*group, name, F.explode(F.when(F.size(words) > 1, heads).otherwise(F.array().cast("array<string>"))).alias("__head"))
    met = listed.join(names.select(*group, F.col(name).alias("__head")).distinct(), [*group, "__head"])
    best = met.groupBy(*group, name).agg(F.max_by("__head", F.length("__head")).alias("__best"))
    return names.select(*group, name).distinct().join(best, [*group, name], "left").select(*group, name, F.coalesce("__best", name).alias("family"))


def tee_split(segments: DataFrame, segment_id: str, snap: float, tolerance: float, group: Sequence[str] = ()) -> DataFrame:
    """Segments cut where another one's snapped end lies within ``tolerance`` of them and further than ``snap`` from their ends.

    (the segments' columns, part, u, v): x0 to y1 are the part's, u and v its snapped nodes, of which cuts closer together
    than ``snap`` keep the first. Parts shorter than ``snap`` are left out, and so are segments without length.
    """
    cell = 16 * max(snap, tolerance)
    node = lambda x, y: F.struct(grid_cell(x, snap).alias("i"), grid_cell(y, snap).alias("j"))
    sized = segments.where((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")))
    ends = sized.select(*group, F.explode(F.array(node(F.col("x0"), F.col("y0")), node(F.col("x1"), F.col("y1")))).alias("n")).distinct()
    at = ends.select(*group, "n", (F.col("n.i") * F.lit(snap)).alias("nx"), (F.col("n.j") * F.lit(snap)).alias("ny"))
    at = at.withColumn("__cx", F.floor(F.col("nx") / cell).cast("long")).withColumn("__cy", F.floor(F.col("ny") / cell).cast("long"))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    listed = along(sized.select(*group, segment_id, *ENDS), cell, tolerance)
    met = listed.join(at, [*group, "__cx", "__cy"])
    size = F.sqrt(dx * dx + dy * dy)
    t = ((F.col("nx") - F.col("x0")) * dx + (F.col("ny") - F.col("y0")) * dy) / (size * size)
    away = F.abs((F.col("nx") - F.col("x0")) * dy - (F.col("ny") - F.col("y0")) * dx) / size
    own = (F.col("n") == node(F.col("x0"), F.col("y0"))) | (F.col("n") == node(F.col("x1"), F.col("y1")))
    met = met.where(~own & (t * size > snap) & ((1 - t) * size > snap) & (away <= tolerance))
    cuts = met.select(*group, segment_id, t.alias("t"), size.alias("size"), "n").distinct()
    last = Window.partitionBy(*group, segment_id).orderBy("t", "n.i", "n.j")
    cuts = cuts.withColumn("__gap", (F.col("t") - F.lag("t").over(last)) * F.col("size")).where("__gap is null or __gap > " + repr(snap))
    gathered = cuts.groupBy(*group, segment_id).agg(F.array_sort(F.collect_list(F.struct("t", "n"))).alias("__cuts"))
    whole = sized.join(gathered, [*group, segment_id], "left")
    end = lambda i, t: F.array(F.struct(F.lit(t).alias("t"), node(F.col(f"x{i}"), F.col(f"y{i}")).alias("n")))
    marks = F.concat(end(0, 0.0), F.coalesce("__cuts", F.array().cast(gathered.schema["__cuts"].dataType)), end(1, 1.0))
    whole = whole.withColumn("__marks", marks)
    parts = F.transform(F.sequence(F.lit(1), F.size("__marks") - 1), lambda i: F.struct(i.alias("part"), F.element_at("__marks", i).alias("a"), F.element_at("__marks", i + 1).alias("b")))
    cut = whole.withColumn("__p", F.explode(parts))
    place = lambda axis, side: F.col(f"{axis}0") + F.col(f"__p.{side}.t") * (F.col(f"{axis}1") - F.col(f"{axis}0"))
    kept = [c for c in segments.columns if c not in ENDS]
    out = cut.select(*kept, F.col("__p.part").alias("part"), *[place(a, s).alias(f"{a}{i}") for i, s in ((0, "a"), (1, "b")) for a in "xy"], F.col("__p.a.n").alias("u"), F.col("__p.b.n").alias("v"))
    return out.where(F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2) >= snap)


def refine_shared(
    segments: DataFrame, segment_id: str, colour: str, group: Sequence[str] = (), fittings: DataFrame | None = None, snap: float = 0.03, tee: float = 0.03,
    connector: float = 0.15, collinear: float = 0.98, buffer: float = 0.011, cell: float = 5.0,
) -> DataFrame:
    """(group, segment, part, length, colour): shared segments' parts adopt a colour over connectivity, in one pass.

    Segments are cut at tees. A part without a colour adopts that of the coloured parts at its snapped ends, if they have just
    one and the part is short (a connector) or collinear with one of them. What is still shared takes the colour of the fitting
    bands (``fittings``: the colour, ring) that hold one of its ends, if they have just one. Colours given at the start decide:
    there is no second pass over what was adopted.
    """
    parts = tee_split(segments, segment_id, snap, tee, group)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    shaped = parts.withColumn("dx", dx).withColumn("dy", dy).withColumn("length", F.sqrt(dx * dx + dy * dy))
    one = [*group, segment_id, "part"]
    known = shaped.where(F.col(colour).isNotNull()).select(*group, F.explode(F.array_distinct(F.array("u", "v"))).alias("__n"), F.col(colour).alias("__c"), F.col("dx").alias("__dx"), F.col("dy").alias("__dy"), F.col("length").alias("__l"))
    loose = shaped.where(F.col(colour).isNull()).select(*one, F.explode(F.array_distinct(F.array("u", "v"))).alias("__n"), "dx", "dy", "length")
    cosine = F.abs(F.col("dx") * F.col("__dx") + F.col("dy") * F.col("__dy")) / (F.col("length") * F.col("__l"))
    near = loose.join(known, [*group, "__n"]).groupBy(*one).agg(F.min("__c").alias("__low"), F.max("__c").alias("__high"), F.max(cosine).alias("__aligned"), F.max("length").alias("__size"))
    adopted = near.where((F.col("__low") == F.col("__high")) & ((F.col("__size") <= connector) | (F.col("__aligned") >= collinear))).select(*one, F.col("__low").alias("__adopted"))
    met = shaped.join(adopted, one, "left").withColumn(colour, F.coalesce(colour, "__adopted"))
    if fittings is not None:
        ends = met.where(F.col(colour).isNull()).select(*one, F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("__e"))
        points = ends.select(*one, "__e.x", "__e.y")
        held = held_by_rings(points, fittings.select(*group, F.col(colour).alias("__c"), "ring"), cell, group, buffer)
        bridged = held.groupBy(*one).agg(F.min("__c").alias("__low"), F.max("__c").alias("__high")).where("__low = __high").select(*one, F.col("__low").alias("__bridged"))
        met = met.join(bridged, one, "left").withColumn(colour, F.coalesce(colour, "__bridged"))
    return met.select(*one, "length", colour)


def held_by_rings(points: DataFrame, rings: DataFrame, cell: float, group: Sequence[str] = (), buffer: float = 0.0) -> DataFrame:
    """Points (x, y) with the columns of each ring that holds them, grown by ``buffer``."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    r = rings.withColumn("__cx", _cells(F.array_min(xs) - buffer, F.array_max(xs) + buffer, cell)).withColumn("__cy", _cells(F.array_min(ys) - buffer, F.array_max(ys) + buffer, cell))
    p = points.withColumn("__cx", F.floor(F.col("x") / cell).cast("long")).withColumn("__cy", F.floor(F.col("y") / cell).cast("long"))
    edge = lambda e: point_segment_distance(F.col("x"), F.col("y"), e["ax"], e["ay"], e["bx"], e["by"])
    near = F.array_min(F.transform(ring_edges(F.col("ring")), edge)) < buffer if buffer > 0 else F.lit(False)
    return p.join(r, [*group, "__cx", "__cy"]).where(inside_ring(F.col("x"), F.col("y"), F.col("ring")) | near).drop("__cx", "__cy", "ring")
