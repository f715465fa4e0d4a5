"""Drawn rails to centrelines: parallel edges paired greedily by distance, their midlines, and lines taken as they are drawn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.grid import ENDS, along, cell_of
from plumbline.operators.pairing import SMALL, greedy_class_pairs
from plumbline.sources.tables import Scratch

#: What names a layer of centrelines that were drawn as such; file families whose rails are paired.
CENTRELINE_TOKENS = ("center line", "centre line", "centerline", "centreline")
PAIRED_FAMILIES = ("dwg", "dxf")


def _sized(segments: DataFrame) -> DataFrame:
    """Segments with length, dx, dy, l."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return segments.withColumns({"dx": dx, "dy": dy}).withColumn("l", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).where("l > 0")


def rail_candidates(places: DataFrame, place: str, group: Sequence[str] = (), least: float = 0.01, most: float = 2.0, overlap: float = 0.5, parallel: float = 0.985) -> DataFrame:
    """(a, b, perp, ordered): places of a group whose rails i and j pair, i being the longer one (of equal ones the lower id): they run parallel,
    with j's middle at a distance from ``least`` to ``most`` from i's line, and beside each other for at least ``overlap`` of the shorter one.

    places: different ends, with how many rails have them (n). ``ordered`` marks places of equal length, which stand here both ways: of their rails,
    those with i < j pair. As j lies beside i for half of its length, its middle is within ``most`` of i: j is looked up by its middle's cell, and i
    listed under the cells along it.
    """
    cell, c = max(most, 1e-9) * 4, F.col
    one = _sized(places.select(*group, F.col(place).alias("a"), "n", *ENDS))
    named = {"a": "b", "dx": "ex", "dy": "ey", "l": "m"} | {e: f"o{e}" for e in ENDS}
    two = one.drop("n").withColumnsRenamed(named).withColumns({"mx": (c("ox0") + c("ox1")) / 2, "my": (c("oy0") + c("oy1")) / 2})
    two = two.withColumns({"__cx": cell_of(c("mx"), F.lit(cell)), "__cy": cell_of(c("my"), F.lit(cell))})
    met = along(one, cell, most).join(two.hint("merge"), [*group, "__cx", "__cy"]).where((c("l") >= c("m")) & ((c("a") != c("b")) | (c("n") > 1)))
    cosine = F.abs(c("dx") * c("ex") + c("dy") * c("ey")) / (c("l") * c("m"))
    place_on = lambda x, y: ((c(x) - c("x0")) * c("dx") + (c(y) - c("y0")) * c("dy")) / c("l")
    met = met.where(cosine >= parallel).withColumns({"__from": place_on("ox0", "oy0"), "__to": place_on("ox1", "oy1")})
    beside = F.greatest(F.least("l", F.greatest("__from", "__to")) - F.greatest(F.lit(0.0), F.least("__from", "__to")), F.lit(0.0))
    perp = F.abs((c("mx") - c("x0")) * c("dy") - (c("my") - c("y0")) * c("dx")) / c("l")
    met = met.withColumns({"perp": perp, "share": beside / F.least("l", "m")}).where((c("perp") >= least) & (c("perp") <= most) & (c("share") >= overlap))
    return met.select("a", "b", "perp", (c("l") == c("m")).alias("ordered"))


def _midline() -> Column:
    """The line from (x0, y0, x1, y1) and (ox0, oy0, ox1, oy1) that joins the middles of their ends, the lower end first."""
    c = F.col
    against = (c("x1") - c("x0")) * (c("ox1") - c("ox0")) + (c("y1") - c("y0")) * (c("oy1") - c("oy0")) < 0
    half = lambda v, own, other: ((c(f"{v}{own}") + F.when(against, c(f"o{v}{1 - other}")).otherwise(c(f"o{v}{other}"))) / 2).alias(v)
    ends = F.array_sort(F.array(*[F.struct(half("x", k, k), half("y", k, k)) for k in (0, 1)]))
    return F.struct(*[ends[k][v].alias(f"{v}{k}") for k in (0, 1) for v in "xy"])


def producer(family: Column, layer: Column) -> Column:
    """How a group's lines become centrelines: ``derived`` from rails or ``authored`` as drawn in files of a drawing program, else ``passthrough``."""
    authored = F.coalesce(F.lower(layer).rlike("|".join(CENTRELINE_TOKENS)), F.lit(False))
    return F.when(F.coalesce(F.lower(family).isin(*PAIRED_FAMILIES), F.lit(False)), F.when(authored, "authored").otherwise("derived")).otherwise("passthrough")


def centreline_parts(segments: DataFrame, segment_id: str, group: Sequence[str] = (), mostly: float = 0.5, rung: float = 0.7, how: str | None = None, small: int = SMALL, **options) -> DataFrame:
    """(group, kind, x0, y0, x1, y1, length): the centrelines of each group as rows.

    Rails (segments longer than ``rung``) pair greedily by distance, then ids, each once; a pair is its ``midline``. A rail that stays unpaired is a
    ``rail``, which counts half where at least ``mostly`` of the group's rails are paired (its fellow is missing), else whole (lines drawn
    single). Rungs are left out. ``how`` names a column with ``producer``'s verdict: ``authored`` and ``passthrough`` lines of any length stay as
    they are; null counts as derived. Segments without length are left out.

    Rails with the same ends stand at one place and have the same candidates: places meet, not rails, so rows don't grow with the square of
    what lies at a place. A group of at most ``small`` rails and meeting places is paired in one task, see ``greedy_class_pairs``.
    """
    sized = _sized(segments).withColumn("__how", F.coalesce(F.col(how), F.lit("derived")) if how else F.lit("derived"))
    as_drawn = sized.where("__how <> 'derived'").select(*group, F.col("__how").alias("kind"), *ENDS, F.col("l").alias("length"))
    rails_ = sized.where((F.col("__how") == "derived") & (F.col("l") > rung)).select(*group, F.col(segment_id).alias("id"), *ENDS, "l")
    with Scratch(segments.sparkSession) as scratch:
        one = [*group, *ENDS]
        places = scratch.table(rails_.groupBy(*one).agg(F.count("*").alias("n"), F.first("l").alias("l")).withColumn("cls", F.monotonically_increasing_id()), "places", keep=True)
        if group:
            parts = places.groupBy(*group).agg(F.min("cls").alias("part"))
            of_part = scratch.table(places.join(parts.hint("merge"), list(group)).select("part", "cls", *one), "parts")
        else:
            of_part = places.select(F.lit(0).cast("long").alias("part"), "cls", *one)
        edges = rail_candidates(places, "cls", group, **options).join(of_part.select("part", F.col("cls").alias("a")).hint("merge"), "a")
        edges = scratch.table(edges.select("part", "a", "b", F.col("perp").alias("cost"), "ordered"), "edges")
        members = scratch.table(rails_.join(of_part.hint("merge"), one).select("part", "cls", "id"), "members")
        pairs = scratch.table(greedy_class_pairs(members, edges, small), "pairs", keep=True)
    times = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("__i")
    other = places.select(F.col("cls").alias("b"), *[F.col(e).alias(f"o{e}") for e in ENDS])
    met = pairs.join(places.select(*one, F.col("cls").alias("a")).hint("merge"), "a").join(other.hint("merge"), "b").select(*group, F.lit("midline").alias("kind"), _midline().alias("midline"), pairs["n"])
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    line = met.select(*group, "kind", "midline.*", times(F.col("n"))).drop("__i").withColumn("length", F.sqrt(dx * dx + dy * dy))
    used = pairs.select(F.explode(F.array("a", "b")).alias("cls"), "n").groupBy("cls").agg(F.sum("n").alias("__used"))
    loose = places.join(used.hint("merge"), "cls", "left").withColumn("__used", F.coalesce("__used", F.lit(0).cast("long")))
    shares = loose.groupBy(*group).agg(F.sum("n").alias("__n"), F.sum("__used").alias("__paired"))
    met = loose.join(shares.hint("merge"), list(group)) if group else loose.crossJoin(F.broadcast(shares))
    double = F.col("__paired") >= mostly * F.col("__n")
    single = met.where("n > __used").select(*group, F.lit("rail").alias("kind"), *ENDS, (F.col("l") * F.when(double, 0.5).otherwise(1.0)).alias("length"), times(F.col("n") - F.col("__used"))).drop("__i")
    return line.union(single).union(as_drawn)


def centrelines(segments: DataFrame, segment_id: str, group: Sequence[str] = (), **options) -> DataFrame:
    """(group, n_pairs, n_unpaired, length): the centreline length of each group that has a segment with length, from ``centreline_parts``."""
    parts = centreline_parts(segments, segment_id, group, **options)
    sums = parts.groupBy(*group).agg(
        F.count_if(F.col("kind") == "midline").alias("n_pairs"), F.count_if(F.col("kind") == "rail").alias("n_unpaired"), F.sum(F.col("length").cast("decimal(28,9)")).alias("length")
    )
    if not group:
        return sums
    every = _sized(segments).select(*group).distinct().join(sums, list(group), "left")
    return every.select(*group, *[F.coalesce(c, F.lit(0).cast(sums.schema[c].dataType)).alias(c) for c in ("n_pairs", "n_unpaired", "length")])
