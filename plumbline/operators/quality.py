"""Coverage, reconciliation, conservation checks and status lattices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import ring_area


def coverage(entities: DataFrame, group: Sequence[str], kind: str, layer: str, unmapped: str, review: str) -> DataFrame:
    """Counts and mapped ratio (four places; one when empty) of each group."""
    n, bad = F.count("*"), F.count(F.col(unmapped))
    return entities.groupBy(*group).agg(
        n.alias("n_entities"),
        F.count_distinct(kind).alias("n_types"),
        F.count_distinct(layer).alias("n_layers"),
        F.count_if(F.col(review)).alias("n_review"),
        bad.alias("n_unmapped"),
        F.round(F.when(n == 0, F.lit(1.0)).otherwise((n - bad) / n), 4).alias("mapped_ratio"),
    )


def counts_by(entities: DataFrame, group: Sequence[str], by: str) -> DataFrame:
    return entities.groupBy(*group, by).agg(F.count("*").alias("n"))


def placement_ratio(entities: DataFrame, blocks: DataFrame, group: str) -> DataFrame:
    """Placed instances / (placed + leaf entities of blocks that no instance places), four places."""
    placed = entities.where(F.col("block_ref").isNotNull())
    n_placed = placed.groupBy(group).agg(F.count("*").alias("placed"))
    stranded = blocks.join(placed.select(group, "block_ref").distinct(), [group, "block_ref"], "left_anti")
    n_stranded = stranded.groupBy(group).agg(F.sum("leaf_count").alias("stranded"))
    met = n_placed.join(n_stranded, group, "full_outer").fillna(0, ["placed", "stranded"])
    total = F.col("placed") + F.col("stranded")
    return met.withColumn("ratio", F.round(F.when(total == 0, F.lit(1.0)).otherwise(F.col("placed") / total), 4))


def count_drift(declared: DataFrame, actual: DataFrame, key: Sequence[str]) -> DataFrame:
    """declared - actual by key; a key without a declaration isn't applicable."""
    met = declared.withColumnRenamed("n", "declared").join(actual.withColumnRenamed("n", "actual"), list(key), "full_outer")
    delta = F.col("declared") - F.coalesce("actual", F.lit(0))
    status = F.when(F.col("declared").isNull(), "not_applicable").when(delta == 0, "match").otherwise("drift")
    return met.select(*key, "declared", F.coalesce("actual", F.lit(0).cast("long")).alias("actual"), delta.alias("delta"), status.alias("status"))


def dangling(rows: DataFrame, reference: str, targets: DataFrame, target: str) -> DataFrame:
    """Rows whose non-null reference has no target."""
    known = targets.select(F.col(target).alias("__t")).distinct()
    return rows.where(F.col(reference).isNotNull()).join(known, F.col(reference) == F.col("__t"), "left_anti")


def extents(rows: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Bounding box of each group, with the number of located rows; degenerate when a side has no length."""
    box = rows.groupBy(*group).agg(
        F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"), F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n_located")
    )
    return box.withColumn("degenerate", (F.col("min_x") == F.col("max_x")) | (F.col("min_y") == F.col("max_y")))


def roll_up(invariants: DataFrame, group: Sequence[str]) -> DataFrame:
    """match, or drift with the sorted names of the gating invariants that drift."""
    gating = F.when(F.col("gating") & (F.col("status") == "drift"), F.col("invariant"))
    drifted = F.array_sort(F.collect_set(gating))
    return invariants.groupBy(*group).agg(drifted.alias("drifted")).withColumn("status", F.when(F.size("drifted") > 0, "drift").otherwise("match"))


#: Statuses from best to worst.
LATTICE = ("valid", "warning", "review", "fail")


def worst_status(rows: DataFrame, group: Sequence[str], status: str) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, LATTICE)), F.col(status))
    return rows.groupBy(*group).agg(F.element_at(F.array(*map(F.lit, LATTICE)), F.max(rank).cast("int")).alias("status"))


def finding_counts(findings: DataFrame, group: Sequence[str], severity: str, levels: Sequence[str]) -> DataFrame:
    """Findings of each group by severity and in all."""
    return findings.groupBy(*group).agg(*[F.count_if(F.col(severity) == s).alias(f"n_{s}") for s in levels], F.count("*").alias("n_total"))


def conservation(checks: Mapping[str, tuple[DataFrame, Column, DataFrame, Column]], tolerance: float = 0.1) -> DataFrame:
    """(check, left_total, right_total, holds) for totals that must agree."""
    out = None
    for name, (left, a, right, b) in checks.items():
        row = left.agg(a.cast("double").alias("left_total")).crossJoin(right.agg(b.cast("double").alias("right_total")))
        row = row.select(F.lit(name).alias("check"), "*", (F.abs(F.col("left_total") - F.col("right_total")) <= tolerance).alias("holds"))
        out = row if out is None else out.union(row)
    return out


def conserved_by(checks: Mapping[str, tuple[DataFrame, Column, DataFrame, Column]], group: Sequence[str], tolerance: float = 0.1) -> DataFrame:
    """(group, check, left_total, right_total, holds) for totals of two independent results that must agree in each group.

    A group that one side lacks has zero there.
    """
    out = None
    for name, (left, a, right, b) in checks.items():
        one, two = left.groupBy(*group).agg(a.cast("double").alias("l")), right.groupBy(*group).agg(b.cast("double").alias("r"))
        met = one.join(two, list(group), "full_outer")
        row = met.select(*group, F.lit(name).alias("check"), F.coalesce("l", F.lit(0.0)).alias("left_total"), F.coalesce("r", F.lit(0.0)).alias("right_total"))
        row = row.withColumn("holds", F.abs(F.col("left_total") - F.col("right_total")) <= tolerance)
        out = row if out is None else out.union(row)
    return out


def manifest(parts: Mapping[str, DataFrame], key: str) -> DataFrame:
    """(key, collection, n): rows of each collection, as a map's entries."""
    out = None
    for name, df in parts.items():
        rows = df.groupBy(key).agg(F.count("*").alias("n")).select(key, F.lit(name).alias("collection"), "n")
        out = rows if out is None else out.union(rows)
    return out


def infer_unit(dimensions: DataFrame, group: str, value: str, priorities: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Unit voted by dimensions: each votes for the first unit whose log10 band holds its value; the lower median wins."""
    log = F.log10(F.col(value))
    vote = F.lit(None).cast("int")
    for i, (_, low, high) in reversed(list(enumerate(priorities))):
        vote = F.when((log >= low) & (log < high), F.lit(i)).otherwise(vote)
    votes = dimensions.where(F.col(value) > 0).withColumn("vote", vote).where("vote is not null")
    middle = F.expr("percentile_disc(0.5) within group (order by vote)").cast("int")
    picked = votes.groupBy(group).agg(middle.alias("unit_index"), F.count("*").alias("n_votes"))
    return picked.withColumn("unit", F.element_at(F.array(*[F.lit(u) for u, _, _ in priorities]), F.col("unit_index") + 1)).drop("unit_index")


def required_checks(revisions: DataFrame, entities: DataFrame, layers: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """(key, check, status, n_bad) of the eight required checks of every revision: pass, review or fail.

    revisions: key, unit, coordinate_system. entities: key, kind, points, closed, block_ref, scale_x, scale_y, layer_ref, provenance. layers:
    key, layer_ref. references: key, resolved (false for an external file that wasn't found). A revision without entities passes what counts them.

    units: fail where none is declared, review where it is ``unitless``. coordinate_system: review where none is known.
    geometry: fail where a point isn't finite or a line has one. closed_polylines: review where a closed line has no area.
    block_transforms: fail where a placed block's scale is zero or missing. layer_mapping: fail where a layer isn't defined.
    external_references: review where one is unresolved. provenance: review where an entity has none.
    """
    numbers = F.forall("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    lined = F.col("kind").isin("line", "polyline")
    yes = lambda c: F.coalesce(c, F.lit(False))
    flat = yes(F.col("closed")) & yes(numbers) & (F.abs(ring_area(F.col("points"))) == 0)
    defined = layers.select(key, "layer_ref", F.lit(True).alias("__defined")).distinct()
    counted = entities.join(defined, [key, "layer_ref"], "left").groupBy(key).agg(
        F.count_if(lined & (~yes(numbers) | (F.coalesce(F.size("points"), F.lit(0)) < 2))).alias("geometry"), F.count_if(flat).alias("closed_polylines"),
        F.count_if(F.col("block_ref").isNotNull() & (F.coalesce(F.col("scale_x") * F.col("scale_y"), F.lit(0.0)) == 0)).alias("block_transforms"),
        F.count_if(F.col("layer_ref").isNotNull() & F.col("__defined").isNull()).alias("layer_mapping"), F.count_if(F.col("provenance").isNull()).alias("provenance"),
    )
    lost = references.groupBy(key).agg(F.count_if(~F.col("resolved").eqNullSafe(True)).alias("external_references"))
    met = revisions.join(counted, key, "left").join(lost, key, "left")
    unit = F.lower(F.trim("unit"))
    no_unit = unit.isNull() | (unit == "")
    zero = F.lit(0).cast("long")
    many = lambda name, bad: (name, F.coalesce(name, zero), bad)
    rows = [
        ("units", F.when(no_unit | (unit == "unitless"), 1).otherwise(0).cast("long"), F.when(no_unit, "fail").otherwise("review")),
        ("coordinate_system", F.when(F.col("coordinate_system").isNull(), 1).otherwise(0).cast("long"), F.lit("review")),
        many("geometry", F.lit("fail")), many("closed_polylines", F.lit("review")), many("block_transforms", F.lit("fail")), many("layer_mapping", F.lit("fail")),
        many("external_references", F.lit("review")), many("provenance", F.lit("review")),
    ]
    said = F.array(*[F.struct(F.lit(name).alias("check"), F.when(n > 0, bad).otherwise("pass").alias("status"), n.alias("n_bad")) for name, n, bad in rows])
    return met.select(key, F.inline(said))


#: Metres in a unit, by priority.
UNIT_METRES = (("mm", 0.001), ("cm", 0.01), ("m", 1.0))


def infer_units(revisions: DataFrame, dimensions: DataFrame, key: str, bands: Sequence[tuple[str, float, float]], sides: Sequence[tuple[str, float, float]]) -> DataFrame:
    """(key, unit, tier, n_votes, contradicted) by two tiers: dimensions vote where a revision has usable ones, else its extent decides.

    revisions: key, declared (metres of the declared unit, or null), width, height. dimensions: key, kind, override, factor. A usable dimension is
    linear with a finite override and factor above zero; it votes for the first unit of ``bands`` whose log10 band holds override / factor, and
    the lower median of the votes wins. Else, of ``sides``, the unit whose band's middle is nearest to log10 of the longer side, in order on
    ties; an extent with a side of zero, or none, is unknown. Declared and inferred units that differ ten times or more contradict.
    """
    usable = dimensions.where((F.col("kind") == "linear") & (F.col("override") > 0) & (F.col("factor") > 0) & (F.col("override") < float("inf")) & (F.col("factor") < float("inf")))
    votes = infer_unit(usable.withColumn("__v", F.col("override") / F.col("factor")), key, "__v", bands).select(key, F.col("unit").alias("voted"), "n_votes")
    log = F.log10(F.greatest("width", "height"))
    near = F.least(*[F.struct(F.abs(log - (low + high) / 2).alias("d"), F.lit(i).alias("i"), F.lit(u).alias("unit")) for i, (u, low, high) in enumerate(sides)])
    by_side = F.when((F.col("width") > 0) & (F.col("height") > 0), near["unit"])
    met = revisions.join(votes, key, "left").withColumn("unit", F.coalesce("voted", by_side))
    metres = F.create_map(*[F.lit(x) for pair in UNIT_METRES for x in pair])[F.col("unit")]
    ratio = F.greatest(F.col("declared") / metres, metres / F.col("declared"))
    tier = F.when(F.col("voted").isNotNull(), "dimensions").when(F.col("unit").isNotNull(), "extent").otherwise("unknown")
    return met.select(key, "unit", tier.alias("tier"), F.coalesce("n_votes", F.lit(0).cast("long")).alias("n_votes"), F.coalesce(ratio >= 10 - 1e-9, F.lit(False)).alias("contradicted"))
