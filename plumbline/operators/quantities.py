"""Quantity takeoff: candidates from geometry and hints, deduplication with conflicts, totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import is_closed, path_length, ring_area


def _payload(columns: Sequence[str]) -> Column:
    """The compared columns as one value in which nulls show."""
    return F.struct(*[F.col(c) for c in columns])


def deduplicate(rows: DataFrame, key: Sequence[str], payload: Sequence[str], order: Sequence[str], row_id: str) -> DataFrame:
    """One row per key: primary_id (lowest in order, then id), n_rows, conflict.

    A key whose rows differ in the payload, a null beside a value included, is a conflict; its group contributes nothing.
    Null keys are a key. Everything combines before the shuffle, so a hot key's copies never meet in one task;
    ``duplicates`` lists them as rows.
    """
    return rows.groupBy(*key).agg(
        F.min_by(F.col(row_id), F.struct(*order, row_id)).alias("primary_id"),
        F.count("*").alias("n_rows"),
        (~F.min(_payload(payload)).eqNullSafe(F.max(_payload(payload)))).alias("conflict"),
    )


def duplicates(rows: DataFrame, found: DataFrame, key: Sequence[str], row_id: str) -> DataFrame:
    """(key, primary_id, duplicate_id): the later rows of each key without a conflict, from ``deduplicate``'s result."""
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in key]
    met = rows.alias("r").join(found.where("n_rows > 1 and not conflict").alias("f"), same)
    met = met.where(F.col(f"r.{row_id}") != F.col("f.primary_id"))
    return met.select(*[F.col(f"r.{k}") for k in key], "f.primary_id", F.col(f"r.{row_id}").alias("duplicate_id"))


def primaries(rows: DataFrame, key: Sequence[str], payload: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The contributing rows: first in order of each key without a conflict.

    Keys are reduced to (first row, smallest and largest payload) before the shuffle, so a hot key's
    copies never meet in one task.
    """
    columns = rows.columns
    best = rows.groupBy(*key).agg(
        F.min_by(F.struct(*columns), F.struct(*order)).alias("__row"), F.min(_payload(payload)).alias("__low"), F.max(_payload(payload)).alias("__high")
    )
    return best.where("__low <=> __high").select("__row.*")


def totals(rows: DataFrame, group: Sequence[str], value: str, scale: int = 9) -> DataFrame:
    """Exact sums, whatever the order of rows: doubles are summed as decimals."""
    return rows.groupBy(*group).agg(
        F.sum(F.col(value).cast(f"decimal(28,{scale})")).alias("total"), F.count("*").alias("n_contributors")
    )


def geometry_candidates(entities: DataFrame, points: str = "points", closed: str = "closed", keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., quantity_type, value): length of open paths; perimeter and area of closed ones; a count for each."""
    p, shut = F.col(points), is_closed(F.col(points), F.col(closed))
    ring = F.when(F.element_at(p, 1) == F.element_at(p, -1), p).otherwise(F.concat(p, F.slice(p, 1, 1)))
    pair = lambda kind, v: F.struct(F.lit(kind).alias("quantity_type"), v.cast("double").alias("value"))
    made = F.when(shut, F.array(pair("perimeter", path_length(ring)), pair("area", F.abs(ring_area(p))), pair("count", F.lit(1.0)))).otherwise(
        F.array(pair("length", path_length(p)), pair("count", F.lit(1.0)))
    )
    return entities.where(F.size(p) >= 2).select(*keep, F.inline(made))


def exclusions(rows: DataFrame, reasons: Sequence[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded with the first reason that holds)."""
    reason = F.lit(None).cast("string")
    for condition, name in reversed(reasons):
        reason = F.when(condition, F.lit(name)).otherwise(reason)
    marked = rows.withColumn("exclusion_reason", reason)
    return marked.where("exclusion_reason is null").drop("exclusion_reason"), marked.where("exclusion_reason is not null")


def hint_fallback(measured: DataFrame, hints: DataFrame, key: Sequence[str], position: str = "position") -> DataFrame:
    """The first strict, non-count hint with a unit of each entity that has no measured quantity."""
    usable = hints.where("strict and quantity_type <> 'count' and unit is not null")
    first = usable.groupBy(*key).agg(F.min_by(F.struct("quantity_type", "value", "unit"), F.col(position)).alias("hint"))
    return first.join(measured.select(*key).distinct(), list(key), "left_anti").select(*key, "hint.*")


def hint_mismatches(measured: DataFrame, hints: DataFrame, key: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Entities whose hint of the same type differs from the measurement by more than the tolerance."""
    both = measured.alias("m").join(hints.alias("h"), [F.col(f"m.{k}") == F.col(f"h.{k}") for k in [*key, "quantity_type"]])
    a, b = F.col("m.value"), F.col("h.value")
    far = F.abs(a - b) > F.greatest(F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))
    return both.where(far).select(*[f"m.{k}" for k in key], "m.quantity_type", a.alias("measured"), b.alias("hinted"))


def takeoff_rows(contributors: DataFrame, aggregates: DataFrame, excluded: DataFrame) -> DataFrame:
    """Contributors, aggregates and exclusions as rows of one table."""
    parts = [df.withColumn("item_kind", F.lit(k)) for df, k in ((contributors, "contributor"), (aggregates, "aggregate"), (excluded, "exclusion"))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def effective_unit(length_unit: Column, unit: Column) -> Column:
    """Lower-case trimmed unit, the length unit first, ``unitless`` by default."""
    clean = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    return F.coalesce(clean(length_unit), clean(unit), F.lit("unitless"))


def first_in_group(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group in order (nulls first), combined before the shuffle; of equal rows any one."""
    best = rows.groupBy(*group).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("__row"))
    return best.select("__row.*")


def engine(entities: DataFrame, hints: DataFrame, group: Sequence[str], good_units: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, contributors, exclusions): the quantities of a revision's entities from geometry and hints.

    entities: group, entity_id, sequence_index, points, closed, unit, source_hash. hints: group, entity_id, quantity_type, value, unit, strict,
    position. An entity's geometry gives its quantities; where it gives none but a count, its first strict hint does. Excluded, with
    the first reason: invalid geometry (a point that isn't finite, fewer than two points and no hint), an unknown unit, a hint that
    contradicts the measurement. Of entities with one hash and equal quantities the first in order contributes; differing ones are a
    conflict and none does.
    """
    one = [*group, "entity_id"]
    finite = F.forall("points", lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    drawn = F.coalesce((F.size("points") >= 2) & finite, F.lit(False))
    carried = [*one, "sequence_index", "unit", "source_hash"]
    made = geometry_candidates(entities.where(drawn), keep=carried)
    measured = made.where("quantity_type <> 'count'")
    hinted = hint_fallback(measured, hints, one).withColumnRenamed("unit", "hint_unit")
    counts = entities.select(*carried, F.lit("count").alias("quantity_type"), F.lit(1.0).alias("value"))
    by_hint = entities.select(*carried).drop("unit").join(hinted, one).select(*one, "sequence_index", F.col("hint_unit").alias("unit"), "source_hash", "quantity_type", "value")
    wrong = hint_mismatches(measured, hints.where("strict"), one).select(*one, "quantity_type", F.lit(True).alias("__wrong")).distinct()
    bare = entities.where(~drawn).join(by_hint.select(*one), one, "left_anti").select(*carried, F.lit(None).cast("string").alias("quantity_type"), F.lit(None).cast("double").alias("value"))
    rows = measured.unionByName(by_hint).unionByName(bare).join(wrong, [*one, "quantity_type"], "left")
    reasons = [(F.col("quantity_type").isNull(), "invalid_geometry"), (~F.coalesce(F.lower(F.trim("unit")).isin(list(good_units)), F.lit(False)), "unknown_unit"), (F.coalesce("__wrong", F.lit(False)), "hint_mismatch")]
    kept, excluded = exclusions(rows, reasons)
    kept = kept.drop("__wrong").unionByName(counts).withColumn("__key", F.coalesce("source_hash", F.concat(F.lit("entity:"), F.col("entity_id").cast("string"))))
    contributors = primaries(kept, [*group, "__key", "quantity_type"], ["value", "unit"], ["sequence_index", "entity_id"]).drop("__key")
    sums = totals(contributors, [*group, "quantity_type", "unit"], "value")
    return sums, contributors, excluded.select(*carried, "quantity_type", "exclusion_reason")
