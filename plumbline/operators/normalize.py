"""Ingest: tolerant payload reading, kinds, units, boxes, classifiers, policies, affine placement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import METRES, first_rule


class UnknownField(ValueError):
    """A requested field that the table doesn't have."""


def finite(x: Column) -> Column:
    """The number, or null where it isn't finite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def json_number(payload: Column, path: str) -> Column:
    """A finite number at a JSON path; booleans and texts that aren't numbers are none."""
    raw = F.get_json_object(payload, path)
    return finite(F.when(~raw.isin("true", "false"), raw.try_cast("double")))


def json_point(payload: Column, path: str) -> Column:
    """A point written as {x, y} or [x, y]."""
    x = F.coalesce(json_number(payload, f"{path}.x"), json_number(payload, f"{path}[0]"))
    y = F.coalesce(json_number(payload, f"{path}.y"), json_number(payload, f"{path}[1]"))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def entity_kind(explicit: Column, start: Column, end: Column, points: Column) -> Column:
    """The named kind, else line with both ends, else polyline with two points."""
    named = F.nullif(F.lower(F.trim(explicit)), F.lit(""))
    return F.coalesce(named, F.when(start.isNotNull() & end.isNotNull(), "line"), F.when(F.size(points) >= 2, "polyline"))


def entity_box(points: Column, centre: Column | None = None, radius: Column | None = None) -> Column:
    """Bounding box of points and, where given, a circle; null without any."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    if centre is not None:
        round_ = lambda c: F.when(centre.isNotNull() & radius.isNotNull(), F.array(centre[c] - radius, centre[c] + radius)).otherwise(F.array().cast("array<double>"))
        xs, ys = F.concat(F.coalesce(xs, F.array().cast("array<double>")), round_("x")), F.concat(F.coalesce(ys, F.array().cast("array<double>")), round_("y"))
    box = F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))
    return F.when(F.size(xs) > 0, box)


def select_fields(df: DataFrame, spine: Sequence[str], fields: Sequence[str] = ()) -> DataFrame:
    """The compact columns and the asked-for ones; a field that doesn't exist is an error."""
    unknown = [f for f in fields if f not in df.columns]
    if unknown:
        raise UnknownField(", ".join(unknown))
    return df.select(*dict.fromkeys([*spine, *fields]))


def equal_filters(df: DataFrame, on_sheet: bool | None = None, **values) -> DataFrame:
    """Rows equal in all given columns; asking for on_sheet leaves out undetermined rows."""
    for column, value in values.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df if on_sheet is None else df.where(F.col("on_sheet") == on_sheet)


#: Tokens of layer names.
WALL_TOKENS = ("wall", "partition")
ROOM_TOKENS = ("room", "space", "area-bound")


def has_token(column: Column, tokens: Sequence[str]) -> Column:
    return F.lower(column).rlike("|".join(tokens))


def measured_length(length: Column, factor: Column, available: Column, contradicted: Column) -> Column:
    """(real_length_m, basis): metres only where a usable factor isn't contradicted; bad lengths count as zero."""
    good = F.coalesce(F.when(finite(length) >= 0, length), F.lit(0.0))
    usable = available & ~contradicted & (finite(factor) > 0)
    return F.struct(F.when(usable, good * factor).alias("real_length_m"), good.alias("drawing_length"), F.when(usable, "metres").otherwise("drawing_units").alias("basis"))


def unit_confidence(declared: Column, inferred: Column) -> Column:
    """confirmed, contradicted, declared, inferred or unknown, from a declared and an inferred unit."""
    return (
        F.when(declared.isNotNull() & inferred.isNotNull(), F.when(declared == inferred, "confirmed").otherwise("contradicted"))
        .when(declared.isNotNull(), "declared")
        .when(inferred.isNotNull(), "inferred")
        .otherwise("unknown")
    )


def valid_polygon(points: Column, least: int = 3) -> Column:
    """Enough finite points and an area."""
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    doubled = F.aggregate(F.zip_with(points, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)
    numbers = F.forall(points, lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    return F.coalesce((F.size(points) >= least) & numbers & (doubled != 0), F.lit(False))


def review_policy(placeholder: Column, confidence: Column, threshold: float = 0.6) -> Column:
    """review_required for placeholder semantics or low confidence."""
    return F.when(F.coalesce(placeholder, F.lit(False)), "review_required").when(confidence.isNull() | (confidence < threshold), "review_required").otherwise("accepted")


def device_category(name: Column) -> Column:
    """Ordered substring rules; a distribution board is named before a switch."""
    n = F.lower(name)
    return first_rule([(n.contains("distribution"), "board"), (n.contains("switch"), "switch"), (n.contains("socket"), "socket"), (n.rlike("lumin|light"), "luminaire")], "other")


def affine(points: Column, sx: Column, sy: Column, degrees: Column, dx: Column, dy: Column) -> Column:
    """Points scaled, rotated and moved."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return F.transform(points, lambda p: F.struct((p["x"] * sx * c - p["y"] * sy * s + dx).alias("x"), (p["x"] * sx * s + p["y"] * sy * c + dy).alias("y")))


def provenance(fields: Column, least: int) -> Column:
    """(status, canonical) of an entity's provenance number: missing, invalid below ``least``, else valid with its canonical text."""
    status = F.when(fields.isNull(), "missing").when(fields < least, "invalid").otherwise("valid")
    return F.struct(status.alias("status"), F.when(fields >= least, F.concat(F.lit("k:"), fields.cast("string"))).alias("canonical"))


def by_key(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the asked ones, each once per row of df; unknown keys give none."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def annotation_zones(labels: DataFrame, anchor: str, pad: float, group: Sequence[str]) -> DataFrame:
    """Padded boxes around labels whose text matches the anchor pattern, numbered in id order."""
    hit = labels.where(F.col("text").rlike(anchor))
    box = F.struct((F.col("x") - pad).alias("min_x"), (F.col("y") - pad).alias("min_y"), (F.col("x") + pad).alias("max_x"), (F.col("y") + pad).alias("max_y"))
    return hit.select(*group, F.col("label_id").alias("zone_id"), box.alias("box"))


def slim_document(df: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Bulk arrays replaced by their counts."""
    return df.select(*[F.size(c).alias(f"{c}_count") if c in arrays else F.col(c) for c in df.columns])


def lineage_mismatches(inputs: DataFrame, parents: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Inputs with the first parent column that disagrees, or missing_parent."""
    p = parents.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    met = inputs.join(p, inputs[key] == p["__k"], "left")
    reason = F.when(F.col("__k").isNull(), "missing_parent")
    for c in columns:
        reason = reason.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), f"{c}_mismatch")
    return met.withColumn("problem", reason).where("problem is not null").select(*inputs.columns, "problem")


def unit_table(spark) -> DataFrame:
    """(unit, metres)."""
    return spark.createDataFrame(sorted(METRES.items()), "unit string, metres double")


def parameter_stamp(parameters: dict) -> Column:
    """Fingerprint of tuning constants, plain or columns: SHA-256 of their sorted text."""
    shown = [F.concat(F.lit(f"{k}="), v if isinstance(v, Column) else F.lit(str(v))) for k, v in sorted(parameters.items())]
    return F.sha2(F.concat_ws("|", *shown), 256)
