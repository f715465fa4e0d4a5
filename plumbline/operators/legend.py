"""Legends: colour and pattern lookups, tolerant hues, fusion of several sources, device typing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import achromatic, hue, hue_distance
from plumbline.operators.spatial import nearest_within


def lookup(rows: DataFrame, legend: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Left equi lookup; ``matched`` tells a hit with a null value from a miss."""
    known = legend.select(*key, value, F.lit(True).alias("__hit"))
    met = rows.join(known, list(key), "left")
    return met.withColumn("matched", F.coalesce("__hit", F.lit(False))).drop("__hit")


def hue_lookup(rows: DataFrame, legend: DataFrame, row_id: str, colour: str, service: str, tolerance: float = 22.0, margin: float = 8.0) -> DataFrame:
    """(row_id, service, basis): the same colour first; else the nearest hue within tolerance whose lead over
    the next service is at least margin; grey colours resolve exactly only.

    Colours are resolved once each, whatever the number of rows. Hues fall into bins as wide as the tolerance; a
    colour meets the three bins around its own.
    """
    bins = max(1, int(360 // (tolerance + margin)))
    width = 360.0 / bins
    exact = legend.groupBy(colour).agg(F.min(service).alias("__exact"))
    listed = legend.where(~achromatic(F.col(colour))).select(hue(F.col(colour)).alias("__h"), F.col(service).alias("__s")).distinct()
    listed = listed.withColumn("__bin", F.floor(F.col("__h") / width) % bins)
    own = rows.select(colour).distinct().join(exact, colour, "left")
    loose = own.where(F.col("__exact").isNull() & ~achromatic(F.col(colour))).withColumn("__own", hue(F.col(colour)))
    around = F.explode(F.array_distinct(F.array(*[F.pmod(F.floor(F.col("__own") / width) + d, F.lit(bins)) for d in (-1, 0, 1)])))
    met = loose.withColumn("__bin", around).join(listed, "__bin").withColumn("__d", hue_distance(F.col("__own"), F.col("__h")))
    per = met.groupBy(colour, "__s").agg(F.min("__d").alias("__d"))
    w = Window.partitionBy(colour).orderBy("__d", "__s")
    near = per.withColumn("__n", F.row_number().over(w)).withColumn("__next", F.lead("__d").over(w)).where("__n = 1")
    near = near.where((F.col("__d") <= tolerance) & (F.col("__next").isNull() | (F.col("__next") - F.col("__d") >= margin)))
    joined = rows.select(row_id, colour).join(own.join(near.select(colour, "__s"), colour, "left"), colour, "left")
    basis = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__s").isNotNull(), "hue").otherwise("unresolved")
    return joined.select(row_id, F.coalesce("__exact", "__s").alias(service), basis.alias("basis"))


def fuse(entries: DataFrame, key: Sequence[str], label: str, text: str, source: str) -> DataFrame:
    """One row per key: primary = first label in order, competing = the rest, sources and joined descriptions."""
    labels = F.array_sort(F.collect_set(label))
    out = entries.groupBy(*key).agg(
        labels.alias("__l"), F.array_sort(F.collect_set(source)).alias("sources"), F.array_join(F.array_sort(F.collect_set(text)), "; ").alias("description")
    )
    return out.withColumn("primary", F.get("__l", F.lit(0))).withColumn("competing", F.slice("__l", 2, F.greatest(F.size("__l"), F.lit(1)))).drop("__l")


def typed_devices(devices: DataFrame, families: DataFrame, tags: DataFrame) -> DataFrame:
    """Device type by family, else by tag; what neither names stays with a null type, nothing is dropped."""
    by_family = families.groupBy("family").agg(F.min("device_type").alias("__f"))
    by_tag = tags.groupBy("tag").agg(F.min("device_type").alias("__t"))
    met = devices.join(by_family, "family", "left").join(by_tag, "tag", "left")
    basis = F.when(F.col("__f").isNotNull(), "family").when(F.col("__t").isNotNull(), "tag").otherwise("unresolved")
    return met.withColumn("device_type", F.coalesce("__f", "__t")).withColumn("basis", basis).drop("__f", "__t")


def attach_single_claims(loose: DataFrame, families: DataFrame, key: str, family: str) -> DataFrame:
    """Rows attached to a family only where exactly one family claims their key."""
    claims = families.groupBy(key).agg(F.count_distinct(family).alias("__n"), F.min(family).alias("__f"))
    return loose.join(claims, key, "left").withColumn(family, F.when(F.col("__n") == 1, F.col("__f"))).drop("__n", "__f")


def link_references(rows: DataFrame, collection: DataFrame, reference: str, identities: str, target: str, order: str) -> DataFrame:
    """Rows with the collection row any of whose identities is their reference; the first in sequence wins."""
    listed = collection.select(F.explode(identities).alias("__i"), target, order).groupBy("__i").agg(F.min_by(target, order).alias(f"linked_{target}"))
    return rows.join(listed, rows[reference] == listed["__i"], "left").drop("__i")


def schedule(devices: DataFrame, group: Sequence[str], name: str, last: Column | None = None) -> DataFrame:
    """Counts by name with a rank: most first, then by name; names for which ``last`` holds come after all others."""
    counts = devices.groupBy(*group, name).agg(F.count("*").alias("n"))
    order = [*([last.cast("int")] if last is not None else []), F.desc("n"), F.asc(name)]
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def fused_dictionary(families: DataFrame, prose: DataFrame, schedules: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, family, abbreviation, device_type, authority, conflict) of legend entries from three sources.

    families: family, device_type (the legend's symbols); prose: abbreviation, device_type (its lines); schedules: family, abbreviation. A
    family's type is its own (``family``). An abbreviation joins a family where a schedule names both and only one family claims it, and
    takes its type there, else its own line's (``tag``). Where both have a type and they differ, the family's holds and ``conflict`` is true.
    """
    own = families.groupBy(*group, "family").agg(F.min("device_type").alias("__f"))
    lines = prose.groupBy(*group, "abbreviation").agg(F.min("device_type").alias("__t"))
    claims = schedules.groupBy(*group, "abbreviation").agg(F.min("family").alias("family"), F.count_distinct("family").alias("__n"))
    claims = claims.select(*group, "abbreviation", F.when(F.col("__n") == 1, F.col("family")).alias("family"))
    tags = lines.join(claims, [*group, "abbreviation"], "full_outer")
    met = own.join(tags, [*group, "family"], "full_outer")
    kind = F.coalesce("__f", "__t")
    authority = F.when(F.col("__f").isNotNull(), "family").when(F.col("__t").isNotNull(), "tag")
    conflict = F.coalesce(F.col("__f") != F.col("__t"), F.lit(False))
    return met.select(*group, "family", "abbreviation", kind.alias("device_type"), authority.alias("authority"), conflict.alias("conflict"))


def nearest_swatches(texts: DataFrame, swatches: DataFrame, anchor: str, reach: float, radius: float, group: Sequence[str] = ()) -> DataFrame:
    """(group, text_id, text, swatch_id): texts in the legend's region with the nearest swatch within the radius.

    The region is the box around the texts that match the anchor pattern, grown by ``reach``; texts outside it, and the anchors, are left
    out. A group without an anchor has no region.
    """
    hit = F.col("text").rlike(anchor)
    box = texts.where(hit).groupBy(*group).agg(*[f(a).alias(f"__{n}_{a}") for a in "xy" for n, f in (("min", F.min), ("max", F.max))])
    inside = F.lit(True)
    for a in "xy":
        inside &= F.col(a).between(F.col(f"__min_{a}") - reach, F.col(f"__max_{a}") + reach)
    held = texts.where(~hit).join(box, list(group)).where(inside).select(*group, "text_id", "text", "x", "y")
    return nearest_within(held, swatches.select(*group, "swatch_id", "x", "y"), radius, "text_id", ["swatch_id"], ["swatch_id"], group).select(*group, "text_id", "text", "swatch_id")


def tagged_devices(devices: DataFrame, tags: DataFrame, families: DataFrame, known_tags: DataFrame, radius: float, group: Sequence[str] = ()) -> DataFrame:
    """(group, device_id, block, tag, device_type, basis) of enumerated devices (device_id, block, x, y).

    A device's tag is the nearest text (tag_id, text, x, y) within the radius, its type that of its block's family, else of its tag.
    """
    near = nearest_within(devices, tags.select(*group, "tag_id", F.col("text").alias("tag"), "x", "y"), radius, "device_id", ["tag_id"], ["tag"], group)
    shaped = near.select(*group, "device_id", "block", F.upper(F.trim("tag")).alias("tag")).withColumn("family", F.col("block"))
    return typed_devices(shaped, families, known_tags).select(*group, "device_id", "block", "tag", "device_type", "basis")
