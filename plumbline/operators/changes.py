"""Changesets with properties and annotations, and validation of their operations.

Operations have set_id, sequence_index, operation_type, entity (their target), value and property (a path); entities have
entity, layer and properties, a map of texts. Sets are independent of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.tables import dealt

#: The operations that can be applied, and those that are only reviewed; the property paths that may be written.
APPLIED = ("change_layer", "update_property", "add_entity", "remove_entity", "annotate_entity", "flag_for_review")
REVIEWED = ("replace_block", "replace_profile_material_candidate")
PROPERTIES = ("description", "label", "mark", "notes", "review_status", "metadata")
LAYER_KEYS = ("layer_ref", "layer", "layer_name", "new_layer")


def property_key(path: Column) -> Column:
    """The property that a path names, with or without ``properties.`` before it; null for one that mustn't be written."""
    key = F.regexp_replace(F.trim(path), "^properties[.]", "")
    return F.when(key.isin(*PROPERTIES), key)


def synced(properties: Column, edits: Column) -> Column:
    """A map in which the keys that it has already take the edits' values; the edits' other keys are left out."""
    return F.transform_values(properties, lambda k, v: F.coalesce(F.element_at(edits, k), v))


def synced_layer(properties: Column, layer: Column) -> Column:
    """A map in which every alias of the layer that it has says the new layer."""
    return F.transform_values(properties, lambda k, v: F.when(k.isin(*LAYER_KEYS) & layer.isNotNull(), layer).otherwise(v))


def replayed(operations: DataFrame, entities: DataFrame) -> DataFrame:
    """The operations, in order of ``sequence_index`` on each entity of a set, with what stands there when they act.

    Adds ``version`` (how often the set has added the entity so far; 0 is the base's), ``base_rows`` (base entities of that name),
    ``base_layer``, ``base_properties`` of version 0, ``exists`` (before the operation) and ``gone`` (a removal took it). The state of an
    entity is what its last addition or removal before says, else the base; each step reads it from a running window, so that no
    list of a set's operations is built. A removal of what isn't there counts as one.
    """
    n = max(operations.count(), entities.count())
    op, o = F.col("operation_type"), dealt(operations, n, "set_id", "entity")
    w = Window.partitionBy("set_id", "entity").orderBy("sequence_index")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    kind = F.when(op == "add_entity", 1).when(op == "remove_entity", 0)
    o = o.withColumn("__kind", kind).withColumn("__last", F.last("__kind", ignorenulls=True).over(before))
    o = o.withColumn("version", F.coalesce(F.sum("__kind").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).cast("int"))
    has = "properties" in entities.columns
    none = F.lit(None).cast("map<string,string>")
    base = dealt(entities, n, "entity").groupBy("entity").agg(F.count("*").alias("base_rows"), F.min("layer").alias("__layer"), (F.first("properties") if has else F.first(none)).alias("__properties"))
    met = dealt(o, n, "entity").join(base.hint("merge"), "entity", "left").withColumn("base_rows", F.coalesce("base_rows", F.lit(0)))
    own = F.col("version") == 0
    return met.select(
        *operations.columns, "version", "base_rows", F.when(own, F.col("__layer")).alias("base_layer"), F.when(own, F.col("__properties")).alias("base_properties"),
        F.coalesce(F.col("__last") == 1, F.col("base_rows") > 0).alias("exists"), F.coalesce(F.col("__last") == 0, F.lit(False)).alias("gone"),
    )


def _blank() -> Column:
    return F.col("value").isNull() | (F.trim("value") == "")


def _errors(blocks: bool) -> list[tuple[str, Column]]:
    """The errors of replayed operations by code, in order."""
    op, adds = F.col("operation_type"), F.col("operation_type") == "add_entity"
    typed, named = op.isin(*APPLIED, *REVIEWED), F.col("entity").isNotNull()
    missing = op.isin("change_layer", "annotate_entity", "replace_block") & _blank() | (op == "update_property") & F.col("value").isNull()
    rules = [
        ("unknown_operation", ~typed), ("missing_target", typed & ~named), ("target_not_found", typed & named & ~adds & ~F.col("exists") & ~F.col("gone")),
        ("target_ambiguous", typed & ~adds & (F.col("base_rows") > 1)), ("target_removed_earlier", typed & ~adds & F.col("gone")), ("duplicate_entity", adds & F.col("exists")),
        ("missing_value", missing), ("invalid_property", (op == "update_property") & property_key(F.col("property")).isNull()),
    ]
    return rules + ([("unknown_block", (op == "replace_block") & ~_blank() & F.col("__is_block").isNull())] if blocks else [])


def findings(operations: DataFrame, entities: DataFrame, layers: DataFrame, blocks: DataFrame) -> DataFrame:
    """(set_id, sequence_index, code, severity) of every rule that an operation breaks.

    Errors: ``unknown_operation``, ``missing_target``, ``target_not_found``, ``target_ambiguous``, ``target_removed_earlier`` (by the same set),
    ``duplicate_entity``, ``missing_value``, ``invalid_property``, ``unknown_block``. Warnings: ``unknown_layer``, ``layer_unchanged``. Reviews:
    ``flagged``, ``review_only``. ``apply_sets`` refuses exactly the sets with an error or a ``review_only``.
    """
    op = F.col("operation_type")
    o = replayed(operations, entities)
    o = o.join(layers.select(F.col("layer").alias("value"), F.lit(True).alias("__is_layer")).distinct(), "value", "left")
    o = o.join(blocks.select(F.col("block").alias("value"), F.lit(True).alias("__is_block")).distinct(), "value", "left")
    rules = [(code, "error", holds) for code, holds in _errors(True)] + [
        ("unknown_layer", "warning", (op == "change_layer") & ~_blank() & F.col("__is_layer").isNull()),
        ("layer_unchanged", "warning", (op == "change_layer") & (F.col("value") == F.col("base_layer"))), ("flagged", "review", op == "flag_for_review"), ("review_only", "review", op.isin(*REVIEWED)),
    ]
    said = F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, holds in rules]))
    return o.select("set_id", "sequence_index", F.inline(said))


def apply_sets(entities: DataFrame, operations: DataFrame) -> DataFrame:
    """(set_id, entity, version, layer, properties, annotations, flags, effect) of the entities that each set touches, operations replayed in order.

    A set with an operation that fails where it stands (its target isn't there, was removed before or is ambiguous, an addition of what
    exists, an unknown operation or property, a missing value, one that is only reviewed) aborts whole and returns nothing. What
    a set adds after it removed it is a new version beside the removed one. Layers and properties are those of the last
    operations, aliases of the layer follow it, annotations and flags (their values) stay in order. Effects: ``removed``, ``added``,
    ``changed`` (an operation changed the layer, though a later one may have changed it back), ``metadata_only`` (a property changed, an
    annotation or flag), ``unchanged``.
    """
    op = F.col("operation_type")
    o = replayed(operations, entities)
    fails = op.isin(*REVIEWED)
    for _, holds in _errors(False):
        fails = fails | F.coalesce(holds, F.lit(False))
    o = o.withColumn("__fails", F.coalesce(fails, F.lit(True))).withColumn("__key", F.when(op == "update_property", property_key(F.col("property"))))
    m = operations.count()
    valid = dealt(o, m, "set_id").join(dealt(o.where("__fails").select("set_id").distinct(), m, "set_id").hint("merge"), "set_id", "left_anti")
    one, n, layered = ["set_id", "entity", "version"], F.col("sequence_index"), op.isin("change_layer", "add_entity")
    past = Window.partitionBy(*one).orderBy("sequence_index").rowsBetween(Window.unboundedPreceding, -1)
    old = F.coalesce("base_properties", F.create_map().cast("map<string,string>"))
    said = F.coalesce(F.last(F.when(layered, F.col("value")), ignorenulls=True).over(past), F.col("base_layer"))
    stale = (F.count(F.when(layered, 1)).over(past) == 0) & F.exists(F.map_entries(old), lambda e: e["key"].isin(*LAYER_KEYS) & ~e["value"].eqNullSafe(F.col("value")))
    steps = valid.withColumn("__moved", (op == "change_layer") & (~F.col("value").eqNullSafe(said) | stale))
    of_key = Window.partitionBy(*one, "__key").orderBy("sequence_index")
    steps = steps.withColumn("__was", F.when(F.row_number().over(of_key) == 1, F.try_element_at(old, F.col("__key"))).otherwise(F.lag("value").over(of_key)))
    edits = steps.where("__key is not null").groupBy(*one, "__key").agg(F.max_by("value", n).alias("v"), F.max((~F.col("value").eqNullSafe(F.col("__was"))).cast("int")).alias("m"))
    edits = edits.groupBy(*one).agg(F.map_from_entries(F.collect_list(F.struct("__key", "v"))).alias("edits"), F.max("m").alias("edited"))
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(op == kind, F.struct(n.alias("n"), F.col("value").alias("value"))))), lambda x: x["value"])
    folded = steps.groupBy(*one).agg(
        F.max((op == "remove_entity").cast("int")).alias("removed"), F.max("__moved").alias("moved"), F.max_by(F.when(layered, F.col("value")), F.when(layered, n)).alias("new_layer"),
        F.max(op.isin("annotate_entity", "flag_for_review").cast("int")).alias("noted"), listed("annotate_entity").alias("annotations"), listed("flag_for_review").alias("flags"),
        F.max("base_layer").alias("base_layer"), F.first("base_properties").alias("base_properties"), F.max((op == "change_layer").cast("int")).alias("relayered"),
    )
    met = folded.join(edits, one, "left")
    none = F.create_map().cast("map<string,string>")
    effect = (
        F.when(F.col("removed") == 1, "removed").when(F.col("version") > 0, "added").when(F.col("moved"), "changed")
        .when((F.col("noted") == 1) | (F.col("edited") == 1), "metadata_only").otherwise("unchanged")
    )
    new = F.coalesce("edits", none)
    kept = F.map_filter(F.coalesce("base_properties", none), lambda k, v: ~F.map_contains_key(new, k))
    layer = F.coalesce("new_layer", "base_layer")
    merged = synced_layer(F.map_concat(kept, new), F.when(F.col("relayered") == 1, F.col("new_layer")))
    return met.select(*one, layer.alias("layer"), merged.alias("properties"), "annotations", "flags", effect.alias("effect"))
