"""Reports and compositions: census, lineage documents, new revisions, floor takeoff."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import spatial, takeoff


def census(rows: DataFrame, key: str, kind: str, supported: Sequence[str], dropped: Column) -> DataFrame:
    """Dropped rows, rows of unsupported kinds and completeness of each key."""
    out = rows.groupBy(key).agg(F.count_if(dropped).alias("n_dropped"), F.count_if(~F.col(kind).isin(list(supported))).alias("n_unsupported"), F.count("*").alias("n_rows"))
    return out.withColumn("complete", (F.col("n_dropped") == 0) & (F.col("n_unsupported") == 0))


def fingerprint(entities: DataFrame, group: str, layer: str, nested: Column, instance: Column) -> DataFrame:
    """Distinct layers, nested rows and instances; informational."""
    return entities.groupBy(group).agg(F.count_distinct(layer).alias("n_layers"), F.count_if(nested).alias("n_nested"), F.count_if(instance).alias("n_instances"))


def sub_documents(revisions: DataFrame, documents: DataFrame, key: str, column: str) -> DataFrame:
    """Each revision's sub-document, with available false where there is none."""
    found = documents.select(key, F.col(column))
    return revisions.select(key).join(found, key, "left").withColumn("available", F.col(column).isNotNull())


def lineage_documents(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One JSON text of lineage fields per row, fields in name order."""
    return rows.select(key, F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).alias("lineage"))


def next_revision(entities: DataFrame, effects: DataFrame, key: str, layer: str) -> DataFrame:
    """Rows after a changeset: survivors with their new layer, without removed rows, with added ones."""
    e = effects.select(F.col(key), F.col(layer).alias("__new"), "effect")
    met = entities.join(e, key, "left").where(F.col("effect").isNull() | (F.col("effect") != "removed"))
    kept = met.withColumn(layer, F.when(F.col("effect") == "changed", F.col("__new")).otherwise(F.col(layer))).select(key, layer)
    added = effects.where("effect = 'added'").join(entities.select(key), key, "left_anti").select(key, layer)
    return kept.union(added)


def existence_findings(operations: DataFrame, op_id: str, lookups: Mapping[str, tuple[str, DataFrame, str]]) -> DataFrame:
    """(op_id, code) for each reference that has no row: code -> (column, table, its key)."""
    out = None
    for code, (column, known, key) in lookups.items():
        rows = operations.where(F.col(column).isNotNull()).join(known.select(F.col(key).alias("__k")).distinct(), F.col(column) == F.col("__k"), "left_anti")
        rows = rows.select(op_id, F.lit(code).alias("code"))
        out = rows if out is None else out.union(rows)
    return out


def bind_inputs(formulas: DataFrame, snapshot: DataFrame, formula_id: str, inputs: str) -> DataFrame:
    """(formula, input_name, entry_key, status) of a map of input names to entry keys: bound or missing."""
    listed = formulas.select(formula_id, F.explode(inputs).alias("input_name", "entry_key"))
    known = snapshot.select(F.col("entry_key").alias("__k")).distinct()
    met = listed.join(known, F.col("entry_key") == F.col("__k"), "left")
    return met.select(formula_id, "input_name", "entry_key", F.when(F.col("__k").isNull(), "missing").otherwise("bound").alias("status"))


def floor_takeoff(
    source_labels: DataFrame, target_labels: DataFrame, devices: DataFrame, lengths: DataFrame, rooms: DataFrame, sheet: str, cell: float
) -> DataFrame:
    """(room_id, measured, counted, estimated) of a floor of several sheets.

    Sheets register by their labels; sheets that fail are left out. Devices (device_id, x, y, drop) and length
    midpoints (length_id, x, y, length) move into the target frame and go to the smallest room that holds
    them; what no room holds is the null row. Rooms have room_id, ring and area.
    """
    frames = takeoff.register_sheets(source_labels, target_labels, sheet).where("quality <> 'failed'")
    placed = {
        name: spatial.smallest_room(takeoff.shifted(df, frames, sheet), rooms, cell, key)
        for name, df, key in (("devices", devices, "device_id"), ("lengths", lengths, "length_id"))
    }
    measured = placed["lengths"].select("room_id", F.col("length").alias("value"))
    counted = placed["devices"].select("room_id", F.lit(1).alias("value"))
    estimated = placed["devices"].select("room_id", F.col("drop").alias("value"))
    return takeoff.room_totals(measured, counted, estimated, "room_id")
