"""Keyed diffs of two revisions, and copy-on-write application of changesets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.changes import apply_sets

def _side(rows: DataFrame, key: str, digest: str, order: str) -> DataFrame:
    """One row per non-null key; of repeated keys the last in order."""
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max_by(F.col(digest), F.col(order)).alias("digest"))


def keyed_diff(base: DataFrame, other: DataFrame, key: str, digest: str, order: str) -> DataFrame:
    """(key, change): added, removed, changed (digests differ) or unchanged."""
    b, o = (_side(x, key, digest, order).withColumn("here", F.lit(True)) for x in (base, other))
    met = b.alias("b").join(o.alias("o"), F.col("b.key") == F.col("o.key"), "full_outer")
    change = (
        F.when(F.col("b.here").isNull(), "added")
        .when(F.col("o.here").isNull(), "removed")
        .when(F.col("b.digest").eqNullSafe(F.col("o.digest")), "unchanged")
        .otherwise("changed")
    )
    return met.select(F.coalesce("b.key", "o.key").alias("key"), change.alias("change"))


def unkeyed_counts(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows without a key on either side; they can't be diffed and are counted apart."""
    n = lambda df, name: df.agg(F.count_if(F.col(key).isNull()).alias(name))
    return n(base, "base_unkeyed").crossJoin(n(other, "other_unkeyed"))


def set_differences(base: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """Values on one side only: (value, side added or removed)."""
    b, o = base.select(F.col(column).alias("value")), other.select(F.col(column).alias("value"))
    return o.exceptAll(b).distinct().join(b, "value", "left_anti").withColumn("side", F.lit("added")).union(
        b.exceptAll(o).distinct().join(o, "value", "left_anti").withColumn("side", F.lit("removed"))
    )


def count_deltas(base: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """(value, base_count, other_count, delta) over the values of both sides."""
    marked = base.select(F.col(column).alias("value"), F.lit(0).alias("side")).union(other.select(F.col(column).alias("value"), F.lit(1).alias("side")))
    counts = marked.groupBy("value").agg(F.count_if(F.col("side") == 0).alias("base_count"), F.count_if(F.col("side") == 1).alias("other_count"))
    return counts.withColumn("delta", F.col("other_count") - F.col("base_count"))


def resolve_targets(operations: DataFrame, entities: DataFrame, op_id: str, target: str, identity: str) -> DataFrame:
    """(operation columns, row_id, status): resolved, not_found or ambiguous, by number of matching entities."""
    found = entities.groupBy(F.col(identity).alias("__t")).agg(F.count("*").alias("__n"), F.min("entity_id").alias("__row"))
    met = operations.join(found, operations[target] == found["__t"], "left")
    status = F.when(F.col("__n").isNull(), "not_found").when(F.col("__n") > 1, "ambiguous").otherwise("resolved")
    return met.withColumn("row_id", F.when(status == "resolved", F.col("__row"))).withColumn("status", status).drop("__t", "__n", "__row")


def apply_changesets(entities: DataFrame, operations: DataFrame, set_id: str, key: str, layer: str) -> DataFrame:
    """(set, entity, version, layer, effect) of ``changes.apply_sets`` for operations without properties.

    Operations have ``operation_type``, ``value`` and ``sequence_index``; they are replayed in order, and a set with one that
    fails where it stands aborts whole.
    """
    named = operations.select(F.col(set_id).alias("set_id"), F.col(key).alias("entity"), "operation_type", "value", "sequence_index", F.lit(None).cast("string").alias("property"))
    found = apply_sets(entities.select(F.col(key).alias("entity"), F.col(layer).alias("layer")), named)
    return found.select(F.col("set_id").alias(set_id), F.col("entity").alias(key), "version", F.col("layer").alias(layer), "effect")


def stale_sets(sets: DataFrame, current: DataFrame) -> DataFrame:
    """Changesets whose base revision is no longer the current one."""
    met = sets.join(current.select("file_id", F.col("revision_id").alias("current_revision")), "file_id")
    return met.where(~F.col("base_revision").eqNullSafe(F.col("current_revision")))


def set_status(findings: DataFrame, set_id: str) -> DataFrame:
    """Status of a set by its worst finding: invalid, needs_review, valid_with_warnings, valid."""
    rank = F.when(F.col("severity") == "error", 3).when(F.col("severity") == "review", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    worst = F.element_at(F.array(*map(F.lit, ("valid", "valid_with_warnings", "needs_review", "invalid"))), F.max(rank) + 1)
    return findings.groupBy(set_id).agg(worst.alias("status"))


def latest_valid(validations: DataFrame, set_id: str, at: str, order: Sequence[str]) -> DataFrame:
    """The newest validation of each set."""
    best = F.max_by(F.struct(*validations.columns), F.struct(at, *order))
    return validations.groupBy(set_id).agg(best.alias("__v")).select("__v.*")


def resequenced(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], into: str = "sequence_index") -> DataFrame:
    """Sequence numbers 0..n-1 in order."""
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
