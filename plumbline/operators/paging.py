"""Keyset and offset pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.tables import written

DEFAULT_PAGE, MAX_PAGE = 50, 200
#: Levels whose union is one plan; then they are written as one table.
PLAN_STEPS = 16


def after(keys: Sequence[str], values: Sequence, descending: bool = False) -> Column:
    """Rows that come after the values in the order of the keys."""
    beyond = lambda k, v: F.col(k) < v if descending else F.col(k) > v
    steps = []
    for i, k in enumerate(keys):
        same = [F.col(p) == F.lit(v) for p, v in zip(keys[:i], values[:i], strict=True)]
        steps.append(reduce(Column.__and__, [*same, beyond(k, F.lit(values[i]))]))
    return reduce(Column.__or__, steps)


def keyset_page(rows: DataFrame, keys: Sequence[str], cursor: Sequence | None = None, limit: int = DEFAULT_PAGE, descending: bool = False) -> DataFrame:
    """Up to limit + 1 rows after the cursor; the extra row says that there is a next page."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be 1 to {MAX_PAGE}")
    if cursor is not None:
        rows = rows.where(after(keys, cursor, descending))
    return rows.orderBy(*[F.desc(k) if descending else F.asc(k) for k in keys]).limit(limit + 1)


def offset_page(rows: DataFrame, keys: Sequence[str], offset: int, limit: int = DEFAULT_PAGE) -> DataFrame:
    """Up to limit rows after the first ``offset`` in the order of the keys (nulls first)."""
    return rows.orderBy(*keys).offset(offset).limit(limit)


def dependency_depth(rows: DataFrame, key: str, parent: str, max_depth: int | None = None) -> DataFrame:
    """Rows with depth below their root; rows on or below a cycle, or with an absent parent, have none.

    One join per level, each level written, until no row is left at the next one; a key's first level counts.
    Rows deeper than ``max_depth``, where it is given, are an error.
    """
    level, _ = written(rows.where(F.col(parent).isNull()).select(key).distinct().withColumn("depth", F.lit(0)), "level")
    found, depth = level, 0
    while True:
        depth += 1
        level = rows.join(level.select(F.col(key).alias("__p")), F.col(parent) == F.col("__p")).select(key).distinct().withColumn("depth", F.lit(depth))
        level, _ = written(level.join(found.select(key), key, "left_anti"), "level")
        if level.isEmpty():
            break
        if max_depth is not None and depth > max_depth:
            raise RuntimeError(f"rows are deeper than {max_depth} levels")
        found = found.union(level)
        if depth % PLAN_STEPS == 0:
            found, _ = written(found, "levels")
    return rows.join(found, key, "left")
