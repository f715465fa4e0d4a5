"""The two points of each group that lie farthest apart, by convex hulls that merge.

Each task first keeps the hulls of the rows it has, so that only hull points are sent on; a group's hull points then come to one
task in order, which holds the hull of what it has seen. The widest pair is found walking the hull once around.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.workers import ready_workers

#: Points that a task holds of one group before it keeps their hull only.
HELD = 1 << 16


def hull(points: list[tuple]) -> list[tuple]:
    """The corners of the convex hull of (x, y, label) points, around; of equal points the lowest label stays."""
    distinct = {}
    for p in sorted(points):
        distinct.setdefault(p[:2], p)
    ordered = list(distinct.values())
    if len(ordered) < 3:
        return ordered

    def chain(rows: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return chain(ordered)[:-1] + chain(ordered[::-1])[:-1]


def widest(points: list[tuple]) -> tuple | None:
    """(label, other label) of the points of a hull that lie farthest apart, ties by the labels; null for fewer than two."""
    n = len(points)
    if n < 2:
        return None
    best = None

    def look(p: tuple, q: tuple) -> None:
        nonlocal best
        a, b = sorted((p, q), key=lambda r: r[2])
        key = (-((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2), a[2], b[2])
        if p is not q and (best is None or key < best):
            best = key

    if n < 4:
        for i in range(n):
            for j in range(i):
                look(points[i], points[j])
        return best[1:]
    area = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    j = 1
    for i in range(n):
        a, b = points[i], points[(i + 1) % n]
        while area(a, b, points[(j + 1) % n]) > area(a, b, points[j]):
            j = (j + 1) % n
        for k in (j, (j + 1) % n, (j - 1) % n):
            look(a, points[k])
            look(b, points[k])
    return best[1:]


def widest_pairs(points: DataFrame, group: Sequence[str], label: str) -> DataFrame:
    """(group, i, j) of the two points (x, y, label) of each group that lie farthest apart, i before j; ties by i, then j.

    Points without coordinates or label are left out, and groups with fewer than two different places. Groups may have null keys.
    """
    ready_workers(points.sparkSession)
    keys = list(group)
    rows = points.select(*keys, F.col(label).alias("__l"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("__l is not null and x is not null and y is not null")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        schema = None
        for batch in batches:
            schema, columns = batch.schema, [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                mine = held.setdefault(row[: len(keys)], [])
                mine.append((row[-2], row[-1], row[-3]))
                if len(mine) >= HELD and len(mine) & (len(mine) - 1) == 0:
                    held[row[: len(keys)]] = hull(mine)
            if sum(map(len, held.values())) > 8 * HELD:
                yield from told(held, schema)
                held.clear()
        if held:
            yield from told(held, schema)

    def told(held: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        out = [(*k, p[2], p[0], p[1]) for k, mine in held.items() for p in hull(mine)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    found = points.schema[label].dataType.simpleString()
    schema = ", ".join([f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys] + [f"i {found}", f"j {found}"])

    def settle(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: list[tuple] = []
        for batch in batches:
            mine = hull(mine + list(zip(*[batch.column(c).to_pylist() for c in ("x", "y", "__l")])))
        pair = widest(mine)
        if pair:
            cells = [*key, *[pa.scalar(v, batch.column("__l").type) for v in pair]]
            yield pa.RecordBatch.from_arrays([pa.array([c.as_py()], c.type) for c in cells], names=[*keys, "i", "j"])

    small = rows.mapInArrow(shrink, rows.schema)
    if keys:
        return small.groupBy(*keys).applyInArrow(settle, schema)
    return small.withColumn("__one", F.lit(1)).groupBy("__one").applyInArrow(lambda key, batches: settle((), batches), schema)
