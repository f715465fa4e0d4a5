"""The room pipeline over arrays against the one in joins, and what it writes."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import room_arrays, rooms
from plumbline.sources.tables import Scratch

ROOMS = "job int, rev string, room_id string, ring array<struct<x:double,y:double>>, area double, rank int, source string, number string"
LABELS = "job int, rev string, label_id long, x double, y double, text string"
DEVICES = "job int, rev string, device_id int, x double, y double"
ZONES = "job int, rev string, box struct<min_x:double,min_y:double,max_x:double,max_y:double>"
KEYS = ["job", "rev"]


def drawings(spark):
    """Overlapping rooms, an L-shaped one, points on edges, names near numbers, equal numbers, nulls."""
    r = random.Random(9)
    at = lambda: r.choice((r.randrange(13) * 1.0, r.random() * 12))
    some = lambda v: v if r.random() < 0.95 else None
    polygons, labels, devices, zones = [], [], [], []
    for d in range(40):
        key = (d % 2, f"r{d // 2}" if d < 38 else None)
        for rank in range(r.choice((1, 2))):
            for i in range(r.randrange(1, 5)):
                x, y, w = r.randrange(9) * 1.0, r.randrange(9) * 1.0, r.choice((2.0, 3.0, 4.0))
                ring = [(x, y), (x + w, y), (x + w, y + w / 2), (x + w / 2, y + w / 2), (x + w / 2, y + w), (x, y + w)] if r.random() < 0.5 else [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
                polygons.append((*key, f"p{i}", ring if r.random() < 0.95 else [], some(w * w), rank + d % 3, "walls", r.choice((None, None, "2.1"))))
        for i in range(r.randrange(14)):
            labels.append((*key, d * 100 - i, some(at()), some(at()), r.choice(("1.1", "1.2", "2.1", "no 3.4 B", "Plant", " Store ", "", None))))
        for i in range(8):
            devices.append((*key, i, some(at()), some(at())))
        for i in range(r.randrange(3)):
            x, y = at(), at()
            zones.append((*key, (x, y, some(x + 2.0), y + 1.0)))
    return [spark.createDataFrame(v, s).cache() for v, s in ((polygons, ROOMS), (labels, LABELS), (devices, DEVICES), (zones, ZONES))]


def told(found):
    return [sorted(map(repr, df.collect())) for df in found]


def test_arrays_and_joins_and_both_agree(spark):
    tables = drawings(spark)
    want = told(rooms.room_pipeline_in_joins(*tables, 3.0, 1.5, 2.0, KEYS))
    assert {True, False} == {"needs_review=True" in v for v in want[0]} and all(any(f"basis='{b}'" in v for v in want[1]) for b in ("polygon", "label", "unassigned"))
    assert any("label-" in v and "name='" in v for v in want[0])
    for most in (1 << 20, 20):
        assert told(rooms.room_pipeline(*tables, 3.0, 1.5, 2.0, KEYS, most=most)) == want


def test_text_ids_and_other_columns_of_devices(spark):
    polygons, labels, devices, zones = drawings(spark)
    labels = labels.withColumn("label_id", F.col("label_id").cast("string"))
    want = told(rooms.room_pipeline_in_joins(polygons, labels, devices, zones, 3.0, 1.5, 2.0, KEYS))
    assert told(rooms.room_pipeline(polygons, labels, devices, zones, 3.0, 1.5, 2.0, KEYS)) == want
    placed = rooms.room_pipeline(polygons, labels, devices.withColumn("tag", F.lit("t")), zones, 3.0, 1.5, 2.0, KEYS)[1]
    assert placed.count() == devices.count() and placed.select("tag").distinct().count() == 1


def test_rows_are_dealt_once_and_one_table_is_written(spark, monkeypatch):
    plans, write = [], Scratch.table

    def table(self, df, *args, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, *args, **options)

    monkeypatch.setattr(Scratch, "table", table)
    found = rooms.room_pipeline(*drawings(spark), 3.0, 1.5, 2.0, KEYS)
    assert len(plans) == 1 and "Join" not in plans[0]
    assert not any("Exchange" in df._jdf.queryExecution().executedPlan().toString() for df in found)


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_pairs_are_met_some_at_a_time(spark, monkeypatch, most):
    monkeypatch.setattr(room_arrays, "MET", most)
    import numpy as np
    import pyarrow as pa

    square = lambda x, w: ([x, x + w, x + w, x], [0.0, 0.0, w, w])
    shapes = [square(0.0, 4.0), square(0.0, 2.0), ([], []), square(1.0, 1.0)]
    area = np.array([16.0, 4.0, 0.0, 1.0])
    rings = room_arrays._Rings(np.zeros(4, np.int64), *[pa.array([s[k] for s in shapes], pa.list_(pa.float64())) for k in (0, 1)], area, area >= 0, np.array([0, 1, 2, 3]))
    x = np.array([0.0, 1.5, 3.0, 4.0, 4.1, 2.0])
    near = [(i.tolist(), j.tolist()) for i, j, _ in room_arrays._near(*[np.array(v) for v in ([0, 0], [0.0, 0.5], [0.0, 0.0], [0, 0, 1], [0.0, 1.0, 0.0], [0.5, 0.0, 0.0])], 1.0)]
    assert len(near) == (2 if most == 1 else 1) and sorted(p for i, j in near for p in zip(i, j)) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    got = rings.smallest(np.array([0, 0, 0, 0, 0, 1]), x, np.full(6, 1.0), x < 5)
    assert got.tolist() == [1, 3, 0, 0, -1, -1]
