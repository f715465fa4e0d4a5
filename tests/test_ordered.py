"""Ordered passes, hulls, lines on the grid and JSON tokens against plain versions."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars
from plumbline.operators import faces, grid, hull, spatial, takeoff, windows


def test_ordered_passes_equal_loops_across_batches(spark):
    r = random.Random(1)
    values = [(i % 3, r.randrange(4000) / 7) for i in range(3000)] + [(0, None), (4, 1.0), (None, 2.0), (None, 9.0)]
    df = spark.createDataFrame(values, "g int, v double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        spaced = sorted(map(tuple, windows.spaced(df, ["g"], "v", 1.5).collect()), key=str)
        clusters = sorted(map(tuple, windows.clustered_rows(df, ["g"], "v", 2.5).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept, grouped = [], []
    for g in (0, 1, 2, 4, None):
        last, total, n = None, 0.0, 0
        for v in sorted(v for k, v in values if k == g and v is not None):
            if last is None or v - last > 1.5:
                kept.append((g, v))
                last = v
            if n and v - total / n > 2.5:
                grouped.append((g, total / n, n))
                total, n = 0.0, 0
            total, n = total + v, n + 1
        grouped.append((g, total / n, n))
    assert spaced == sorted(kept, key=str) and clusters == sorted(grouped, key=str)
    assert windows.spaced(df.limit(0), ["g"], "v", 1.0).count() == 0
    assert [x["v"] for x in windows.spaced(df.where("g = 4"), [], "v", 1.0).collect()] == [1.0]


def brute_widest(points):
    pairs = [(-((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2), *sorted((a[2], b[2]))) for i, a in enumerate(points) for b in points[:i] if a[:2] != b[:2]]
    return min(pairs)[1:] if pairs else None


@pytest.mark.parametrize("seed", range(6))
def test_widest_pair_of_a_hull(seed):
    r = random.Random(seed)
    for n in (0, 1, 2, 3, 5, 40):
        for span in (3, 9, 1000):
            points = [(float(r.randrange(span)), float(r.randrange(span)), i) for i in range(n)]
            lowest = {}
            for p in points:
                lowest.setdefault(p[:2], p)
            got = hull.widest(hull.hull(points))
            want = brute_widest(list(lowest.values()))
            if want is None:
                assert got is None
                continue
            at = {p[2]: p for p in points}
            size = lambda pair: math.dist(at[pair[0]][:2], at[pair[1]][:2])
            assert size(got) == size(want)


def test_widest_pairs_on_a_circle_and_in_groups(spark):
    many = 20_000
    ring = [("ring", i, math.cos(2 * math.pi * i / many) * 100, math.sin(2 * math.pi * i / many) * 100) for i in range(many)]
    few = [("one", 1, 0.0, 0.0), ("same", 1, 2.0, 2.0), ("same", 2, 2.0, 2.0), ("line", 3, 0.0, 0.0), ("line", 1, 5.0, 5.0), ("line", 2, 9.0, 9.0), (None, 4, 0.0, 0.0), (None, 5, 1.0, 0.0), ("line", 9, None, 1.0), ("square", 1, 0.0, 0.0), ("square", 2, 1.0, 1.0), ("square", 3, 1.0, 0.0), ("square", 4, 0.0, 1.0)]
    df = spark.createDataFrame(ring + few, "g string, id int, x double, y double").repartition(7)
    got = {x["g"]: (x["i"], x["j"]) for x in hull.widest_pairs(df, ["g"], "id").collect()}
    at = {i: (x, y) for _, i, x, y in ring}
    assert math.dist(at[got["ring"][0]], at[got["ring"][1]]) == pytest.approx(200, abs=1e-9)
    assert {k: v for k, v in got.items() if k != "ring"} == {"line": (2, 3), None: (4, 5), "square": (1, 2)}
    base = takeoff.widest_baseline(df.where("g = 'line'"), "g", "id").first()
    assert (base["i"], base["j"], round(base["baseline"], 9)) == (2, 3, round(math.hypot(9, 9), 9))


def test_lines_list_the_cells_along_them(spark):
    long = spark.createDataFrame([(1, 0.5, 0.5, 9999.5, 9998.5)], "id int, x0 double, y0 double, x1 double, y1 double")
    assert 19_000 < grid.along(long, 1.0).count() < 41_000
    assert grid.along(long.withColumn("x1", F.lit(None).cast("double")), 1.0).count() == 0
    r = random.Random(3)
    lines = [(i, *[r.randrange(-80, 80) / 4 for _ in range(4)]) for i in range(120)]
    df = spark.createDataFrame(lines, long.schema)
    cells = {}
    for x in grid.along(df, 2.0, 0.5).select("id", "__cx", "__cy").collect():
        cells.setdefault(x["id"], []).append((x["__cx"], x["__cy"]))
    for i, x0, y0, x1, y1 in lines:
        assert len(cells[i]) == len(set(cells[i]))
        for k in range(101):
            x, y = x0 + (x1 - x0) * k / 100, y0 + (y1 - y0) * k / 100
            for dx, dy in ((0, 0), (0.35, 0.35), (-0.5, 0), (0, -0.5), (0.5, 0)):
                assert (math.floor((x + dx) / 2), math.floor((y + dy) / 2)) in cells[i]


def test_boxes_of_any_size_meet_their_points(spark):
    r = random.Random(4)
    boxes = [(i, (x, y, x + w, y + h)) for i in range(60) for x, y, w, h in [(r.uniform(-50, 50), r.uniform(-50, 50), 2.0 ** r.randrange(-3, 8), 2.0 ** r.randrange(-3, 8))]]
    points = [(i, r.uniform(-60, 120), r.uniform(-60, 120)) for i in range(300)] + [(900, None, 1.0)]
    b = spark.createDataFrame(boxes, "room int, box struct<min_x:double,min_y:double,max_x:double,max_y:double>")
    p = spark.createDataFrame(points, "id int, x double, y double")
    got = sorted((x["id"], x["room"]) for x in spatial.in_boxes(p, b, 1.0).collect())
    assert got == sorted((i, k) for i, x, y in points if x is not None for k, (x0, y0, x1, y1) in boxes if x0 <= x <= x1 and y0 <= y <= y1)
    assert grid.boxes_at(b, 1.0).count() <= 4 * len(boxes)


def test_points_in_rings_by_rows_of_edges(spark):
    r = random.Random(5)
    rings = [(k, [(10 * math.cos(a) * s, 10 * math.sin(a) * s) for a in [i * math.pi / 8 for i in range(16)] for s in [r.choice((0.4, 1.0))]]) for k in range(4)]
    df = spark.createDataFrame(rings, "room int, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(i, r.uniform(-11, 11), r.uniform(-11, 11)) for i in range(200)] + [(900 + i, *rings[0][1][i]) for i in range(4)], "id int, x double, y double")
    pairs = points.crossJoin(df)
    want = sorted((x["id"], x["room"]) for x in pairs.where(scalars.inside_ring(F.col("x"), F.col("y"), F.col("ring"))).collect())
    got = grid.inside_rows(pairs.select("id", "x", "y", "room"), grid.ring_lines(df, ["room"]), ["id"], ["room"], 1.5)
    assert sorted((x["id"], x["room"]) for x in got.collect()) == want


def test_long_lines_are_split_like_short_ones(spark):
    rows = [(1, 0.0, 0.0, 400.0, 399.0), (2, 0.0, 100.0, 300.0, 100.0), (3, 37.0, 0.0, 37.0, 200.0)]
    df = spark.createDataFrame(rows, "segment_id int, x0 double, y0 double, x1 double, y1 double")
    whole = lambda d: sorted((x["segment_id"], round(x["x0"], 6), round(x["y0"], 6), round(x["x1"], 6), round(x["y1"], 6)) for x in d.collect())
    assert whole(faces.split_at_crossings(df, 1.0)) == whole(faces.split_at_crossings(df, 500.0))


def test_json_keeps_what_is_not_finite(spark):
    texts = ['{"b": NaN, "a": [Infinity, -Infinity, 1]}', '{"NaN": "NaN, \\"NaN\\" -Infinity\\\\", "x": NaN}', '{"a": 1.5, "Infinity": true}', "{bad NaN", "NaN", "[]", None]

    def tokens(v):
        if isinstance(v, dict):
            return {k: tokens(x) for k, x in v.items()}
        if isinstance(v, list):
            return [tokens(x) for x in v]
        return v if not isinstance(v, float) or math.isfinite(v) else "nan" if v != v else "infinity" if v > 0 else "-infinity"

    def want(t):
        try:
            return json.dumps(tokens(json.loads(t)), sort_keys=True, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [x[0] for x in df.select(scalars.canonical_json(F.col("t"))).collect()] == [want(t) for t in texts]
