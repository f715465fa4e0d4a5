"""The service takeoff's rules on small drawings, and its parts against a loop."""

import random
from collections import Counter
from math import hypot

import pytest
from pyspark.sql import functions as F

from plumbline.operators import service

RUNS = "rev string, run int, x double, y double, length double, status string, conflict boolean, discipline string"
SEGMENTS = "rev string, segment_id int, run int, x0 double, y0 double, x1 double, y1 double"
TAGS = "rev string, run int, service string, size string, kind string"
LABELS = "rev string, x double, y double, service string, size string, kind string"
EVIDENCE = "rev string, stack int, service string"
ROOMS = "rev string, room_id int, ring array<struct<x:double,y:double>>, area double"
ANCHORS = "rev string, room int, x double, y double"
SYMBOLS = "rev string, symbol_id int, kind string, x double, y double, discipline string"


@pytest.fixture
def drawing(spark):
    def make(**tables):
        frame = lambda name, schema: spark.createDataFrame(tables.get(name, []), schema)
        return [frame(n, s) for n, s in (("runs", RUNS), ("segments", SEGMENTS), ("tags", TAGS), ("labels", LABELS), ("evidence", EVIDENCE), ("rooms", ROOMS), ("anchors", ANCHORS))], frame("symbols", SYMBOLS)

    return make


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def lengths(parts):
    got = Counter()
    for r in parts.collect():
        got[r["run"], r["service"], r["room_id"]] += r["length"]
    return dict(got)


def test_segments_go_to_their_nearest_label_and_bundles_to_every_service(drawing):
    run = lambda i: ("a", i, None, None, None, "resolved", False, None)
    tables, symbols = drawing(
        runs=[run(1), run(2), run(3), ("a", 4, 5.0, 5.0, 7.0, "unknown", True, "M"), ("a", 5, 99.0, 0.0, None, None, None, None)],
        segments=[("a", 1, 1, 0.0, 0.0, 10.0, 0.0), ("a", 2, 1, 10.0, 0.0, 30.0, 0.0), ("a", 3, 2, 0.0, 50.0, 8.0, 50.0), ("a", 4, 3, 0.0, 90.0, 4.0, 90.0), ("a", 5, 3, 4.0, 90.0, 4.0, 90.0), ("b", 1, 1, 0.0, 0.0, 1.0, 0.0)],
        tags=[("a", 1, "SA", "100", "round"), ("a", 1, "CW", None, None)] + [("a", 2, s, "50", "round") for s in ("SA", "RA", "EA")] + [("a", 3, "SA", None, None), ("a", 3, "XX", None, None)],
        labels=[("a", 5.0, 1.0, "SA", "100", "round"), ("a", 20.0, 1.0, "CW", None, None), ("b", 0.5, 0.0, "SA", None, None)],
        evidence=[("a", 1, "SA"), ("a", 1, "RA"), ("a", 1, "RA"), ("a", 2, "XX"), ("a", 2, "YY"), ("b", 3, "SA"), ("b", 3, "XX")],
        rooms=[("a", 7, box(0.0, 45.0, 2.0, 55.0), 20.0), ("a", 8, box(0.0, 0.0, 6.0, 6.0), 36.0)], anchors=[("a", 70, 6.0, 50.0)],
    )
    parts = service.takeoff_parts(*tables, 16.0, 5.0, 3.5, ["rev"])
    assert lengths(parts.where("rev = 'a'")) == {
        (1, "SA", 8): 10.0, (1, "CW", None): 20.0, (2, "SA", 7): 2.0, (2, "RA", 7): 2.0, (2, "EA", 7): 2.0, (2, "SA", 70): 6.0, (2, "RA", 70): 6.0, (2, "EA", 70): 6.0,
        (3, None, None): 4.0, (4, None, 8): 7.0, (5, None, None): 0.0,
    }
    assert {(r["run"], r["bundle"], r["evidence_absent"]) for r in parts.where("rev = 'a'").collect()} == {(1, False, True), (2, True, False), (3, False, True), (4, False, False), (5, False, False)}
    counts = service.takeoff_counts(parts, tables[2], ["rev"]).where("rev = 'a'").first()
    assert (counts["unassigned_runs"], counts["unknown_runs"]) == (3, 2)


def test_symbols_are_counted_beside_what_has_no_service(drawing):
    tables, _ = drawing(runs=[("a", 1, 1.0, 1.0, 2.5, "partial", True, "P")], rooms=[("a", 8, box(0.0, 0.0, 6.0, 6.0), 36.0)])
    spark = tables[0].sparkSession
    symbols = spark.createDataFrame([("a", 1, "rise", 1.0, 1.0, "M"), ("a", 2, "drop", 2.0, 2.0, None), ("a", 3, "rise", 9.0, 9.0, None), ("b", 4, "drop", None, None, "E")], SYMBOLS)
    got = service.service_takeoff(*tables, symbols, 16.0, 5.0, group=["rev"]).collect()
    assert {(r["rev"], r["room_id"]): (r["service"], float(r["length"]), r["n_runs"], r["status"], r["conflict"], r["discipline"], r["risers"], r["drops"]) for r in got} == {
        ("a", 8): (None, 2.5, 1, "partial", True, "M", 1, 1), ("a", None): (None, 0.0, 0, "unknown", False, None, 1, 0), ("b", None): (None, 0.0, 0, "unknown", False, "E", 0, 1),
    }


def test_random_runs_equal_a_loop(drawing):
    r = random.Random(6)
    names = ["SA", "RA", "EA", "CW"]
    runs = [("a", i, None, None, None, "resolved", False, None) for i in range(40)]
    segments, tags = [], []
    for i in range(160):
        x, y, n = r.randrange(100), r.randrange(100) + 0.25, r.randrange(1, 20)
        flat = r.random() < 0.5
        segments.append(("a", i, r.randrange(40), float(x), y, float(x + n) if flat else float(x), y if flat else y + n))
    for i in range(40):
        tags += [("a", i, s, r.choice(("50", "100", None)), "round") for s in r.choices(names, k=r.randrange(4))]
    labels = [("a", r.randrange(120) + 0.5, r.randrange(120) + 0.5, r.choice(names), r.choice(("50", None)), None) for _ in range(40)]
    evidence = [("a", i, s) for i in range(3) for s in r.sample(names, 2)]
    rooms = [("a", i, box(float(x), float(y), x + w + 0.5, y + h + 0.5), (w + 0.5) * (h + 0.5)) for i in range(25) for x, y, w, h in [(r.randrange(100), r.randrange(100), r.randrange(5, 30), r.randrange(5, 30))]]
    tables, _ = drawing(runs=runs, segments=segments, tags=tags, labels=labels, evidence=evidence, rooms=rooms)
    got = Counter()
    for x in service.takeoff_parts(*tables, 16.0, 8.0, None, ["rev"]).collect():
        got[x["run"], x["service"], x["size"], x["room_id"]] += x["length"]

    of_run = {i: {} for i in range(40)}
    for _, i, s, size, _ in tags:
        of_run[i].setdefault(s, []).append(size)
    stacks = [{s for _, i, s in evidence if i == k} for k in range(3)]
    corners = {i: (ring[0], ring[2], area) for _, i, ring, area in rooms}
    room_at = lambda x, y: min(((a, i) for i, (p, q, a) in corners.items() if p[0] <= x <= q[0] and p[1] <= y <= q[1]), default=(0, None))[1]
    want = Counter()
    for _, _, i, x0, y0, x1, y1 in segments:
        mine = of_run[i]
        if len(mine) > 1 and any(len(set(mine) & s) > 1 for s in stacks):
            flat = y0 == y1
            lo, hi, fixed = (x0, x1, y0) if flat else (y0, y1, x0)
            axis = 0 if flat else 1
            cuts = sorted({lo, hi} | {c for p, q, _ in corners.values() for c in (p[axis], q[axis]) if lo < c < hi})
            for a, b in zip(cuts, cuts[1:]):
                m = (a + b) / 2
                room = room_at(m, fixed) if flat else room_at(fixed, m)
                for s, sizes in mine.items():
                    n = Counter(sizes)
                    want[i, s, min(n, key=lambda v: (-n[v], v or "")), room] += b - a
        else:
            mx, my = (x0 + x1) / 2, (y0 + y1) / 2
            near = min(((round(hypot(mx - x, my - y), 9), s, size or "", size) for _, x, y, s, size, _ in labels if hypot(mx - x, my - y) <= 8), default=(0, None, "", None))
            want[i, near[1], near[3], room_at(mx, my)] += hypot(x1 - x0, y1 - y0)
    for i in set(range(40)) - {x[2] for x in segments}:
        want[i, next(iter(of_run[i])) if len(of_run[i]) == 1 else None, None, None] += 0.0
    assert {k: pytest.approx(v) for k, v in want.items()} == dict(got)
    assert sum(v for (_, s, *_), v in got.items() if s is None) > 0


def test_one_size_for_each_service(spark):
    rows = [(1, "SA", "100", "round"), (1, "SA", "100", "rect"), (1, "SA", "50", "round"), (1, "RA", None, None), (1, "RA", "50", "round"), (2, "SA", "75", "round")]
    got = service.collapsed_services(spark.createDataFrame(rows, "run int, service string, size string, kind string"), ["run"]).collect()
    assert {(x["run"], x["service"]): (x["size"], x["kind"]) for x in got} == {(1, "SA"): ("100", "rect"), (1, "RA"): (None, None), (2, "SA"): ("75", "round")}


def test_runs_are_named_by_texts_beside_them(spark):
    tags = spark.createDataFrame([(1, "300x200 SA", 1.0, 0.5), (2, "note", 1.0, 0.1), (3, "100 mm RA", 50.0, 50.0)], "tag_id int, text string, x double, y double")
    lines = spark.createDataFrame([(7, 0.0, 0.0, 9.0, 0.0)], "run int, x0 double, y0 double, x1 double, y1 double")
    got = service.tagged_runs(tags, lines, 2.0).select("tag_id", "run", "service", "size", "kind").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 7, "SA", "300x200", "rect"), (3, None, "RA", "100", "round")]
    assert [tuple(x) for x in service.run_anchors(lines.withColumn("y1", F.lit(2.0))).collect()] == [(7, 4.5, 1.0)]
