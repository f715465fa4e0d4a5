"""Bands, rooms, rails, changes and checks on small inputs, against plain versions and over several drawings at once."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import bands, blocks, catalog, changes, estimate, faces, graph, quality, rails, registration, rooms, spatial, windows

RING = "array<struct<x:double,y:double>>"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def rect(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def lines(spark, items):
    return spark.createDataFrame(items, "rev string, segment_id long, x0 double, y0 double, x1 double, y1 double")


def test_tags_as_drawings_write_them(spark):
    tags = {
        "300x200 SA": ("SA", "rect", None, 300, 200), "100mm SA": ("SA", "round", 100, None, None), "15∅CDP AT HL": ("CDP", "round", 15, None, None), "54 VAC": ("VAC", "round", 54, None, None),
        "100 mmx50 mm REFRIGERANT TRAY": ("REFRIGERANT TRAY", "rect", None, 100, 50), "100x50 LV & ELV & OF": ("LV & ELV", "rect", None, 100, 50), "100x50 A & B": None, "100x50 & B": None, "42 mm": None, "Ø250 LOW LOSS HEADER": None, "100MM ABOVE THE DESK": None, "EA": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in tags], "t string")
    got = {r[0]: r[1] and tuple(r[1])[:5] for r in df.select("t", S.round_tag(F.col("t"))).collect()}
    assert got == tags
    strict = {r[0]: r[1] is not None for r in df.select("t", S.round_tag(F.col("t"), strict=True)).collect()}
    assert strict["15∅CDP AT HL"] and not strict["54 VAC"]
    assert spark.range(1).select(S.round_tag(F.lit("54 VAC"), legend=("VAC",), strict=True)["service"]).first()[0] == "VAC"


def test_names_texts_and_ids(spark):
    one = spark.range(1)
    assert one.select(S.derived_uuid("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.lit("k"))).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "k"))
    numbers = [0.0, -0.0, 1e-13, 0.1, 1 / 3, 1e15, 1e22, 1e-5, 0.0001, 1e100, -2.5, 123456.789, float("nan"), float("inf"), None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in numbers], "x double").select(S.general_text(F.col("x"))).collect()]
    assert got == ["" if x is None else "0" if x == 0 else format(x, ".15g") for x in numbers]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert spark.sql("select timestamp'2024-06-01 12:00:00' as t").select(S.iso_utc(F.col("t"))).first()[0] == "2024-06-01T16:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def in_order(items):
    used, out = {}, {}
    for g, o, a, b, q in sorted(items, key=lambda r: (r[0], r[1])):
        taken = used.setdefault(g, set())
        base = f"e-{q:06d}"
        free = [c.strip() for c in (a, b) if c and c.strip() and c.strip() not in taken] or [n for n in [base, *(f"{base}-{i}" for i in range(1, 99))] if n not in taken]
        taken.add(free[0])
        out[g, o] = free[0]
    return out


def test_references_are_unique(spark):
    r = random.Random(1)
    items = [(1, 1, "A", "x", 1), (1, 2, "A", None, 2), (1, 3, "A-2", "A", 3), (1, 4, " ", "A", 4), (1, 6, None, None, 6), (1, 7, "e-000006", None, 7), (2, 1, "A", "x", 1)]
    items += [(3, i, r.choice("abcd"), r.choice([None, "q", "a"]), i % 9) for i in range(40)]
    df = spark.createDataFrame(items, "g int, o int, a string, b string, s int")
    got = {(x["g"], x["o"]): x["unique_ref"] for x in windows.unique_references(df, ["g"], ["o"], ["a", "b"], "e", "s").collect()}
    assert got == in_order(items)
    assert windows.unique_references(df.limit(0), ["g"], ["o"], ["a"], "e", "s").count() == 0


def test_references_of_groups_that_a_pass_holds_are_written_once(spark, monkeypatch):
    r = random.Random(2)
    items = [(g, i, r.choice("ab"), r.choice([None, "q", " a "]), i % 5) for g in range(3) for i in range(12)]
    df = spark.createDataFrame(r.sample(items, len(items)), "g int, o int, a string, b string, s int")
    made, table = [], windows.Scratch.table
    monkeypatch.setattr(windows.Scratch, "table", lambda self, df, name, *more, **named: made.append(name) or table(self, df, name, *more, **named))
    for most in (windows.PASS_ROWS, 12, 5, 0):
        made.clear()
        monkeypatch.setattr(windows, "PASS_ROWS", most)
        got = {(x["g"], x["o"]): x["unique_ref"] for x in windows.unique_references(df, ["g"], ["o"], ["a", "b"], "e", "s").collect()}
        assert got == in_order(items), most
        assert (len(made) == 1) == (most >= 12)


def covered(segment, band, buffer=0.011, n=20000):
    """Share of a segment inside a grown rectangle, by sampling."""
    (x0, y0, x1, y1), (x, y, w, h) = segment, band
    hits = 0
    for i in range(n):
        px, py = x0 + (i + 0.5) / n * (x1 - x0), y0 + (i + 0.5) / n * (y1 - y0)
        dx, dy = max(x - px, 0, px - x - w), max(y - py, 0, py - y - h)
        hits += dx * dx + dy * dy <= buffer * buffer
    return hits / n


def test_overlaps_against_sampling_in_two_drawings(spark):
    r = random.Random(4)
    segments = [(i, *(r.uniform(0, 3) for _ in range(4))) for i in range(30)]
    bars = [(i, r.uniform(0, 2.5), r.uniform(0, 2.5), r.uniform(0.1, 0.8), r.uniform(0.1, 0.8)) for i in range(12)]
    s = lines(spark, [(rev, *x) for rev in "ab" for x in segments] + [("a", 99, 1.0, 1.0, 1.0, 1.0)])
    b = spark.createDataFrame([(rev, i, rect(*x)) for rev in "ab" for i, *x in bars], f"rev string, k int, ring {RING}")
    got = bands.measured_overlaps(s, b, "segment_id", "k", 0.7, ["rev"], reach=0.1).collect()
    shares = {(x["rev"], x["segment_id"], x["k"]): x["overlap"] for x in got}
    assert {k[1:] for k in shares if k[0] == "a"} == {k[1:] for k in shares if k[0] == "b"}
    for i, *seg in segments:
        for k, *bar in bars:
            want = covered(seg, bar, n=4000)
            assert shares.get(("a", i, k), 0.0) == pytest.approx(want, abs=0.002), (i, k)
    whole = bands.attributed(s, b, "segment_id", "k", 0.7, ["rev"])
    assert whole.count() == 60 and whole.groupBy("rev").agg(F.round(F.sum("length"), 6)).select(F.col("round(sum(length), 6)")).distinct().count() == 1


def test_a_lost_length_shows(spark):
    a = spark.createDataFrame([("x", 5.0), ("x", 5.0), ("y", 1.0)], "g string, v double")
    b = spark.createDataFrame([("x", 9.0), ("y", 1.0), ("z", 2.0)], "g string, v double")
    held = {r["g"]: r["holds"] for r in quality.conserved_by({"c": (a, F.sum("v"), b, F.sum("v"))}, ["g"]).collect()}
    assert held == {"x": False, "y": True, "z": False}


def test_drawings_with_equal_coordinates_stay_apart(spark):
    one = [(1, 0.0, 0.0, 10.0, 0.0), (2, 10.0, 0.0, 10.0, 5.0), (3, 10.0, 5.0, 0.0, 5.0), (4, 0.0, 5.0, 0.0, 0.0), (5, 5.0, -1.0, 5.0, 6.0)]
    two = lines(spark, [(rev, *x) for rev in "ab" for x in one])
    found = faces.trace_faces(faces.split_at_crossings(two, 10.0, group=["rev"]), 0.1, 1.0, ["rev"])
    assert rows(found.groupBy("rev").agg(F.count("*"), F.sum("area"))) == [("a", 2, 50.0), ("b", 2, 50.0)]
    nodes, _ = graph.topology(two, 0.1, group=["rev"])
    assert nodes.count() == 2 * graph.topology(two.where("rev = 'a'"), 0.1)[0].count() and nodes.where("degree = 4").count() == 0
    boxes = spark.createDataFrame([(rev, "r", (2.0, -1.0, 4.0, 6.0)) for rev in "ab"], "rev string, room string, box struct<min_x:double,min_y:double,max_x:double,max_y:double>")
    assert rows(spatial.split_by_boxes(two.where("segment_id = 1"), boxes, "segment_id", "room", 3.0, ["rev"]).where("room is not null")) == [("a", 1, "r", 2.0), ("b", 1, "r", 2.0)]
    tags = spark.createDataFrame([("a", 1, 5.0, 1.0), ("c", 1, 5.0, 1.0)], "rev string, tag int, x double, y double")
    near = {r["rev"]: r["segment_id"] for r in spatial.nearest_run(tags, two, 2.0, "tag", "segment_id", group=["rev"]).collect()}
    assert near == {"a": 5, "c": None}
    assert rows(rails.centrelines(two.where("segment_id in (1, 3)"), "segment_id", ["rev"], most=6.0).select("rev", "n_pairs", F.col("length").cast("double"))) == [("a", 1, 10.0), ("b", 1, 10.0)]


def test_names_go_to_numbers_in_order(spark):
    labels = [("f", 1, 0.0, 0.0, "1.1"), ("f", 2, 1.0, 0.0, "1.2"), ("f", 3, 0.9, 0.1, "Plant room"), ("f", 4, 5.0, 5.0, "9.9"), ("f", 5, None, None, "Store")]
    df = spark.createDataFrame(labels, "floor string, label_id int, x double, y double, text string")
    assert rows(rooms.label_rooms(df, 1.5, ["floor"]).select("label_id", "name")) == [(1, "Plant room"), (2, None), (4, None)]
    assert rooms.label_rooms(df.limit(0), 1.5, ["floor"]).count() == 0


def test_expansion_of_odd_blocks(spark):
    schema = "owner string, insert_id string, block string, x double, y double, sx double, sy double, rotation double, cols int, rows int, dx double, dy double"
    inserts = spark.createDataFrame([(None, "a", "B", 10.0, 0.0, 2.0, 2.0, 0.0, 0, None, 0.0, 0.0), (None, "z", "none", 0.0, 0.0, 1.0, 1.0, 0.0, 1, 1, 0.0, 0.0), ("B", "b", "B", 0.0, 0.0, 1.0, 1.0, 0.0, 1, 1, 0.0, 0.0)], schema)
    defined = spark.createDataFrame([("B", (1.0, 0.0))], "block string, base struct<x:double,y:double>")
    leaves = spark.createDataFrame([("B", 1, [(2.0, 3.0)]), ("C", 1, [(0.0, 0.0)])], f"block string, leaf int, points {RING}")
    got = blocks.expand_blocks(inserts, defined, leaves).collect()
    assert [(r["instance_id"], [tuple(p) for p in r["points"]], r["approximate"]) for r in got] == [("a#0.0", [(12.0, 6.0)], False)]


def test_widest_baseline_is_exact(spark):
    r = random.Random(9)
    pts = [("s", i, r.gauss(0, 1), r.gauss(0, 1)) for i in range(300)]
    df = spark.createDataFrame([(*p, 2 * p[3] + 1, -2 * p[2]) for p in pts], "sheet string, label int, x double, y double, tx double, ty double")
    got = registration.baseline(df, "sheet", "label").first()
    best = max(((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2, a[1], b[1]) for a in pts for b in pts if a[1] < b[1])
    assert (got["label_i"], got["label_j"]) == best[1:] and got["scale"] == pytest.approx(2) and got["rotation"] == pytest.approx(-90)


def test_formula_definitions(spark):
    lit = lambda v, c="scalar": {"kind": "literal", "value": v, "contract": c}
    q, inputs = {"kind": "input", "name": "q"}, {"q": ("q", "quantity")}
    good = {"kind": "round", "scale": 2, "args": [{"kind": "multiply", "args": [lit("3.25", "rate"), q]}]}
    assert estimate.check_formula(good, inputs) == []
    bad = {
        "too deep": q, "canonical": {"kind": "multiply", "args": [lit("1.50", "rate"), q]}, "unknown input": {"kind": "input", "name": "z"}, "unused": lit("1", "money"), "scale": {"kind": "round", "scale": 99, "args": [q]},
        "arguments": {"kind": "divide", "args": [q]}, "unknown kind": {"kind": "pow", "args": [q, q]}, "not money": q,
    }
    for _ in range(70):
        bad["too deep"] = {"kind": "negate", "args": [bad["too deep"]]}
    for said, node in bad.items():
        assert any(said in p for p in estimate.check_formula(node, inputs)), said


def test_sets_abort_whole_and_properties_merge(spark):
    entities = spark.createDataFrame([("e", "A", {"label": "x", "k": "v"}), ("n", "A", None)], "entity string, layer string, properties map<string,string>")
    ops = [(1, 1, "update_property", "e", "y", "properties.label"), (1, 2, "annotate_entity", "e", "note", None), (1, 3, "update_property", "n", "m", "mark"), (2, 1, "update_property", "e", "y", "geometry"), (2, 2, "change_layer", "e", "B", None), (3, 1, "move", "e", None, None)]
    got = changes.apply_sets(entities, spark.createDataFrame(ops, "set_id int, sequence_index int, operation_type string, entity string, value string, property string")).collect()
    assert {(r["set_id"], r["entity"]): (r["layer"], r["properties"], r["annotations"], r["effect"]) for r in got} == {
        (1, "e"): ("A", {"label": "y", "k": "v"}, ["note"], "metadata_only"), (1, "n"): ("A", {"mark": "m"}, [], "metadata_only"),
    }


def test_a_catalog_load_refuses_what_is_wrong(spark):
    schema = "entry_id int, currency string, value decimal(18,9), scope_type string, project_id long, effective_start date, effective_end date"
    new = spark.createDataFrame([(1, "GBP", None, "global", None, None, None)], schema).union(spark.sql("select 2, 'GBP', cast(1.5 as decimal(18,9)), 'global', null, date'2024-01-01', null"))
    good, bad = catalog.load_entries(new, new.limit(0).withColumn("checksum", F.lit("")), ["value"])
    assert [r["entry_id"] for r in good.collect()] == [2] and [(r["entry_id"], r["problem"]) for r in bad.collect()] == [(1, "value")]


def test_connectivity_has_one_pass_and_cuts_tees(spark):
    s = spark.createDataFrame([(1, "red", 0.0, 0.0, 1.0, 0.0), (2, None, 1.0, 0.0, 2.0, 0.0), (3, None, 2.0, 0.0, 3.0, 0.0), (4, None, 6.0, 0.0, 9.0, 0.0), (5, "blue", 7.5, 0.0, 7.5, 1.0), (6, None, 7.5, 1.0, 7.56, 1.08)], "segment_id int, colour string, x0 double, y0 double, x1 double, y1 double")
    got = rows(bands.refine_shared(s, "segment_id", "colour").select("segment_id", "part", F.round("length", 6), "colour"))
    assert got == [(1, 1, 1.0, "red"), (2, 1, 1.0, "red"), (3, 1, 1.0, None), (4, 1, 1.5, None), (4, 2, 1.5, None), (5, 1, 1.0, "blue"), (6, 1, 0.1, "blue")]
