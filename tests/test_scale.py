"""Queries and joins on tables whose rows grow while their places, groups or types stay."""

import random
import re

from plumbline import registry
from plumbline.operators import catalog, graph, rails, spatial, stacks, takeoff
from plumbline.sources import tables

SF = "/root/testdata/sf0.001"


def test_next_revision_is_of_the_parts(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").collect()
    effect = lambda size: "added" if size <= 2 else None if size <= 20 else ("removed", "changed", "metadata_only")[size % 3]
    layer = lambda r: {"added": "added", "changed": "new"}.get(effect(r["p_size"]), r["p_brand"])
    want = sorted((r["p_partkey"], layer(r)) for r in parts if effect(r["p_size"]) != "removed")
    assert sorted(map(tuple, registry.queries()["next_revision"](spark, SF).collect())) == want


def test_rails_of_several_sheets_pair_over_many_rounds(spark):
    """Each line waits for the one before: more rounds than are made before the rest is cut into parts."""
    at = [0.0]
    for k in range(13):
        at.append(at[-1] + 0.05 + k * 0.01)
    rows = [(sheet, k, 0.0, y, 10.0, y) for sheet in (1, 2) for k, y in enumerate(at)]
    lines = spark.createDataFrame(rows, "sheet int, rail int, x0 double, y0 double, x1 double, y1 double")
    got = rails.centrelines(lines, "rail", ["sheet"]).select("sheet", "n_pairs", "n_unpaired").collect()
    assert sorted(map(tuple, got)) == [(1, 7, 0), (2, 7, 0)]


def test_a_search_is_made_once_for_each_place(spark):
    """A thousand points and a thousand others at four places each: the join has a row for each pair of places."""
    points = spark.range(1000).selectExpr("id AS p", "cast(id % 4 AS double) AS x", "0D AS y")
    others = spark.range(1000).selectExpr("id + 5 AS o", "cast(id % 4 AS double) AS x", "1D AS y", "id % 7 AS s")
    plan = spatial.within_radius(spatial._places(points, []), others.groupBy("x", "y").count(), 2.0)
    assert plan.count() <= 16
    got = spatial.nearest_within(points, others, 2.0, "p", ["o"], ["o"])
    assert {tuple(r) for r in got.select("p", "o", "distance").collect()} == {(i, i % 4 + 5, 1.0) for i in range(1000)}
    tied = spatial.nearest_with_ties(points, others, 2.0, "p", ["s"])
    assert {tuple(r) for r in tied.select("p", "s", "tied").collect()} == {(i, 0, True) for i in range(1000)}


def test_crowded_rooms_are_tried_by_size(spark, monkeypatch):
    """Rooms in heaps, with equal areas and a place in no room, against a loop; the rounds are made and what they leave is right."""
    made = []
    own = spatial._rooms_by_size
    monkeypatch.setattr(spatial, "ROOMS_AT_ONCE", 4)
    monkeypatch.setattr(spatial, "_rooms_by_size", lambda *a: made.append(1) or own(*a))
    boxes = [(i, i % 3 * 1.0, i * 7 % 20 * 1.0, 3.0 + i * 5 % 11, 2.0 + i % 4) for i in range(150)]
    rooms = spark.createDataFrame([(i, [(x, y), (x + w, y), (x + w, y + h), (x, y + h)], w * h) for i, x, y, w, h in boxes], "room_id long, ring array<struct<x:double,y:double>>, area double")
    spots = [(k, k % 12 + 0.5, k % 29 * 0.75) for k in range(200)] + [(200, 90.0, 90.0), (201, None, 1.0)]
    points = spark.createDataFrame(spots, "p long, x double, y double")
    held = lambda x, y: min(((w * h, i) for i, a, b, w, h in boxes if x is not None and a <= x <= a + w and b <= y <= b + h), default=(None, None))[1]
    got = {r["p"]: r["room_id"] for r in spatial.smallest_room(points, rooms, 4.0, "p").collect()}
    assert made and got == {k: held(x, y) for k, x, y in spots}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_listed_under_cells_are_not_broadcast(spark, tmp_path):
    """Small files, whose rows are listed under many cells: Spark reckons by the files."""
    spark.range(100).selectExpr("id", "cast(id AS double) AS x", "0D AS y").write.parquet(f"{tmp_path}/p")
    p = spark.read.parquet(f"{tmp_path}/p")
    assert "Broadcast" not in _plan(spatial.within_radius(p.select("id", "x", "y"), p.select(p["id"].alias("o"), "x", "y"), 2.0))
    bands = p.selectExpr("id AS d", "'red' AS colour", "named_struct('min_x', x, 'min_y', y, 'max_x', x + 9, 'max_y', y + 1) AS box")
    lines = p.selectExpr("id AS d", "'x' AS axis", "x AS at", "1 AS line")
    assert "Broadcast" not in _plan(stacks.bundle_readings(bands, lines, 1.0, 0.5, 0.1, ["d"]))


def test_catalogs_with_many_equal_requests_and_entries(spark):
    """400,000 requests of one key and 100,000 entries: not requests times entries (40,000,000,000 pairs before)."""
    day = "date'2024-01-01'"
    requests = spark.range(400000).selectExpr("id AS r", "'k' AS item", "id % 3 AS project_id", f"date_add({day}, cast(id % 10 AS int)) AS as_of")
    entries = spark.range(100000).selectExpr("id AS entry_id", "'k' AS item", "CASE WHEN id > 0 THEN id % 2 END AS project_id", f"date_add({day}, cast(CASE WHEN id < 3 THEN 5 ELSE 20 END AS int)) AS effective_start", "cast(NULL AS date) AS effective_end", "id * 1.0 AS value")
    got = catalog.select_as_of(requests, entries, ["item"], "r").groupBy(requests["project_id"], "as_of", "entry_id", "status").count()
    want = {(p, d, None if d < 5 else (2, 1, 0)[p], "missing" if d < 5 else "selected") for p in range(3) for d in range(10)}
    assert {(r[0], r[1].day - 1, r[2], r[3]) for r in got.collect()} == want
    formulas = entries.selectExpr("entry_id", "'k' AS formula_id", "least(entry_id, 9) AS version", "project_id")
    asked = requests.selectExpr("r", "'k' AS formula_id", "project_id", "CASE WHEN r % 2 = 0 THEN 3 END AS version")
    got = catalog.select_formulas(asked, formulas, "r").groupBy("project_id", "version", "entry_id", "status").count()
    ambiguous, missing = (None, "ambiguous"), (None, "missing")
    assert {tuple(r)[:4] for r in got.collect()} == {(p, v, *x) for p, v, x in [(0, 3, missing), (1, 3, (3, "selected")), (2, 3, missing), (0, None, ambiguous), (1, None, ambiguous), (2, None, (0, "selected"))]}


def test_texts_above_numbers_of_one_place(spark):
    numbers = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 59.0, 119.0)], "n long, x double, y double").selectExpr("1 AS g", "*")
    names = spark.createDataFrame([(1, 60.0, 1.0, "a"), (2, -60.0, 120.0, "b"), (3, 61.0, 5.0, "c"), (4, 0.0, 121.0, "d"), (5, 0.0, 0.0, "e")], "i long, x double, y double, text string").selectExpr("1 AS g", "*")
    found = takeoff.text_above(numbers, names, ["g"], 60.0, 120.0, "n", "i")
    assert {tuple(r) for r in found.collect()} == {(1, "b a"), (2, "b a"), (3, "d")}
    joined = [line for line in _plan(takeoff.text_above(numbers, names, ["g"], 60.0, 120.0, "n", "i")).splitlines() if "SortMergeJoin" in line]
    assert any("__a" in line for line in joined)


def test_service_takeoff_joins_without_broadcasting(spark):
    assert "BroadcastHashJoin" not in _plan(registry.queries()["service_takeoff"](spark, SF))


def test_chains_that_lie_together_need_no_rounds(spark, monkeypatch):
    def none(*_):
        raise AssertionError("rounds are made")

    monkeypatch.setattr(graph, "_rounds", none)
    chains = spark.range(300, numPartitions=2).selectExpr("id * 100 AS k", "explode(sequence(0, 6)) AS i").selectExpr("k + i AS u", "k + i + 1 AS v")
    got = {r["node"]: r["component"] for r in graph.min_label_components(chains).collect()}
    assert got == {k * 100 + i: k * 100 for k in range(300) for i in range(8)}


def test_components_of_links_cut_anywhere(spark, monkeypatch):
    """Random links, contracted a few at a time, of numbers and of texts, against a loop."""
    monkeypatch.setattr(graph, "CHUNK", 5)
    draw = random.Random(5)
    links = [(draw.randrange(600), draw.randrange(600)) for _ in range(330)] + [(700 + i, 701 + i) for i in range(60)] + [(900, 900), (901, None)]
    for name in (int, lambda i: f"é{i}"):
        named = [tuple(None if x is None else name(x) for x in link) for link in links]
        low = {x: x for u, v in named if u != v and v is not None for x in (u, v)}
        for _ in range(70):
            for u, v in named:
                if u in low and v in low:
                    low[u] = low[v] = min(low[u], low[v])
        kind = "long" if name is int else "string"
        got = graph.min_label_components(spark.createDataFrame(named, f"u {kind}, v {kind}").repartition(3)).collect()
        assert len(got) == len(low) and {r["node"]: r["component"] for r in got} == low


def test_equal_boxes_meet_windows_once(spark):
    """A thousand entities and a hundred windows at few places, one of a negative zero: lists are made for each different box."""
    box = lambda x, w: f"named_struct('min_x', {x}, 'min_y', 0D, 'max_x', {x} + {w}, 'max_y', 1D)"
    entities = spark.range(1000).selectExpr("id AS e", f"CASE WHEN id % 5 > 0 THEN {box('cast(id % 5 * 10 AS double)', '1')} END AS box").union(spark.range(1000, 1001).selectExpr("id", f"{box('-0D', '1')}"))
    windows = spark.range(100).selectExpr("id AS w", f"{box('cast(id % 4 * 10 AS double)', '12')} AS box")
    found = spatial.sheet_membership(entities, windows, "e", "w", 4.0)
    want = {0: None, 1: (0, 1), 2: (1, 2), 3: (2, 3), 4: (3,)}
    listed = lambda n: None if want[n] is None else [w for w in range(100) if w % 4 in want[n]]
    got = {r["e"]: (r["viewports"], r["on_sheet"]) for r in found.collect()}
    assert got == {e: (listed(e % 5), None if e % 5 == 0 else True) for e in range(1000)} | {1000: ([w for w in range(100) if w % 4 == 0], True)}
    assert "HashAggregate(keys=[__min_x" in _plan(found)


def test_tasks_of_changesets_and_estimates_follow_the_rows(spark, monkeypatch):
    """A hundred rows for a task: more tasks than the session's four, whatever its shuffle partitions are."""
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 100)
    for name in ("changeset_properties", "estimate_assembly"):
        dealt = [int(n) for n in re.findall(r"hashpartitioning\(.*?, (\d+)\)", _plan(registry.queries()[name](spark, SF)))]
        assert sum(n > 10 for n in dealt) >= 4, (name, dealt)


def test_rooms_of_points_are_made_once(spark):
    """Rooms with an expensive ring: the result reads what was written, not the rooms' own plan."""
    rooms = spark.range(50).selectExpr("id AS room_id", "transform(array(0, 1, 2, 3), i -> named_struct('x', id + (i % 2) * 1D, 'y', floor(i / 2) * 1D)) AS ring", "1D AS area")
    points = spark.range(50).selectExpr("id AS p", "id + 0.25D AS x", "0.1D AS y")
    held = spatial.smallest_room(points, rooms, 4.0, "p")
    assert held._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 50") == 2
    assert held.count() == 50
