"""Edge cases of the operators that the given tables don't hold."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import catalog, diff, estimate, graph, paging, quantities, spatial, windows


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_conflicting_group_contributes_nothing(spark):
    df = spark.createDataFrame([(1, "h", 10.0, 1), (2, "h", 10.0, 2), (3, "h", 11.0, 3), (4, "g", 5.0, 4), (5, "g", 5.0, 5)], "id int, k string, v double, seq int")
    assert rows(quantities.primaries(df, ["k"], ["v"], ["seq"])) == [(4, "g", 5.0, 4)]
    found = {r["k"]: r for r in quantities.deduplicate(df, ["k"], ["v"], ["seq"], "id").collect()}
    assert found["h"]["conflict"] and not found["g"]["conflict"] and found["g"]["n_rows"] == 2
    assert rows(quantities.duplicates(df, quantities.deduplicate(df, ["k"], ["v"], ["seq"], "id"), ["k"], "id")) == [("g", 4, 5)]
    odd = spark.createDataFrame([(1, None, 5.0, 1), (1, 5.0, None, 2), (2, None, 5.0, 1), (2, None, 5.0, 2)], "k int, a double, b double, o int")
    assert rows(quantities.primaries(odd, ["k"], ["a", "b"], ["o"])) == [(2, None, 5.0, 1)]


def test_exact_totals_whatever_the_order(spark):
    df = spark.createDataFrame([("a", 0.1)] * 10, "k string, v double")
    assert str(quantities.totals(df, ["k"], "v").first()["total"]) == "1.000000000"


def test_project_scope_shadows_global_and_ends_are_open(spark):
    day = date(2024, 5, 1)
    entries = [(1, "k", None, day, None, 1.0), (2, "k", 7, day, None, 2.0), (3, "m", None, date(2024, 1, 1), day, 3.0), (4, "n", None, day, None, 4.0), (5, "n", None, day, None, 5.0)]
    e = spark.createDataFrame(entries, "entry_id int, item string, project_id int, effective_start date, effective_end date, value double")
    r = spark.createDataFrame([(1, "k", 7, day), (2, "k", 8, day), (3, "m", 7, day), (4, "n", 7, day)], "request int, item string, project_id int, as_of date")
    got = {x["request"]: (x["entry_id"], x["status"]) for x in catalog.select_as_of(r, e, ["item"], "request").collect()}
    assert got == {1: (2, "selected"), 2: (1, "selected"), 3: (None, "missing"), 4: (None, "ambiguous")}


def test_formula_contracts(spark):
    inputs = {"q": ("q", "quantity")}
    lit = lambda v, c="scalar": {"kind": "literal", "value": v, "contract": c}
    q = {"kind": "input", "name": "q"}
    df = spark.createDataFrame([("2.5",)], "q string")
    made = estimate.formula_lines(df, {"kind": "multiply", "args": [lit("19.99", "rate"), q]}, inputs)
    assert str(made.first()["amount"]) == "49.98"
    for bad in ({"kind": "add", "args": [q, lit("1")]}, {"kind": "multiply", "args": [q, q]}, {"kind": "divide", "args": [lit("1"), q]}, {"kind": "input", "name": "z"}, {"kind": "pow", "args": [q, q]}):
        with pytest.raises(estimate.FormulaError):
            estimate.compile_formula(bad, inputs)


def test_diff_takes_the_last_of_repeated_keys(spark):
    schema = "key string, digest string, seq int"
    base = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", None, 1), (None, "x", 1)], schema)
    other = spark.createDataFrame([("a", "2", 1), ("b", None, 1), ("c", "1", 1)], schema)
    assert rows(diff.keyed_diff(base, other, "key", "digest", "seq")) == [("a", "unchanged"), ("b", "unchanged"), ("c", "added")]


def test_changeset_with_an_unknown_target_aborts_whole(spark):
    entities = spark.createDataFrame([("e1", "A"), ("e2", "A")], "entity string, layer string")
    schema = "s int, entity string, operation_type string, value string, sequence_index int"
    ops = [(1, "e1", "change_layer", "B", 1), (1, "zz", "remove_entity", None, 2), (2, "e1", "change_layer", "B", 1), (2, "e1", "change_layer", "A", 2), (2, "n", "add_entity", "C", 3), (2, "n", "change_layer", "D", 4), (2, "e2", "flag_for_review", None, 5)]
    got = rows(diff.apply_changesets(entities, spark.createDataFrame(ops, schema), "s", "entity", "layer"))
    assert got == [(2, "e1", 0, "A", "changed"), (2, "e2", 0, "A", "metadata_only"), (2, "n", 1, "D", "added")]


def test_page_limits_and_cycles(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4)], "k int, p int")
    with pytest.raises(ValueError):
        paging.keyset_page(df, ["k"], limit=0)
    assert rows(paging.dependency_depth(df, "k", "p").select("k", "depth")) == [(1, 0), (2, 1), (3, 2), (4, None), (5, None)]


def test_points_on_edges_are_inside(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (10.0, 0.0), (10.0, 5.0), (5.0, 5.0), (5.0, 10.0), (0.0, 10.0))])
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 7.0, 7.0), (3, 0.0, 3.0), (4, 4.0, 9.0), (5, 10.0, 5.0), (6, -1.0, 5.0)], "id int, x double, y double")
    got = pts.select("id", S.inside_ring(F.col("x"), F.col("y"), ring).alias("i"), S.ring_area(ring).alias("a")).collect()
    assert {r["id"] for r in got if r["i"]} == {1, 3, 4, 5} and got[0]["a"] == 75.0


def test_split_lengths_cover_the_segment(spark):
    box = "struct<min_x:double,min_y:double,max_x:double,max_y:double>"
    boxes = spark.createDataFrame([("big", (0.0, 0.0, 10.0, 10.0)), ("small", (2.0, 0.0, 4.0, 10.0))], f"room string, box {box}")
    s = spark.createDataFrame([(1, -5.0, 5.0, 15.0, 5.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    got = {r["room"]: round(r["length"], 9) for r in spatial.split_by_boxes(s, boxes, "id", "room", 5.0).collect()}
    assert got == {None: 10.0, "big": 8.0, "small": 2.0}


def test_runs_with_nulls_and_rows_without_nodes(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "a"), (1, 4, None)], "g int, o int, v string")
    assert [(r["v"], r["n"]) for r in windows.run_length(df, ["g"], ["o"], "v").orderBy("run").collect()] == [(None, 2), ("a", 1), (None, 1)]
    lines = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "x", "y"), (4, None, None)], "id int, u string, v string")
    assert rows(graph.component_sizes(lines, "id", ["u", "v"])) == [(1, "a", 2), (2, "a", 2), (3, "x", 1), (4, None, 1)]


def test_empty_tables_stay_empty(spark):
    e = spark.createDataFrame([], "u long, v long")
    assert graph.min_label_components(e).count() == 0
    assert graph.greedy_pairs(spark.createDataFrame([], "i int, j int, c double"), "c").count() == 0


def test_dependency_depth_has_no_last_level(spark):
    chain = [(0, None)] + [(i, i - 1) for i in range(1, 70)] + [(100, 101), (101, 100), (102, 101)]
    df = spark.createDataFrame(chain, "k int, p int")
    assert dict(rows(paging.dependency_depth(df, "k", "p").select("k", "depth"))) == {i: i for i in range(70)} | {100: None, 101: None, 102: None}
    with pytest.raises(RuntimeError):
        paging.dependency_depth(df.where("k < 6"), "k", "p", max_depth=3)
    again = spark.createDataFrame([(1, None), (1, 2), (2, 1)], "k int, p int")
    assert {r["k"]: r["depth"] for r in paging.dependency_depth(again, "k", "p").collect()} == {1: 0, 2: 1}


def test_greedy_pairs_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1, float(i)) for i in range(900)], "i int, j int, c double")
    assert {r["i"] for r in graph.greedy_pairs(chain, "c").collect()} == set(range(0, 900, 2))
    odd = [(i, i + 1, float(i)) for i in range(8)] + [(50, 51, 0.0), (50, 51, 0.0), (60, None, 0.5), (60, 61, 1.0), (60, 62, 0.1), (70, 70, 1.0), (None, 71, 0.0), (71, 72, 3.0)]
    df = spark.createDataFrame(odd, "i int, j int, c double")
    want = sorted([(0, 1), (2, 3), (4, 5), (6, 7), (50, 51), (50, 51), (60, 62), (70, 70)])
    for small in (0, 3, 10_000):
        assert sorted((r["i"], r["j"]) for r in graph.greedy_pairs(df, "c", small=small).collect()) == want
