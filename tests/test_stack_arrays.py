"""The stack matching over arrays against the one in joins, and its pass over batches."""

import random
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.operators import arrays, stack_arrays, stacks
from plumbline.sources.tables import Scratch

TAGS = "job int, rev string, tag_id string, x double, y double, service string, size int, kind string"
HEADERS = "job int, rev string, header_id int, text string, x double, y double"
BANDS = "job int, rev string, colour string, ring array<struct<x:double,y:double>>"
KEYS = ["job", "rev"]


def drawings(spark):
    r = random.Random(5)
    tags, headers, bands = [], [], []
    for d in range(60):
        key = (d % 2, f"r{d // 2}")
        services = [r.choice(("SA", "EA")) for _ in range(r.randrange(2, 5))]
        for stack in range(r.choice((1, 1, 2))):
            for i, s in enumerate(services):
                tags.append((*key, f"t{stack}{i}", 30.0 * stack + r.choice((0.0, 0.05)), 0.5 * i if r.random() < 0.95 else None, s if r.random() < 0.95 else None, r.choice((50, None)), r.choice(("round", "", None))))
            headers.append((*key, stack, r.choice(("from top to  bottom", "Bottom to top", "left to right", "note", None)), 30.0 * stack, r.choice((-0.3, None, -0.3, -0.3))))
        for again in range(r.choice((1, 1, 2))):
            for i, s in enumerate(services if r.random() < 0.7 else services[::-1]):
                low = 12.0 * again + r.choice((0.3, 0.21)) * i
                bands.append((*key, {"SA": "red", "EA": r.choice(("blue", "blue", None))}[s], [(0.0, low), (10.0 + 0.5 * i, low), (10.0 + 0.5 * i, low + 0.2), (0.0, low + 0.2)]))
        bands.append((*key, "red", []))
    return spark.createDataFrame(tags, TAGS), spark.createDataFrame(headers, HEADERS), spark.createDataFrame(bands, BANDS)


def told(found):
    return [sorted(map(repr, df.select(*[c for c in df.columns if c != "kind"]).collect())) for df in found]


def test_arrays_and_joins_and_both_agree(spark):
    tables = [df.cache() for df in drawings(spark)]
    want = told(stacks.match_large_stacks(*tables, 4.0, KEYS))
    assert len(want[0]) > 5 and len({v.split("verdict=")[1] for v in want[2]}) > 4
    assert told(stacks.match_stacks(*tables, 4.0, KEYS)) == want
    assert told(stacks.match_stacks(*tables, 4.0, KEYS, most=9)) == want


def test_rows_are_dealt_once_and_one_table_is_written(spark, monkeypatch):
    plans, write = [], Scratch.table

    def table(self, df, *args, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, *args, **options)

    monkeypatch.setattr(Scratch, "table", table)
    stacks.match_stacks(*drawings(spark), 4.0, KEYS)
    assert len(plans) == 1 and "Join" not in plans[0]


def test_batches_of_any_size_give_the_same(spark, monkeypatch):
    tags, headers, bands = drawings(spark)
    sides = bands.where(F.size("ring") > 2).select(*KEYS, F.lit(2).alias("__k"), "colour", stacks.ring_box(F.col("ring")).alias("b")).select(*KEYS, "__k", "colour", "b.*")
    rows = tags.withColumn("__k", F.lit(0)).unionByName(headers.select(*KEYS, F.lit(1).alias("__k"), "header_id", "x", "y", F.lit(0).alias("said")), allowMissingColumns=True)
    table = rows.unionByName(sides, allowMissingColumns=True).repartition(1).sortWithinPartitions(*KEYS).toArrow()
    tolerances = stacks.Tolerances()

    def run(held, batch, most):
        monkeypatch.setattr(arrays, "ROWS", held)
        out = pa.Table.from_batches(arrays.passes(KEYS, most, stack_arrays.fields, partial(stack_arrays.match, tolerances=tolerances, keys=KEYS))(iter(table.combine_chunks().to_batches(batch))))
        return sorted(map(repr, out.to_pylist()))

    monkeypatch.setattr(stack_arrays, "MET", 3)
    whole = run(1 << 20, 1 << 20, 1 << 20)
    assert len(whole) > 60 and run(5, 3, 1 << 20) == whole
    large = [v for v in run(4, 2, 9) if "'__o': 3" in v]
    sizes = rows.unionByName(sides, allowMissingColumns=True).groupBy(*KEYS).count().where("count > 9").count()
    assert len(large) == len(set(large)) == sizes > 0


def test_many_stacks_and_readings_that_say_the_same_go_through_joins(spark, monkeypatch):
    tags = [(1, "a", f"t{k}{i}", 30.0 * k, 1.0 * i, s, 50, None) for k in range(16) for i, s in enumerate(("SA", "EA"))] + [(1, "b", "t", 0.0, 0.0, "SA", 1, None), (1, "b", "u", 0.0, 1.0, "EA", 1, None)]
    headers = [(1, rev, k, "top to bottom", 30.0 * k, -0.3) for rev, n in (("a", 16), ("b", 1)) for k in range(n)]
    box = lambda x, y: [(0.0, y), (x, y), (x, y + 0.2), (0.0, y + 0.2)]
    bands = [(1, "a", c, box(10.0 + 0.5 * i, 9.0 * i + y)) for i in range(30) for c, y in (("red", 0.0), ("blue", 0.3))] + [(1, "b", c, box(x, y)) for x in (10.0, 11.0) for c, y in (("red", 0.0), ("blue", 0.3))]
    tables = [spark.createDataFrame(v, t) for v, t in ((tags, TAGS), (headers, HEADERS), (bands, BANDS))]
    joined, by_joins = [], stacks.match_large_stacks
    monkeypatch.setattr(stacks, "match_large_stacks", lambda *a: joined.append(a[0].select("rev").distinct().collect()) or by_joins(*a))
    assert told(stacks.match_stacks(*tables, 4.0, KEYS)) == told(by_joins(*tables, 4.0, KEYS))
    assert [[r["rev"] for r in rows] for rows in joined] == [["a"]]


def test_lines_keep_their_distance_from_the_last_kept():
    g, at, number = stack_arrays._lines(np.array([0, 0, 0, 0, 1, 0]), np.array([0.0, 2.0, 1.0, 5.0, 1.0, 3.0]), 1.5)
    assert list(zip(g, at, number)) == [(0, 0.0, 1), (0, 2.0, 2), (0, 5.0, 3), (1, 1.0, 1)]
