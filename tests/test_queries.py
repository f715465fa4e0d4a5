"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from plumbline import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    """A value as comparable text; numbers rounded, null as one mark."""
    if v is None or type(v).__name__ in ("NAType", "NaTType") or v != v:
        return "null"
    if isinstance(v, bool) or type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    try:
        return f"{round(float(v), 5):.5f}".replace("-0.00000", "0.00000")
    except (TypeError, ValueError):
        return str(v)


def canonical(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, row)) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_its_sql(spark, db, name):
    got = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got.count() >= 0
        return
    assert canonical(got.toPandas()) == canonical(db.execute(sql).fetchdf())


def test_rail_pairs_match_a_greedy_loop(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").collect()
    best = {}
    for r in rows:
        key = (r["l_partkey"], r["l_suppkey"])
        best[key] = min(best.get(key, float("inf")), r["l_extendedprice"])
    taken_i, taken_j, want = set(), set(), set()
    for (i, j), cost in sorted(best.items(), key=lambda x: (x[1], x[0])):
        if i not in taken_i and j not in taken_j and i not in taken_j and j not in taken_i:
            taken_i.add(i)
            taken_j.add(j)
            want.add((i, j, cost))
    got = {tuple(r) for r in registry.queries()["rail_pairs"](spark, SF).collect()}
    assert got == want


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(registry.oracle_sql()) <= set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
