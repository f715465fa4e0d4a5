import math
import random

import pytest

from plumbline.operators import rails
from plumbline.sources.tables import Scratch

SCHEMA = "sheet int, rail string, x0 double, y0 double, x1 double, y1 double"


def drawn(seed: int, n: int) -> list[tuple]:
    """Rails at few places, many of equal length, both ways round, some askew; ids aren't in the order of places."""
    r = random.Random(seed)
    places = []
    for _ in range(14):
        x, y, l = r.randrange(6) * 2.0, r.choice([r.randrange(8) * 0.5, r.random() * 4]), r.choice([5.0, 5.0, 6.0, 7.5])
        line = (x, y, x + l, y + r.choice([0.0, 0.0, 0.3]))
        places.append(line if r.random() < 0.7 else line[2:] + line[:2])
    ids = [f"r{i:04d}" for i in range(n)]
    r.shuffle(ids)
    return [(i % 2, ids[i], *r.choice(places)) for i in range(n)]


def slowly(lines: list[tuple], least: float) -> list[tuple]:
    """(sheet, length) of midlines, by all pairs of rails."""
    found = []
    for s, i, *p in lines:
        for t, j, *q in lines:
            (dx, dy), (ex, ey) = (p[2] - p[0], p[3] - p[1]), (q[2] - q[0], q[3] - q[1])
            l, m = math.sqrt(dx * dx + dy * dy), math.sqrt(ex * ex + ey * ey)
            if s != t or i == j or not (l > m or l == m and i < j) or abs(dx * ex + dy * ey) / (l * m) < 0.985:
                continue
            a, b = (((q[k] - p[0]) * dx + (q[k + 1] - p[1]) * dy) / l for k in (0, 2))
            perp = abs(((q[0] + q[2]) / 2 - p[0]) * dy - ((q[1] + q[3]) / 2 - p[1]) * dx) / l
            if least <= perp <= 2.0 and max(min(l, max(a, b)) - max(0.0, min(a, b)), 0.0) / m >= 0.5:
                e = q if dx * ex + dy * ey >= 0 else q[2:] + q[:2]
                mid = [(u + v) / 2 for u, v in zip(p, e)]
                found.append((perp, s, i, j, math.hypot(mid[2] - mid[0], mid[3] - mid[1])))
    used, out = set(), []
    for _, s, i, j, length in sorted(found):
        if not {(s, i), (s, j)} & used:
            used |= {(s, i), (s, j)}
            out.append((s, round(length, 6)))
    return sorted(out)


@pytest.mark.parametrize("small,least", [(1 << 21, 0.01), (1 << 21, 0.0), (12, 0.0)])
def test_rails_at_few_places_pair_as_all_pairs_in_order(spark, small, least):
    for seed in range(2 if small > 12 else 1):
        lines = drawn(seed, 90 if small > 12 else 44)
        parts = rails.centreline_parts(spark.createDataFrame(lines, SCHEMA), "rail", ["sheet"], small=small, least=least).collect()
        want = slowly(lines, least)
        assert want and sorted((r["sheet"], round(r["length"], 6)) for r in parts if r["kind"] == "midline") == want
        assert sum(r["kind"] == "rail" for r in parts) == len(lines) - 2 * len(want)


def test_rails_without_groups_and_without_partners(spark):
    df = spark.createDataFrame([(0, "a", 0.0, 0.0, 9.0, 0.0), (0, "b", 0.0, 1.0, 8.0, 1.0), (0, "c", 0.0, 50.0, 8.0, 50.0), (0, None, 0.0, 1.5, 8.0, 1.5)], SCHEMA)
    assert sorted(r["kind"] for r in rails.centreline_parts(df, "rail").collect()) == ["midline", "rail", "rail"]
    assert rails.centreline_parts(df.limit(0), "rail", ["sheet"]).count() == 0
    assert [r["kind"] for r in rails.centreline_parts(df.where("rail = 'c'"), "rail", ["sheet"]).collect()] == ["rail"]


def test_rails_at_two_places_write_no_row_for_each_two_of_them(spark, monkeypatch):
    sizes, write = [], Scratch.table

    def table(self, df, name, *args, **options):
        made = write(self, df, name, *args, **options)
        sizes.append((made.count(), name))
        return made

    monkeypatch.setattr(Scratch, "table", table)
    lines = [(1, f"{i:04d}", 0.0, float(i % 2), 10.0 + i % 2, float(i % 2)) for i in range(600)]
    got = rails.centrelines(spark.createDataFrame(lines, SCHEMA), "rail", ["sheet"]).select("n_pairs", "n_unpaired").collect()
    assert [tuple(r) for r in got] == [(300, 0)] and max(sizes)[0] <= 600
