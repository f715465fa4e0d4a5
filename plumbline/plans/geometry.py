"""Spatial, ordered and graph queries over points, labels and segments derived from the given keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import graph, spatial, windows
from plumbline.plans.base import LABELS, POINTS, SEGMENTS, V_LABELS, V_POINTS, V_SEGMENTS, Tables, query, select_list


def _points(t: Tables) -> DataFrame:
    return select_list(t.customer, POINTS)


def _labels(t: Tables) -> DataFrame:
    return select_list(t.supplier, LABELS)


def _segments(t: Tables) -> DataFrame:
    return select_list(t.orders, SEGMENTS)


BOXES = "p_partkey AS room_id, CAST((p_partkey * 61) % 950 AS DOUBLE) AS rx, CAST((p_partkey * 83) % 950 AS DOUBLE) AS ry, CAST(20 + p_size AS DOUBLE) AS w, CAST(10 + p_partkey % 37 AS DOUBLE) AS h"
V_BOXES = f"boxes AS (SELECT {BOXES} FROM part)"


def _boxes(t: Tables) -> DataFrame:
    b = select_list(t.part, BOXES)
    box = F.struct(F.col("rx").alias("min_x"), F.col("ry").alias("min_y"), (F.col("rx") + F.col("w")).alias("max_x"), (F.col("ry") + F.col("h")).alias("max_y"))
    return b.select("room_id", box.alias("box"), (F.col("w") * F.col("h")).alias("area"))


D = "sqrt((p.x - l.x) * (p.x - l.x) + (p.y - l.y) * (p.y - l.y))"


@query(f"""
WITH {V_POINTS}, {V_LABELS}, near AS (SELECT point_id, label_id, {D} AS d FROM points p, labels_at l WHERE abs(p.x - l.x) <= 60 AND {D} <= 60),
best AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, label_id) AS n FROM near)
SELECT p.point_id, b.label_id, round(d, 6) AS distance FROM points p LEFT JOIN best b ON p.point_id = b.point_id AND n = 1
""")
def nearest_tag(t: Tables) -> DataFrame:
    """Nearest label within reach, first by id on ties."""
    found = spatial.nearest_within(_points(t), _labels(t).drop("sheet"), 60.0, "point_id", ["label_id"], ["label_id"])
    return found.select("point_id", "label_id", F.round("distance", 6).alias("distance"))


@query(f"""
WITH {V_POINTS}, {V_LABELS}, near AS (SELECT p.point_id, l.label_id, {D} AS d FROM points p JOIN labels_at l ON p.sheet = l.sheet AND {D} <= 300),
best AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, label_id) AS n FROM near)
SELECT p.point_id, b.label_id FROM points p LEFT JOIN best b ON p.point_id = b.point_id AND n = 1
""")
def nearest_tag_on_sheet(t: Tables) -> DataFrame:
    """Nearest label of the same sheet, as a grid bubble finds its text."""
    return spatial.nearest_within(_points(t), _labels(t), 300.0, "point_id", ["label_id"], ["label_id"], ["sheet"]).select("point_id", "label_id")


@query(f"""
WITH {V_SEGMENTS}, {V_LABELS}, mid AS (SELECT segment_id, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM segments),
near AS (SELECT segment_id, 'S' || (label_id % 4) AS service, label_id % 3 AS size, {D} AS d FROM mid p, labels_at l WHERE {D} <= 50),
low AS (SELECT segment_id, min(d) AS low FROM near GROUP BY 1),
ties AS (SELECT n.* FROM near n JOIN low USING (segment_id) WHERE d <= low + 1e-9)
SELECT s.segment_id, k.service, k.size, k.tied FROM mid s LEFT JOIN (
  SELECT segment_id, arg_min(service, (service, size)) AS service, arg_min(size, (service, size)) AS size, count(*) > 1 AS tied FROM ties GROUP BY 1) k ON s.segment_id = k.segment_id
""")
def segment_labels(t: Tables) -> DataFrame:
    """Nearest label of each segment's midpoint, lexicographic on ties."""
    mid = _segments(t).select("segment_id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    labels = _labels(t).select("x", "y", F.concat(F.lit("S"), (F.col("label_id") % 4).cast("string")).alias("service"), (F.col("label_id") % 3).alias("size"))
    return spatial.nearest_with_ties(mid, labels, 50.0, "segment_id", ["service", "size"]).select("segment_id", "service", "size", "tied")


PSD = """sqrt((x - (x0 + t * (x1 - x0))) * (x - (x0 + t * (x1 - x0))) + (y - (y0 + t * (y1 - y0))) * (y - (y0 + t * (y1 - y0))))"""


@query(f"""
WITH {V_SEGMENTS}, {V_LABELS}, pairs AS (SELECT label_id, x, y, run_id, x0, y0, x1, y1, (x1-x0)*(x1-x0)+(y1-y0)*(y1-y0) AS size FROM labels_at, segments
  WHERE x BETWEEN least(x0,x1) - 25 AND greatest(x0,x1) + 25 AND y BETWEEN least(y0,y1) - 25 AND greatest(y0,y1) + 25),
placed AS (SELECT *, CASE WHEN size = 0 THEN 0.0 ELSE least(greatest(((x-x0)*(x1-x0)+(y-y0)*(y1-y0)) / size, 0.0), 1.0) END AS t FROM pairs),
runs AS (SELECT label_id, run_id, min({PSD}) AS d FROM placed WHERE {PSD} <= 25 GROUP BY ALL),
near AS (SELECT *, min(d) OVER (PARTITION BY label_id) AS low FROM runs),
best AS (SELECT label_id, min(run_id) AS run_id, min(d) AS d, count(*) > 1 AS ambiguous FROM near WHERE d <= low + 1e-9 GROUP BY 1)
SELECT l.label_id, b.run_id, round(b.d, 6) AS distance, b.ambiguous FROM labels_at l LEFT JOIN best b ON l.label_id = b.label_id
""")
def tag_runs(t: Tables) -> DataFrame:
    """Nearest run of a tag by point-to-segment distance."""
    found = spatial.nearest_run(_labels(t), _segments(t).select("run_id", "x0", "y0", "x1", "y1"), 25.0, "label_id", "run_id")
    return found.select("label_id", "run_id", F.round("distance", 6).alias("distance"), "ambiguous")


@query(f"""
WITH {V_POINTS}, {V_BOXES}, near AS (
  SELECT point_id, room_id, greatest(rx - x, 0, x - rx - w) AS dx, greatest(ry - y, 0, y - ry - h) AS dy FROM points, boxes),
hit AS (SELECT point_id, room_id, dx * dx + dy * dy AS d FROM near WHERE dx * dx + dy * dy <= 16),
best AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d > 0, d, room_id) AS n FROM hit)
SELECT p.point_id, b.room_id, b.d = 0 AS contained FROM points p LEFT JOIN best b ON p.point_id = b.point_id AND n = 1
""")
def terminal_devices(t: Tables) -> DataFrame:
    """Containing device box, else the nearest in reach."""
    return spatial.contained_or_nearest(_points(t), _boxes(t).drop("area"), 4.0, "point_id", "room_id").select("point_id", "room_id", "contained")


@query(f"""
WITH {V_POINTS}, {V_BOXES}, hit AS (
  SELECT point_id, room_id, row_number() OVER (PARTITION BY point_id ORDER BY w * h - (w / 2) * (h / 2), room_id) AS n FROM points, boxes
  WHERE x BETWEEN rx AND rx + w AND y BETWEEN ry AND ry + h AND NOT (x > rx + w / 2 AND y > ry + h / 2))
SELECT p.point_id, b.room_id FROM points p LEFT JOIN hit b ON p.point_id = b.point_id AND n = 1
""")
def rooms_of_points(t: Tables) -> DataFrame:
    """Smallest L-shaped ring that holds a point, boundary included."""
    b = _boxes(t)
    x0, y0, x1, y1 = (F.col(f"box.{c}") for c in ("min_x", "min_y", "max_x", "max_y"))
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, my), (mx, my), (mx, y1), (x0, y1))])
    rooms = b.select("room_id", ring.alias("ring"), F.abs(S.ring_area(ring)).alias("area"))
    return spatial.smallest_room(_points(t), rooms, 50.0, "point_id").select("point_id", "room_id")


@query(f"WITH {V_BOXES} SELECT room_id FROM boxes WHERE rx <= 400 AND rx + w >= 300 AND ry <= 520 AND ry + h >= 450")
def box_filter(t: Tables) -> DataFrame:
    """P5: boxes that meet a query box."""
    return spatial.box_filter(_boxes(t), 300.0, 450.0, 400.0, 520.0).select("room_id")


@query(f"WITH {V_BOXES} SELECT room_id FROM boxes WHERE greatest(rx - 500, 0, 500 - rx - w) * greatest(rx - 500, 0, 500 - rx - w) + greatest(ry - 500, 0, 500 - ry - h) * greatest(ry - 500, 0, 500 - ry - h) <= 22500")
def near_point_filter(t: Tables) -> DataFrame:
    """Boxes near a point."""
    return spatial.near_point(_boxes(t), 500.0, 500.0, 150.0).select("room_id")


@query(f"""
WITH {V_POINTS}, {V_LABELS}, env AS (SELECT sheet, min(x) - 100 AS ax, max(x) + 100 AS rx, min(y) - 100 AS ay, max(y) + 100 AS ry FROM labels_at GROUP BY 1),
near AS (SELECT p.point_id, l.label_id, row_number() OVER (PARTITION BY p.point_id ORDER BY {D}, l.label_id) AS n
  FROM points p JOIN env e ON p.sheet = e.sheet AND p.x BETWEEN ax AND rx AND p.y BETWEEN ay AND ry JOIN labels_at l ON l.sheet = p.sheet)
SELECT p.point_id, near.label_id FROM points p LEFT JOIN near ON p.point_id = near.point_id AND n = 1
""")
def voronoi_rooms(t: Tables) -> DataFrame:
    """Nearest anchor inside the grown envelope of its sheet."""
    found = spatial.bounded_voronoi(_points(t), _labels(t), 100.0, "point_id", "label_id", ["sheet"], 1600.0)
    return found.select("point_id", "label_id")


@query(f"""
WITH e AS (SELECT p_partkey AS entity_id, CASE WHEN p_partkey % 9 <> 0 THEN (p_partkey * 17) % 1000 END AS ex, (p_partkey * 29) % 1000 AS ey FROM part),
w AS (SELECT s_suppkey AS room_id, CAST((s_suppkey * 61) % 950 AS DOUBLE) AS rx, CAST((s_suppkey * 83) % 950 AS DOUBLE) AS ry, 70.0 AS w, 45.0 AS h FROM supplier),
hits AS (SELECT entity_id, string_agg(room_id, ',' ORDER BY room_id) AS v FROM e JOIN w ON ex <= rx + w.w AND ex + 30 >= rx AND ey <= ry + w.h AND ey + 20 >= ry GROUP BY 1)
SELECT e.entity_id, CASE WHEN ex IS NOT NULL THEN coalesce(v, '') END AS viewports, CASE WHEN ex IS NOT NULL THEN v IS NOT NULL END AS on_sheet FROM e LEFT JOIN hits ON e.entity_id = hits.entity_id
""")
def sheet_membership(t: Tables) -> DataFrame:
    """Viewports that an entity's extent meets; undetermined without an extent."""
    x, y = ((F.col("p_partkey") * 17) % 1000).cast("double"), ((F.col("p_partkey") * 29) % 1000).cast("double")
    box = F.struct(x.alias("min_x"), y.alias("min_y"), (x + 30).alias("max_x"), (y + 20).alias("max_y"))
    e = t.part.select(F.col("p_partkey").alias("entity_id"), F.when(F.col("p_partkey") % 9 != 0, box).alias("box"))
    wx, wy = ((F.col("s_suppkey") * 61) % 950).cast("double"), ((F.col("s_suppkey") * 83) % 950).cast("double")
    window = F.struct(wx.alias("min_x"), wy.alias("min_y"), (wx + 70).alias("max_x"), (wy + 45).alias("max_y"))
    windows_ = t.supplier.select(F.col("s_suppkey").alias("room_id"), window.alias("box"))
    found = spatial.sheet_membership(e, windows_, "entity_id", "room_id", 60.0)
    return found.select("entity_id", F.array_join(F.col("viewports").cast("array<string>"), ",").alias("viewports"), "on_sheet")


@query("""
WITH boxes AS (SELECT p_partkey // 400 AS sheet, p_partkey AS room_id, CAST((p_partkey * 61) % 950 AS DOUBLE) AS rx, CAST((p_partkey * 83) % 950 AS DOUBLE) AS ry, CAST(20 + p_size AS DOUBLE) AS w, CAST(10 + p_partkey % 37 AS DOUBLE) AS h FROM part),
s AS (SELECT o_orderkey // 3000 AS sheet, o_orderkey AS segment_id, CAST((o_orderkey * 37) % 900 AS DOUBLE) AS x0, CAST((o_orderkey * 91) % 900 AS DOUBLE) + 0.5 AS y, CAST((o_orderkey * 37) % 900 + 64 AS DOUBLE) AS x1 FROM orders),
met AS (SELECT s.*, room_id, rx, w, h FROM s JOIN boxes USING (sheet) WHERE y BETWEEN ry AND ry + h),
cuts AS (SELECT segment_id, x0 AS c FROM s UNION SELECT segment_id, x1 FROM s UNION SELECT segment_id, rx FROM met WHERE rx > x0 AND rx < x1 UNION SELECT segment_id, rx + w FROM met WHERE rx + w > x0 AND rx + w < x1),
parts AS (SELECT segment_id, c AS a, lead(c) OVER (PARTITION BY segment_id ORDER BY c) AS b FROM cuts),
own AS (SELECT p.segment_id, p.a, p.b, arg_min(room_id, (w * h, room_id)) AS room_id FROM parts p LEFT JOIN met m ON p.segment_id = m.segment_id AND (a + b) / 2 BETWEEN rx AND rx + w WHERE b IS NOT NULL GROUP BY ALL)
SELECT segment_id, room_id, round(sum(b - a), 6) AS length FROM own GROUP BY ALL
""")
def length_by_room(t: Tables) -> DataFrame:
    """Length split at every crossing with a room's ring, each part to the smallest room that holds it, the rest unassigned; on sheets of 400 rooms."""
    x0, y = ((F.col("o_orderkey") * 37) % 900).cast("double"), ((F.col("o_orderkey") * 91) % 900).cast("double") + 0.5
    s = t.orders.select(F.floor(F.col("o_orderkey") / 3000).alias("sheet"), F.col("o_orderkey").alias("segment_id"), x0.alias("x0"), y.alias("y0"), (x0 + 64).alias("x1"), y.alias("y1"))
    rooms = _boxes(t).withColumn("sheet", F.floor(F.col("room_id") / 400))
    found = spatial.split_by_boxes(s, rooms.select("sheet", "room_id", "box"), "segment_id", "room_id", 64.0, ["sheet"])
    return found.select("segment_id", "room_id", F.round("length", 6).alias("length"))


@query("""
WITH o AS (SELECT l_orderkey AS segment_id, l_linenumber AS band, l_discount * 4 AS overlap, round(l_tax * 2, 3) AS distance FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY overlap DESC, band) AS o_rank, row_number() OVER (PARTITION BY segment_id ORDER BY distance, band) AS d_rank, count(*) OVER (PARTITION BY segment_id) AS n FROM o),
s AS (SELECT segment_id, max(CASE WHEN o_rank = 1 THEN band END) AS o_band, max(overlap) AS top, max(CASE WHEN d_rank = 1 THEN band END) AS d_band,
  max(CASE WHEN d_rank = 1 THEN distance END) AS d1, max(CASE WHEN d_rank = 2 THEN distance END) AS d2, max(n) AS n FROM r GROUP BY 1)
SELECT segment_id, CASE WHEN top >= 0.3 THEN 'overlap' WHEN d1 < 0.1 AND (n = 1 OR d2 - d1 >= 0.02) THEN 'nearest' ELSE 'shared' END AS basis,
  CASE WHEN top >= 0.3 THEN o_band WHEN d1 < 0.1 AND (n = 1 OR d2 - d1 >= 0.02) THEN d_band END AS band FROM s
""")
def band_attribution(t: Tables) -> DataFrame:
    """Widest overlap, else the nearest band with a margin, else shared."""
    o = t.lineitem.select(F.col("l_orderkey").alias("segment_id"), F.col("l_linenumber").alias("band"), (F.col("l_discount") * 4).alias("overlap"), F.round(F.col("l_tax") * 2, 3).alias("distance"))
    return spatial.band_attribution(o, "segment_id", "band")


RUNS = """
w AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type = lag(event_type) OVER u THEN 0 ELSE 1 END AS s FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM w),
runs AS (SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS n FROM r GROUP BY user_id, run)
"""


@query(f"WITH {RUNS} SELECT * FROM runs")
def event_runs(t: Tables) -> DataFrame:
    """Run-length encoding."""
    return windows.run_length(t.events, ["user_id"], ["ts", "event_id"], "event_type")


@query(f"WITH {RUNS} SELECT * FROM runs WHERE n >= 2")
def stable_event_runs(t: Tables) -> DataFrame:
    """Runs of at least two."""
    return windows.stable_runs(t.events, ["user_id"], ["ts", "event_id"], "event_type", 2)


@query("""
WITH p AS (SELECT p_brand, p_partkey, p_size * 10 AS lo, p_size * 10 + p_partkey % 13 AS hi FROM part),
s AS (SELECT *, CASE WHEN max(hi) OVER w IS NULL OR lo - max(hi) OVER w > 8 THEN 1 ELSE 0 END AS s FROM p WINDOW w AS (PARTITION BY p_brand ORDER BY lo, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT p_brand, p_partkey, CAST(sum(s) OVER (PARTITION BY p_brand ORDER BY lo, p_partkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM s
""")
def gap_segments(t: Tables) -> DataFrame:
    """Segments at gaps."""
    rows = t.part.select("p_brand", "p_partkey", (F.col("p_size") * 10).cast("long").alias("lo"), (F.col("p_size") * 10 + F.col("p_partkey") % 13).alias("hi"))
    return windows.gap_segments(rows, ["p_brand"], "lo", "hi", 8, ["p_partkey"]).select("p_brand", "p_partkey", "segment")


@query("""
WITH RECURSIVE v AS (SELECT DISTINCT p_brand, CAST(p_size AS DOUBLE) AS s FROM part),
k AS (SELECT p_brand, min(s) AS s FROM v GROUP BY 1 UNION ALL SELECT p_brand, s FROM (SELECT k.p_brand, (SELECT min(v.s) FROM v WHERE v.p_brand = k.p_brand AND v.s - k.s > 5) AS s FROM k) WHERE s IS NOT NULL)
SELECT p_brand, s AS p_size FROM k
""")
def spaced_values(t: Tables) -> DataFrame:
    """Values further than the tolerance from the last kept one."""
    return windows.spaced(t.part.select("p_brand", F.col("p_size").cast("double").alias("p_size")), ["p_brand"], "p_size", 5.0)


@query("""
WITH g AS (SELECT p_brand, p_size, lead(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) - p_size AS gap FROM (SELECT DISTINCT p_brand, p_size FROM part)),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY gap DESC, p_size) AS n FROM g WHERE gap IS NOT NULL),
two AS (SELECT p_brand, max(CASE WHEN n = 1 THEN p_size END) AS cut_after, max(CASE WHEN n = 1 THEN gap END) AS gap, max(CASE WHEN n = 2 THEN gap END) AS second FROM r GROUP BY 1)
SELECT p_brand, cut_after, gap FROM two WHERE gap >= 2 AND (second IS NULL OR gap > 1.2 * second)
""")
def outlier_gaps(t: Tables) -> DataFrame:
    """A gap that stands out."""
    return windows.outlier_gap(t.part, ["p_brand"], "p_size", 1.2, 2)


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, lead(o_orderkey) OVER w AS next_o_orderkey, lead(o_totalprice) OVER w AS next_o_totalprice FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, o_orderkey, next_o_orderkey, round(next_o_totalprice - o_totalprice, 4) AS change FROM o WHERE next_o_orderkey IS NOT NULL
""")
def consecutive_pairs(t: Tables) -> DataFrame:
    """Consecutive points of a path."""
    found = windows.consecutive(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])
    return found.select("o_custkey", "o_orderkey", "next_o_orderkey", F.round(F.col("next_o_totalprice") - F.col("o_totalprice"), 4).alias("change"))


@query("""
SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER w AS n, lead(l_quantity) OVER w AS nx FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber))
WHERE n = 1 AND (nx IS NULL OR nx - l_quantity >= 5)
""")
def best_with_margin(t: Tables) -> DataFrame:
    """The best of a group where its lead is wide enough."""
    return windows.best_with_margin(t.lineitem, ["l_orderkey"], "l_quantity", ["l_linenumber"], 5).select("l_orderkey", "l_linenumber")


@query("SELECT l_partkey AS device_id, min(l_orderkey) AS circuit_id FROM lineitem GROUP BY 1")
def first_claims(t: Tables) -> DataFrame:
    """Each item goes to its lowest claimant."""
    return windows.first_claims(t.lineitem.select(F.col("l_partkey").alias("device_id"), F.col("l_orderkey").alias("circuit_id")), "device_id", "circuit_id")


@query("SELECT c_custkey, 'label-room-' || (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) - 1) AS room FROM customer")
def numbered_rooms(t: Tables) -> DataFrame:
    """Ids by order."""
    return windows.numbered_ids(t.customer, ["c_nationkey"], ["c_name", "c_custkey"], "label-room-", "room").select("c_custkey", "room")


@query("""
SELECT p_type, p_brand, n FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS r FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL)) WHERE r = 1
""")
def dominant_size(t: Tables) -> DataFrame:
    """Most frequent value, first on a tie."""
    return windows.dominant(t.part, ["p_type"], "p_brand")


@query(f"""
WITH {V_POINTS} SELECT sheet, max(x) - min(x) AS dx, max(y) - min(y) AS dy,
  CASE WHEN max(x) > min(x) AND max(y) - min(y) <= 0.97 * (max(x) - min(x)) THEN 'horizontal' WHEN max(y) > min(y) AND max(x) - min(x) <= 0.97 * (max(y) - min(y)) THEN 'vertical' ELSE 'none' END AS axis FROM points GROUP BY 1
""")
def reading_axes(t: Tables) -> DataFrame:
    """Reading axis by spread."""
    return windows.reading_axis(_points(t), ["sheet"], "x", "y", 0.97)


#: Rounds of smallest labels in SQL: more than the longest shortest path between two nodes of this dense graph.
LABELS_SQL = "".join(
    f", l{i} AS MATERIALIZED (SELECT l.node, least(min(l.low), min(m.low)) AS low FROM l{i - 1} l JOIN both_ways b ON l.node = b.u JOIN l{i - 1} m ON m.node = b.v GROUP BY 1)" for i in range(1, 13)
)


@query(f"""
WITH edges AS (SELECT DISTINCT l_partkey AS u, l_suppkey + 10000000 AS v FROM lineitem), both_ways AS MATERIALIZED (SELECT u, v FROM edges UNION SELECT v, u FROM edges), l0 AS MATERIALIZED (SELECT DISTINCT u AS node, u AS low FROM both_ways)
{LABELS_SQL} SELECT node, low AS component FROM l12
""")
def components(t: Tables) -> DataFrame:
    """G1: connected components of all links by the smallest node."""
    return graph.min_label_components(t.lineitem.select(F.col("l_partkey").alias("u"), (F.col("l_suppkey") + 10000000).alias("v")))


def _chains(t: Tables) -> DataFrame:
    """(edge, u, v): the lines of each order as edges one after the other."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1
    edge = F.col("l_orderkey") * 100 + F.col("i")
    return t.lineitem.select("l_orderkey", place.alias("i")).select(edge.alias("edge"), edge.alias("u"), (edge + 1).alias("v"))


@query("""
SELECT l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS row_id, l_orderkey AS component, count(*) OVER (PARTITION BY l_orderkey) AS size FROM lineitem
""")
def component_sizes(t: Tables) -> DataFrame:
    """G1: rows that share a node are a component, with its size: the lines of an order as a chain of two nodes each."""
    found = graph.component_sizes(_chains(t).withColumnRenamed("edge", "row_id"), "row_id", ["u", "v"])
    return found.select("row_id", F.floor(F.col("component") / 100).alias("component"), "size")


@query("""
WITH lines AS (SELECT l_orderkey, min(l_linenumber) AS low, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey AS o, n AS n_edges, CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey * 100 + low END AS anchor FROM lines
""")
def cable_circuits(t: Tables) -> DataFrame:
    """Connected edges are a circuit, with the lowest device at its nodes as anchor and its number of edges."""
    k = F.col("l_orderkey") * 100
    devices = t.lineitem.where("l_orderkey % 3 = 0").select((k + 0).alias("node"), (k + F.col("l_linenumber")).alias("device"))
    found, _ = graph.circuits(_chains(t), devices, "edge", "device")
    return found.select(F.floor(F.col("circuit_id") / 100).alias("o"), "n_edges", "anchor")


@query(f"""
WITH {V_SEGMENTS}, e AS (SELECT layer_ref, round_even(x0 / 20, 0)::BIGINT || ':' || round_even(y0 / 20, 0)::BIGINT AS node FROM segments UNION ALL SELECT layer_ref, round_even(x1 / 20, 0)::BIGINT || ':' || round_even(y1 / 20, 0)::BIGINT FROM segments)
SELECT layer_ref, layer_ref || ':' || node AS node, count(*) AS degree, count(*) = 1 AS terminal FROM e GROUP BY layer_ref, node
""")
def cable_topology(t: Tables) -> DataFrame:
    """Nodes of snapped endpoints of each layer with degree and terminals."""
    nodes, _ = graph.topology(_segments(t), 20.0, group=["layer_ref"])
    return nodes.select("layer_ref", "node", "degree", "terminal")


@query("""
WITH RECURSIVE c AS (SELECT p_partkey AS k, CASE WHEN p_partkey > 3 THEN p_partkey // 3 END AS p FROM part),
walk AS (SELECT k, k AS root, 0 AS depth, CAST(k AS VARCHAR) AS path FROM c WHERE p IS NULL UNION ALL SELECT c.k, w.root, w.depth + 1, w.path || '/' || c.k FROM walk w JOIN c ON c.p = w.k WHERE w.depth < 8)
SELECT * FROM walk
""")
def block_tree(t: Tables) -> DataFrame:
    """Instance tree with depth cap and paths."""
    k = F.col("p_partkey")
    rows = t.part.select(k.alias("k"), F.when(k > 3, F.floor(k / 3)).alias("p"))
    found = graph.tree_walk(rows, "k", "p", rows.where("p is null").select("k"), 8)
    return found.withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/"))


@query("""
WITH RECURSIVE e AS (SELECT o_orderkey AS k, o_orderkey // 8 AS p, o_custkey % 7 + 1 AS w FROM orders WHERE o_orderkey >= 32),
walk AS (SELECT o_orderkey AS source, o_orderkey AS node, 0::DOUBLE AS distance FROM orders WHERE o_orderkey < 32 AND o_orderkey >= 4 UNION ALL SELECT source, e.k, distance + w FROM walk JOIN e ON e.p = node)
SELECT * FROM walk
""")
def home_runs(t: Tables) -> DataFrame:
    """Shortest paths from several sources at once, over trays that branch and have longer doubles."""
    k, w = F.col("o_orderkey"), F.col("o_custkey") % 7 + 1
    known = t.orders.where("o_orderkey >= 32").select(k.alias("u"), F.floor(k / 8).alias("v"), w.alias("weight"))
    doubles = t.orders.where("o_orderkey >= 32 and o_orderkey % 3 = 0").select(F.floor(k / 8), k, w + 5)
    return graph.shortest_paths(known.union(doubles), t.orders.where("o_orderkey between 4 and 31").select(k.alias("source"), k.alias("node")))


@query("""
WITH p AS (SELECT l_partkey AS i, l_suppkey AS j, min(l_extendedprice) AS price FROM lineitem GROUP BY ALL), o AS (SELECT list([i, j] ORDER BY price, i, j) AS pairs FROM p),
w AS (SELECT list_reduce(list_prepend([]::BIGINT[], pairs), lambda t, x: CASE WHEN list_contains(t, x[1]) OR list_contains(t, x[2]) THEN t ELSE list_concat(t, x) END) AS used FROM o),
k AS (SELECT used, unnest(range(1, len(used), 2)) AS n FROM w)
SELECT i, j, price AS cost FROM k JOIN p ON i = used[n] AND j = used[n + 1]
""")
def rail_pairs(t: Tables) -> DataFrame:
    """Greedy mutual pairing by cost, as rails pair."""
    pairs = t.lineitem.groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.min("l_extendedprice").alias("price"))
    return graph.greedy_pairs(pairs, "price")
