"""Connectivity, tag-stack and device queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import bands, legend, normalize, runs, spatial
from plumbline.plans.attribution import _rgb
from plumbline.plans.base import LABELS, POINTS, SEGMENTS, V_LABELS, V_POINTS, V_SEGMENTS, Tables, query, select_list
from plumbline.plans.geometry import V_BOXES, _boxes


@query("""
WITH s AS (SELECT p_partkey AS k, p_partkey // 10 AS c, p_partkey % 10 AS i, p_brand FROM part), own AS (SELECT c, p_brand FROM s WHERE i = 0)
SELECT k AS segment_id, CAST(n AS INT) AS part, round(CASE WHEN i = 5 THEN CASE WHEN n = 1 THEN 0.24 ELSE 0.76 END WHEN i = 7 THEN 0.1 ELSE 1.0 END, 6) AS length,
  CASE WHEN i IN (0, 1, 7) THEN own.p_brand WHEN i = 4 THEN 'fit' WHEN i = 6 THEN 'tee' WHEN i = 5 THEN NULL END AS colour
FROM s LEFT JOIN own ON s.c = own.c, (SELECT unnest([1, 2]) AS n) WHERE n = 1 OR i = 5
""")
def connectivity_refinement(t: Tables) -> DataFrame:
    """Shared segments cut at tees adopt their neighbours' colour in one pass, then that of the fitting that holds an end.

    Ten segments in a row of their own: the coloured one (0), a collinear neighbour (1) and a short one aslant of it (7), which adopt;
    one whose end is in a fitting (4); one that a coloured branch (6) meets in its middle, which is cut and, aslant, keeps no colour (5).
    """
    k = F.col("p_partkey")
    i, y = k % 10, (F.floor(k / 10) * 20).cast("double")
    at = {0: (0, 0, 1, 0), 1: (1, 0, 2, 0), 2: (2, 0, 3, 0), 3: (3, 0, 3, 1), 4: (6, 0, 7, 0), 5: (9, 0, 10, 0), 6: (9.24, 0, 9.24, 1), 7: (0, 0, 0.06, 0.08), 8: (0, 9, 1, 9), 9: (4, 9, 5, 9)}
    pick = lambda n: F.element_at(F.array(*[F.lit(float(at[j][n])) for j in range(10)]), (i + 1).cast("int"))
    colour = F.when(i == 0, F.col("p_brand")).when(i == 6, "tee")
    s = t.part.select(k.alias("segment_id"), colour.alias("colour"), pick(0).alias("x0"), (y + pick(1)).alias("y0"), pick(2).alias("x1"), (y + pick(3)).alias("y1"))
    corner = lambda x, dy: F.struct(F.lit(x).alias("x"), (y + dy).alias("y"))
    fits = t.part.where(i == 4).select(F.lit("fit").alias("colour"), F.array(corner(6.9, -0.2), corner(7.3, -0.2), corner(7.3, 0.2), corner(6.9, 0.2)).alias("ring"))
    found = bands.refine_shared(s, "segment_id", "colour", fittings=fits)
    return found.select("segment_id", F.col("part").cast("int").alias("part"), F.round("length", 6).alias("length"), "colour")


STACK_SQL = """
WITH stacks AS (SELECT o_custkey AS g, o_orderkey AS stack, l_returnflag AS service, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_quantity, l_partkey, l_suppkey) - 1 AS place FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
scans AS (SELECT o_custkey AS g, o_orderkey AS scan, l_suppkey % 9 AS colour, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_tax, l_partkey, l_suppkey, l_quantity) - 1 AS place FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
a AS (SELECT *, count(*) OVER (PARTITION BY g, stack) AS n FROM stacks), b AS (SELECT *, count(*) OVER (PARTITION BY g, scan) AS n FROM scans)
SELECT g, colour, CASE WHEN min(service) = max(service) THEN min(service) END AS service, count(*) AS n_votes FROM a JOIN b USING (g, n, place) GROUP BY g, colour
"""


@query(STACK_SQL)
def tag_stack_consensus(t: Tables) -> DataFrame:
    """Tag stacks and band scans of equal length vote; a colour with two services abstains."""
    from pyspark.sql import Window

    met = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("g")), "l_orderkey")
    place = lambda *order: F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - 1
    stacks = met.select("g", F.col("l_orderkey").alias("stack"), F.col("l_returnflag").alias("service"), place("l_quantity", "l_partkey", "l_suppkey").alias("place"))
    scans = met.select("g", F.col("l_orderkey").alias("scan"), (F.col("l_suppkey") % 9).alias("colour"), place("l_tax", "l_partkey", "l_suppkey", "l_quantity").alias("place"))
    return runs.sequence_consensus(stacks, scans, ["g"], "stack", "scan")


@query(f"""
WITH {V_SEGMENTS}, {V_BOXES}, a AS (SELECT run_id, avg((x0 + x1) / 2) AS x, avg((y0 + y1) / 2) AS y FROM segments GROUP BY 1),
r AS (SELECT run_id, arg_min(room_id, (w * h, room_id)) AS room_id FROM a JOIN boxes ON x BETWEEN rx AND rx + w AND y BETWEEN ry AND ry + h GROUP BY 1)
SELECT a.run_id, r.room_id FROM a LEFT JOIN r ON a.run_id = r.run_id
""")
def anchor_rooms(t: Tables) -> DataFrame:
    """A run's whole length to the room of its mean point."""
    anchors = runs.run_anchors(select_list(t.orders, SEGMENTS), "run_id")
    b = _boxes(t)
    corner = lambda x, y: F.struct(F.col(f"box.{x}").alias("x"), F.col(f"box.{y}").alias("y"))
    ring = F.array(corner("min_x", "min_y"), corner("max_x", "min_y"), corner("max_x", "max_y"), corner("min_x", "max_y"))
    return spatial.smallest_room(anchors, b.select("room_id", ring.alias("ring"), "area"), 50.0, "run_id").select("run_id", "room_id")


@query("""
WITH c AS (SELECT s_suppkey, (s_suppkey * 37) % 256 AS r, (s_suppkey * 101) % 256 AS g, (s_suppkey * 59) % 256 AS b FROM supplier)
SELECT s_suppkey, printf('%02x%02x%02x', r, g, b) AS rgb FROM c WHERE greatest(r, g, b) - least(r, g, b) >= 30
""")
def chromatic_swatches(t: Tables) -> DataFrame:
    """Swatches with enough channel spread."""
    rgb = _rgb("s_suppkey", 37, 101, 59)
    return t.supplier.select("s_suppkey", rgb.alias("rgb")).where(~S.achromatic(rgb))


@query(f"""
WITH {V_POINTS}, {V_LABELS}, near AS (SELECT point_id, arg_min(label_id, (sqrt((p.x - l.x) * (p.x - l.x) + (p.y - l.y) * (p.y - l.y)), label_id)) AS label_id FROM points p JOIN labels_at l ON sqrt((p.x - l.x) * (p.x - l.x) + (p.y - l.y) * (p.y - l.y)) <= 70 GROUP BY 1),
f AS (SELECT p_size AS family, min(p_type) AS t FROM part WHERE p_size <= 20 GROUP BY 1), g AS (SELECT s_suppkey AS tag, min(s_name) AS t FROM supplier WHERE s_acctbal > 0 GROUP BY 1)
SELECT p.point_id, n.label_id AS tag, coalesce(f.t, g.t) AS device_type, CASE WHEN f.t IS NOT NULL THEN 'family' WHEN g.t IS NOT NULL THEN 'tag' ELSE 'unresolved' END AS basis
FROM points p LEFT JOIN near n ON p.point_id = n.point_id LEFT JOIN f ON p.point_id % 50 = f.family LEFT JOIN g ON n.label_id = g.tag
""")
def tagged_devices(t: Tables) -> DataFrame:
    """Devices tagged by the nearest label, then typed by family or tag."""
    near = spatial.nearest_within(select_list(t.customer, POINTS), select_list(t.supplier, LABELS).drop("sheet"), 70.0, "point_id", ["label_id"], ["label_id"])
    devices = near.select("point_id", F.col("label_id").alias("tag"), (F.col("point_id") % 50).alias("family"))
    families = t.part.where("p_size <= 20").select(F.col("p_size").cast("long").alias("family"), F.col("p_type").alias("device_type"))
    tags = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("tag"), F.col("s_name").alias("device_type"))
    return legend.typed_devices(devices, families, tags).select("point_id", "tag", "device_type", "basis")


@query("""
SELECT event_id, CASE WHEN k IS NULL THEN 'missing' WHEN k < 10 THEN 'invalid' ELSE 'valid' END AS status, CASE WHEN k >= 10 THEN 'k:' || k END AS canonical FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
""")
def provenance_status(t: Tables) -> DataFrame:
    """provenance fields validated and put in canonical form."""
    k = F.from_json("props", "k bigint")["k"]
    return t.events.select("event_id", normalize.provenance(k, 10).alias("p")).select("event_id", "p.*")
