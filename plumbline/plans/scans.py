"""Scans of drawing rows, legends and service takeoff over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import legend, service, spatial, stacks, takeoff
from plumbline.plans.base import LABELS, POINTS, SEGMENTS, V_LABELS, V_SEGMENTS, Tables, query, select_list
from plumbline.plans.geometry import V_BOXES, _boxes
from plumbline.plans.jobs import _pick, _point, _text
from plumbline.plans.rooms import _rect, _street
from plumbline.sources import tables


def _entities(t: Tables) -> DataFrame:
    """Rows of a drawing for each customer: an order's kind, layer, geometry and text by its number."""
    k = F.col("o_orderkey")
    n = k.cast("double")
    kind = _pick(k % 5, "hatch", "arc", "text", "spline", "insert")
    few = F.when(k % 3 == 0, F.array(_point(n, 0), _point(n + 2, 0), _point(n + 1, 3))).otherwise(F.array(_point(n, 0)))
    return t.orders.select(
        F.col("o_custkey").alias("rev"), k.alias("entity_id"), kind.alias("entity_type"), _pick(k % 4, "M-SERVICE fill", "M-Rise up", "E-Tags", "A-Wall").alias("layer_ref"),
        few.alias("points"), _point(n, 5).alias("centre"), F.when(k % 7 > 0, "FF0000").alias("rgb"), (k % 7).alias("colour_index"), F.when(k % 2 == 0, "ANSI31").alias("pattern"), F.concat(F.lit("T"), _text(k % 9)).alias("text"),
        _pick(k % 3, "Socket", "M_Door 1", "Sensor").alias("block_ref"), F.when(k % 2 == 0, 2.0).alias("scale_x"), F.lit(-1.0).alias("scale_y"), (k % 2 == 0).alias("closed"), F.lit(None).cast("struct<min_x:double,min_y:double,max_x:double,max_y:double>").alias("box"),
    )


@query("SELECT o_custkey AS rev, o_orderkey AS entity_id, CASE WHEN o_orderkey % 7 > 0 THEN 'ff0000' ELSE 'idx:0' END AS colour, CASE WHEN o_orderkey % 2 = 0 THEN 'ANSI31' END AS pattern FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 4 = 0 AND o_orderkey % 3 = 0")
def band_scan(t: Tables) -> DataFrame:
    """Hatch rings on token layers with their colour key and pattern."""
    return tables.band_scan(_entities(t), ["service"], ["rev"]).select("rev", "entity_id", "colour", "pattern")


@query("""
SELECT o_orderkey AS entity_id, 'rise' AS what, CASE WHEN o_orderkey % 7 > 0 THEN 'ff0000' ELSE 'idx:0' END AS said, o_orderkey * 1.0 AS x FROM orders WHERE o_orderkey % 5 IN (0, 1) AND o_orderkey % 4 = 1
UNION ALL SELECT o_orderkey, 'text', 'T' || (o_orderkey % 9), o_orderkey FROM orders WHERE o_orderkey % 5 = 2 AND o_orderkey % 4 = 2
UNION ALL SELECT o_orderkey, 'header', 'T' || (o_orderkey % 9), o_orderkey FROM orders WHERE o_orderkey % 5 = 2 AND o_orderkey % 4 = 2 AND o_orderkey % 9 < 3
""")
def rise_drop_and_stack_scan(t: Tables) -> DataFrame:
    """Rise symbols at their anchors, stack texts and stack headers."""
    e = _entities(t)
    rise = tables.rise_drop_scan(e, "rise").select("entity_id", F.lit("rise").alias("what"), F.col("colour").alias("said"), "x")
    text = lambda what, pattern: tables.text_scan(e, ["tags"], pattern).select("entity_id", F.lit(what).alias("what"), F.col("text").alias("said"), "x")
    return rise.union(text("text", None)).union(text("header", "^T[0-2]$"))


@query("""
SELECT o_orderkey AS entity_id, 'spline' AS what, o_orderkey % 3 > 0 AS dropped, NULL::DOUBLE AS min_x, NULL::DOUBLE AS max_y FROM orders WHERE o_orderkey % 5 = 3
UNION ALL SELECT o_orderkey, 'device', FALSE, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - CASE WHEN o_orderkey % 2 = 0 THEN 2.0 ELSE 1.0 END END, CASE WHEN o_orderkey % 3 = 0 THEN 6.0 END FROM orders WHERE o_orderkey % 5 = 4 AND o_orderkey % 3 <> 1
""")
def spline_and_footprint_scan(t: Tables) -> DataFrame:
    """Splines with too few vertices marked, and device footprints in world boxes, without building fabric."""
    e = _entities(t)
    boxes = t.customer.select(F.col("c_custkey").alias("rev"), F.lit("Socket").alias("block_ref"), F.struct(*[F.lit(v).alias(n) for n, v in (("min_x", -1.0), ("min_y", -1.0), ("max_x", 1.0), ("max_y", 1.0))]).alias("box"))
    none = F.lit(None).cast("double")
    splines = tables.spline_scan(e, ["rev"]).select("entity_id", F.lit("spline").alias("what"), "dropped", none.alias("min_x"), none.alias("max_y"))
    return splines.union(tables.footprint_scan(e, boxes, ["rev"]).select("entity_id", F.lit("device"), F.lit(False), "box.min_x", "box.max_y"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'mm' WHEN 1 THEN 'm' END AS declared, CASE event_id % 3 WHEN 0 THEN 0.001 END AS factor, event_id % 3 = 0 AS available FROM events")
def scale_contexts(t: Tables) -> DataFrame:
    """Units of each revision's document, unavailable without a usable factor."""
    body = _pick(F.col("event_id") % 3, '{"units":{"declared":"mm","factor":0.001}}', '{"units":{"declared":"m","factor":0}}', "{}")
    return tables.scale_context(t.events.select("event_id", body.alias("body")), "event_id", "body")


@query("""
WITH d AS (SELECT l_orderkey AS circuit, CASE l_linenumber % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 1.2 WHEN 2 THEN 1.2 ELSE 0 END AS d FROM lineitem) SELECT circuit, round(sum(d), 6) AS drops FROM d GROUP BY 1
""")
def device_drops(t: Tables) -> DataFrame:
    """Drops of devices by the parameter table of their category."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("circuit"), _pick(F.col("l_linenumber") % 4, "luminaire", "switch", "socket", "board").alias("category"))
    met = rows.join(F.broadcast(takeoff.drop_parameters(t.spark)), "category")
    return met.groupBy("circuit").agg(F.round(F.sum("drop"), 6).alias("drops"))


@query("""
SELECT CASE m WHEN 3 THEN NULL ELSE 'F' || k END AS family, CASE m WHEN 1 THEN 'A' || k WHEN 2 THEN 'A' || k WHEN 3 THEN 'A' || k WHEN 4 THEN 'A' || k END AS abbreviation, CASE m WHEN 3 THEN 'line' WHEN 4 THEN 'line' ELSE 'own' END AS device_type, CASE m WHEN 3 THEN 'tag' WHEN 4 THEN 'tag' ELSE 'family' END AS authority, m = 2 AS conflict FROM (SELECT p_partkey AS k, p_partkey % 5 AS m FROM part)
""")
def legend_dictionary(t: Tables) -> DataFrame:
    """Families, prose lines and schedules as one dictionary; an abbreviation joins a family that alone claims it."""
    k, m = F.col("p_partkey"), F.col("p_partkey") % 5
    name = lambda p: F.concat(F.lit(p), _text(k))
    families = t.part.where(m < 3).select(name("F").alias("family"), F.lit("own").alias("device_type"))
    prose = t.part.where(m > 1).select(name("A").alias("abbreviation"), F.lit("line").alias("device_type"))
    pairs = t.part.where(m.isin(1, 2, 3, 4)).select(name("F").alias("family"), name("A").alias("abbreviation"))
    second = t.part.where(m == 3).select(F.concat(name("F"), F.lit("b")), name("A"))
    return legend.fused_dictionary(families, prose, pairs.union(second))


@query("SELECT o_custkey AS floor, o_orderkey * 3 + 1 AS text_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS swatch_id FROM orders")
def legend_swatches(t: Tables) -> DataFrame:
    """Texts in the legend's region with their nearest swatch."""
    k, x = F.col("n"), F.col("x")
    texts = _street(t).select("floor", F.inline(F.array(*[F.struct((k * 3 + i).alias("text_id"), F.lit(s).alias("text"), x.alias("x"), F.lit(float(y)).alias("y")) for i, s, y in ((0, "LEGEND", 0), (1, "Pipe", -3), (2, "note", 500))])))
    swatches = _street(t).where("n % 2 = 0").select("floor", F.col("n").alias("swatch_id"), (x - 1).alias("x"), F.lit(-3.0).alias("y"))
    return legend.nearest_swatches(texts, swatches, "^LEGEND$", 10.0, 2.0, ["floor"]).select("floor", "text_id", "swatch_id")


@query(f"""
WITH {V_SEGMENTS}, {V_LABELS}, {V_BOXES}, mid AS (SELECT segment_id, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM segments),
near AS (SELECT segment_id, arg_min(label_id, (sqrt((m.x - l.x) * (m.x - l.x) + (m.y - l.y) * (m.y - l.y)), label_id)) AS label_id FROM mid m JOIN labels_at l ON sqrt((m.x - l.x) * (m.x - l.x) + (m.y - l.y) * (m.y - l.y)) <= 50 GROUP BY 1),
room AS (SELECT segment_id, arg_min(room_id, (w * h, room_id)) AS room_id FROM mid JOIN boxes ON x BETWEEN rx AND rx + w AND y BETWEEN ry AND ry + h GROUP BY 1)
SELECT m.segment_id, label_id, room_id FROM mid m LEFT JOIN near USING (segment_id) LEFT JOIN room USING (segment_id)
""")
def segment_shares(t: Tables) -> DataFrame:
    """Each segment's middle to the nearest label and to the smallest room that holds it."""
    mid = select_list(t.orders, SEGMENTS).select("segment_id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    near = spatial.nearest_within(mid, select_list(t.supplier, LABELS).drop("sheet"), 50.0, "segment_id", ["label_id"], ["label_id"]).drop("distance")
    b = _boxes(t)
    return spatial.smallest_room(near, b.select("room_id", spatial.box_ring(F.col("box")).alias("ring"), "area"), 50.0, "segment_id").select("segment_id", "label_id", "room_id")


@query(f"""
WITH {V_LABELS}, p AS (SELECT c_custkey AS id, (c_custkey * 37) % 1000 AS x, (c_custkey * 91) % 1000 AS y, c_nationkey AS sheet FROM customer),
near AS (SELECT id, arg_min(label_id, (sqrt((p.x - l.x) * (p.x - l.x) + (p.y - l.y) * (p.y - l.y)), label_id)) AS l FROM p JOIN labels_at l ON p.sheet = l.sheet AND sqrt((p.x - l.x) * (p.x - l.x) + (p.y - l.y) * (p.y - l.y)) <= 200 GROUP BY 1)
SELECT p.id AS device_id, 'S' || (l % 4) AS tag, CASE WHEN p.id % 3 = 0 THEN 'by family' WHEN l % 4 = 1 THEN 'by tag' END AS device_type, CASE WHEN p.id % 3 = 0 THEN 'family' WHEN l % 4 = 1 THEN 'tag' ELSE 'unresolved' END AS basis FROM p LEFT JOIN near USING (id)
""")
def resolved_devices(t: Tables) -> DataFrame:
    """Enumerated devices with the nearest tag of their sheet, typed by the legend's family, else tag."""
    devices = select_list(t.customer, POINTS).withColumnRenamed("point_id", "device_id").withColumn("block", _pick(F.col("device_id") % 3, "F0", "F1", "F2"))
    tags = select_list(t.supplier, LABELS).select("sheet", F.col("label_id").alias("tag_id"), F.concat(F.lit(" s"), _text(F.col("label_id") % 4)).alias("text"), "x", "y")
    families = t.region.where("r_regionkey = 0").select(F.lit("F0").alias("family"), F.lit("by family").alias("device_type"))
    known = t.region.where("r_regionkey = 0").select(F.lit("S1").alias("tag"), F.lit("by tag").alias("device_type"))
    return legend.tagged_devices(devices, tags, families, known, 200.0, ["sheet"]).select("device_id", "tag", "device_type", "basis")


@query("""
SELECT o_orderkey AS drawing, ['matched', 'no_header', 'degenerate', 'ambiguous', 'no_match', 'unstable', 'conflict'][o_orderkey % 7 + 1] AS verdict, 1 + (o_orderkey % 7 = 6)::INT AS n_stacks,
  CASE WHEN o_orderkey % 7 = 0 THEN 'blue=EA:75,red=SA:100+50' ELSE '' END AS assigned, CASE WHEN o_orderkey % 7 = 0 THEN 'EA,SA' ELSE '' END AS evidence FROM orders
""")
def tag_stack_scans(t: Tables) -> DataFrame:
    """Tag stacks of a drawing for each order, read by their headers and matched to bands; six of seven kinds abstain, each for its own reason."""
    n = F.col("o_orderkey")
    m = n % 7
    put = lambda x, *rows: F.array(*[F.struct(F.lit(i).alias("tag_id"), F.lit(x).alias("x"), F.lit(y).alias("y"), s.alias("service"), F.lit(size).alias("size"), F.lit("round").alias("kind")) for i, y, s, size in rows])
    first = put(0.0, (1, 3.0, F.when(m == 2, "SA").otherwise("EA"), "75"), (2, 2.0, F.lit("SA"), "100"), (3, 1.0, F.when(m == 4, "EA").otherwise("SA"), "50"))
    second = put(20.0, (4, 3.0, F.lit("XX"), "75"), (5, 2.0, F.lit("SA"), "100"), (6, 1.0, F.lit("SA"), "50"))
    tags = t.orders.select(n.alias("drawing"), F.inline(F.when(m == 6, F.concat(first, second)).otherwise(first)))
    heads = F.array(*[F.struct(F.lit(i).alias("header_id"), F.lit("from Top  to bottom :").alias("text"), F.lit(x).alias("x"), F.lit(3.5).alias("y")) for i, x in ((1, 0.1), (2, 20.0))])
    headers = t.orders.where(m != 1).select(n.alias("drawing"), F.inline(heads))
    band = lambda colour, low, wide: F.struct(F.lit(colour).alias("colour"), _rect(F.lit(0.0), F.lit(low), F.when(m == 5, 10.0).otherwise(wide), F.lit(0.2)).alias("ring"))
    own = F.array(band("red", 2.0, 10.0), band("red", 2.3, 11.0), band("blue", 2.6, 12.0))
    again = F.array(band("green", 12.0, 10.0), band("green", 12.3, 11.0), band("black", 12.6, 12.0))
    bands = t.orders.select(n.alias("drawing"), F.inline(F.when(m == 3, F.concat(own, again)).otherwise(own)))
    found = stacks.match_stacks(tags, headers, bands, 8.0, ["drawing"])
    said = F.concat(F.col("colour"), F.lit("="), F.col("service"), F.lit(":"), F.array_join("sizes", "+"))
    listed = lambda df, text, name: df.groupBy("drawing").agg(F.array_join(F.array_sort(F.collect_list(text)), ",").alias(name))
    out = found.verdicts.groupBy("drawing").agg(F.max("verdict").alias("verdict"), F.count("*").cast("int").alias("n_stacks"))
    out = out.join(listed(found.assigned, said, "assigned"), "drawing", "left").join(listed(found.evidence, F.col("service"), "evidence"), "drawing", "left")
    return out.fillna("", ["assigned", "evidence"])


@query("""
WITH boxes AS (SELECT p_partkey // 400 AS sheet, p_partkey AS room_id, CAST((p_partkey * 61) % 950 AS DOUBLE) AS rx, CAST((p_partkey * 83) % 950 AS DOUBLE) AS ry, CAST(20 + p_size AS DOUBLE) AS w, CAST(10 + p_partkey % 37 AS DOUBLE) AS h FROM part),
s AS (SELECT o_orderkey // 3000 AS sheet, o_custkey % 40 AS run, o_orderkey AS segment_id, CAST((o_orderkey * 37) % 900 AS DOUBLE) AS x0, CAST((o_orderkey * 91) % 900 AS DOUBLE) + 0.5 AS y, CAST((o_orderkey * 37) % 900 + 64 AS DOUBLE) AS x1 FROM orders),
r AS (SELECT sheet, run, NULL::DOUBLE AS x, NULL::DOUBLE AS y, NULL::DOUBLE AS length FROM s GROUP BY ALL UNION ALL SELECT sheet, 40 + j, j * 150.0, j * 130.0, 10.0 FROM (SELECT DISTINCT sheet FROM s), range(5) v(j)),
tags AS (SELECT o_orderkey // 3000 AS sheet, o_custkey % 45 AS run, 'S' || (o_orderkey // 25 % 5) AS service, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey // 25 % 3 * 50 AS VARCHAR) END AS size FROM orders WHERE o_orderkey % 25 = 0),
top AS (SELECT DISTINCT ON (sheet, run, service) sheet, run, service, size FROM (SELECT sheet, run, service, size, count(*) AS n FROM tags GROUP BY ALL) ORDER BY sheet, run, service, n DESC, coalesce(size, '')),
e AS (SELECT DISTINCT s_suppkey % 5 AS sheet, s_suppkey AS stack, unnest(['S' || (s_suppkey % 5), 'S' || (s_suppkey // 5 % 5)]) AS service FROM supplier WHERE s_suppkey % 3 = 0),
bundles AS (SELECT DISTINCT sheet, run FROM (SELECT t.sheet, run, stack FROM top t JOIN e ON t.sheet = e.sheet AND t.service = e.service GROUP BY ALL HAVING count(*) >= 2)),
runs AS (SELECT r.*, coalesce(n, 0) AS n, b.run IS NOT NULL AS bundle FROM r LEFT JOIN (SELECT sheet, run, count(*) AS n FROM top GROUP BY ALL) t ON r.sheet = t.sheet AND r.run = t.run LEFT JOIN bundles b ON r.sheet = b.sheet AND r.run = b.run),
l AS (SELECT c_custkey % 5 AS sheet, CAST((c_custkey * 37) % 1000 AS DOUBLE) AS lx, CAST((c_custkey * 91) % 1000 AS DOUBLE) AS ly, 'S' || (c_custkey % 5) AS service, CAST(c_custkey % 3 * 50 AS VARCHAR) AS size FROM customer),
a AS (SELECT s_suppkey % 5 AS sheet, CAST((s_suppkey * 53) % 1000 AS DOUBLE) AS ax, CAST((s_suppkey * 71) % 1000 AS DOUBLE) AS ay, 1000000 + s_suppkey AS room FROM supplier),
met AS (SELECT s.*, room_id, rx, w, h FROM s JOIN bundles USING (sheet, run) JOIN boxes ON s.sheet = boxes.sheet AND y BETWEEN ry AND ry + h),
whole AS (SELECT s.* FROM s JOIN bundles USING (sheet, run)),
cuts AS (SELECT segment_id, x0 AS c FROM whole UNION SELECT segment_id, x1 FROM whole UNION SELECT segment_id, rx FROM met WHERE rx > x0 AND rx < x1 UNION SELECT segment_id, rx + w FROM met WHERE rx + w > x0 AND rx + w < x1),
pieces AS (SELECT segment_id, c AS f, lead(c) OVER (PARTITION BY segment_id ORDER BY c) AS g FROM cuts),
points AS (SELECT s.sheet, s.run, 'p' || p.segment_id || ':' || f AS id, (f + g) / 2 AS x, y, g - f AS length, true AS bundle, false AS absent, NULL AS service, NULL AS size FROM pieces p JOIN s USING (segment_id) WHERE g IS NOT NULL
  UNION ALL SELECT s.sheet, s.run, 's' || segment_id, (x0 + x1) / 2, s.y, 64, false, n > 1, arg_min(l.service, (d, l.service, l.size)), arg_min(l.size, (d, l.service, l.size)) FROM (SELECT s.*, n FROM s JOIN runs r ON s.sheet = r.sheet AND s.run = r.run WHERE NOT bundle) s LEFT JOIN LATERAL
    (SELECT service, size, sqrt(((x0 + x1) / 2 - lx) * ((x0 + x1) / 2 - lx) + (s.y - ly) * (s.y - ly)) AS d FROM l WHERE l.sheet = s.sheet AND lx BETWEEN (x0 + x1) / 2 - 25 AND (x0 + x1) / 2 + 25 AND ly BETWEEN s.y - 25 AND s.y + 25) l ON d <= 25 GROUP BY s.sheet, s.run, segment_id, x0, x1, s.y, n
  UNION ALL SELECT sheet, run, 'r' || run || ':' || sheet, x, y, length, bundle, n > 1 AND NOT bundle, CASE WHEN n = 1 THEN (SELECT any_value(service) FROM top WHERE top.sheet = runs.sheet AND top.run = runs.run) END, CASE WHEN n = 1 THEN (SELECT any_value(size) FROM top WHERE top.sheet = runs.sheet AND top.run = runs.run) END FROM runs WHERE length IS NOT NULL),
held AS (SELECT p.id, arg_min(room_id, (w * h, room_id)) AS room FROM points p JOIN boxes b ON p.sheet = b.sheet AND x BETWEEN rx AND rx + w AND y BETWEEN ry AND ry + h GROUP BY 1),
lab AS (SELECT id, arg_min(room, (sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)), room)) AS room FROM points p JOIN a ON p.sheet = a.sheet AND sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)) <= 30 GROUP BY 1),
roomed AS (SELECT p.*, coalesce(h.room, lab.room) AS room_id FROM points p LEFT JOIN held h USING (id) LEFT JOIN lab USING (id)),
parts AS (SELECT sheet, run, room_id, length, bundle, absent, service, size, CASE WHEN service IS NOT NULL THEN 'round' END AS kind FROM roomed WHERE NOT bundle UNION ALL SELECT p.sheet, p.run, room_id, length, bundle, absent, t.service, t.size, 'round' FROM roomed p JOIN top t ON p.sheet = t.sheet AND p.run = t.run WHERE bundle),
marks AS (SELECT p_partkey AS id, p_partkey % 5 AS sheet, CAST((p_partkey * 17) % 1000 AS DOUBLE) AS x, CAST((p_partkey * 29) % 1000 AS DOUBLE) AS y, p_partkey % 2 AS up FROM part),
placed AS (SELECT m.id, any_value(m.sheet) AS sheet, any_value(up) AS up, arg_min(room_id, (w * h, room_id)) AS room_id FROM marks m LEFT JOIN boxes b ON m.sheet = b.sheet AND x BETWEEN rx AND rx + w AND y BETWEEN ry AND ry + h GROUP BY 1),
lines AS (SELECT sheet, service, size, kind, room_id, length, run, run % 3 AS rank, run % 4 = 0 AS conflict, bundle, absent, CASE WHEN run % 5 > 0 THEN 'D' || (run % 5) END AS discipline, 0 AS risers, 0 AS drops FROM parts
  UNION ALL SELECT sheet, NULL, NULL, NULL, room_id, 0, NULL, NULL, false, false, false, 'M', up, 1 - up FROM placed)
SELECT sheet, service, size, kind, room_id, round(sum(length), 6) AS length, count(DISTINCT run) AS n_runs, coalesce(['unknown', 'partial', 'resolved'][min(rank) + 1], 'unknown') AS status, bool_or(conflict) AS conflict, bool_or(bundle) AS bundle, bool_or(absent) AS evidence_absent,
  min(discipline) AS discipline, sum(risers)::BIGINT AS risers, sum(drops)::BIGINT AS drops FROM lines GROUP BY ALL
""")
def service_takeoff(t: Tables) -> DataFrame:
    """The service takeoff of sheets of 400 rooms on which runs, tags, labels, rooms and stacks meet at random: bundles, segments, symbols."""
    k = F.col("o_orderkey")
    x0, y = ((k * 37) % 900).cast("double"), ((k * 91) % 900).cast("double") + 0.5
    sheet = F.floor(k / 3000)
    text = lambda c: c.cast("long").cast("string")
    named = lambda n: F.concat(F.lit("S"), text(n % 5))
    lines = t.orders.select(sheet.alias("sheet"), k.alias("segment_id"), (F.col("o_custkey") % 40).alias("run"), x0.alias("x0"), y.alias("y0"), (x0 + 64).alias("x1"), y.alias("y1"))
    bare = lines.select("sheet").distinct().select("sheet", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("j"))
    nothing = F.lit(None).cast("double")
    every = lines.select("sheet", "run").distinct().select("sheet", "run", nothing.alias("x"), nothing.alias("y"), nothing.alias("length"))
    every = every.union(bare.select("sheet", F.col("j") + 40, F.col("j") * 150.0, F.col("j") * 130.0, F.lit(10.0)))
    run = F.col("run")
    every = every.select("*", _pick(run % 3, "unknown", "partial", "resolved").alias("status"), (run % 4 == 0).alias("conflict"), F.when(run % 5 > 0, F.concat(F.lit("D"), text(run % 5))).alias("discipline"))
    n = F.floor(k / 25)
    tags = t.orders.where(k % 25 == 0).select(sheet.alias("sheet"), (F.col("o_custkey") % 45).alias("run"), named(n).alias("service"), F.when(k % 4 > 0, text(n % 3 * 50)).alias("size"), F.lit("round").alias("kind"))
    labels = select_list(t.customer, POINTS).select((F.col("point_id") % 5).alias("sheet"), "x", "y", named(F.col("point_id")).alias("service"), text(F.col("point_id") % 3 * 50).alias("size"), F.lit("round").alias("kind"))
    stack = F.col("s_suppkey")
    evidence = t.supplier.where(stack % 3 == 0).select((stack % 5).alias("sheet"), stack.alias("stack"), F.explode(F.array(named(stack), named(F.floor(stack / 5)))).alias("service"))
    anchors = select_list(t.supplier, LABELS).select((F.col("label_id") % 5).alias("sheet"), "x", "y", (F.col("label_id") + 1000000).alias("room"))
    p = F.col("p_partkey")
    rooms_ = _boxes(t).select(F.floor(F.col("room_id") / 400).alias("sheet"), "room_id", spatial.box_ring(F.col("box")).alias("ring"), "area")
    symbols = t.part.select((p % 5).alias("sheet"), p.alias("symbol_id"), F.when(p % 2 == 1, "rise").otherwise("drop").alias("kind"), ((p * 17) % 1000).cast("double").alias("x"), ((p * 29) % 1000).cast("double").alias("y"), F.lit("M").alias("discipline"))
    found = service.service_takeoff(every, lines, tags, labels, evidence, rooms_, anchors, symbols, 64.0, 25.0, 30.0, ["sheet"])
    return found.withColumn("length", F.round(F.col("length").cast("double"), 6))
