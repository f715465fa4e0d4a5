"""Ingest, classification and validation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import blocks, normalize, quantities, spatial, takeoff
from plumbline.plans.base import LABELS, POINTS, SEGMENTS, V_LABELS, V_POINTS, V_SEGMENTS, Tables, query, select_list
from plumbline.sources import tables


@query("""
SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN CAST(event_id % 100 AS DOUBLE) END AS x, CASE WHEN event_id % 3 <> 2 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS y FROM events
""")
def payload_points(t: Tables) -> DataFrame:
    """Points written as objects or lists; a boolean is no number."""
    k, y = F.col("event_id"), F.get_json_object("props", "$.k")
    x = (k % 100).cast("string")
    body = (
        F.when(k % 3 == 0, F.concat(F.lit('{"p":{"x":'), x, F.lit(',"y":'), y, F.lit("}}")))
        .when(k % 3 == 1, F.concat(F.lit('{"p":['), x, F.lit(","), y, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"p":{"x":true,"y":'), y, F.lit("}}")))
    )
    point = normalize.json_point(body, "$.p")
    return t.events.select("event_id", point["x"].alias("x"), point["y"].alias("y"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'arc' WHEN l_linenumber = 2 THEN 'line' WHEN l_linenumber = 3 THEN 'polyline' END AS kind FROM lineitem
""")
def entity_kinds(t: Tables) -> DataFrame:
    """Explicit kind, else inferred from the geometry that is there."""
    n = F.col("l_linenumber")
    point = F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("y"))
    start = F.when(n == 2, point)
    points = F.when(n == 3, F.array(point, point))
    return t.lineitem.select("l_orderkey", "l_linenumber", normalize.entity_kind(F.when(n == 1, " ARC "), start, start, points).alias("kind"))


@query(f"""
WITH {V_SEGMENTS} SELECT segment_id, least(x0, x1, x0 - 3) AS min_x, least(y0, y1, y0 - 3) AS min_y, greatest(x0 + 3, x1) AS max_x, greatest(y0 + 3, y1) AS max_y FROM segments
""")
def entity_boxes(t: Tables) -> DataFrame:
    """Box of points and a circle."""
    s = select_list(t.orders, SEGMENTS)
    point = lambda i: F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"))
    box = normalize.entity_box(F.array(point(0), point(1)), point(0), F.lit(3.0))
    return s.select("segment_id", *[box[c].alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0")
def equality_filters(t: Tables) -> DataFrame:
    """Equality filters and a compact projection; an undetermined sheet isn't on it."""
    rows = t.customer.withColumn("on_sheet", F.when(F.col("c_acctbal") < 5000, F.col("c_acctbal") >= 0).otherwise(F.lit(True)))
    return normalize.select_fields(normalize.equal_filters(rows, on_sheet=True, c_mktsegment="BUILDING"), ["c_custkey"], ["c_name"])


@query("SELECT p_partkey, regexp_matches(lower(p_type), 'steel|tin') AS is_wall FROM part")
def wall_layers(t: Tables) -> DataFrame:
    """Layer-name predicate."""
    return t.part.select("p_partkey", normalize.has_token(F.col("p_type"), ["steel", "tin"]).alias("is_wall"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW' THEN round(o_totalprice * 0.3048, 4) END AS real_length_m, CASE WHEN o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW' THEN 'metres' ELSE 'drawing_units' END AS basis FROM orders
""")
def scale_gate(t: Tables) -> DataFrame:
    """Metres only where the scale may be used."""
    made = normalize.measured_length(F.col("o_totalprice"), F.lit(0.3048), F.col("o_orderstatus") != "F", F.col("o_orderpriority") == "5-LOW")
    return t.orders.select("o_orderkey", F.round(made["real_length_m"], 4).alias("real_length_m"), made["basis"].alias("basis"))


@query("""
SELECT p_partkey, CASE WHEN p_size > 10 AND p_size < 40 THEN CASE WHEN p_size % 2 = 0 THEN 'confirmed' ELSE 'contradicted' END WHEN p_size > 10 THEN 'declared' WHEN p_size < 40 THEN 'inferred' ELSE 'unknown' END AS confidence FROM part
""")
def unit_confidence(t: Tables) -> DataFrame:
    """Declared against inferred units."""
    declared = F.when(F.col("p_size") > 10, F.lit("m"))
    inferred = F.when(F.col("p_size") < 40, F.when(F.col("p_size") % 2 == 0, "m").otherwise("mm"))
    return t.part.select("p_partkey", normalize.unit_confidence(declared, inferred).alias("confidence"))


@query("SELECT p_partkey, p_size > 5 AND p_partkey % 7 > 0 AS valid FROM part")
def polygon_validity(t: Tables) -> DataFrame:
    """Finite points and an area."""
    w, h = F.col("p_size").cast("double"), (F.col("p_partkey") % 7).cast("double")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    bad = F.when(F.col("p_size") > 5, w).otherwise(F.lit(float("nan")))
    ring = F.array(corner(F.lit(0.0), F.lit(0.0)), corner(bad, F.lit(0.0)), corner(w, h))
    return t.part.select("p_partkey", normalize.valid_polygon(ring).alias("valid"))


@query("SELECT doc_id, CASE WHEN toxic = 1 OR quality IS NULL OR quality * 0.7 < 0.6 THEN 'review_required' ELSE 'accepted' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def review_policy(t: Tables) -> DataFrame:
    """Placeholder semantics and low confidence need review."""
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return rows.select("doc_id", normalize.review_policy(F.col("toxic") == 1, F.col("quality") * 0.7).alias("status"))


@query(r"""
WITH n AS (SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'Plant room ' || c_custkey WHEN 1 THEN 'ALL PIPES SHALL BE' WHEN 2 THEN 'WC' WHEN 3 THEN c_custkey || ' mm TRAY' WHEN 4 THEN 'see notes:' ELSE '' || c_custkey END AS name,
  CASE c_custkey % 5 WHEN 0 THEN '0.2.' || (c_custkey % 100) WHEN 1 THEN 'G.0' || (c_custkey % 9) END AS number, c_custkey % 2 = 0 AS pdf FROM customer)
SELECT k AS c_custkey, k % 6 IN (0, 2) AS plausible, CASE WHEN pdf THEN coalesce(k % 5 = 0, FALSE) ELSE k % 5 IN (0, 1) OR k % 6 IN (0, 2) END AS genuine FROM n
""")
def room_names(t: Tables) -> DataFrame:
    """Plausible room names, and rooms that are genuine by number or name; of one input family by a strict number only."""
    k = F.col("c_custkey")
    word = lambda c: c.cast("string")
    name = F.element_at(F.array(F.concat(F.lit("Plant room "), word(k)), F.lit("ALL PIPES SHALL BE"), F.lit("WC"), F.concat(word(k), F.lit(" mm TRAY")), F.lit("see notes:"), word(k)), (k % 6 + 1).cast("int"))
    number = F.when(k % 5 == 0, F.concat(F.lit("0.2."), word(k % 100))).when(k % 5 == 1, F.concat(F.lit("G.0"), word(k % 9)))
    return t.customer.select("c_custkey", S.plausible_room_name(name).alias("plausible"), S.genuine_room(number, name, k % 2 == 0).alias("genuine"))


@query("""
SELECT p_partkey, round(p_size * 2.0 * cos(radians(30 * (p_partkey % 12))) - 3.0 * sin(radians(30 * (p_partkey % 12))) + 100, 6) AS x, round(p_size * 2.0 * sin(radians(30 * (p_partkey % 12))) + 3.0 * cos(radians(30 * (p_partkey % 12))) - 50, 6) AS y FROM part
""")
def block_placement_points(t: Tables) -> DataFrame:
    """block points scaled, rotated and moved to the insert."""
    points = F.array(F.struct(F.col("p_size").cast("double").alias("x"), F.lit(3.0).alias("y")))
    moved = normalize.affine(points, F.lit(2.0), F.lit(1.0), (30 * (F.col("p_partkey") % 12)).cast("double"), F.lit(100.0), F.lit(-50.0))[0]
    return t.part.select("p_partkey", F.round(moved["x"], 6).alias("x"), F.round(moved["y"], 6).alias("y"))


@query(f"""
WITH {V_POINTS}, {V_LABELS}, z AS (SELECT label_id AS zone_id, sheet, x - 120 AS ax, x + 120 AS cx, y - 120 AS ay, y + 120 AS cy FROM labels_at WHERE regexp_matches('LBL' || label_id, '[05]$'))
SELECT p.point_id, min(z.zone_id) AS zone_id FROM points p JOIN z ON p.sheet = z.sheet AND p.x BETWEEN ax AND cx AND p.y BETWEEN ay AND cy GROUP BY 1
""")
def annotation_zones(t: Tables) -> DataFrame:
    """Labels inside padded zones, the first zone naming the reason."""
    labels = select_list(t.supplier, LABELS).withColumn("text", F.concat(F.lit("LBL"), F.col("label_id").cast("string")))
    zones = normalize.annotation_zones(labels, "[05]$", 120.0, ["sheet"])
    met = spatial.in_boxes(select_list(t.customer, POINTS), zones, 240.0, ["sheet"])
    return met.groupBy("point_id").agg(F.min("zone_id").alias("zone_id"))


@query("""
SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'missing_parent' ELSE 'nation_mismatch' END AS problem FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > -500) ON o_custkey = c_custkey WHERE c_custkey IS NULL OR c_nationkey <> o_orderkey % 25
""")
def lineage_mismatches(t: Tables) -> DataFrame:
    """Inputs whose lineage disagrees with their parent's."""
    inputs = t.orders.select("o_orderkey", F.col("o_custkey").alias("file_id"), (F.col("o_orderkey") % 25).alias("nation"))
    parents = t.customer.where("c_acctbal > -500").select(F.col("c_custkey").alias("file_id"), F.col("c_nationkey").cast("long").alias("nation"))
    return normalize.lineage_mismatches(inputs, parents, "file_id", ["nation"]).select("o_orderkey", "problem")


@query("""
SELECT l_orderkey, CAST(count(*) AS INT) AS lines_count, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1
""")
def slim_documents(t: Tables) -> DataFrame:
    """Bulk arrays replaced by counts."""
    whole = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("lines"), F.max("l_shipdate").alias("shipped"))
    return normalize.slim_document(whole, ["lines"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_suppkey % 5 = 2")
def versioned_rows(t: Tables) -> DataFrame:
    """Derived rows of one algorithm version."""
    rows = t.lineitem.withColumn("algo_version", F.concat(F.lit("v"), (F.col("l_suppkey") % 5).cast("string")))
    return tables.versioned_scan(rows, "v2").select("l_orderkey", "l_linenumber", "l_quantity")


@query(r"""
SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}')) AS tag FROM documents
""")
def tag_placements(t: Tables) -> DataFrame:
    """Tags found in text blocks, one row each."""
    return t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{3}-[0-9]{4}"), F.lit(0))).alias("tag"))


@query("""
SELECT l.l_orderkey, l.l_linenumber, p.o_custkey AS parent_owner FROM lineitem l LEFT JOIN orders p ON l.l_orderkey = p.o_orderkey
""")
def parent_links(t: Tables) -> DataFrame:
    """Rows with their parent's attribute."""
    parents = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("parent_owner"))
    return blocks.parent_links(t.lineitem.select("l_orderkey", "l_linenumber"), parents, "l_orderkey", "l_orderkey", ["parent_owner"])


@query(f"""
WITH {V_LABELS}, {V_POINTS}, boxes AS (SELECT p_partkey AS room_id, CAST((p_partkey * 61) % 950 AS DOUBLE) AS rx, CAST((p_partkey * 83) % 950 AS DOUBLE) AS ry, 20.0 + p_size AS w, 10.0 + p_partkey % 37 AS h FROM part),
inside AS (SELECT point_id, arg_min(room_id, (w * h, room_id)) AS room_id FROM points JOIN boxes ON x BETWEEN rx AND rx + w AND y BETWEEN ry AND ry + h GROUP BY 1),
near AS (SELECT point_id, arg_min(label_id, (sqrt((p.x - l.x) * (p.x - l.x) + (p.y - l.y) * (p.y - l.y)), label_id)) AS label_id FROM points p JOIN labels_at l ON sqrt((p.x - l.x) * (p.x - l.x) + (p.y - l.y) * (p.y - l.y)) <= 80
  WHERE point_id NOT IN (SELECT point_id FROM inside) GROUP BY 1)
SELECT p.point_id, CASE WHEN room_id IS NOT NULL THEN 'R' || room_id WHEN label_id IS NOT NULL THEN 'L' || label_id END AS room,
  CASE WHEN room_id IS NOT NULL THEN 'polygon' WHEN label_id IS NOT NULL THEN 'label' ELSE 'unassigned' END AS basis
FROM points p LEFT JOIN inside USING (point_id) LEFT JOIN near USING (point_id)
""")
def hybrid_rooms(t: Tables) -> DataFrame:
    """Polygon room first, then the nearest label room, else unassigned."""
    points = select_list(t.customer, POINTS)
    x, y = ((F.col("p_partkey") * 61) % 950).cast("double"), ((F.col("p_partkey") * 83) % 950).cast("double")
    w, h = F.lit(20.0) + F.col("p_size"), F.lit(10.0) + F.col("p_partkey") % 37
    ring = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))])
    rooms = t.part.select(F.col("p_partkey").alias("room_id"), ring.alias("ring"), (w * h).alias("area"))
    inside = spatial.smallest_room(points, rooms, 50.0, "point_id")
    outside = inside.where("room_id is null").drop("room_id")
    near = spatial.nearest_within(outside, select_list(t.supplier, LABELS).drop("sheet"), 80.0, "point_id", ["label_id"], ["label_id"])
    met = inside.join(near.select("point_id", "label_id"), "point_id", "left")
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    room = F.coalesce(named("R", "room_id"), named("L", "label_id"))
    basis = F.when(F.col("room_id").isNotNull(), "polygon").when(F.col("label_id").isNotNull(), "label").otherwise("unassigned")
    return met.select("point_id", room.alias("room"), basis.alias("basis"))


@query("""
SELECT o_orderkey AS circuit_id, round(q, 2) AS home_run, CASE WHEN q IS NULL THEN 'no_anchor' ELSE 'ok' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey
""")
def home_run_join(t: Tables) -> DataFrame:
    """In-plan circuits with their home runs; a missing one is no_anchor."""
    homes = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("circuit_id")).agg(F.sum("l_quantity").alias("home_run"))
    met = takeoff.home_run_statuses(t.orders.select(F.col("o_orderkey").alias("circuit_id")), homes)
    return met.select("circuit_id", F.round("home_run", 2).alias("home_run"), "status")


@query(f"""
WITH {V_POINTS}, pairs AS (SELECT a.sheet, a.point_id AS i, b.point_id AS j, (b.x - a.x) AS dx, (b.y - a.y) AS dy FROM points a JOIN points b ON a.sheet = b.sheet AND a.point_id < b.point_id),
best AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY dx * dx + dy * dy DESC, i, j) AS n FROM pairs)
SELECT sheet, i, j, round(degrees(atan2(dy, dx)), 6) AS bearing, round(sqrt(dx * dx + dy * dy), 6) AS baseline FROM best WHERE n = 1
""")
def widest_baseline(t: Tables) -> DataFrame:
    """The two farthest fiducials of a sheet, their bearing and distance."""
    found = takeoff.widest_baseline(select_list(t.customer, POINTS), "sheet", "point_id")
    return found.select("sheet", "i", "j", F.round("bearing", 6).alias("bearing"), F.round("baseline", 6).alias("baseline"))


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT max(p_partkey) FROM part)")
def point_lookup(t: Tables) -> DataFrame:
    """Lookup by key."""
    key = t.part.agg(F.max("p_partkey").alias("p_partkey"))
    return normalize.by_key(t.part.select("p_partkey", "p_brand"), key, "p_partkey")


@query("""
SELECT p_partkey, CASE WHEN p_brand LIKE '%1' THEN 'board' WHEN p_brand LIKE '%2' THEN 'switch' WHEN p_brand LIKE '%3' THEN 'socket' WHEN p_brand LIKE '%4' THEN 'luminaire' ELSE 'other' END AS category FROM part
""")
def device_categories(t: Tables) -> DataFrame:
    """Ordered substring rules."""
    last = F.substring("p_brand", -1, 1)
    name = F.when(last == "1", "Distribution switch").when(last == "2", "2-gang Switch").when(last == "3", "Socket").when(last == "4", "LED light").otherwise("Pump")
    return t.part.select("p_partkey", normalize.device_category(name).alias("category"))


@query("""
SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1))::INT % 4 + 1 AS INT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
FROM (SELECT p_partkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(CAST(p_partkey AS VARCHAR))) AS h FROM part)
""")
def derived_ids(t: Tables) -> DataFrame:
    """F8: name-based UUIDs of version 5."""
    return t.part.select("p_partkey", S.derived_uuid("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.col("p_partkey").cast("string")).alias("id"))


@query("""
SELECT DISTINCT ON (l_orderkey) l_orderkey, l_linenumber AS effect FROM lineitem ORDER BY l_orderkey, l_quantity DESC, l_linenumber
""")
def first_effects(t: Tables) -> DataFrame:
    """First effect of each entity by priority."""
    rows = t.lineitem.select("l_orderkey", (-F.col("l_quantity")).alias("priority"), F.col("l_linenumber").alias("effect"))
    return quantities.first_in_group(rows, ["l_orderkey"], ["priority", "effect"]).select("l_orderkey", "effect")
