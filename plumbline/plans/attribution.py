"""Legend, run, room and text-parsing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import legend, service, takeoff, windows
from plumbline.plans.base import LABELS, POINTS, SEGMENTS, V_LABELS, V_POINTS, V_SEGMENTS, Tables, query, select_list


@query("""
WITH k AS (SELECT DISTINCT p_brand, p_size, CASE WHEN p_size % 3 > 0 THEN p_type END AS kind FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) = 1)
SELECT l_orderkey, l_linenumber, k.kind, k.p_brand IS NOT NULL AS matched
FROM lineitem LEFT JOIN k ON k.p_brand = 'Brand#' || (l_partkey % 5 + 1) || (l_suppkey % 5 + 1) AND k.p_size = CAST(l_quantity AS INT)
""")
def legend_lookup(t: Tables) -> DataFrame:
    """Composite legend lookup; a hit with a null type isn't a miss."""
    first = windows_first(t)
    brand = F.concat(F.lit("Brand#"), (F.col("l_partkey") % 5 + 1).cast("string"), (F.col("l_suppkey") % 5 + 1).cast("string"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", brand.alias("p_brand"), F.col("l_quantity").cast("int").alias("p_size"))
    return legend.lookup(rows, first, ["p_brand", "p_size"], "kind").select("l_orderkey", "l_linenumber", "kind", "matched")


def windows_first(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 > 0, F.col("p_type"))
    best = t.part.groupBy("p_brand", "p_size").agg(F.min_by(F.struct(kind.alias("kind")), F.col("p_partkey")).alias("b"))
    return best.select("p_brand", "p_size", "b.kind")


RGB = "printf('%02x%02x%02x', (p_partkey * 7) % 256, (p_partkey * 11) % 256, (p_partkey * 13) % 256)"
HUE = """CASE WHEN greatest(r, g, b) = least(r, g, b) THEN NULL WHEN greatest(r, g, b) = r THEN (g - b) / (greatest(r, g, b) - least(r, g, b))::DOUBLE
  WHEN greatest(r, g, b) = g THEN (b - r) / (greatest(r, g, b) - least(r, g, b))::DOUBLE + 2 ELSE (r - g) / (greatest(r, g, b) - least(r, g, b))::DOUBLE + 4 END * 60"""


@query(f"""
WITH c AS (SELECT p_partkey, {RGB} AS rgb, (p_partkey * 7) % 256 AS r, (p_partkey * 11) % 256 AS g, (p_partkey * 13) % 256 AS b FROM part)
SELECT p_partkey, rgb, greatest(r, g, b) - least(r, g, b) < 30 AS achromatic, round((({HUE}) + 360) - 360 * floor((({HUE}) + 360) / 360), 6) AS hue FROM c
""")
def colours(t: Tables) -> DataFrame:
    """Achromatic test and hue of a colour."""
    rgb = _rgb("p_partkey", 7, 11, 13)
    return t.part.select("p_partkey", rgb.alias("rgb"), S.achromatic(rgb).alias("achromatic"), F.round(S.hue(rgb), 6).alias("hue"))


def _rgb(key: str, *by: int):
    return F.lower(F.concat(*[F.lpad(F.hex((F.col(key) * m) % 256), 2, "0") for m in by]))


@query(f"""
WITH v AS (SELECT s_suppkey % 4 AS service, (s_suppkey * 37) % 256 AS r, (s_suppkey * 101) % 256 AS g, (s_suppkey * 59) % 256 AS b FROM supplier),
l AS (SELECT service, printf('%02x%02x%02x', r, g, b) AS rgb, greatest(r, g, b) - least(r, g, b) < 30 AS grey, (({HUE}) + 360) % 360 AS h FROM v),
p AS (SELECT p_partkey, {RGB} AS rgb, (p_partkey * 7) % 256 AS r, (p_partkey * 11) % 256 AS g, (p_partkey * 13) % 256 AS b FROM part),
q AS (SELECT p_partkey, rgb, greatest(r, g, b) - least(r, g, b) < 30 AS grey, (({HUE}) + 360) % 360 AS h, (SELECT min(service) FROM l WHERE l.rgb = p.rgb) AS exact FROM p),
d AS (SELECT p_partkey, l.service, min(least(abs(q.h - l.h), 360 - abs(q.h - l.h))) AS d FROM q JOIN l ON NOT q.grey AND NOT l.grey AND exact IS NULL GROUP BY ALL),
n AS (SELECT *, row_number() OVER w AS n, lead(d) OVER w AS nx FROM d WINDOW w AS (PARTITION BY p_partkey ORDER BY d, service)),
k AS (SELECT p_partkey, service FROM n WHERE n = 1 AND d <= 22 AND (nx IS NULL OR nx - d >= 8))
SELECT q.p_partkey, coalesce(exact, k.service) AS service, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN k.service IS NOT NULL THEN 'hue' ELSE 'unresolved' END AS basis FROM q LEFT JOIN k ON q.p_partkey = k.p_partkey
""")
def tolerant_hues(t: Tables) -> DataFrame:
    """Nearest hue within tolerance and with a margin, exact first."""
    known = t.supplier.select((F.col("s_suppkey") % 4).alias("service"), _rgb("s_suppkey", 37, 101, 59).alias("colour"))
    rows = t.part.select("p_partkey", _rgb("p_partkey", 7, 11, 13).alias("colour"))
    return legend.hue_lookup(rows, known, "p_partkey", "colour", "service")


@query("""
SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS labels, string_agg(DISTINCT p_name, '; ' ORDER BY p_name) AS description FROM part GROUP BY 1
""")
def legend_fusion(t: Tables) -> DataFrame:
    """Entries of one key fused, first label primary and the rest competing."""
    found = legend.fuse(t.part.withColumn("source", F.lit("table")), ["p_brand"], "p_type", "p_name", "source")
    return found.select("p_brand", F.array_join(F.concat(F.array("primary"), "competing"), ",").alias("labels"), "description")


@query("""
SELECT l_orderkey, l_linenumber, coalesce(f.t, g.t) AS device_type, CASE WHEN f.t IS NOT NULL THEN 'family' WHEN g.t IS NOT NULL THEN 'tag' ELSE 'unresolved' END AS basis
FROM lineitem LEFT JOIN (SELECT p_partkey, min(p_type) AS t FROM part WHERE p_size > 25 GROUP BY 1) f ON l_partkey = f.p_partkey
LEFT JOIN (SELECT s_suppkey, min(s_name) AS t FROM supplier WHERE s_acctbal > 0 GROUP BY 1) g ON l_suppkey = g.s_suppkey
""")
def device_types(t: Tables) -> DataFrame:
    """Type by family, then by tag; nothing dropped."""
    devices = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("family"), F.col("l_suppkey").alias("tag"))
    families = t.part.where("p_size > 25").select(F.col("p_partkey").alias("family"), F.col("p_type").alias("device_type"))
    tags = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("tag"), F.col("s_name").alias("device_type"))
    return legend.typed_devices(devices, families, tags).select("l_orderkey", "l_linenumber", "device_type", "basis")


@query("""
SELECT o_orderkey, CASE WHEN n = 1 THEN b END AS p_brand FROM orders LEFT JOIN (SELECT p_size, count(DISTINCT p_brand) AS n, min(p_brand) AS b FROM part WHERE p_retailprice > 915 GROUP BY 1) c ON o_custkey = c.p_size
""")
def single_claims(t: Tables) -> DataFrame:
    """Attached only where exactly one family claims the key."""
    families = t.part.where("p_retailprice > 915").select(F.col("p_size").cast("long").alias("key"), "p_brand")
    return legend.attach_single_claims(t.orders.select("o_orderkey", F.col("o_custkey").alias("key")), families, "key", "p_brand").select("o_orderkey", "p_brand")


@query("""
WITH i AS (SELECT arg_min(l_orderkey, l_orderkey) AS linked, k FROM (SELECT l_orderkey, unnest([l_partkey, l_suppkey]) AS k FROM lineitem) GROUP BY k)
SELECT c_custkey, linked AS linked_l_orderkey FROM customer LEFT JOIN i ON c_custkey = k
""")
def reference_links(t: Tables) -> DataFrame:
    """Link by any identity of a row, first in sequence."""
    rows = t.lineitem.select("l_orderkey", F.array("l_partkey", "l_suppkey").alias("identities"), F.col("l_orderkey").alias("seq"))
    return legend.link_references(t.customer.select("c_custkey"), rows, "c_custkey", "identities", "l_orderkey", "seq")


@query("""
SELECT p_type, p_brand, n, row_number() OVER (PARTITION BY p_type ORDER BY p_brand LIKE '%5', n DESC, p_brand) AS rank FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL)
""")
def device_schedule(t: Tables) -> DataFrame:
    """Counts by name, most first, one class of names last."""
    return legend.schedule(t.part, ["p_type"], "p_brand", F.col("p_brand").endswith("5")).withColumn("rank", F.col("rank").cast("long"))


@query(f"""
WITH {V_SEGMENTS} SELECT run_id, layer_ref, string_agg(segment_id, ',' ORDER BY segment_id) AS members, count(*) AS n_members FROM segments GROUP BY run_id, layer_ref
""")
def routed_runs(t: Tables) -> DataFrame:
    """Runs with their members in order."""
    s = select_list(t.orders, SEGMENTS).withColumn("seq", F.col("segment_id"))
    found = takeoff.group_runs(s, ["run_id", "layer_ref"], "segment_id", "seq")
    return found.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


L = "sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"


@query(f"""
WITH {V_SEGMENTS} SELECT run_id, round(CAST(sum(CASE WHEN {L} > 0 THEN CAST({L} AS DECIMAL(28, 9)) END) AS DOUBLE), 6) AS length, sum(({L} > 0)::INT)::BIGINT AS n_segments FROM segments GROUP BY 1
""")
def drawn_lengths(t: Tables) -> DataFrame:
    """Drawn length of a run."""
    return takeoff.drawn_lengths(select_list(t.orders, SEGMENTS), ["run_id"]).withColumn("length", F.round(F.col("length").cast("double"), 6))


@query("""
SELECT CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey % 5 END AS service, l_returnflag AS size, CAST(sum(CAST(l_quantity AS DECIMAL(28, 6))) AS DOUBLE) AS length, count(DISTINCT l_orderkey) AS n_runs,
  count(DISTINCT l_partkey) AS n_entities, max(l_linenumber) AS worst_status, max(l_tax > 0.07) AS any_conflict FROM lineitem GROUP BY ALL
""")
def service_buckets(t: Tables) -> DataFrame:
    """Attribution rows to service buckets; unknown services are a bucket."""
    rows = t.lineitem.withColumn("service", F.when(F.col("l_suppkey") % 5 > 0, F.col("l_suppkey") % 5)).withColumn("conflict", F.col("l_tax") > 0.07).withColumnRenamed("l_returnflag", "size")
    found = takeoff.service_buckets(rows, ["service", "size"], "l_orderkey", "l_quantity", "l_partkey", "l_linenumber", "conflict")
    return found.withColumn("length", F.col("length").cast("double"))


@query("""
WITH r AS (SELECT l_orderkey AS run, l_suppkey % 9 AS service, max(l_quantity) AS length FROM lineitem GROUP BY ALL),
e AS (SELECT DISTINCT s_suppkey AS stack, unnest([s_suppkey % 9, (s_suppkey // 9) % 9]) AS service FROM supplier WHERE s_acctbal > 7000),
shared AS (SELECT DISTINCT run FROM (SELECT run, stack FROM r JOIN e USING (service) GROUP BY ALL HAVING count(*) >= 2)),
p AS (SELECT run, count(*) AS n, max(length) AS length FROM r GROUP BY 1)
SELECT DISTINCT run, CASE WHEN s.run IS NOT NULL OR n = 1 THEN service END AS service, p.length, CASE WHEN s.run IS NOT NULL THEN 'bundle' WHEN n = 1 THEN 'single' ELSE 'bundle_evidence_absent' END AS basis
FROM r JOIN p USING (run) LEFT JOIN shared s USING (run)
""")
def bundle_lengths(t: Tables) -> DataFrame:
    """Full length to every service of a run that shares two with one stack; two services of different stacks confirm nothing."""
    runs = t.lineitem.groupBy(F.col("l_orderkey").alias("run"), (F.col("l_suppkey") % 9).alias("service")).agg(F.max("l_quantity").alias("length"))
    pair = F.array(F.col("s_suppkey") % 9, F.floor(F.col("s_suppkey") / 9) % 9)
    evidence = t.supplier.where("s_acctbal > 7000").select(F.col("s_suppkey").alias("stack"), F.explode(pair).alias("service"))
    return service.bundle_shares(runs, evidence, "run", "length")


@query("""
SELECT coalesce(CAST(k AS VARCHAR), 'shared') AS k, CAST(sum(CAST(l_quantity AS DECIMAL(28, 6))) AS DOUBLE) AS length, (SELECT sum(l_quantity) FROM lineitem) AS total
FROM (SELECT CASE WHEN l_linenumber < 6 THEN l_linenumber END AS k, l_quantity FROM lineitem) GROUP BY 1
""")
def length_tallies(t: Tables) -> DataFrame:
    """Tallies by key with a shared bucket and the conserved total."""
    rows = t.lineitem.select(F.when(F.col("l_linenumber") < 6, F.col("l_linenumber")).alias("k"), "l_quantity")
    found = takeoff.tallies(rows, "k", "l_quantity")
    return found.select("k", F.col("length").cast("double").alias("length"), F.col("total").cast("double").alias("total"))


@query(f"""
WITH {V_POINTS} SELECT sheet, CAST(round_even(x / 40, 0) AS BIGINT) AS cell_x, CAST(round_even(y / 40, 0) AS BIGINT) AS cell_y, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS n, min(point_id) AS colour FROM points GROUP BY ALL
""")
def symbol_clusters(t: Tables) -> DataFrame:
    """One symbol per grid cell."""
    found = takeoff.symbol_clusters(select_list(t.customer, POINTS).withColumn("colour", F.col("point_id")), ["sheet"], 40.0)
    return found.withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


@query("""
SELECT c_nationkey, c_mktsegment, min(c_custkey) AS room_id, count(DISTINCT c_custkey % 11) AS n_anchors, max(c_acctbal < 0) AS review FROM customer GROUP BY 1, 2
""")
def merged_rooms(t: Tables) -> DataFrame:
    """Rooms of one number as one."""
    rooms = t.customer.select("c_nationkey", "c_mktsegment", F.col("c_custkey").alias("room_id"), F.array(F.col("c_custkey") % 11).alias("anchors"), (F.col("c_acctbal") < 0).alias("review"))
    found = takeoff.merge_rooms(rooms, ["c_nationkey"], "c_mktsegment", "room_id", "anchors", "review")
    return found.select("c_nationkey", "c_mktsegment", "room_id", F.size("anchors").cast("long").alias("n_anchors"), "review")


@query("SELECT p_type, p_brand, count(DISTINCT p_size) AS n_rooms FROM part GROUP BY ALL HAVING count(DISTINCT p_size) > 1")
def repeated_room_numbers(t: Tables) -> DataFrame:
    """Numbers that several rooms have."""
    return takeoff.repeated_numbers(t.part, ["p_type"], "p_brand", "p_size")


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM (SELECT *, min(l_returnflag) OVER (PARTITION BY l_orderkey) AS b FROM lineitem) WHERE l_returnflag = b")
def strategy_cascade(t: Tables) -> DataFrame:
    """Rows of each group's best strategy."""
    return takeoff.strategy_cascade(t.lineitem, "l_orderkey", "l_returnflag").select("l_orderkey", "l_linenumber", "l_returnflag")


@query("""
SELECT p_brand, p_size FROM part WHERE p_type = 'STEEL' UNION ALL SELECT p_brand, p_size FROM part p WHERE p_type <> 'STEEL' AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_type = 'STEEL' AND q.p_brand = p.p_brand AND q.p_size = p.p_size)
""")
def room_union(t: Tables) -> DataFrame:
    """Stamped rooms and unmatched labelled ones."""
    stamped, labelled = (t.part.where(c).select("p_brand", "p_size") for c in ("p_type = 'STEEL'", "p_type <> 'STEEL'"))
    return takeoff.room_union(stamped, labelled, ["p_brand", "p_size"])


@query("""
WITH own AS (SELECT l_partkey AS d, min(l_orderkey) AS c FROM lineitem WHERE l_quantity > 30 GROUP BY 1), s AS (SELECT c, sum(CAST(p_retailprice AS DECIMAL(28, 6))) AS drop_length, count(*) AS n FROM part LEFT JOIN own ON p_partkey = d GROUP BY 1)
SELECT o_orderkey AS circuit_id, o_totalprice AS in_plan, CAST(coalesce(drop_length, 0) AS DOUBLE) AS drop_length, coalesce(n, 0) AS n_devices FROM orders LEFT JOIN s ON o_orderkey = c
UNION ALL SELECT c, NULL, CAST(drop_length AS DOUBLE), n FROM s WHERE c IS NULL
""")
def circuit_roll_up(t: Tables) -> DataFrame:
    """Device drops by first claim, unattributed ones in the null row."""
    claims = t.lineitem.where("l_quantity > 30").select(F.col("l_orderkey").alias("circuit_id"), F.col("l_partkey").alias("device_id"))
    drops = t.part.select(F.col("p_partkey").alias("device_id"), F.col("p_retailprice").alias("drop"))
    circuits = t.orders.select(F.col("o_orderkey").alias("circuit_id"), F.col("o_totalprice").alias("in_plan"))
    return takeoff.circuit_roll_up(claims, drops, circuits).withColumn("drop_length", F.col("drop_length").cast("double"))


@query("""
WITH r AS (SELECT o_orderkey AS circuit_id, o_totalprice AS in_plan, o_totalprice / 4 AS drop_length FROM orders), h AS (SELECT l_orderkey AS circuit_id, max(l_quantity) AS home_run FROM lineitem WHERE l_quantity > 20 GROUP BY 1)
SELECT CAST(sum(CAST(in_plan AS DECIMAL(28, 6))) AS DOUBLE) AS in_plan, CAST(sum(CAST(drop_length AS DECIMAL(28, 6))) AS DOUBLE) AS drops, CAST(sum(CAST(home_run AS DECIMAL(28, 6))) AS DOUBLE) AS home_runs,
  sum((home_run IS NULL)::INT)::BIGINT AS no_anchor,
  round(CAST(round((sum(CAST(in_plan AS DECIMAL(28, 6))) + sum(CAST(drop_length AS DECIMAL(28, 6))) + sum(CAST(home_run AS DECIMAL(28, 6)))) * 1.1, 6) AS DOUBLE), 4) AS with_spare FROM r LEFT JOIN h USING (circuit_id)
""")
def cable_assembly(t: Tables) -> DataFrame:
    """Cable totals with spare."""
    rolled = t.orders.select(F.col("o_orderkey").alias("circuit_id"), F.col("o_totalprice").alias("in_plan"), (F.col("o_totalprice") / 4).alias("drop_length"))
    homes = t.lineitem.where("l_quantity > 20").groupBy(F.col("l_orderkey").alias("circuit_id")).agg(F.max("l_quantity").alias("home_run"))
    found = takeoff.assembly_totals(rolled, homes)
    return found.select(*[F.col(c).cast("double").alias(c) for c in ("in_plan", "drops", "home_runs")], "no_anchor", F.round(F.col("with_spare").cast("double"), 4).alias("with_spare"))


SHEETS = """
src AS (SELECT c_nationkey AS sheet, 'G' || (c_custkey % 40) AS label, (c_custkey * 37) % 1000 AS x, (c_custkey * 91) % 1000 AS y FROM customer),
dst AS (SELECT sheet, label, x + 5 + CASE WHEN label = 'G7' THEN 2 ELSE 0 END + sheet % 3 AS x, y - 3 AS y FROM src),
one AS (SELECT * FROM src QUALIFY count(*) OVER (PARTITION BY sheet, label) = 1), two AS (SELECT * FROM dst QUALIFY count(*) OVER (PARTITION BY sheet, label) = 1),
delta AS (SELECT sheet, two.x - one.x AS dx, two.y - one.y AS dy FROM one JOIN two USING (sheet, label)),
shift AS (SELECT sheet, median(dx) AS dx, median(dy) AS dy, count(*) AS n FROM delta GROUP BY 1),
res AS (SELECT d.sheet, max(sqrt((d.dx - s.dx) * (d.dx - s.dx) + (d.dy - s.dy) * (d.dy - s.dy))) AS r FROM delta d JOIN shift s USING (sheet) GROUP BY 1)
"""


@query(f"WITH {SHEETS} SELECT sheet, n AS n_matches, dx, dy, round(r, 6) AS residual_max, CASE WHEN n < 2 OR r > 3 THEN 'failed' WHEN n >= 3 AND r <= 1 THEN 'good' ELSE 'degraded' END AS quality FROM shift JOIN res USING (sheet)")
def sheet_registration(t: Tables) -> DataFrame:
    """Median shift of uniquely labelled points with a quality class."""
    source, target = _sheets(t)
    found = takeoff.register_sheets(source, target, "sheet")
    return found.select("sheet", "n_matches", "dx", "dy", F.round("residual_max", 6).alias("residual_max"), "quality")


def _sheets(t: Tables) -> tuple[DataFrame, DataFrame]:
    source = t.customer.select(
        F.col("c_nationkey").alias("sheet"), F.concat(F.lit("G"), (F.col("c_custkey") % 40).cast("string")).alias("label"),
        ((F.col("c_custkey") * 37) % 1000).cast("double").alias("x"), ((F.col("c_custkey") * 91) % 1000).cast("double").alias("y"),
    )
    moved = F.col("x") + 5 + F.when(F.col("label") == "G7", 2).otherwise(0) + F.col("sheet") % 3
    return source, source.withColumn("x", moved).withColumn("y", F.col("y") - 3)


@query(f"WITH {SHEETS} SELECT sheet, round(avg(src.x + dx), 6) AS x, round(avg(src.y + dy), 6) AS y FROM src JOIN shift USING (sheet) GROUP BY 1")
def registered_points(t: Tables) -> DataFrame:
    """points moved into the target sheet's frame."""
    source, target = _sheets(t)
    moved = takeoff.shifted(source, takeoff.register_sheets(source, target, "sheet"), "sheet")
    return moved.groupBy("sheet").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))


@query("""
SELECT coalesce(a.k, b.k, c.k) AS room, CAST(a.v AS DOUBLE) AS measured, CAST(b.v AS DOUBLE) AS counted, CAST(c.v AS DOUBLE) AS estimated
FROM (SELECT l_partkey AS k, sum(CAST(l_quantity AS DECIMAL(28, 6))) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a
FULL JOIN (SELECT l_partkey AS k, count(*) AS v FROM lineitem WHERE l_quantity > 49 GROUP BY 1) b ON a.k = b.k FULL JOIN (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_size > 40) c ON coalesce(a.k, b.k) = c.k
""")
def room_totals(t: Tables) -> DataFrame:
    """Measured, counted and estimated kept apart by room."""
    line = t.lineitem.withColumnRenamed("l_partkey", "room")
    found = takeoff.room_totals(
        line.where("l_returnflag = 'A'").select("room", F.col("l_quantity").alias("value")), line.where("l_quantity > 49").select("room", F.lit(1).alias("value")),
        t.part.where("p_size > 40").select(F.col("p_partkey").alias("room"), F.col("p_size").alias("value")), "room",
    )
    return found.select("room", *[F.col(c).cast("double").alias(c) for c in ("measured", "counted", "estimated")])


@query("""
SELECT round(CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_totalprice AS DECIMAL(28, 6)) END) / sum(CAST(o_totalprice AS DECIMAL(28, 6))) AS DOUBLE), 4) AS no_anchor_fraction, count(*) AS n_circuits, 'ok' AS band FROM orders
""")
def floor_summary(t: Tables) -> DataFrame:
    """Share of home runs without an anchor, and its band."""
    rows = t.orders.withColumn("anchor", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey")))
    return takeoff.floor_summary(rows, "o_totalprice", "anchor")


@query(f"""
WITH {V_POINTS}, {V_LABELS}, near AS (SELECT l.label_id, p.point_id, p.y AS py FROM labels_at l JOIN points p ON p.sheet = l.sheet AND abs(p.x - l.x) <= 60 AND p.y > l.y AND p.y - l.y <= 120)
SELECT label_id, string_agg('P' || point_id, ' ' ORDER BY py DESC, point_id) AS name FROM near GROUP BY 1
""")
def stacked_names(t: Tables) -> DataFrame:
    """Name lines stacked above a number."""
    names = select_list(t.customer, POINTS).withColumn("text", F.concat(F.lit("P"), F.col("point_id").cast("string")))
    return takeoff.text_above(select_list(t.supplier, LABELS), names, ["sheet"], 60.0, 120.0, "label_id", "point_id")


@query("""
WITH p AS (SELECT l_partkey AS i, l_suppkey AS j, min(l_extendedprice) AS d FROM lineitem GROUP BY ALL)
SELECT i, j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS a, row_number() OVER (PARTITION BY j ORDER BY d, i) AS b FROM p) WHERE a = 1 AND b = 1
""")
def mutual_fragments(t: Tables) -> DataFrame:
    """Pairs that are each other's nearest."""
    pairs = t.lineitem.groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.min("l_extendedprice").alias("d"))
    return takeoff.mutual_pairs(pairs, "i", "j", "d").select("i", "j")


@query(f"""
WITH g AS (SELECT p_partkey, p_partkey % 8 AS k, CASE p_partkey % 3 WHEN 0 THEN 'SA' WHEN 1 THEN 'CHW' ELSE 'LIFE' END AS s, p_size AS n FROM part)
SELECT p_partkey, CASE WHEN k = 0 THEN s || ' FB' WHEN k IN (1, 2, 3, 4) THEN s END AS service, CASE WHEN k = 0 THEN 'rect' WHEN k IN (1, 2, 3, 4) THEN 'round' END AS size_kind,
  CASE WHEN k IN (1, 2, 3, 4) THEN n + 50 END AS diameter, CASE WHEN k = 0 THEN n * 10 END AS width, CASE WHEN k = 0 THEN n * 5 + 100 END AS height,
  CASE WHEN k IN (0, 1, 2) THEN s WHEN k = 3 AND s <> 'LIFE' THEN s END || CASE WHEN k = 0 THEN ' FB' ELSE '' END AS strict_service FROM g
""")
def pipe_tags(t: Tables) -> DataFrame:
    """pipe tags, the size before the service: rectangular, in millimetres, by glyph and bare; units, note words,
    header vessels and texts without a size aren't tags; strict, contact details and services outside the vocabulary aren't either."""
    k, n = F.col("p_partkey"), F.col("p_size")
    word = lambda c: c.cast("string")
    s = F.when(k % 3 == 0, "SA").when(k % 3 == 1, "CHW").otherwise("LIFE")
    d = word(n + 50)
    shapes = [
        F.concat(word(n * 10), F.lit(" x "), word(n * 5 + 100), F.lit("mm "), s, F.lit(" FB ABOVE CEILING")), F.concat(d, F.lit("mm  "), s), F.concat(F.lit("\\L"), d, F.lit(" mm "), F.lower(s)), F.concat(d, F.lit("Ø"), s, F.lit(" AT HL")),
        F.concat(d, F.lit(" "), s), F.concat(d, F.lit(" mm AND NOT")), F.concat(F.lit("Ø"), d, F.lit(" "), s, F.lit(" HEADER")), s,
    ]
    text = F.element_at(F.array(*shapes), (k % 8 + 1).cast("int"))
    tag, strict = S.round_tag(text), S.round_tag(text, strict=True)
    return t.part.select("p_partkey", *[tag[c].alias(c) for c in ("service", "size_kind", "diameter", "width", "height")], strict["service"].alias("strict_service"))


@query(r"""
SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)+'), lambda x: regexp_matches(x, '[0-9]'))[1] AS number FROM documents
""")
def room_numbers(t: Tables) -> DataFrame:
    """F16: first dotted token with a digit."""
    return t.documents.select("doc_id", S.room_number(F.col("text")).alias("number"))


@query("""
SELECT p_partkey, 'PA' || p_size AS abbreviation, p_name || ' of ' || p_brand AS definition FROM part
""")
def legend_prose(t: Tables) -> DataFrame:
    """abbreviation and definition of a legend line."""
    line = F.concat(F.lit("  PA"), F.col("p_size").cast("string"), F.lit(" -  "), F.col("p_name"), F.lit(" of "), F.col("p_brand"), F.lit(" "))
    parsed = S.prose_line(line)
    return t.part.select("p_partkey", parsed["abbreviation"].alias("abbreviation"), parsed["definition"].alias("definition"))


@query("""
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'background' WHEN 1 THEN 'foreground' WHEN 2 THEN 'services' WHEN 3 THEN 'services' WHEN 4 THEN 'unknown' WHEN 5 THEN 'background' END AS role, CASE p_partkey % 7 WHEN 6 THEN 'other' ELSE 'known' END AS kind FROM part WHERE p_partkey % 7 < 6
UNION ALL SELECT p_partkey, CASE WHEN (p_partkey * 7) % 256 > 0 OR (p_partkey * 11) % 256 > 0 OR (p_partkey * 13) % 256 > 0 THEN CASE
  WHEN (greatest((p_partkey * 7) % 256, (p_partkey * 11) % 256, (p_partkey * 13) % 256) - least((p_partkey * 7) % 256, (p_partkey * 11) % 256, (p_partkey * 13) % 256)) * 1.0 / greatest((p_partkey * 7) % 256, (p_partkey * 11) % 256, (p_partkey * 13) % 256) >= 0.3 THEN 'services'
  WHEN ((p_partkey * 7) % 256 + (p_partkey * 11) % 256 + (p_partkey * 13) % 256) / 765.0 >= 0.5 THEN 'background' ELSE 'foreground' END ELSE 'foreground' END, 'other' FROM part WHERE p_partkey % 7 = 6
""")
def layer_roles(t: Tables) -> DataFrame:
    """Role of a layer by its pen's colour, else by the first known part of its name, background before foreground before services."""
    k = F.col("p_partkey")
    names = ["A-Space Tags", "Pipe tags", "M_DRAIN_2", "ext-VENT-1", "event prevention", "Colour Fill pipe"]
    name = F.when(k % 7 == 6, F.concat(F.lit("pen-"), _rgb("p_partkey", 7, 11, 13), F.lit("-w2"))).otherwise(F.element_at(F.array(*map(F.lit, names)), (k % 7 + 1).cast("int")))
    return t.part.select("p_partkey", S.layer_role(name).alias("role"), F.when(k % 7 == 6, "other").otherwise("known").alias("kind"))


@query("""
SELECT p_brand, round(c, 6) AS centre, n FROM (
  WITH RECURSIVE v AS (SELECT p_brand, CAST(p_size AS DOUBLE) AS s, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS i FROM part),
  w AS (SELECT p_brand, i, s AS total, 1 AS n, 1 AS cluster FROM v WHERE i = 1
    UNION ALL SELECT v.p_brand, v.i, CASE WHEN v.s - w.total / w.n <= 4 THEN w.total + v.s ELSE v.s END, CASE WHEN v.s - w.total / w.n <= 4 THEN w.n + 1 ELSE 1 END,
      CASE WHEN v.s - w.total / w.n <= 4 THEN w.cluster ELSE w.cluster + 1 END FROM w JOIN v ON v.p_brand = w.p_brand AND v.i = w.i + 1)
  SELECT p_brand, cluster, arg_max(total / n, n) AS c, max(n)::BIGINT AS n FROM w GROUP BY p_brand, cluster)
""")
def row_clusters(t: Tables) -> DataFrame:
    """Rows clustered by running mean."""
    return windows.clustered_rows(t.part, ["p_brand"], "p_size", 4.0).withColumn("centre", F.round("centre", 6))
