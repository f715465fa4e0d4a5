"""Report, face and floor queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import faces, normalize, quantities, reports
from plumbline.plans.attribution import SHEETS, _rgb, _sheets
from plumbline.plans.base import LABELS, POINTS, V_LABELS, V_POINTS, Tables, query, select_list


@query("SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_size, p_partkey")
def definition_scan(t: Tables) -> DataFrame:
    """Definitions in sequence order."""
    return t.part.select("p_partkey", "p_brand", "p_size").orderBy("p_size", "p_partkey")


@query("""
SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber > 2 THEN l_returnflag END, lower(p_brand)) AS colour FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber IN (1, 2, 4) AND p_size > 10
""")
def routed_scan(t: Tables) -> DataFrame:
    """Routed rows with their own colour, else their layer's."""
    layers = t.part.where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_brand").alias("layer_colour"))
    rows = t.lineitem.where("l_linenumber in (1, 2, 4)").join(layers, "l_partkey")
    own = F.when(F.col("l_linenumber") > 2, F.col("l_returnflag"))
    return rows.select("l_orderkey", "l_linenumber", F.coalesce(own, "layer_colour").alias("colour"))


@query("SELECT o_orderkey, c_name, c_custkey IS NOT NULL AS available FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def sub_documents(t: Tables) -> DataFrame:
    """Sub-documents with availability."""
    revisions = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    found = t.customer.where("c_acctbal > 0").select("c_custkey", "c_name")
    return revisions.join(reports.sub_documents(revisions.distinct(), found, "c_custkey", "c_name").distinct(), "c_custkey").select("o_orderkey", "c_name", "available")


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'ft' WHEN p_size % 4 = 1 THEN 'mm' ELSE 'unitless' END AS unit FROM part
""")
def effective_units(t: Tables) -> DataFrame:
    """Length unit, else unit, else unitless."""
    n = F.col("p_size") % 4
    unit = quantities.effective_unit(F.when(n == 0, " FT "), F.when(n <= 1, "mm").otherwise(" "))
    return t.part.select("p_partkey", unit.alias("unit"))


@query(f"""
WITH {V_LABELS}, {V_POINTS}, box AS (SELECT sheet, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS cy FROM labels_at GROUP BY 1)
SELECT p.point_id, 'T' || (point_id % 7) AS abbreviation FROM points p LEFT JOIN box b ON p.sheet = b.sheet WHERE point_id % 7 < 4 AND NOT coalesce(x BETWEEN ax AND bx AND y BETWEEN ay AND cy, FALSE)
""")
def legend_devices(t: Tables) -> DataFrame:
    """Texts equal to an abbreviation, outside the legend's own box."""
    texts = select_list(t.customer, POINTS).withColumn("abbreviation", F.concat(F.lit("T"), (F.col("point_id") % 7).cast("string")))
    known = t.supplier.select(F.concat(F.lit("T"), (F.col("s_suppkey") % 4).cast("string")).alias("abbreviation")).distinct()
    box = select_list(t.supplier, LABELS).groupBy("sheet").agg(F.min("x").alias("ax"), F.max("x").alias("bx"), F.min("y").alias("ay"), F.max("y").alias("cy"))
    met = texts.join(known, "abbreviation", "left_semi").join(box, "sheet", "left")
    inside = F.coalesce(F.col("x").between(F.col("ax"), F.col("bx")) & F.col("y").between(F.col("ay"), F.col("cy")), F.lit(False))
    return met.where(~inside).select("point_id", "abbreviation")


@query("""
SELECT l_orderkey * 10 + l_linenumber AS op_id, 'unknown_block' AS code FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)
UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'unknown_layer' FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
""")
def changeset_findings(t: Tables) -> DataFrame:
    """References of operations that don't exist."""
    ops = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("op_id"), "l_partkey", "l_suppkey")
    lookups = {"unknown_block": ("l_partkey", t.part.where("p_size > 3"), "p_partkey"), "unknown_layer": ("l_suppkey", t.supplier.where("s_acctbal > 0"), "s_suppkey")}
    return reports.existence_findings(ops, "op_id", lookups)


@query("""
SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_layers, sum((l_linenumber > 2)::INT)::BIGINT AS n_nested, sum((l_quantity > 25)::INT)::BIGINT AS n_instances FROM lineitem GROUP BY 1
""")
def structural_fingerprint(t: Tables) -> DataFrame:
    """Informational structure counts."""
    return reports.fingerprint(t.lineitem, "l_orderkey", "l_returnflag", F.col("l_linenumber") > 2, F.col("l_quantity") > 25)


@query("""
SELECT o_custkey, sum((o_totalprice < 20000)::INT)::BIGINT AS n_dropped, sum((o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'))::INT)::BIGINT AS n_unsupported, count(*) AS n_rows,
  sum((o_totalprice < 20000)::INT) = 0 AND sum((o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'))::INT) = 0 AS complete FROM orders GROUP BY 1
""")
def census_completeness(t: Tables) -> DataFrame:
    """Dropped and unsupported rows."""
    return reports.census(t.orders, "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"], F.col("o_totalprice") < 20000)


@query("SELECT o_orderkey, sha256('overlap=0.' || (o_custkey % 9 + 1) || '|radius=5.0|snap=0.3') AS stamp FROM orders")
def parameter_stamps(t: Tables) -> DataFrame:
    """Fingerprint of the constants that a result was made with, from each row's own and the fixed ones."""
    overlap = F.concat(F.lit("0."), (F.col("o_custkey") % 9 + 1).cast("string"))
    return t.orders.select("o_orderkey", normalize.parameter_stamp({"snap": 0.3, "radius": 5.0, "overlap": overlap}).alias("stamp"))


@query("""
WITH entities AS (SELECT p_partkey AS entity, p_brand AS layer FROM part WHERE p_size > 2),
e AS (SELECT p_partkey AS entity, CASE WHEN p_size % 3 = 0 THEN 'removed' WHEN p_size % 3 = 1 THEN 'changed' ELSE 'metadata_only' END AS effect FROM part WHERE p_size > 20)
SELECT n.entity, CASE WHEN effect = 'changed' THEN 'new' ELSE layer END AS layer FROM entities n LEFT JOIN e ON n.entity = e.entity WHERE coalesce(effect, '') <> 'removed'
UNION ALL SELECT p_partkey, 'added' FROM part WHERE p_size <= 2
""")
def next_revision(t: Tables) -> DataFrame:
    """Rows of the revision that a changeset makes."""
    entities = t.part.where("p_size > 2").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("layer"))
    m = F.col("p_size") % 3
    effect = F.when(F.col("p_size") <= 2, "added").when(m == 0, "removed").when(m == 1, "changed").otherwise("metadata_only")
    layer = F.when(effect == "added", "added").when(effect == "changed", "new")
    effects = t.part.where("p_size <= 2 or p_size > 20").select(F.col("p_partkey").alias("entity"), layer.alias("layer"), effect.alias("effect"))
    return reports.next_revision(entities, effects, "entity", "layer")


@query("""SELECT o_orderkey, '{"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS lineage FROM orders""")
def lineage_documents(t: Tables) -> DataFrame:
    """Lineage fields as a document."""
    return reports.lineage_documents(t.orders, "o_orderkey", ["o_orderstatus", "o_custkey"])


@query("""
SELECT p_brand AS formula, p_type AS input_name, p_size AS entry_key, CASE WHEN p_size IN (SELECT s_nationkey FROM supplier) THEN 'bound' ELSE 'missing' END AS status
FROM (SELECT DISTINCT ON (p_brand, p_type) p_brand, p_type, p_size FROM part ORDER BY p_brand, p_type, p_size)
""")
def formula_bindings(t: Tables) -> DataFrame:
    """Formula inputs bound to snapshot entries."""
    one = t.part.groupBy("p_brand", "p_type").agg(F.min("p_size").alias("p_size"))
    formulas = one.groupBy(F.col("p_brand").alias("formula")).agg(F.map_from_entries(F.collect_list(F.struct("p_type", "p_size"))).alias("inputs"))
    return reports.bind_inputs(formulas, t.supplier.select(F.col("s_nationkey").alias("entry_key")), "formula", "inputs")


@query("""
SELECT o_orderkey, printf('%.15g', o_totalprice) AS x, printf('%.15g', -o_totalprice / 8192) AS small, printf('%.15g', o_totalprice * 1e-12) AS tiny, printf('%.15g', o_totalprice * 1e14) AS large,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at, CASE WHEN o_custkey % 2 = 0 THEN 'length:model' ELSE 'length' END AS label, CASE WHEN o_custkey % 2 = 0 THEN 'f' || o_orderkey END AS file_id
FROM (SELECT * REPLACE (CAST(CAST(o_totalprice AS INTEGER) AS DOUBLE) AS o_totalprice) FROM orders)
""")
def export_fields(t: Tables) -> DataFrame:
    """number, time, label and token texts."""
    even, price = F.col("o_custkey") % 2 == 0, F.bround(F.col("o_totalprice")).cast("int").cast("double")
    token = F.when(even, F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(":lighting"))).otherwise("broken token")
    numbers = {"x": price, "small": -price / 8192, "tiny": price * 1e-12, "large": price * 1e14}
    return t.orders.select(
        "o_orderkey", *[S.general_text(v).alias(n) for n, v in numbers.items()], S.iso_utc(F.col("o_orderdate")).alias("at"),
        S.quantity_label(F.lit("length"), F.when(even, "model").otherwise("")).alias("label"), S.role_token(token)["id"].alias("file_id"),
    )


@query("""
SELECT p_partkey, p_size AS n, CAST(p_size AS DOUBLE) AS x_last FROM part
""")
def polyline_round_trip(t: Tables) -> DataFrame:
    """polylines as text and back."""
    points = F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: F.struct(i.cast("double").alias("x"), (i * 2).cast("double").alias("y")))
    back = S.text_polyline(S.polyline_text(points))
    return t.part.select("p_partkey", F.size(back).alias("n"), F.element_at(back, -1)["x"].alias("x_last"))


@query("""
SELECT s_nationkey AS sheet, s_suppkey AS part, CAST(side AS BIGINT) AS side, CAST((10 + s_suppkey % 7) * (5 + s_suppkey % 5) / 2.0 - CASE WHEN side = 0 THEN 2 ELSE 0 END AS DOUBLE) AS area, CASE WHEN side = 0 THEN 1 ELSE 0 END::BIGINT AS n_holes FROM supplier, (SELECT unnest([0, 1]) AS side)
UNION ALL SELECT s_nationkey, s_suppkey, 0, 2.0, 0 FROM supplier
""")
def wall_faces(t: Tables) -> DataFrame:
    """Closed faces of wall lines, noded at crossings: a rectangle with a middle wall that overshoots and a pillar, a hole of one half, for each supplier.

    All suppliers of a nation stand in one sheet, and the sheets have equal coordinates."""
    k = F.col("s_suppkey").cast("double")
    x, w, h = k * 40, (F.lit(10) + F.col("s_suppkey") % 7).cast("double"), (F.lit(5) + F.col("s_suppkey") % 5).cast("double")
    zero, one, three = F.lit(0.0), F.lit(1.0), F.lit(3.0)
    walls = [(x, zero, x + w, zero), (x + w, zero, x + w, h), (x + w, h, x, h), (x, h, x, zero), (x + w / 2, F.lit(-1.0), x + w / 2, h + 1)]
    walls += [(x + 1, one, x + 2, one), (x + 2, one, x + 2, three), (x + 2, three, x + 1, three), (x + 1, three, x + 1, one)]
    rows = F.array(*[F.struct(F.lit(i).alias("n"), *[c.alias(n) for c, n in zip(wall, ("x0", "y0", "x1", "y1"), strict=True)]) for i, wall in enumerate(walls)])
    lines = t.supplier.select(F.col("s_nationkey").alias("sheet"), "s_suppkey", F.inline(rows)).withColumn("segment_id", F.col("s_suppkey") * 10 + F.col("n"))
    found = faces.trace_faces(faces.split_at_crossings(lines, 40.0, group=["sheet"]), 0.1, 1.0, ["sheet"])
    owner, width = F.floor(F.col("min_x") / 40), F.col("max_x") - F.col("min_x")
    side = F.when(width < 2, 0).otherwise((F.col("min_x") > owner * 40 + 1).cast("int"))
    return found.select("sheet", owner.alias("part"), side.cast("long").alias("side"), F.round("area", 6).alias("area"), "n_holes")


@query(f"""
WITH {SHEETS}, frames AS (SELECT sheet, dx, dy FROM shift JOIN res USING (sheet) WHERE NOT (n < 2 OR r > 3)),
boxes AS (SELECT p_partkey AS room_id, CAST((p_partkey * 61) % 950 AS DOUBLE) AS rx, CAST((p_partkey * 83) % 950 AS DOUBLE) AS ry, 40.0 + p_size AS w, 30.0 + p_partkey % 37 AS h FROM part),
d AS (SELECT c_custkey AS id, c_nationkey AS sheet, (c_custkey * 37) % 1000 AS x, (c_custkey * 91) % 1000 AS y FROM customer),
m AS (SELECT o_orderkey AS id, o_custkey % 25 AS sheet, (o_orderkey * 37) % 1000 AS x, (o_orderkey * 91) % 1000 AS y FROM orders),
dd AS (SELECT id, x + dx AS x, y + dy AS y FROM d JOIN frames USING (sheet)), mm AS (SELECT id, x + dx AS x, y + dy AS y FROM m JOIN frames USING (sheet)),
dr AS (SELECT dd.id, arg_min(room_id, (w * h, room_id)) AS room_id FROM dd LEFT JOIN boxes ON x BETWEEN rx AND rx + w AND y BETWEEN ry AND ry + h GROUP BY 1),
mr AS (SELECT mm.id, arg_min(room_id, (w * h, room_id)) AS room_id FROM mm LEFT JOIN boxes ON x BETWEEN rx AND rx + w AND y BETWEEN ry AND ry + h GROUP BY 1),
rows AS (SELECT room_id, NULL AS measured, 1 AS counted, 1.2 AS estimated FROM dr UNION ALL SELECT room_id, id % 50, NULL, NULL FROM mr)
SELECT room_id, CAST(sum(measured) AS DOUBLE) AS measured, CAST(sum(counted) AS DOUBLE) AS counted, CAST(sum(estimated) AS DOUBLE) AS estimated FROM rows GROUP BY 1
""")
def floor_takeoff(t: Tables) -> DataFrame:
    """A floor of several sheets: registration, frames, rooms, measured, counted and estimated totals."""
    source, target = _sheets(t)
    at = lambda key: (((F.col(key) * 37) % 1000).cast("double").alias("x"), ((F.col(key) * 91) % 1000).cast("double").alias("y"))
    devices = t.customer.select(F.col("c_custkey").alias("device_id"), F.col("c_nationkey").alias("sheet"), *at("c_custkey"), F.lit(1.2).alias("drop"))
    lengths = t.orders.select(F.col("o_orderkey").alias("length_id"), (F.col("o_custkey") % 25).cast("int").alias("sheet"), *at("o_orderkey"), (F.col("o_orderkey") % 50).alias("length"))
    x, y = ((F.col("p_partkey") * 61) % 950).cast("double"), ((F.col("p_partkey") * 83) % 950).cast("double")
    w, h = F.lit(40.0) + F.col("p_size"), F.lit(30.0) + F.col("p_partkey") % 37
    ring = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))])
    rooms = t.part.select(F.col("p_partkey").alias("room_id"), ring.alias("ring"), (w * h).alias("area"))
    found = reports.floor_takeoff(source, target, devices, lengths, rooms, "sheet", 90.0)
    return found.select("room_id", *[F.col(c).cast("double").alias(c) for c in ("measured", "counted", "estimated")])
