"""Room and band queries: rings as rooms, naming, assignment, measured attribution, takeoff compositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import bands, quality, rooms, takeoff
from plumbline.plans.base import Tables, query


def _rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))])


#: A floor for each customer: a street of rooms 10 wide, one for each order, with half as high inner rooms in every third.
def _street(t: Tables) -> DataFrame:
    k = F.col("o_orderkey").cast("double")
    return t.orders.select(F.col("o_custkey").alias("floor"), F.col("o_orderkey").alias("n"), (k * 20).alias("x"))


def _rooms(t: Tables) -> DataFrame:
    s = _street(t)
    outer = s.select("floor", "n", F.col("n").cast("string").alias("entity"), _rect(F.col("x"), F.lit(0.0), F.lit(10.0), F.lit(10.0)).alias("points"), F.lit(None).cast("boolean").alias("closed"))
    inner = s.where("n % 3 = 0").select("floor", "n", F.concat(F.lit("in"), F.col("n").cast("string")).alias("entity"), _rect(F.col("x"), F.lit(0.0), F.lit(10.0), F.lit(5.0)).alias("points"), F.lit(True).alias("closed"))
    open_ = s.where("n % 5 = 0").select("floor", "n", F.concat(F.lit("open"), F.col("n").cast("string")).alias("entity"), _rect(F.col("x"), F.lit(0.0), F.lit(4.0), F.lit(4.0)).alias("points"), F.lit(False).alias("closed"))
    flat = s.where("n % 7 = 0").select("floor", "n", F.concat(F.lit("flat"), F.col("n").cast("string")).alias("entity"), _rect(F.col("x"), F.lit(0.0), F.lit(4.0), F.lit(0.0)).alias("points"), F.lit(True).alias("closed"))
    return rooms.rooms_from_rings(outer.union(inner).union(open_).union(flat), "entity", "explicit", ["floor"])


@query("""
SELECT o_custkey AS floor, CAST(o_orderkey AS VARCHAR) AS room_id, 100.0 AS area FROM orders
UNION ALL SELECT o_custkey, 'in' || o_orderkey, 50.0 FROM orders WHERE o_orderkey % 3 = 0
""")
def explicit_rooms(t: Tables) -> DataFrame:
    """Closed rings as rooms; open ones and those without an area aren't."""
    return _rooms(t).select("floor", "room_id", "area")


@query("""
SELECT o_custkey AS floor, o_orderkey AS n, CASE WHEN o_orderkey % 3 = 0 THEN 'in' ELSE '' END || o_orderkey AS room_id FROM orders
""")
def entities_of_rooms(t: Tables) -> DataFrame:
    """Entities by the middle of their box, in the smallest room that holds it."""
    x = F.col("x")
    box = F.struct((x + 1).alias("min_x"), F.lit(1.0).alias("min_y"), (x + 3).alias("max_x"), F.lit(3.0).alias("max_y"))
    e = _street(t).select("floor", "n", box.alias("box"))
    asked = F.when(F.col("room_id").startswith("open"), F.lit(None)).otherwise(F.col("room_id"))
    return rooms.entities_in_room(e, _rooms(t), asked, "n", 40.0, ["floor"]).select("floor", "n", "room_id")


def _labels(t: Tables) -> DataFrame:
    """Two numbers and two names in each room; the later ones count for nothing."""
    k, x = F.col("n"), F.col("x")
    texts = [F.concat(F.lit("1."), k.cast("string")), F.concat(F.lit("Room "), k.cast("string")), F.lit("9.9"), F.lit("Store")]
    rows = F.array(*[F.struct((k * 4 + i).alias("label_id"), (x + 2 + i).alias("x"), F.lit(7.0).alias("y"), text.alias("text")) for i, text in enumerate(texts)])
    return _street(t).select("floor", F.inline(rows))


@query("""
SELECT o_custkey AS floor, CAST(o_orderkey AS VARCHAR) AS room_id, '1.' || o_orderkey AS number, 'Room ' || o_orderkey AS name FROM orders
UNION ALL SELECT o_custkey, 'in' || o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 3 = 0
""")
def stamped_room_names(t: Tables) -> DataFrame:
    """Numbers and names of rooms from the first labels inside them."""
    return rooms.named_rooms(_rooms(t), _labels(t), 40.0, ["floor"]).select("floor", "room_id", "number", "name")


@query("""
SELECT o_custkey AS floor, o_orderkey * 4 + i AS label_id, CASE i WHEN 0 THEN 'Plant' WHEN 1 THEN 'Store' END AS name FROM orders, (SELECT unnest([0, 1, 2]) AS i)
""")
def label_cluster_rooms(t: Tables) -> DataFrame:
    """Number labels with the nearest name that no earlier number took; the third finds none left."""
    k, x = F.col("n"), F.col("x")
    spots = [(0, 0.0, "7.1"), (1, 0.4, "7.2"), (2, 0.8, "7.3"), (3, 0.1, "Plant"), (9, 0.9, "Store")]
    rows = F.array(*[F.struct((F.lit(i) + k * 4 if i < 3 else F.lit(i) - 1000000 * (k + 1)).alias("label_id"), (x + dx).alias("x"), F.lit(0.5 if i > 2 else 0.0).alias("y"), F.lit(text).alias("text")) for i, dx, text in spots])
    return rooms.label_rooms(_street(t).select("floor", F.inline(rows)), 1.5, ["floor"]).select("floor", "label_id", "name")


@query("""
WITH r AS (SELECT o_custkey AS floor, o_orderkey AS n FROM orders), dup AS (SELECT floor, n % 2 AS m, count(*) AS c FROM r WHERE n % 4 < 2 GROUP BY ALL)
SELECT r.floor, CAST(n AS VARCHAR) AS room, '5.' || (n % 2) AS number, dup.c > 1 AS needs_review, 1 AS n_devices FROM r JOIN dup ON r.floor = dup.floor AND n % 2 = m WHERE n % 4 < 2
UNION ALL SELECT floor, CAST(n AS VARCHAR), NULL, FALSE, 1 FROM r WHERE n % 4 >= 2
UNION ALL SELECT floor, 'label-' || (n * 4 + 2), '8.' || n, FALSE, 1 FROM r
""")
def room_pipeline(t: Tables) -> DataFrame:
    """Strategy, zones, names, label rooms, device assignment and review flags over all floors at once.

    Rooms of the second strategy are there and serve no floor. Half the rooms' numbers lie in a notice zone; the other half's
    repeat on a floor. A number beside each room is a label room with a device of its own.
    """
    s = _street(t)
    one = _rooms(t).where("not room_id like 'in%'").withColumn("rank", F.lit(0))
    two = one.withColumn("rank", F.lit(1)).withColumn("room_id", F.concat(F.lit("w"), F.col("room_id")))
    k, x = F.col("n"), F.col("x")
    inside = s.select("floor", (k * 4).alias("label_id"), (x + 5).alias("x"), F.lit(5.0).alias("y"), F.concat(F.lit("5."), (k % 2).cast("string")).alias("text"))
    beside = s.select("floor", (k * 4 + 2).alias("label_id"), (x + 14).alias("x"), F.lit(5.0).alias("y"), F.concat(F.lit("8."), k.cast("string")).alias("text"))
    zone = F.struct((x + 4).alias("min_x"), F.lit(4.0).alias("min_y"), (x + 6).alias("max_x"), F.lit(6.0).alias("max_y"))
    devices = s.select("floor", (k * 2).alias("device_id"), (x + 1).alias("x"), F.lit(1.0).alias("y")).union(s.select("floor", k * 2 + 1, x + 15, F.lit(5.0)))
    found, placed = rooms.room_pipeline(one.union(two), inside.union(beside), devices, s.where("n % 4 >= 2").select("floor", zone.alias("box")), 40.0, 1.5, 3.0, ["floor"])
    counts = placed.groupBy("floor", "room").agg(F.count("*").cast("int").alias("n_devices"))
    return found.select("floor", "room", "number", "needs_review").join(counts, ["floor", "room"], "left")


@query("""
SELECT l_returnflag AS room, l_suppkey % 3 AS kind, count(*) AS n, FALSE AS excluded FROM lineitem WHERE l_suppkey % 3 <> 2 GROUP BY ALL UNION ALL SELECT NULL, 2, count(*), TRUE FROM lineitem WHERE l_suppkey % 3 = 2
""")
def counted_rooms(t: Tables) -> DataFrame:
    """Devices by room and kind; excluded kinds are tallied apart."""
    devices = t.lineitem.select(F.col("l_returnflag").alias("room"), (F.col("l_suppkey") % 3).alias("kind"))
    kept, out = rooms.counted_by_room(devices, "kind", "room", [2])
    return kept.withColumn("excluded", F.lit(False)).unionByName(out.withColumn("excluded", F.lit(True)), allowMissingColumns=True)


@query("""
WITH d AS (SELECT CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey % 50 END AS room, l_orderkey AS c, l_quantity AS v FROM lineitem), h AS (SELECT o_custkey % 50 AS room, o_orderkey AS c, o_totalprice AS v FROM orders WHERE o_orderkey % 4 = 0),
a AS (SELECT room, c, v AS d, 0 AS h FROM d UNION ALL SELECT room, c, 0, v FROM h)
SELECT room, CAST(sum(CAST(d AS DECIMAL(28, 6))) AS DOUBLE) AS drops, CAST(sum(CAST(h AS DECIMAL(28, 6))) AS DOUBLE) AS home_runs, count(DISTINCT c) AS n_circuits FROM a GROUP BY 1
""")
def estimated_rooms(t: Tables) -> DataFrame:
    """Drops in the device's room, home runs in the anchor's, and the circuits that touch a room."""
    drops = t.lineitem.select(F.when(F.col("l_suppkey") % 5 > 0, F.col("l_suppkey") % 50).alias("room"), F.col("l_orderkey").alias("circuit_id"), F.col("l_quantity").alias("drop"))
    homes = t.orders.where("o_orderkey % 4 = 0").select((F.col("o_custkey") % 50).alias("room"), F.col("o_orderkey").alias("circuit_id"), F.col("o_totalprice").alias("home_run"))
    found = rooms.estimated_by_room(drops, homes, "room")
    return found.select("room", *[F.col(c).cast("double").alias(c) for c in ("drops", "home_runs")], "n_circuits")


@query("""
WITH s AS (SELECT o_custkey AS floor, o_orderkey AS n FROM orders)
SELECT floor, CASE WHEN n % 3 = 0 THEN 'in' ELSE '' END || n AS room, 'polygon' AS basis, 6.0 AS length FROM s
UNION ALL SELECT floor, 'L' || n, 'label', 4.0 FROM s WHERE n % 2 = 0
UNION ALL SELECT floor, NULL, 'unassigned', 4.0 * count(*) FROM s WHERE n % 2 = 1 GROUP BY floor
""")
def measured_rooms(t: Tables) -> DataFrame:
    """Length inside rooms, and what lies outside by the nearest label room, else unassigned."""
    x = F.col("x")
    lines = _street(t).select("floor", F.col("n").alias("segment_id"), (x + 4).alias("x0"), F.lit(2.0).alias("y0"), (x + 14).alias("x1"), F.lit(2.0).alias("y1"))
    anchors = _street(t).where("n % 2 = 0").select("floor", F.concat(F.lit("L"), F.col("n").cast("string")).alias("room"), (x + 12).alias("x"), F.lit(2.0).alias("y"))
    found = rooms.measured_by_room(lines, _rooms(t), anchors, "segment_id", 40.0, 5.0, ["floor"])
    return found.withColumn("length", F.round(F.col("length").cast("double"), 6))


BANDS_SQL = """
WITH s AS (SELECT o_custkey AS floor, o_orderkey AS n FROM orders)
"""


def _bands(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Segments 10 long in their own street: the colour bands of k % 5: 0 half covered by two overlapping ones and a narrow other;
    1 beside one band; 2 between two at nearly equal distance; 3 far from all; 4 one of 2 of 10, then the nearest."""
    k, x = F.col("n"), F.col("x") * 10
    s = _street(t).withColumn("k", k % 5)
    lines = s.select("floor", F.col("n").alias("segment_id"), x.alias("x0"), F.lit(0.0).alias("y0"), (x + 10).alias("x1"), F.lit(0.0).alias("y1"))
    put = lambda kind, colour, dx, y, w, h: s.where(f"k = {kind}").select("floor", F.lit(colour).alias("colour"), F.lit(f"p{kind}").alias("pattern"), _rect(x + dx, F.lit(y), F.lit(w), F.lit(h)).alias("ring"))
    parts = [put(0, "red", 1.0, -1.0, 3.0, 2.0), put(0, "red", 3.0, -1.0, 3.0, 2.0), put(0, "blue", 7.0, -1.0, 1.0, 2.0), put(1, "red", 0.0, 0.061, 10.0, 1.0), put(2, "red", 0.0, 0.061, 10.0, 1.0), put(2, "blue", 0.0, -1.071, 10.0, 1.0), put(3, "red", 0.0, 0.5, 10.0, 1.0), put(4, "blue", 0.0, -1.0, 2.0, 2.0)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return lines, out


@query("""
SELECT o_custkey AS floor, o_orderkey AS segment_id, colour, round(overlap, 6) AS overlap, round(distance, 6) AS distance FROM orders JOIN (VALUES
  (0, 'red', 0.5022, 0.0), (0, 'blue', 0.1022, 0.0), (1, 'red', 0.0, 0.05), (2, 'red', 0.0, 0.05), (2, 'blue', 0.0, 0.06), (4, 'blue', 0.2011, 0.0)) v(k, colour, overlap, distance) ON o_orderkey % 5 = k
""")
def band_overlaps(t: Tables) -> DataFrame:
    """Shares of segments inside bands grown by 11 mm, overlapping ones counted once, and distances to them."""
    found = bands.measured_overlaps(*_bands(t), "segment_id", "colour", 60.0, ["floor"])
    return found.select("floor", "segment_id", "colour", F.round("overlap", 6).alias("overlap"), F.round("distance", 6).alias("distance"))


@query("""
SELECT o_custkey AS floor, o_orderkey % 5 AS k, CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'red' WHEN o_orderkey % 5 = 4 THEN 'blue' END AS colour, CASE o_orderkey % 5 WHEN 0 THEN 'overlap' WHEN 1 THEN 'nearest' WHEN 4 THEN 'nearest' ELSE 'shared' END AS basis, 10.0 * count(*) AS length FROM orders GROUP BY ALL
""")
def band_lengths(t: Tables) -> DataFrame:
    """Segments to bands by measured overlap, else the nearest with a margin, else shared; lengths by colour."""
    found = bands.attributed(*_bands(t), "segment_id", "colour", 60.0, ["floor"])
    sums = found.groupBy("floor", (F.col("segment_id") % 5).alias("k"), "colour", "basis").agg(F.sum("length").alias("length"))
    return sums.withColumn("length", F.round("length", 6))


CONTAINMENT_SQL = """
WITH v AS (SELECT o_custkey AS floor, o_orderkey AS n, o_orderkey % 5 AS k FROM orders),
named AS (SELECT floor, k, CASE k WHEN 0 THEN 'TRAY' WHEN 4 THEN CASE WHEN n % 2 = 0 THEN 'LIFE' ELSE 'LIFE FB' END END AS kind, CASE k WHEN 0 THEN 'legend' WHEN 4 THEN 'run_label' WHEN 1 THEN 'unresolved' ELSE 'shared' END AS basis FROM v),
heads AS (SELECT floor, max(kind = 'LIFE') AS has FROM named GROUP BY 1)
SELECT n.floor, CASE WHEN kind = 'LIFE FB' AND has THEN 'LIFE' ELSE kind END AS containment_type, basis, 10.0 * count(*) AS length FROM named n JOIN heads b ON n.floor = b.floor GROUP BY ALL
"""


def _containment(t: Tables) -> DataFrame:
    lines, rings = _bands(t)
    legend = t.customer.select(F.col("c_custkey").alias("floor"), F.lit("red").alias("colour"), F.lit("p0").alias("pattern"), F.lit("TRAY").alias("containment_type"))
    legend = legend.union(t.customer.select("c_custkey", F.lit("blue"), F.lit("p0"), F.lit("TRUNKING"))).union(t.customer.select("c_custkey", F.lit("red"), F.lit("p2"), F.lit("TRAY"))).union(t.customer.select("c_custkey", F.lit("blue"), F.lit("p2"), F.lit(None).cast("string")))
    x = F.col("x") * 10
    labels = _street(t).where("n % 5 = 4").select("floor", (x + 5).alias("x"), F.lit(1.0).alias("y"), F.when(F.col("n") % 2 == 0, "LIFE").otherwise("LIFE FB").alias("service"))
    return bands.containment_lengths(lines, rings, legend, labels, "segment_id", 60.0, ["floor"])


@query(CONTAINMENT_SQL)
def containment_takeoff(t: Tables) -> DataFrame:
    """Containment of all floors: bands typed by the legend, segments attributed, unmapped ones by their label, label families merged."""
    return _containment(t).withColumn("length", F.round(F.col("length").cast("double"), 6))


@query(f"""
WITH lengths AS ({CONTAINMENT_SQL}) SELECT floor, 'containment' AS "check", sum(length)::DOUBLE AS left_total, any_value(n) * 10.0 AS right_total, TRUE AS holds FROM lengths JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = floor GROUP BY floor
""")
def containment_conserved(t: Tables) -> DataFrame:
    """Lengths by type with the unresolved and shared ones against the segments' own total."""
    lines, _ = _bands(t)
    drawn = takeoff.drawn_lengths(lines, ["floor"]).select("floor", "length")
    return quality.conserved_by({"containment": (_containment(t), F.sum("length"), drawn, F.sum("length"))}, ["floor"])


@query("""
WITH v AS (SELECT o_custkey AS floor, o_orderkey % 5 AS k FROM orders)
SELECT floor, 'colours' AS "check", 10.0 * count(*) AS left_total, 10.0 * count(*) AS right_total, TRUE AS holds FROM v GROUP BY 1
""")
def bands_conserved(t: Tables) -> DataFrame:
    """Lengths by colour with the shared one against the segments' own total."""
    lines, rings = _bands(t)
    found = bands.attributed(lines, rings, "segment_id", "colour", 60.0, ["floor"])
    drawn = takeoff.drawn_lengths(lines, ["floor"]).select("floor", "length")
    return quality.conserved_by({"colours": (found, F.sum(F.col("length").cast("decimal(28,9)")), drawn, F.sum("length"))}, ["floor"])
