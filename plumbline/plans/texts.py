"""Queries over texts, numbers and simple geometry of single rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.plans.base import Tables, query


@query("""
WITH m AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey, l_suppkey, CAST(round(CAST(l_extendedprice AS DECIMAL(18, 2)) * CAST(l_discount AS DECIMAL(4, 2)) / 7, 6) AS DECIMAL(18, 6)) AS v FROM lineitem)
SELECT id, l_partkey, l_suppkey, CAST(round(v, 2) AS VARCHAR) AS money, rtrim(rtrim(CAST(v AS VARCHAR), '0'), '.') AS shown FROM m
""")
def money_texts(t: Tables) -> DataFrame:
    """amounts rounded to six places and, half up, to two, and their texts."""
    exact = F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(4,2)")
    v = F.round((exact.cast("double") / 7).cast("decimal(38,12)"), 6).cast("decimal(18,6)")
    rows = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_partkey", "l_suppkey", v.alias("v"))
    return rows.select("id", "l_partkey", "l_suppkey", S.money(F.col("v")).cast("decimal(18,2)").cast("string").alias("money"), S.decimal_text(F.col("v")).alias("shown"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE '{"a":[1,{"x":null,"y":"' || event_type || '"}],"k":' || json_extract(props, '$.k') || ',"z":true}' END AS canonical FROM events
""")
def canonical_texts(t: Tables) -> DataFrame:
    """JSON text with sorted keys and no spaces; null for what isn't JSON."""
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{ "z": true, "k": '), k, F.lit(', "a" : [1, {"y": "'), F.col("event_type"), F.lit('", "x": null}]}'))
    return t.events.select("event_id", S.canonical_json(F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(text)).alias("canonical"))


@query("""
SELECT p_partkey, CAST(p_size * 3 AS DOUBLE) AS length, CAST(p_size * p_size AS DOUBLE) AS area, CAST(p_size AS DOUBLE) AS to_segment, CAST(CASE WHEN p_size > 10 THEN (p_size - 10) * (p_size - 10) ELSE 0 END AS DOUBLE) AS to_box, p_partkey % 2 = 0 AS closed FROM part
""")
def geometry_measures(t: Tables) -> DataFrame:
    """length, area and closedness of a polyline, and distances of a point to a segment and a box."""
    n, zero = F.col("p_size").cast("double"), F.lit(0.0)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    square = F.array(point(zero, zero), point(n, zero), point(n, n), point(zero, n))
    last = F.when(F.col("p_partkey") % 2 == 0, point(zero, zero)).otherwise(point(zero, n))
    path = F.array(point(zero, zero), point(n, zero), last)
    box = F.struct(zero.alias("min_x"), zero.alias("min_y"), F.lit(10.0).alias("max_x"), F.lit(10.0).alias("max_y"))
    return t.part.select(
        "p_partkey", S.path_length(square).alias("length"), S.ring_area(square).alias("area"), S.point_segment_distance(n, n, zero, zero, n, zero).alias("to_segment"),
        S.box_distance_squared(n, F.lit(5.0), box).alias("to_box"), S.is_closed(path).alias("closed"),
    )


@query("SELECT p_partkey, p_name || ' ' || p_brand AS plain, CAST(round_even(p_retailprice / 8, 0) AS BIGINT) AS cell FROM part")
def plain_texts(t: Tables) -> DataFrame:
    """texts without underline marks and doubled spaces, and grid cells by half-even rounding."""
    text = F.concat(F.lit("\\L "), F.col("p_name"), F.lit(" \t "), F.col("p_brand"), F.lit("  "))
    return t.part.select("p_partkey", S.normalised_text(text).alias("plain"), S.grid_cell(F.col("p_retailprice"), 8.0).alias("cell"))


@query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_type WHEN 1 THEN p_type WHEN 2 THEN NULL WHEN 3 THEN p_type || ' - ' || p_brand WHEN 4 THEN p_type WHEN 5 THEN NULL END AS family FROM part
""")
def family_names(t: Tables) -> DataFrame:
    """block names as device types, without legend stage and id tail, halves that are alike once, placeholders null."""
    name, brand = F.col("p_type"), F.col("p_brand")
    shapes = [F.concat(name, F.lit("_Legend Stage 12 ")), F.concat(name, F.lit(" - "), F.lower(name), F.lit("-2364563-03_ Ss_75")), F.lit("Family - ___"), F.concat(F.lit(" "), name, F.lit(" - "), brand), name, F.lit("--")]
    return t.part.select("p_partkey", S.family_type_name(F.element_at(F.array(*shapes), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("family"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 1.0 WHEN 1 THEN p_size * 2.0 WHEN 2 THEN p_size + 5.0 END AS x, CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 4 / 3.0 WHEN 2 THEN 2.0 END AS y,
  CASE WHEN p_partkey % 3 = 0 THEN p_size / 2.0 ELSE p_size * 2.0 END AS rx FROM part
""")
def symbol_anchors(t: Tables) -> DataFrame:
    """a symbol's place by centre, vertices or box, and a run member's by line or polyline."""
    n, kind = F.col("p_size").cast("double"), F.col("p_partkey") % 4
    point = lambda x, y: F.struct(x.alias("x"), F.lit(float(y)).alias("y"))
    many = F.array(point(n, 0), point(n * 2, 1), point(n * 3, 3))
    box = F.when(kind == 2, F.struct(n.alias("min_x"), F.lit(1.0).alias("min_y"), (n + 10).alias("max_x"), F.lit(3.0).alias("max_y")))
    at = S.symbol_anchor(F.when(kind == 0, point(n, 1)), F.when(kind == 1, many), box)
    line = F.col("p_partkey") % 3 == 0
    run = S.representative_point(F.when(line, point(F.lit(0.0), 0)), F.when(line, point(n, 0)), many)
    return t.part.select("p_partkey", at["x"].alias("x"), at["y"].alias("y"), run["x"].alias("rx"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 7 THEN 'legend_exemplar' WHEN f.p_partkey IS NOT NULL THEN 'device' WHEN l_suppkey % 4 = 0 THEN 'architecture' WHEN l_suppkey % 4 = 1 THEN 'annotation' WHEN l_linenumber <= 3 THEN 'device' ELSE 'unknown' END AS kind
FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 40) f ON l_partkey = f.p_partkey
""")
def instance_kinds(t: Tables) -> DataFrame:
    """Kinds of placed blocks by seven rules in order."""
    families = t.part.where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("in_family"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(families, "l_partkey", "left")
    block = F.element_at(F.array(*map(F.lit, ("M_Curtain Panel", "RUK-Titleblock A0", "Socket", "Sensor"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    layer = F.when(F.col("l_linenumber") == 7, "E-LEGEND-2").otherwise("E-LTG")
    tag = F.when(F.col("l_linenumber") <= 3, "S1")
    kind = S.instance_kind(layer, block, tag, F.col("in_family"), F.col("l_linenumber") == 1)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", kind.alias("kind"))
