"""Changesets, checks, catalog loads, estimates, the quantity engine, blocks, rails and registration over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import blocks, catalog, changes, estimate, quality, quantities, rails, registration, rooms, runs, takeoff
from plumbline.operators.graph import circuits
from plumbline.plans.attribution import SHEETS, _sheets
from plumbline.plans.base import Tables, query
from plumbline.sources import tables


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _pick(index: Column, *values) -> Column:
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (index + 1).cast("int"))


def _struct_array(*rows: dict) -> Column:
    return F.array(*[F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in row.items()]) for row in rows])


def _point(x, y) -> Column:
    as_ = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(as_(x).cast("double").alias("x"), as_(y).cast("double").alias("y"))


#: A set for each order of five operations on its own entity, of which every seventh set writes a property that mustn't be written.
def _set(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    entities = t.orders.select(k.alias("entity"), F.lit("A").alias("layer"), F.create_map(F.lit("label"), F.lit("old"), F.lit("keep"), F.lit("x")).alias("properties"))
    kind = k % 5
    ops = _struct_array(
        {"sequence_index": 1, "entity": k, "operation_type": "update_property", "property": F.when(k % 7 == 0, "geometry.x").otherwise("properties.label"), "value": "first"},
        {"sequence_index": 2, "entity": k, "operation_type": "update_property", "property": "label", "value": F.concat(F.lit("v"), _text(k))},
        {"sequence_index": 3, "entity": k, "operation_type": "annotate_entity", "property": F.lit(None).cast("string"), "value": "note"},
        {"sequence_index": 4, "entity": F.when(kind == 3, k + 100000000).otherwise(k), "operation_type": _pick(kind, "change_layer", "change_layer", "remove_entity", "add_entity", "flag_for_review"), "property": F.lit(None).cast("string"), "value": _pick(kind, "B", "A", F.lit(None).cast("string"), "C", F.lit(None).cast("string"))},
    )
    return entities, t.orders.select(k.alias("set_id"), F.inline(ops))


@query("""
SELECT o_orderkey AS set_id, o_orderkey AS entity, CASE o_orderkey % 5 WHEN 0 THEN 'B' ELSE 'A' END AS layer, 'v' || o_orderkey AS label, 'x' AS keep, 'note' AS notes, CASE o_orderkey % 5 WHEN 0 THEN 'changed' WHEN 2 THEN 'removed' ELSE 'metadata_only' END AS effect FROM orders WHERE o_orderkey % 7 > 0
UNION ALL SELECT o_orderkey, o_orderkey + 100000000, 'C', NULL, NULL, '', 'added' FROM orders WHERE o_orderkey % 7 > 0 AND o_orderkey % 5 = 3
""")
def changeset_properties(t: Tables) -> DataFrame:
    """Property edits, annotations and the other operations folded per entity; a set that writes a forbidden property aborts whole."""
    found = changes.apply_sets(*_set(t))
    return found.select("set_id", "entity", "layer", F.element_at("properties", "label").alias("label"), F.element_at("properties", "keep").alias("keep"), F.array_join("annotations", ",").alias("notes"), "effect")


@query("""
SELECT p_partkey, 'L2' AS layer, 'L2' AS inner_layer, 'new' AS mark, NULL AS notes FROM part
""")
def synced_properties(t: Tables) -> DataFrame:
    """a stored map takes a new layer under all its aliases, and an edit only of a property that it has."""
    stored = F.create_map(*[F.lit(x) for x in ("layer", "L1", "new_layer", "L0", "mark", "old")])
    edits = F.create_map(*[F.lit(x) for x in ("mark", "new", "notes", "n")])
    made = changes.synced(changes.synced_layer(stored, F.lit("L2")), edits)
    return t.part.select("p_partkey", made["layer"].alias("layer"), made["new_layer"].alias("inner_layer"), made["mark"].alias("mark"), F.try_element_at(made, F.lit("notes")).alias("notes"))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 13 AS m FROM orders)
SELECT k AS set_id, CAST(s AS INT) AS sequence_index, code, severity FROM o JOIN (VALUES
  (0, 1, 'unknown_operation', 'error'), (1, 1, 'missing_target', 'error'), (2, 1, 'target_not_found', 'error'), (3, 2, 'target_removed_earlier', 'error'), (4, 1, 'duplicate_entity', 'error'), (5, 1, 'missing_value', 'error'),
  (6, 1, 'invalid_property', 'error'), (7, 1, 'unknown_block', 'error'), (7, 1, 'review_only', 'review'), (8, 1, 'unknown_layer', 'warning'), (9, 1, 'layer_unchanged', 'warning'), (10, 1, 'flagged', 'review'), (11, 1, 'review_only', 'review')) v(m, s, code, severity) USING (m)
""")
def changeset_validation(t: Tables) -> DataFrame:
    """Findings of operations by rule and severity; of thirteen kinds of sets, the last is clean."""
    k = F.col("o_orderkey")
    m, none = k % 13, F.lit(None).cast("string")
    first = {
        "sequence_index": 1, "entity": F.when(m == 1, F.lit(None)).when(m == 2, -k).when(m == 12, k + 100000000).otherwise(k),
        "operation_type": _pick(m, "explode", "change_layer", "change_layer", "remove_entity", "add_entity", "change_layer", "update_property", "replace_block", "change_layer", "change_layer", "flag_for_review", "replace_profile_material_candidate", "add_entity"),
        "property": F.when(m == 6, "geometry"), "value": _pick(m, none, "B", "B", none, "B", " ", "v", "no such", "Z", "A", none, none, "B"),
    }
    second = {"sequence_index": 2, "entity": F.when(m == 12, k + 100000000).otherwise(k), "operation_type": F.when(m == 3, "change_layer").when(m == 12, "change_layer"), "property": none, "value": "B"}
    ops = t.orders.select(k.alias("set_id"), F.inline(_struct_array(first, second))).where("operation_type is not null")
    entities = t.orders.select(k.alias("entity"), F.lit("A").alias("layer"))
    layers = t.region.select(_pick(F.col("r_regionkey") % 2, "A", "B").alias("layer"))
    return changes.findings(ops, entities, layers, t.nation.select(F.col("n_name").alias("block")))


def _revision_rows(t: Tables) -> dict[str, DataFrame]:
    """A revision for each customer: entities are its orders."""
    k, r = F.col("o_orderkey"), F.col("o_custkey").alias("rev")
    kind = k % 11
    p = [_point(0, 0), _point(1, 1)]
    points = F.when(kind == 1, F.array(p[0])).when(kind == 2, F.array(p[0], _point(float("nan"), 1))).when(kind == 3, F.array(p[0], p[1], p[0])).otherwise(F.array(*p))
    entities = t.orders.select(
        r, F.lit("polyline").alias("kind"), points.alias("points"), (kind == 3).alias("closed"), F.when(kind >= 4, "b").alias("block_ref"), F.when(kind == 4, 0.0).otherwise(1.0).alias("scale_x"), F.lit(1.0).alias("scale_y"),
        F.when(kind == 5, "Z").otherwise("A").alias("layer_ref"), F.when(kind != 6, "p").alias("provenance"),
    )
    c = F.col("c_custkey")
    return {
        "revisions": t.customer.select(c.alias("rev"), _pick(c % 3, F.lit(None).cast("string"), " Unitless ", "mm").alias("unit"), F.when(c % 2 == 0, "grid").alias("coordinate_system")),
        "entities": entities, "layers": t.customer.select(c.alias("rev"), F.lit("A").alias("layer_ref")), "references": t.customer.where("c_custkey % 4 = 0").select(c.alias("rev"), (c % 8 == 0).alias("resolved")),
    }


@query("""
WITH n AS (SELECT o_custkey AS rev, sum((o_orderkey % 11 IN (1, 2))::INT) AS geometry, sum((o_orderkey % 11 = 3)::INT) AS closed_polylines, sum((o_orderkey % 11 = 4)::INT) AS block_transforms, sum((o_orderkey % 11 = 5)::INT) AS layer_mapping, sum((o_orderkey % 11 = 6)::INT) AS provenance FROM orders GROUP BY 1),
c AS (SELECT c_custkey AS rev, n.* EXCLUDE (rev) FROM customer LEFT JOIN n ON c_custkey = rev),
x AS (SELECT rev, 'units' AS "check", (rev % 3 < 2)::INT AS n_bad, CASE rev % 3 WHEN 0 THEN 'fail' ELSE 'review' END AS bad FROM c UNION ALL SELECT rev, 'coordinate_system', rev % 2, 'review' FROM c UNION ALL SELECT rev, 'geometry', geometry, 'fail' FROM c
  UNION ALL SELECT rev, 'closed_polylines', closed_polylines, 'review' FROM c UNION ALL SELECT rev, 'block_transforms', block_transforms, 'fail' FROM c UNION ALL SELECT rev, 'layer_mapping', layer_mapping, 'fail' FROM c
  UNION ALL SELECT rev, 'external_references', (rev % 8 = 4)::INT, 'review' FROM c UNION ALL SELECT rev, 'provenance', provenance, 'review' FROM c)
SELECT rev, "check", CASE WHEN coalesce(n_bad, 0) > 0 THEN bad ELSE 'pass' END AS status, coalesce(n_bad, 0)::BIGINT AS n_bad FROM x
""")
def revision_checks(t: Tables) -> DataFrame:
    """The eight required checks of every revision."""
    rows = _revision_rows(t)
    return quality.required_checks(rows["revisions"], rows["entities"], rows["layers"], rows["references"], "rev")


@query("""
WITH v AS (SELECT o_custkey AS rev, CASE WHEN o_orderkey % 3 = 0 THEN 'mm' WHEN o_orderkey % 3 = 1 THEN 'm' END AS vote, CASE o_orderkey % 3 WHEN 0 THEN 0 ELSE 1 END AS p FROM orders WHERE o_orderkey % 3 < 2),
t1 AS (SELECT rev, count(*) AS n, CASE quantile_disc(p, 0.5) WHEN 0 THEN 'mm' ELSE 'm' END AS unit FROM v GROUP BY 1),
c AS (SELECT c_custkey AS rev, coalesce(unit, CASE c_custkey % 3 WHEN 0 THEN 'mm' WHEN 1 THEN 'm' END) AS unit, unit IS NOT NULL AS voted, coalesce(n, 0) AS n FROM customer LEFT JOIN t1 ON rev = c_custkey)
SELECT rev, unit, CASE WHEN voted THEN 'dimensions' WHEN unit IS NOT NULL THEN 'extent' ELSE 'unknown' END AS tier, n AS n_votes, coalesce(unit = 'm', FALSE) AS contradicted FROM c
""")
def unit_tiers(t: Tables) -> DataFrame:
    """Units by the lower median of dimension votes, else by the drawing's extent; contradictions with the declared unit."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    dims = t.orders.select(F.col("o_custkey").alias("rev"), F.when(k % 3 == 2, "angular").otherwise("linear").alias("kind"), _pick(k % 3, 5000.0, 5.0, 5.0).alias("override"), F.lit(1.0).alias("factor"))
    side = _pick(c % 3, 40000.0, 40.0, 0.0)
    revisions = t.customer.select(c.alias("rev"), F.lit(0.001).alias("declared"), side.alias("width"), (side / 2).alias("height"))
    return quality.infer_units(revisions, dims, "rev", [("mm", 3.0, 9.0), ("cm", 2.0, 3.0), ("m", 0.0, 2.0)], [("mm", 4.0, 5.0), ("cm", 3.0, 4.0), ("m", 1.0, 2.0)])


@query("""
WITH f AS (SELECT p_partkey AS entry_id, p_brand AS formula_id, p_size AS version, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 END AS project FROM part),
r AS (SELECT c_custkey AS request, 'Brand#' || (c_custkey % 6 + 1) || (c_custkey % 5 + 1) AS formula_id, c_custkey % 2 AS project, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 50 + 1 END AS version FROM customer),
m AS (SELECT r.request, f.entry_id, f.version AS v, f.project IS NOT NULL AS own FROM r JOIN f ON r.formula_id = f.formula_id AND (r.version IS NULL OR r.version = f.version) AND (f.project IS NULL OR f.project = r.project)),
b AS (SELECT * FROM m QUALIFY (own::INT * 1000 + v) = max(own::INT * 1000 + v) OVER (PARTITION BY request)), g AS (SELECT request, min(entry_id) AS e, count(*) AS n FROM b GROUP BY 1)
SELECT r.request, CASE WHEN n = 1 THEN e END AS entry_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'selected' END AS status FROM r LEFT JOIN g ON r.request = g.request
""")
def formula_choice(t: Tables) -> DataFrame:
    """Formulas by id and version, the project's own before global ones."""
    k, c = F.col("p_partkey"), F.col("c_custkey")
    formulas = t.part.select(k.alias("entry_id"), F.col("p_brand").alias("formula_id"), F.col("p_size").cast("long").alias("version"), F.when(k % 3 == 0, k % 2).alias("project_id"))
    requests = t.customer.select(c.alias("request"), F.concat(F.lit("Brand#"), _text(c % 6 + 1), _text(c % 5 + 1)).alias("formula_id"), (c % 2).alias("project_id"), F.when(c % 4 > 0, c % 50 + 1).alias("version"))
    return catalog.select_formulas(requests, formulas, "request").select("request", "entry_id", "status")


@query("""
SELECT c_custkey AS request, CASE c_custkey % 5 WHEN 0 THEN c_custkey * 10 WHEN 4 THEN c_custkey * 10 + 1 END AS entry_id, CASE c_custkey % 5 WHEN 0 THEN 'matched' WHEN 1 THEN 'checksum_mismatch' WHEN 2 THEN 'stale' WHEN 3 THEN 'missing' ELSE 'selected' END AS status FROM customer
""")
def catalog_requests(t: Tables) -> DataFrame:
    """All references of estimates resolved at once: named entries by checksum, the others by key, scope and date."""
    c = F.col("c_custkey")
    day = F.lit("2024-01-01").cast("date")
    base = {"item": _text(c), "project_id": F.lit(None).cast("long"), "effective_start": day, "effective_end": F.lit(None).cast("date"), "value": 1.0}
    entries = t.customer.select(F.inline(_struct_array({"entry_id": c * 10, "checksum": "s", **base, "item": F.concat(F.lit("old"), _text(c))}, {"entry_id": c * 10 + 1, "checksum": "t", **base})))
    links = t.customer.where(c % 5 == 2).select((c * 10).alias("predecessor_id"), (c * 10 + 1).alias("successor_id"))
    ref = F.when(c % 5 == 3, -c).when(c % 5 < 3, c * 10)
    requests = t.customer.select(c.alias("request"), ref.alias("entry_ref"), F.when(c % 5 == 1, "x").otherwise("s").alias("checksum"), _text(c).alias("item"), F.lit(None).cast("long").alias("project_id"), F.lit("2024-05-01").cast("date").alias("as_of"))
    return catalog.resolve_requests(requests, entries, links, ["item"], "request").select("request", "entry_id", "status")


@query("""
SELECT p_partkey AS entry_id, CASE p_partkey % 7 WHEN 0 THEN 'places' WHEN 1 THEN 'value' WHEN 2 THEN 'currency' WHEN 3 THEN 'scope' WHEN 4 THEN 'window' END AS problem, p_partkey % 7 = 5 AS accepted FROM part WHERE p_partkey % 7 < 6
""")
def catalog_load(t: Tables) -> DataFrame:
    """A catalog load: entries refused by currency, value, places, scope and window; what is there already is left out."""
    k = F.col("p_partkey")
    m, day = k % 7, F.lit("2024-01-01").cast("date")
    new = t.part.select(
        k.alias("entry_id"), F.when(m == 2, "EUR").otherwise("GBP").alias("currency"), F.when(m == 0, F.lit("1.0000001")).when(m == 1, F.lit("0")).otherwise("2.5").cast("decimal(18,9)").alias("value"),
        F.when(m == 3, "project").otherwise("global").alias("scope_type"), F.lit(None).cast("long").alias("project_id"), day.alias("effective_start"), F.when(m == 4, day).alias("effective_end"),
    )
    stored = new.where(m == 6).withColumn("checksum", catalog.entry_checksum(["currency", "value"])).select("entry_id", "checksum")
    good, bad = catalog.load_entries(new, stored, ["currency", "value"])
    return good.select("entry_id", F.lit(None).cast("string").alias("problem"), F.lit(True).alias("accepted")).union(bad.select("entry_id", "problem", F.lit(False)))


@query("""
WITH l AS (SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, (l_partkey + l_suppkey) % 7 AS m, l_quantity AS q, p_retailprice AS r FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT m, CASE m WHEN 0 THEN 'missing_quantity' WHEN 1 THEN 'missing_entry' WHEN 2 THEN 'kind_mismatch' WHEN 3 THEN 'unit_mismatch' ELSE 'priced' END AS status, count(*) AS n, CASE WHEN m >= 4 THEN CAST(sum(round(CASE WHEN m = 4 THEN CAST(r AS DECIMAL(18, 6)) ELSE CAST(q AS DECIMAL(18, 6)) * CAST(r AS DECIMAL(18, 6)) END, 2)) AS DOUBLE) END AS amount FROM l GROUP BY m
""")
def estimate_assembly(t: Tables) -> DataFrame:
    """Estimate lines with their quantity and rate, material or assumption, and why one has no price."""
    m = (F.col("l_partkey") + F.col("l_suppkey")) % 7
    rows = t.lineitem.select("l_partkey", "l_quantity", m.alias("m"), F.monotonically_increasing_id().alias("line_key"))
    rows, _ = tables.written(rows, "lines")
    lines = rows.select("line_key", F.when(F.col("m") == 4, "assumption").otherwise("rate").alias("kind"), F.when(F.col("m") != 0, F.col("line_key")).alias("quantity_key"), F.when(F.col("m") == 1, -1).when(F.col("m") == 2, F.col("l_partkey") + 100000000).when(F.col("m") == 4, F.col("l_partkey") + 200000000).otherwise(F.col("l_partkey")).alias("entry_key"), F.when(F.col("m") == 3, "ft").otherwise("m").alias("unit"))
    amounts = rows.select(F.col("line_key").alias("quantity_key"), F.col("l_quantity").alias("value"), F.lit("m").alias("unit"))
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    entries = t.part.select(F.inline(_struct_array({"kind": "rate", "entry_key": k, "value": price, "unit": "m"}, {"kind": "material", "entry_key": k + 100000000, "value": price, "unit": "m"}, {"kind": "assumption", "entry_key": k + 200000000, "value": price, "unit": "m"})))
    n = rows.count()
    met = tables.dealt(rows.select("line_key", "m"), n, "line_key")
    found = tables.dealt(estimate.assemble_lines(lines, amounts, entries), n, "line_key").join(met.hint("merge"), "line_key")
    return found.groupBy("m", "status").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))


@query("""
WITH r AS (SELECT o_custkey AS rev, o_orderkey AS k, o_orderkey % 10 AS m FROM orders)
SELECT rev, quantity_type, unit, sum(v)::DOUBLE AS total, count(*) AS n_contributors FROM (
  SELECT rev, 'length' AS quantity_type, 'm' AS unit, 5.0 AS v FROM r WHERE m IN (0, 1) UNION ALL SELECT rev, 'length', 'ft', 7.0 FROM r WHERE m = 2 UNION ALL SELECT rev, 'perimeter', 'm', 14.0 FROM r WHERE m = 3 UNION ALL SELECT rev, 'area', 'm', 12.0 FROM r WHERE m = 3
  UNION ALL SELECT rev, 'length', 'm', 5.0 FROM r WHERE m = 6 UNION ALL SELECT rev, 'length', 'm', 5.0 FROM r WHERE m = 9
  UNION ALL SELECT rev, 'count', 'm', 1.0 FROM r WHERE m NOT IN (4) UNION ALL SELECT rev, 'count', 'parsec', 1.0 FROM r WHERE m = 4) GROUP BY ALL
""")
def quantity_engine_whole(t: Tables) -> DataFrame:
    """The quantity engine end to end: lengths, closed rings, hints where nothing is measured, unknown units and contradicted measurements
    left out, copies counted once and conflicting copies not at all."""
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 10
    line, ring = F.array(_point(0, 0), _point(3, 4)), F.array(_point(0, 0), _point(3, 0), _point(3, 4), _point(0, 4))
    points = F.when(m == 3, ring).when(m.isin(2, 7), F.array().cast("array<struct<x:double,y:double>>")).otherwise(line)
    other = F.when(m == 8, F.array(_point(0, 0), _point(6, 8))).otherwise(points)
    row = lambda i, p: {"entity_id": k * 2 + i, "sequence_index": k * 2 + i, "points": p, "closed": m == 3, "unit": F.when(m == 4, "parsec").otherwise(" M " if i else "m"), "source_hash": F.when(m >= 6, F.concat(F.lit("h"), _text(k)))}
    one = t.orders.select(F.col("o_custkey").alias("rev"), F.inline(_struct_array(row(0, points), row(1, other)))).where("source_hash is not null or entity_id % 2 = 0")
    entities = one.withColumn("unit", F.lower(F.trim("unit")))
    hints = t.orders.where(m.isin(2, 5)).select(F.col("o_custkey").alias("rev"), (k * 2).alias("entity_id"), F.lit("length").alias("quantity_type"), F.lit(7.0).alias("value"), F.lit("ft").alias("unit"), F.lit(True).alias("strict"), F.lit(0).alias("position"))
    sums, _, _ = quantities.engine(entities, hints, ["rev"], ["m", "ft", "mm"])
    return sums.withColumn("total", F.col("total").cast("double"))


@query("""
WITH c AS (SELECT s_suppkey AS k, 2 + s_suppkey % 2 AS sy, i, j FROM supplier, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
SELECT k AS rev, 'i' || k || '#' || i || '.' || j AS instance_id, 2.0 * k - 10 * j - sy AS x, 5.0 * i + 2 AS y, sy = 3 AS approximate FROM c
UNION ALL SELECT k, 'i' || k || '#' || i || '.' || j || ':in#0.0', 2.0 * k - 10 * j - 3 * sy, 5.0 * i + 6, sy = 3 FROM c
""")
def block_expansion(t: Tables) -> DataFrame:
    """Arrays of blocks with a block inside, turned and scaled, in world coordinates; a block inside itself isn't followed."""
    k = F.col("s_suppkey")
    sy = F.when(k % 2 == 1, 3.0).otherwise(2.0)
    one = {"owner": F.lit(None).cast("string"), "insert_id": F.concat(F.lit("i"), _text(k)), "block": "B", "x": k * 2.0, "y": 0.0, "sx": 2.0, "sy": sy, "rotation": 90.0, "cols": 2, "rows": 2, "dx": 5.0, "dy": 10.0}
    two = {**one, "owner": F.lit("B"), "insert_id": F.lit("in"), "block": F.lit("C"), "x": F.lit(4.0), "y": F.lit(4.0), "sx": F.lit(1.0), "sy": F.lit(1.0), "rotation": 0.0, "cols": 1, "rows": 1}
    loop = {**two, "owner": F.lit("C"), "insert_id": F.lit("again"), "block": F.lit("B")}
    inserts = t.supplier.select(k.alias("rev"), F.inline(_struct_array(one, two, loop)))
    defined = t.supplier.select(k.alias("rev"), F.inline(_struct_array({"block": "B", "base": _point(1, 1)}, {"block": "C", "base": _point(1, 1)})))
    leaf = F.array(_point(2, 2))
    leaves = t.supplier.select(k.alias("rev"), F.inline(_struct_array({"block": "B", "leaf": 1, "points": leaf}, {"block": "C", "leaf": 2, "points": F.array(_point(1, 1))})))
    found = blocks.expand_blocks(inserts, defined, leaves, ["rev"])
    return found.select("rev", "instance_id", *[F.round(F.col("points")[0][a], 6).alias(a) for a in "xy"], "approximate")


@query("""
WITH s AS (SELECT o_custkey % 50 AS sheet, o_orderkey AS rail, (o_orderkey * 37 % 800)::DOUBLE AS x0, (o_orderkey * 91 % 400)::DOUBLE / 16 AS y, 0.5 + o_orderkey % 23 AS len, o_custkey % 7 AS k FROM orders),
r AS (SELECT sheet, rail, x0, x0 + len AS x1, y, len FROM s WHERE k < 5 AND len > 0.7),
c AS (SELECT a.sheet, a.rail AS i, b.rail AS j, abs(a.y - b.y) AS perp, abs((a.x1 + b.x1) / 2 - (a.x0 + b.x0) / 2) AS mid FROM r a JOIN r b ON a.sheet = b.sheet AND (a.len > b.len OR (a.len = b.len AND a.rail < b.rail)) AND abs(a.y - b.y) BETWEEN 0.01 AND 2
  AND least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.5 * b.len),
o AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY perp, i, j) AS n FROM c),
lists AS (SELECT sheet, list([i, j] ORDER BY n) AS pairs, list(mid ORDER BY n) AS mids FROM o GROUP BY sheet),
won AS (SELECT sheet, mids, list_reduce(list_prepend([]::BIGINT[], pairs), lambda t, p: CASE WHEN list_contains(t, p[1]) OR list_contains(t, p[2]) THEN t ELSE list_concat(t, p) END) AS used, pairs FROM lists),
pairs AS (SELECT sheet, unnest(list_filter(range(1, len(pairs) + 1), lambda k: list_position(used, pairs[k][1]) % 2 = 1 AND used[list_position(used, pairs[k][1]) + 1] = pairs[k][2])) AS k, mids, used FROM won),
paired AS (SELECT sheet, count(*) AS n_pairs, sum(mids[k]) AS length FROM pairs GROUP BY 1),
alone AS (SELECT r.sheet, count(*) AS n_rails, sum((used IS NULL OR NOT list_contains(used, rail))::INT) AS n_unpaired, sum(CASE WHEN used IS NULL OR NOT list_contains(used, rail) THEN len END) AS length FROM r LEFT JOIN won USING (sheet) GROUP BY 1),
drawn AS (SELECT sheet, sum(len) AS length FROM s WHERE k >= 5 GROUP BY 1)
SELECT sheet, coalesce(n_pairs, 0)::BIGINT AS n_pairs, coalesce(n_unpaired, 0)::BIGINT AS n_unpaired,
  round((coalesce(b.length, 0) + coalesce(a.length, 0) * CASE WHEN 4 * coalesce(n_pairs, 0) >= n_rails THEN 0.5 ELSE 1 END + coalesce(d.length, 0))::DOUBLE, 6) AS length
FROM (SELECT DISTINCT sheet FROM s) LEFT JOIN paired b USING (sheet) LEFT JOIN alone a USING (sheet) LEFT JOIN drawn d USING (sheet)
""")
def tray_centrelines(t: Tables) -> DataFrame:
    """Rails of many lengths at random, rungs among them, to midlines by greedy pairing; authored lines and other families as they are drawn."""
    k = F.col("o_orderkey")
    x, y = (k * 37 % 800).cast("double"), (k * 91 % 400).cast("double") / 16
    how = rails.producer(F.when(F.col("o_custkey") % 7 < 6, "DWG").otherwise("pdf"), F.when(F.col("o_custkey") % 7 == 5, "M-Duct Centre Line").otherwise("M-Duct"))
    lines = t.orders.select((F.col("o_custkey") % 50).alias("sheet"), k.alias("rail"), x.alias("x0"), y.alias("y0"), (x + 0.5 + k % 23).alias("x1"), y.alias("y1"), how.alias("how"))
    return rails.centrelines(lines, "rail", ["sheet"], how="how").withColumn("length", F.round(F.col("length").cast("double"), 6))


@query(f"""
WITH {SHEETS} SELECT sheet, CASE WHEN n < 2 OR r > 3 THEN 'failed' WHEN n >= 3 AND r <= 1 THEN 'good' ELSE 'degraded' END AS quality, CASE WHEN n >= 3 AND r <= 1 THEN 'ok' ELSE 'failed' END AS outcome FROM shift JOIN res USING (sheet)
""")
def floor_registration(t: Tables) -> DataFrame:
    """Sheets of a floor that register well by shift, turn and scale, and those that don't."""
    source, target = _sheets(t)
    return registration.floor_members(source, target, "sheet").select("sheet", "quality", "outcome")


@query("""
WITH p AS (SELECT c_nationkey AS sheet, c_custkey AS label, (c_custkey * 37) % 1000 AS x, (c_custkey * 91) % 1000 AS y FROM customer),
b AS (SELECT a.sheet, a.label AS i, b.label AS j, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS d FROM p a JOIN p b ON a.sheet = b.sheet AND a.label < b.label)
SELECT sheet, i AS label_i, j AS label_j, CASE sheet % 3 WHEN 0 THEN 90.0 WHEN 1 THEN 0.0 ELSE 180.0 END AS turn, 1.0 + sheet AS scale FROM b QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY d DESC, i, j) = 1
""")
def baseline_turns(t: Tables) -> DataFrame:
    """Rotation and scale of a sheet by its widest baseline: sheets turned by quarter and half turns, scaled by their number."""
    n = F.col("c_nationkey")
    x, y, scale = ((F.col("c_custkey") * 37) % 1000).cast("double"), ((F.col("c_custkey") * 91) % 1000).cast("double"), n + 1.0
    tx = F.when(n % 3 == 0, -y).when(n % 3 == 1, x).otherwise(-x) * scale + 7
    ty = F.when(n % 3 == 0, x).when(n % 3 == 1, y).otherwise(-y) * scale - 5
    found = registration.baseline(t.customer.select(n.alias("sheet"), F.col("c_custkey").alias("label"), x.alias("x"), y.alias("y"), tx.alias("tx"), ty.alias("ty")), "sheet", "label")
    return found.select("sheet", "label_i", "label_j", F.round(F.abs("rotation"), 6).alias("turn"), F.round("scale", 6).alias("scale"))


@query("""
SELECT c_nationkey AS sheet, c_custkey AS circuit_id, CASE WHEN c_nationkey % 5 > 0 AND c_custkey % 4 < 2 THEN 3.0 + 10 * (c_custkey % 4 + 1) END AS distance,
  CASE WHEN c_nationkey % 5 = 0 THEN 'no_containment_sheet' WHEN c_custkey % 4 < 2 THEN 'ok' WHEN c_custkey % 4 = 2 THEN 'no_anchor' ELSE 'unreachable' END AS status FROM customer
""")
def two_sheet_home_runs(t: Tables) -> DataFrame:
    """Home runs over the trays of another sheet, moved into the circuits' frame."""
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    m, x = c % 4, c * 100.0
    circuits_ = t.customer.select(n.alias("sheet"), c.alias("circuit_id"), x.alias("x"), F.lit(0.0).alias("y"))
    node = lambda i, dx, dy, board: {"node": c * 4 + i, "x": x + dx - 5, "y": F.lit(float(dy)) + 2, "board": F.lit(board)}
    trays = t.customer.where(m != 2).select(n.alias("sheet"), F.inline(_struct_array(node(0, 0.0, 3.0, False), node(1, 10.0, 3.0, True))))
    edges = t.customer.where(m < 2).select((c * 4).alias("u"), (c * 4 + 1).alias("v"), (10 * (m + 1)).alias("weight"))
    frames = t.nation.where("n_nationkey % 5 > 0").select(F.col("n_nationkey").alias("sheet"), F.lit(5.0).alias("dx"), F.lit(-2.0).alias("dy"))
    return registration.two_sheet_home_runs(circuits_, trays, edges, frames, "sheet", 5.0)


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 3 = 0 AND n >= 5 AND o_orderkey % 5 > 0 THEN 'fill_noise' ELSE 'normal' END AS tier FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
""")
def materialization_tier(t: Tables) -> DataFrame:
    """Short lines of large components are noise, but for consumed layers; a customer's orders are a component."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    lines = t.orders.select(k.alias("entity"), F.concat(F.lit("c"), _text(c)).alias("u"), F.concat(F.lit("o"), _text(k)).alias("v"))
    from plumbline.operators.graph import component_sizes

    sizes = component_sizes(lines, "entity", ["u", "v"])
    e = t.orders.select(k.alias("entity"), F.when(c % 2 == 0, "line").otherwise("arc").alias("kind"), F.when(k % 3 == 0, 0.001).otherwise(1.0).alias("length"), F.when(k % 5 == 0, "M-Tray fill").otherwise("other").alias("layer"))
    found = takeoff.tiered(e, sizes, "entity", "kind", "length", "layer", ["tray"], crowd=5)
    return found.select(F.col("entity").alias("o_orderkey"), "tier")


@query("""
SELECT p_type AS sheet, p_brand AS layer, n AS score FROM (SELECT p_type, p_brand, count(*) AS n, max(count(*)) OVER (PARTITION BY p_type) AS best FROM part GROUP BY 1, 2) WHERE n >= 0.8 * best
""")
def wall_layers_by_faces(t: Tables) -> DataFrame:
    """Wall layers by the number of closed faces, near the best one's."""
    return takeoff.selected_layers(t.part.select(F.col("p_type").alias("sheet"), F.col("p_brand").alias("layer")), ["sheet"], "layer")


@query("""
WITH e AS (SELECT o_custkey AS rev, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT o_custkey AS rev, count(*) AS n, sum((o_orderkey % 3 > 0)::INT) AS named, sum((o_orderkey % 4 = 0)::INT) AS review FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
SELECT c_custkey AS rev, coalesce(e.n, 0) AS n_entities, 2 AS n_layers, 'services=1,unknown=1' AS roles, coalesce(r.n, 0) AS n_rooms, coalesce(named, 0)::BIGINT AS n_named, coalesce(review, 0)::BIGINT AS n_review, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS n_devices, CASE WHEN c_custkey % 2 = 0 THEN 'unknown=1' END AS types
FROM customer LEFT JOIN e ON e.rev = c_custkey LEFT JOIN r ON r.rev = c_custkey
""")
def revision_overview(t: Tables) -> DataFrame:
    """Counts of a revision's entities, layers by role, rooms and devices by type."""
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    layers = t.customer.select(c.alias("rev"), F.explode(F.array(F.lit("services"), F.lit(None).cast("string"))).alias("role"))
    found_rooms = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("rev"), F.when(k % 3 > 0, "r").alias("name"), (k % 4 == 0).alias("needs_review"))
    devices = t.customer.where("c_custkey % 2 = 0").select(c.alias("rev"), F.lit(None).cast("string").alias("device_type"))
    found = takeoff.revision_summary(t.customer.select(c.alias("rev")), t.orders.select(F.col("o_custkey").alias("rev")), layers, found_rooms, devices, "rev")
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return found.withColumns({"roles": shown("roles"), "types": shown("types")})


@query("""
WITH i AS (SELECT event_id, (event_id % 4) AS n FROM events)
SELECT event_id, 'entities' AS collection, n::BIGINT AS n, n::BIGINT AS rows FROM i UNION ALL SELECT event_id, 'layers', 1, 1 FROM i UNION ALL SELECT event_id, 'blocks', 0, 0 FROM i
""")
def document_manifest(t: Tables) -> DataFrame:
    """Documents exploded into the rows of their collections; the manifest's counts equal the rows."""
    many = F.array(*[F.lit(f'{{"n":{i}}}') for i in (1, 2, 3)])
    items = F.array_join(F.slice(many, F.lit(1), (F.col("event_id") % 4).cast("int")), ",")
    body = F.concat(F.lit('{"entities":['), items, F.lit('],"layers":["'), F.col("event_type"), F.lit('"]}'))
    rows = blocks.document_rows(t.events.select("event_id", body.alias("body")), "event_id", "body", {"entities": "entities", "layers": "layers", "blocks": "blocks"})
    made = None
    for name in ("entities", "layers", "blocks"):
        part = rows[name].groupBy("event_id").agg(F.count("*").alias("rows")).select("event_id", F.lit(name).alias("collection"), "rows")
        made = part if made is None else made.union(part)
    return rows["manifest"].join(made, ["event_id", "collection"], "left").fillna(0, ["rows"])


@query("""
SELECT l_orderkey AS sheet, count(*) AS n_edges, count(*) AS n_members, TRUE AS holds FROM lineitem GROUP BY 1
""")
def circuit_edges_conserved(t: Tables) -> DataFrame:
    """Every edge of a sheet in exactly one circuit: its edges against the circuits' own."""
    from plumbline.plans.geometry import _chains

    edges, _ = tables.written(_chains(t), "edges")
    found, members = circuits(edges, edges.select(F.col("u").alias("node"), F.col("u").alias("device")), "edge", "device")
    sheet = lambda c: F.floor(F.col(c) / 100).alias("sheet")
    held = quality.conserved_by({"edges": (edges.select(sheet("edge")), F.count("*"), found.select(sheet("circuit_id"), "n_edges"), F.sum("n_edges"))}, ["sheet"])
    one = quality.conserved_by({"members": (edges.select(sheet("edge")), F.count("*"), members.select(sheet("edge"), "edge").distinct(), F.count("*"))}, ["sheet"])
    return held.join(one.select("sheet", F.col("right_total").alias("m"), F.col("holds").alias("h")), "sheet").select("sheet", F.col("left_total").alias("n_edges"), F.col("m").alias("n_members"), (F.col("holds") & F.col("h")).alias("holds"))


@query("""
WITH d AS (SELECT sum(CAST(p_retailprice AS DECIMAL(28, 6)))::DOUBLE AS drops FROM part), c AS (SELECT count(*)::DOUBLE AS n FROM orders),
i AS (SELECT sum(CAST(o_totalprice AS DECIMAL(28, 6)))::DOUBLE AS v FROM orders), h AS (SELECT sum(CAST(q AS DECIMAL(28, 6)))::DOUBLE AS v FROM (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem WHERE l_quantity > 20 GROUP BY 1))
SELECT 'drops' AS "check", drops AS left_total, drops AS right_total, TRUE AS holds FROM d UNION ALL SELECT 'circuits', n, n, TRUE FROM c UNION ALL SELECT 'assembly_drops', drops, drops - coalesce(loose, 0), coalesce(loose, 0) <= 0.1 FROM d, (SELECT sum(p_retailprice) AS loose FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 30))
UNION ALL SELECT 'assembly_in_plan', v, v, TRUE FROM i UNION ALL SELECT 'assembly_home_runs', v, v, TRUE FROM h UNION ALL SELECT 'room_home_runs', v, v, TRUE FROM h
""")
def cable_conserved(t: Tables) -> DataFrame:
    """Device drops against the circuits' and the unattributed ones; circuits with and without a home run against all;
    the assembly's totals against circuits, drops and home runs; home runs by room against all. Drops of devices that no circuit lists
    are missing in the assembly, which the check says."""
    claims = t.lineitem.where("l_quantity > 30").select(F.col("l_orderkey").alias("circuit_id"), F.col("l_partkey").alias("device_id"))
    drops = t.part.select(F.col("p_partkey").alias("device_id"), F.col("p_retailprice").alias("drop"))
    plan = t.orders.select(F.col("o_orderkey").alias("circuit_id"), F.col("o_totalprice").alias("in_plan"))
    homes = t.lineitem.where("l_quantity > 20").groupBy(F.col("l_orderkey").alias("circuit_id")).agg(F.max("l_quantity").alias("home_run"))
    rolled, _ = tables.written(takeoff.circuit_roll_up(claims, drops, plan), "rolled")
    totals, _ = tables.written(takeoff.assembly_totals(rolled.where("circuit_id is not null"), homes), "totals")
    statuses = takeoff.home_run_statuses(plan, homes)
    by_room = rooms.estimated_by_room(drops.limit(0).select(F.lit(0).alias("room"), F.lit(0).cast("long").alias("circuit_id"), "drop"), homes.select((F.col("circuit_id") % 50).cast("int").alias("room"), "circuit_id", "home_run"), "room")
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,6)"))
    return quality.conservation({
        "drops": (drops, exact("drop"), rolled, F.sum("drop_length")), "circuits": (plan, F.count("*"), statuses, F.count_if(F.col("status").isin("ok", "no_anchor"))),
        "assembly_drops": (drops, exact("drop"), totals, F.sum("drops")), "assembly_in_plan": (plan, exact("in_plan"), totals, F.sum("in_plan")),
        "assembly_home_runs": (homes, exact("home_run"), totals, F.sum("home_runs")), "room_home_runs": (homes, exact("home_run"), by_room, F.sum("home_runs")),
    })


@query("""
SELECT p_partkey, p_brand FROM part WHERE p_brand > 'Brand#2' OR (p_brand = 'Brand#2' AND p_partkey > 0) ORDER BY p_brand, p_partkey LIMIT 51
""")
def definition_page(t: Tables) -> DataFrame:
    """The other lists page by the same keys: definitions after a cursor."""
    from plumbline.operators import paging

    return paging.keyset_page(t.part.select("p_partkey", "p_brand"), ["p_brand", "p_partkey"], ["Brand#2", 0])


@query("""
SELECT o_custkey AS g, o_orderkey AS number_id, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey * 10 + 1 END AS fragment_id, CASE o_orderkey % 3 WHEN 0 THEN 'SA' END AS service FROM orders
""")
def tag_reassembly(t: Tables) -> DataFrame:
    """Numbers with their nearest service fragment within reach, each used once, none where two are equally near; joined texts are read as tags again."""
    k = F.col("o_orderkey")
    x = k * 10.0
    bits = [{"fragment_id": k * 10 + 1, "x": x + 1, "y": 0.0, "text": "∅SA"}, {"fragment_id": k * 10 + 2, "x": F.when(k % 3 == 1, x - 1).otherwise(x + 3), "y": 0.0, "text": "∅RA"}]
    fragments = t.orders.where("o_orderkey % 3 < 2").select(F.col("o_custkey").alias("g"), F.inline(_struct_array(*bits)))
    numbers = t.orders.select(F.col("o_custkey").alias("g"), k.alias("number_id"), x.alias("x"), F.lit(0.0).alias("y"), F.lit("100").alias("text"))
    return runs.reassembled(numbers, fragments, 4.0, ["g"]).select("g", "number_id", "fragment_id", F.col("tag.service").alias("service"))
