"""Takeoff, catalog and estimate queries over lineitem, orders and part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import catalog, estimate, quantities
from plumbline.plans.base import V_SEGMENTS, SEGMENTS, Tables, query, select_list

ROWS = "l_returnflag, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_tax"
KEY = ["l_partkey", "l_suppkey"]

DEDUP_SQL = """
SELECT l_partkey, l_suppkey, min(l_orderkey * 10 + l_linenumber) AS primary_id, count(*) AS n_rows,
  count(DISTINCT l_quantity) > 1 AS conflict
FROM lineitem GROUP BY ALL
"""


@query(DEDUP_SQL)
def quantity_dedup(t: Tables) -> DataFrame:
    """A2: conflicts and primaries of contributors that share an identity."""
    rows = t.lineitem.withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return quantities.deduplicate(rows, KEY, ["l_quantity"], ["row_id"], "row_id")


@query("""
WITH rows AS (SELECT l_partkey AS k, l_orderkey * 10 + l_linenumber AS row_id, CASE WHEN l_linenumber % 2 = 0 THEN l_tax END AS a, CASE WHEN l_linenumber % 2 = 1 THEN l_tax END AS b FROM lineitem WHERE l_quantity = 50),
g AS (SELECT k, min(row_id) AS primary_id, count(DISTINCT coalesce(CAST(a AS VARCHAR), '-') || '/' || coalesce(CAST(b AS VARCHAR), '-')) AS n FROM rows GROUP BY 1)
SELECT k, primary_id, row_id AS duplicate_id FROM rows JOIN g USING (k) WHERE n = 1 AND row_id <> primary_id
""")
def quantity_duplicates(t: Tables) -> DataFrame:
    """A2: the duplicates of a key as rows; a null beside a value is a conflict."""
    value = lambda odd: F.when(F.col("l_linenumber") % 2 == odd, F.col("l_tax"))
    rows = t.lineitem.where("l_quantity = 50").select(F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), value(0).alias("a"), value(1).alias("b"))
    found = quantities.deduplicate(rows, ["k"], ["a", "b"], ["row_id"], "row_id")
    return quantities.duplicates(rows, found, ["k"], "row_id")


TOTALS_SQL = """
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS n,
    min(l_quantity) OVER (PARTITION BY l_partkey, l_suppkey) = max(l_quantity) OVER (PARTITION BY l_partkey, l_suppkey) AS same
  FROM lineitem)
SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(28, 6))) AS DOUBLE) AS total, count(*) AS n_contributors
FROM ranked WHERE n = 1 AND same GROUP BY ALL
"""


@query(TOTALS_SQL)
def quantity_totals(t: Tables) -> DataFrame:
    """A1 over A2: exact totals of the contributors whose group has no conflict."""
    kept = quantities.primaries(t.lineitem, KEY, ["l_quantity"], ["l_orderkey", "l_linenumber"])
    return quantities.totals(kept, ["l_returnflag"], "l_quantity").withColumn("total", F.col("total").cast("double"))


@query(f"""
WITH {V_SEGMENTS}
SELECT layer_ref, 'length' AS quantity_type, round(CAST(sum(CAST(sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS DECIMAL(28,9))) AS DOUBLE), 4) AS total, count(*) AS n_contributors
FROM segments GROUP BY ALL
UNION ALL SELECT layer_ref, 'count', count(*)::DOUBLE, count(*) FROM segments GROUP BY ALL
""")
def quantity_engine(t: Tables) -> DataFrame:
    """Candidates from line geometry, then totals by type."""
    segments = select_list(t.orders, SEGMENTS)
    point = lambda i: F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"))
    shaped = segments.withColumn("points", F.array(point(0), point(1))).withColumn("closed", F.lit(False))
    made = quantities.geometry_candidates(shaped, keep=["layer_ref"])
    return quantities.totals(made, ["layer_ref", "quantity_type"], "value").withColumn("total", F.round(F.col("total").cast("double"), 4))


@query("""
SELECT p_partkey, 'perimeter' AS quantity_type, CAST(2 * (p_size + p_partkey % 7 + 1) AS DOUBLE) AS value FROM part
UNION ALL SELECT p_partkey, 'area', CAST(p_size * (p_partkey % 7 + 1) AS DOUBLE) FROM part
UNION ALL SELECT p_partkey, 'count', 1.0 FROM part
""")
def closed_polyline_quantities(t: Tables) -> DataFrame:
    """E1 for closed polylines: perimeter, area and count of a rectangle for each part."""
    w, h = F.col("p_size").cast("double"), (F.col("p_partkey") % 7 + 1).cast("double")
    zero = F.lit(0.0)
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((zero, zero), (w, zero), (w, h), (zero, h))])
    shaped = t.part.select("p_partkey", ring.alias("points"), F.lit(True).alias("closed"))
    return quantities.geometry_candidates(shaped, keep=["p_partkey"])


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.08 THEN 'discounted' WHEN l_quantity < 2 THEN 'too_small' END AS exclusion_reason
FROM lineitem WHERE l_discount > 0.08 OR l_quantity < 2
""")
def quantity_exclusions(t: Tables) -> DataFrame:
    """P20: rows routed to exclusions with their first reason."""
    _, out = quantities.exclusions(t.lineitem, [(F.col("l_discount") > 0.08, "discounted"), (F.col("l_quantity") < 2, "too_small")])
    return out.select("l_orderkey", "l_linenumber", "exclusion_reason")


@query("""
WITH hints AS (SELECT p_partkey AS entity_id, 'length' AS quantity_type, CAST(p_size AS DOUBLE) AS value, p_type AS unit, p_size % 2 = 0 AS strict FROM part),
measured AS (SELECT DISTINCT l_partkey AS entity_id FROM lineitem WHERE l_quantity > 45)
SELECT entity_id, quantity_type, value, unit FROM hints WHERE strict AND unit IS NOT NULL AND entity_id NOT IN (SELECT entity_id FROM measured)
""")
def hint_fallback(t: Tables) -> DataFrame:
    """Strict hints of entities without a measurement."""
    hints = t.part.select(
        F.col("p_partkey").alias("entity_id"), F.lit("length").alias("quantity_type"), F.col("p_size").cast("double").alias("value"),
        F.col("p_type").alias("unit"), (F.col("p_size") % 2 == 0).alias("strict"), F.lit(0).alias("position"),
    )
    measured = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("entity_id"))
    return quantities.hint_fallback(measured, hints, ["entity_id"])


@query("""
SELECT p_partkey AS entity_id, 'price' AS quantity_type, max(l_extendedprice / l_quantity) AS measured, any_value(p_retailprice) AS hinted
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey
HAVING abs(max(l_extendedprice / l_quantity) - any_value(p_retailprice)) > greatest(1e-9 * greatest(abs(max(l_extendedprice / l_quantity)), abs(any_value(p_retailprice))), 1e-9)
""")
def hint_mismatches(t: Tables) -> DataFrame:
    """Measurements that contradict the hint."""
    measured = t.lineitem.groupBy(F.col("l_partkey").alias("entity_id")).agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("value"))
    hints = t.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_retailprice").alias("value"))
    named = [df.withColumn("quantity_type", F.lit("price")) for df in (measured, hints)]
    return quantities.hint_mismatches(named[0], named[1], ["entity_id"])


@query("""
WITH kept AS (SELECT * FROM lineitem WHERE l_quantity >= 2)
SELECT 'contributor' AS item_kind, count(*) AS n FROM kept
UNION ALL SELECT 'aggregate', count(DISTINCT l_returnflag) FROM kept
UNION ALL SELECT 'exclusion', count(*) FROM lineitem WHERE l_quantity < 2
""")
def takeoff_rows(t: Tables) -> DataFrame:
    """Contributors, aggregates and exclusions as one table, counted by kind."""
    kept, out = quantities.exclusions(t.lineitem.select("l_returnflag", "l_quantity"), [(F.col("l_quantity") < 2, "too_small")])
    sums = quantities.totals(kept, ["l_returnflag"], "l_quantity")
    return quantities.takeoff_rows(kept, sums, out).groupBy("item_kind").agg(F.count("*").alias("n"))


CATALOG = """
entries AS (
  SELECT p_partkey AS entry_id, p_brand AS item_key, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 25 END AS project_id,
    DATE '1992-01-01' + CAST(p_size * 60 AS INT) AS effective_start,
    CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE DATE '1992-01-01' + CAST(p_size * 60 + 40 AS INT) END AS effective_end,
    CAST(p_retailprice AS DECIMAL(18, 6)) AS value FROM part),
requests AS (
  SELECT o_orderkey AS request_id, 'Brand#' || CAST(o_custkey % 5 + 1 AS VARCHAR) || CAST(o_orderkey % 5 + 1 AS VARCHAR) AS item_key,
    o_custkey % 25 AS project_id, CAST(o_orderdate AS DATE) AS as_of FROM orders)
"""


def _entries(t: Tables) -> DataFrame:
    start = lambda more: F.date_add(F.lit("1992-01-01").cast("date"), (F.col("p_size") * 60 + more).cast("int"))
    return t.part.select(
        F.col("p_partkey").alias("entry_id"), F.col("p_brand").alias("item_key"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") % 25).alias("project_id"), start(0).alias("effective_start"),
        F.when(F.col("p_partkey") % 5 != 0, start(40)).alias("effective_end"), F.col("p_retailprice").cast("decimal(18,6)").alias("value"),
    )


def _requests(t: Tables) -> DataFrame:
    brand = F.concat(F.lit("Brand#"), (F.col("o_custkey") % 5 + 1).cast("string"), (F.col("o_orderkey") % 5 + 1).cast("string"))
    return t.orders.select(F.col("o_orderkey").alias("request_id"), brand.alias("item_key"), (F.col("o_custkey") % 25).alias("project_id"), F.col("o_orderdate").cast("date").alias("as_of"))


@query(f"""
WITH {CATALOG}, met AS (
  SELECT r.request_id, count(e.project_id) AS n_own, count(*) AS n_all,
    min(CASE WHEN e.project_id IS NOT NULL THEN e.entry_id END) AS own_id, min(CASE WHEN e.project_id IS NULL THEN e.entry_id END) AS any_id,
    min(CASE WHEN e.project_id IS NOT NULL THEN e.value END) AS own_value, min(CASE WHEN e.project_id IS NULL THEN e.value END) AS any_value
  FROM requests r JOIN entries e ON r.item_key = e.item_key AND e.effective_start <= r.as_of AND (e.effective_end IS NULL OR r.as_of < e.effective_end)
    AND (e.project_id IS NULL OR e.project_id = r.project_id) GROUP BY r.request_id),
judged AS (SELECT r.*, m.* EXCLUDE (request_id), CASE WHEN m.n_all IS NULL THEN 'missing' WHEN (CASE WHEN n_own > 0 THEN n_own ELSE n_all END) > 1 THEN 'ambiguous' ELSE 'selected' END AS status
  FROM requests r LEFT JOIN met m ON r.request_id = m.request_id)
SELECT request_id, status, CASE WHEN status = 'selected' THEN coalesce(own_id, any_id) END AS entry_id,
  CAST(CASE WHEN status = 'selected' THEN coalesce(own_value, any_value) END AS DOUBLE) AS value FROM judged
""")
def catalog_as_of(t: Tables) -> DataFrame:
    """Entry valid at the request's date, project before global, ambiguity as a status."""
    found = catalog.select_as_of(_requests(t), _entries(t), ["item_key"], "request_id")
    return found.select("request_id", "status", "entry_id", F.col("value").cast("double").alias("value"))


@query(f"""
WITH {CATALOG}, superseded AS (SELECT p_partkey AS predecessor_id, p_partkey + 1 AS successor_id FROM part WHERE p_size = 1)
SELECT e.entry_id, s.successor_id, b.predecessor_id FROM entries e LEFT JOIN superseded s ON e.entry_id = s.predecessor_id LEFT JOIN superseded b ON e.entry_id = b.successor_id
""")
def catalog_supersession(t: Tables) -> DataFrame:
    """Predecessors and successors."""
    return catalog.supersession_view(_entries(t), _edges(t)).select("entry_id", "successor_id", "predecessor_id")


def _edges(t: Tables) -> DataFrame:
    return t.part.where("p_size = 1").select(F.col("p_partkey").alias("predecessor_id"), (F.col("p_partkey") + 1).alias("successor_id"))


@query(f"""
WITH {CATALOG} SELECT entry_id, item_key FROM entries
WHERE effective_start <= DATE '1995-06-01' AND (effective_end IS NULL OR DATE '1995-06-01' < effective_end) AND entry_id NOT IN (SELECT p_partkey FROM part WHERE p_size = 1)
""")
def catalog_list(t: Tables) -> DataFrame:
    """Entries valid at a date, without superseded ones."""
    return catalog.listing(_entries(t), F.lit("1995-06-01").cast("date"), _edges(t)).select("entry_id", "item_key")


@query("""
WITH refs AS (SELECT l_partkey + CAST(l_linenumber = 7 AS INT) * 100000000 AS entry_id, CASE WHEN l_linenumber = 3 THEN 'stale' ELSE md5(CAST(l_partkey AS VARCHAR)) END AS checksum FROM lineitem)
SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN p_partkey IS NULL THEN 'missing' WHEN checksum = md5(CAST(p_partkey AS VARCHAR)) THEN 'matched' ELSE 'checksum_mismatch' END AS status
  FROM refs LEFT JOIN part ON entry_id = p_partkey) GROUP BY status
""")
def reference_checksums(t: Tables) -> DataFrame:
    """Explicit references checked by checksum."""
    md5 = lambda c: F.md5(F.encode(F.col(c).cast("string"), "UTF-8"))
    entry = F.col("l_partkey") + (F.col("l_linenumber") == 7).cast("long") * 100000000
    refs = t.lineitem.select(entry.alias("entry_id"), F.when(F.col("l_linenumber") == 3, "stale").otherwise(md5("l_partkey")).alias("checksum"))
    entries = t.part.select(F.col("p_partkey").alias("entry_id"), md5("p_partkey").alias("checksum"))
    return catalog.check_references(refs, entries).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, sha256('brand=' || p_brand || '|key=' || CAST(p_partkey AS VARCHAR) || '|size=' || CAST(p_size AS VARCHAR)) AS checksum FROM part")
def catalog_checksums(t: Tables) -> DataFrame:
    """checksum of a row's canonical text."""
    named = t.part.select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_partkey").alias("key"), F.col("p_size").alias("size"))
    return named.select("p_partkey", catalog.entry_checksum(["key", "brand", "size"]).alias("checksum"))


@query("""
SELECT entry_id, CASE WHEN entry_id % 50 = 0 THEN 'currency' WHEN value <= 0 THEN 'value' WHEN entry_id % 7 = 0 THEN 'scope' END AS problem
FROM (SELECT p_partkey AS entry_id, p_retailprice - 950 AS value FROM part) WHERE entry_id % 50 = 0 OR value <= 0 OR entry_id % 7 = 0
""")
def catalog_problems(t: Tables) -> DataFrame:
    """Entries that break a load rule, with the first rule broken."""
    entries = t.part.select(
        F.col("p_partkey").alias("entry_id"), F.when(F.col("p_partkey") % 50 == 0, "USD").otherwise("GBP").alias("currency"), (F.col("p_retailprice") - 950).alias("value"),
        F.when(F.col("p_partkey") % 7 == 0, "project").otherwise("global").alias("scope_type"), F.lit(None).cast("long").alias("project_id"),
        F.lit("2020-01-01").cast("date").alias("effective_start"), F.lit(None).cast("date").alias("effective_end"),
    )
    return catalog.entry_problems(entries).select("entry_id", "problem")


LINES = """
lines AS (SELECT p_brand, l_returnflag, round(CAST(l_quantity AS DECIMAL(18, 6)) * CAST(p_retailprice AS DECIMAL(18, 6)), 2) AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""


@query(f"""
WITH {LINES}, sums AS (SELECT p_brand, sum(amount) AS subtotal, count(*) AS n_lines FROM lines GROUP BY p_brand)
SELECT p_brand, n_lines, CAST(subtotal AS DOUBLE) AS subtotal, CAST(round(CAST(subtotal AS DECIMAL(28, 2)) * CAST(0.2 AS DECIMAL(9, 6)), 2) AS DOUBLE) AS tax,
  CAST(subtotal + round(CAST(subtotal AS DECIMAL(28, 2)) * CAST(0.2 AS DECIMAL(9, 6)), 2) AS DOUBLE) AS total FROM sums
""")
def estimate_totals(t: Tables) -> DataFrame:
    """Priced lines, the sum of rounded lines, tax and total of each brand."""
    lines = t.lineitem.select("l_partkey", "l_quantity").join(t.part.select("p_partkey", "p_brand", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    priced = estimate.priced_lines(lines, "l_quantity", "p_retailprice")
    found = estimate.estimate_totals(priced, ["p_brand"], "0.2")
    return found.select("p_brand", "n_lines", *[F.col(c).cast("double").alias(c) for c in ("subtotal", "tax", "total")])


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'computed' ELSE 'division_by_zero' END AS status,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(round(CAST(CAST(l_quantity AS DECIMAL(28, 9)) * 19.99 AS DECIMAL(38, 12)), 2) AS DOUBLE) END AS amount
FROM lineitem
""")
def formula_amounts(t: Tables) -> DataFrame:
    """A typed formula compiled to a column; division by zero is a status."""
    tree = {
        "kind": "divide",
        "args": [
            {"kind": "multiply", "args": [{"kind": "literal", "value": "19.99", "contract": "rate"}, {"kind": "input", "name": "quantity"}]},
            {"kind": "input", "name": "even"},
        ],
    }
    lines = t.lineitem.withColumn("even", F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(0))
    made = estimate.formula_lines(lines, tree, {"quantity": ("l_quantity", "quantity"), "even": ("even", "scalar")})
    return made.select("l_orderkey", "l_linenumber", "status", F.col("amount").cast("double").alias("amount"))


@query("""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_custkey % 9 = 0 THEN 'unanchored' ELSE 'accepted' END AS status FROM customer
""")
def assumption_lines(t: Tables) -> DataFrame:
    """Assumptions must not be negative and need an anchor."""
    lines = t.customer.withColumn("anchor", F.when(F.col("c_custkey") % 9 != 0, F.col("c_nationkey")))
    return estimate.assumption_lines(lines, "c_acctbal", "anchor").select("c_custkey", "status")


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_line_keys(t: Tables) -> DataFrame:
    """Keys that must be unique and aren't."""
    return estimate.repeated_keys(t.lineitem, KEY)


@query("""
SELECT 'material' AS entry_kind, count(*) AS n, count(DISTINCT p_brand || p_type || p_partkey) AS n_payloads FROM part
UNION ALL SELECT 'rate', count(*), count(*) FROM supplier
""")
def estimate_snapshot(t: Tables) -> DataFrame:
    """Frozen entries of several kinds with checksums, counted."""
    parts = {"material": t.part.withColumnRenamed("p_partkey", "key"), "rate": t.supplier.withColumnRenamed("s_suppkey", "key")}
    found = estimate.snapshot(parts, "key")
    return found.groupBy("entry_kind").agg(F.count("*").alias("n"), F.count_distinct("checksum").alias("n_payloads"))


@query("""
SELECT p_partkey, rtrim(rtrim(CAST(CAST(p_retailprice AS DECIMAL(18, 6)) AS VARCHAR), '0'), '.') AS shown,
  CASE WHEN regexp_matches(p_name, '^[=+@-]') THEN '''' || p_name ELSE p_name END AS safe, 'sha256:' || sha256(p_name) AS digest FROM part
""")
def export_texts(t: Tables) -> DataFrame:
    """decimal, spreadsheet-safe and digest texts."""
    price = F.col("p_retailprice").cast("decimal(18,6)")
    return t.part.select("p_partkey", S.decimal_text(price).alias("shown"), S.spreadsheet_safe(F.col("p_name")).alias("safe"), S.prefixed_sha256(F.col("p_name")).alias("digest"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN round(p_size * 0.001::DOUBLE, 9) WHEN 1 THEN round(p_size * 0.01::DOUBLE, 9) WHEN 2 THEN round(p_size * 0.3048::DOUBLE, 9) END AS metres FROM part
""")
def unit_conversion(t: Tables) -> DataFrame:
    """lengths in metres, null for unknown units."""
    unit = F.element_at(F.array(*map(F.lit, (" MM", "cm", "ft ", "furlong"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", F.round(S.to_metres(F.col("p_size"), unit), 9).alias("metres"))
