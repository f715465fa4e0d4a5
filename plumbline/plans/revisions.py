"""Diff, changeset, paging and quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import diff, paging, quality
from plumbline.operators.windows import unique_references
from plumbline.plans.base import ENTITIES, V_ENTITIES, Tables, query, select_list
from plumbline.sources import tables


def _two_revisions(t: Tables) -> tuple[DataFrame, DataFrame]:
    """orders as two revisions: keys missing on either side, some digests changed, some keys null."""
    key = F.when(F.col("o_orderpriority") != "2-HIGH", F.col("o_orderkey"))
    price = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    base = t.orders.where("o_orderstatus <> 'F'").select(key.alias("key"), F.md5(F.encode(price, "UTF-8")).alias("digest"), F.col("o_orderkey").alias("seq"), "o_orderpriority")
    text = F.concat(price, F.when(F.col("o_totalprice") > 300000, "x").otherwise(""))
    other = t.orders.where("o_orderpriority <> '5-LOW'").select(key.alias("key"), F.md5(F.encode(text, "UTF-8")).alias("digest"), F.col("o_orderkey").alias("seq"), "o_orderpriority")
    return base, other


TWO = """
price AS (SELECT *, CASE WHEN o_orderpriority <> '2-HIGH' THEN o_orderkey END AS key, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS p FROM orders),
base AS (SELECT key, md5(p) AS digest, o_orderpriority FROM price WHERE o_orderstatus <> 'F'),
other AS (SELECT key, md5(p || CASE WHEN o_totalprice > 300000 THEN 'x' ELSE '' END) AS digest, o_orderpriority FROM price WHERE o_orderpriority <> '5-LOW')
"""


@query(f"""
WITH {TWO} SELECT coalesce(b.key, o.key) AS key, CASE WHEN b.key IS NULL THEN 'added' WHEN o.key IS NULL THEN 'removed' WHEN b.digest = o.digest THEN 'unchanged' ELSE 'changed' END AS change
FROM (SELECT * FROM base WHERE key IS NOT NULL) b FULL JOIN (SELECT * FROM other WHERE key IS NOT NULL) o ON b.key = o.key
""")
def revision_diff(t: Tables) -> DataFrame:
    """Keyed diff of two revisions."""
    return diff.keyed_diff(*_two_revisions(t), "key", "digest", "seq")


@query(f"WITH {TWO} SELECT (SELECT count(*) FROM base WHERE key IS NULL) AS base_unkeyed, (SELECT count(*) FROM other WHERE key IS NULL) AS other_unkeyed")
def revision_unkeyed(t: Tables) -> DataFrame:
    """Rows without a key, counted apart."""
    return diff.unkeyed_counts(*_two_revisions(t), "key")


SEGMENT = "c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR)"


@query(f"""
WITH b AS (SELECT DISTINCT {SEGMENT} AS value FROM customer WHERE c_acctbal < 0), o AS (SELECT DISTINCT {SEGMENT} AS value FROM customer WHERE c_acctbal > 8000)
SELECT value, 'added' AS side FROM (SELECT * FROM o EXCEPT SELECT * FROM b) UNION ALL SELECT value, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM o)
""")
def layer_differences(t: Tables) -> DataFrame:
    """Values on one side only."""
    named = t.customer.withColumn("layer", F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")))
    return diff.set_differences(named.where("c_acctbal < 0"), named.where("c_acctbal > 8000"), "layer")


@query(f"""
WITH {TWO} SELECT o_orderpriority AS value, sum(s = 0)::BIGINT AS base_count, sum(s = 1)::BIGINT AS other_count, (sum(s = 1) - sum(s = 0))::BIGINT AS delta
FROM (SELECT o_orderpriority, 0 AS s FROM base UNION ALL SELECT o_orderpriority, 1 FROM other) GROUP BY 1
""")
def type_count_deltas(t: Tables) -> DataFrame:
    """D3: count changes by type."""
    return diff.count_deltas(*_two_revisions(t), "o_orderpriority")


@query(f"""
WITH {TWO}, r AS (SELECT (SELECT round(count(key) / count(*), 4) FROM base) AS a, (SELECT round(count(key) / count(*), 4) FROM other) AS b)
SELECT a AS base_ratio, b AS other_ratio, round(b - a, 4) AS delta FROM r
""")
def coverage_delta(t: Tables) -> DataFrame:
    """Change of a coverage ratio."""
    base, other = _two_revisions(t)
    ratio = lambda df, n: df.agg(F.round(F.count("key") / F.count("*"), 4).alias(n))
    return ratio(base, "base_ratio").crossJoin(ratio(other, "other_ratio")).withColumn("delta", F.round(F.col("other_ratio") - F.col("base_ratio"), 4))


def _changesets(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A set for each order, whose lines act on its four entities, of which three are there at first."""
    k = F.col("o_orderkey")
    entities = t.orders.select(F.explode(F.array(*[k * 4 + j for j in range(3)])).alias("entity"), F.col("o_orderpriority").alias("layer"))
    kind = F.element_at(F.array(*map(F.lit, ("change_layer", "change_layer", "flag_for_review", "remove_entity", "add_entity"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    target = F.when(F.col("l_linenumber") % 3 > 0, F.col("l_suppkey") % 4).otherwise(3 - F.col("l_suppkey") % 4)
    ops = t.lineitem.select(
        F.col("l_orderkey").alias("set_id"), (F.col("l_orderkey") * 4 + target).alias("entity"), kind.alias("operation_type"),
        F.when(kind.isin("change_layer", "add_entity"), F.concat(F.lit("L"), (F.col("l_suppkey") % 3).cast("string"))).alias("value"), (F.col("l_linenumber") * 1000000000000 + F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("sequence_index"),
    )
    return entities, ops


@query("""
WITH entities AS (SELECT o_orderkey * 4 + j AS entity, o_orderpriority AS layer FROM orders, range(3) r(j)),
ops AS (SELECT l_orderkey AS set_id, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS n, l_orderkey * 4 + CASE WHEN l_linenumber % 3 > 0 THEN l_suppkey % 4 ELSE 3 - l_suppkey % 4 END AS entity, l_partkey % 5 AS k, 'L' || (l_suppkey % 3) AS value FROM lineitem),
there AS (SELECT ops.*, layer AS base, (layer IS NOT NULL)::INT + coalesce(sum((k = 4)::INT - (k = 3)::INT) OVER (PARTITION BY set_id, ops.entity ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS has,
  coalesce(sum((k = 4)::INT) OVER (PARTITION BY set_id, ops.entity ORDER BY n), 0)::INT AS version FROM ops LEFT JOIN entities ON entities.entity = ops.entity),
good AS (SELECT * FROM there WHERE set_id NOT IN (SELECT set_id FROM there WHERE (k = 4 AND has > 0) OR (k <> 4 AND has < 1))),
layered AS (SELECT *, lag(value) OVER (PARTITION BY set_id, entity, version ORDER BY n) AS was FROM good WHERE k IN (0, 1, 4)),
moved AS (SELECT set_id, entity, version, arg_max(value, n) AS layer, bool_or(k < 2 AND value <> coalesce(was, CASE WHEN version = 0 THEN base END)) AS moved FROM layered GROUP BY ALL)
SELECT g.set_id, g.entity, g.version, coalesce(any_value(layer), CASE WHEN g.version = 0 THEN any_value(base) END) AS layer,
  CASE WHEN bool_or(k = 3) THEN 'removed' WHEN g.version > 0 THEN 'added' WHEN bool_or(moved) THEN 'changed' WHEN bool_or(k = 2) THEN 'metadata_only' ELSE 'unchanged' END AS effect
FROM good g LEFT JOIN moved USING (set_id, entity, version) GROUP BY g.set_id, g.entity, g.version
""")
def changeset_apply(t: Tables) -> DataFrame:
    """Operations replayed in order on entities that they add and remove; sets in which one fails abort whole."""
    entities, ops = _changesets(t)
    return diff.apply_changesets(entities, ops, "set_id", "entity", "layer")


@query("""
WITH found AS (SELECT o_custkey AS target, count(*) AS n, min(o_orderkey) AS row_id FROM orders GROUP BY 1)
SELECT c_custkey AS op_id, CASE WHEN n = 1 THEN row_id END AS row_id, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status
FROM customer LEFT JOIN found ON c_custkey = target
""")
def changeset_targets(t: Tables) -> DataFrame:
    """Targets resolved, missing or ambiguous."""
    ops = t.customer.select(F.col("c_custkey").alias("op_id"), F.col("c_custkey").alias("target"))
    entities = t.orders.select(F.col("o_orderkey").alias("entity_id"), F.col("o_custkey").alias("source_identity"))
    return diff.resolve_targets(ops, entities, "op_id", "target", "source_identity").select("op_id", "row_id", "status")


@query("""
SELECT c_custkey AS set_id, c_nationkey AS base_revision, c_custkey % 25 AS current_revision FROM customer WHERE c_nationkey <> c_custkey % 25
""")
def stale_changesets(t: Tables) -> DataFrame:
    """Sets whose base revision isn't current."""
    sets = t.customer.select(F.col("c_custkey").alias("set_id"), F.col("c_custkey").alias("file_id"), F.col("c_nationkey").cast("long").alias("base_revision"))
    current = t.customer.select(F.col("c_custkey").alias("file_id"), (F.col("c_custkey") % 25).alias("revision_id"))
    return diff.stale_sets(sets, current).select("set_id", "base_revision", "current_revision")


@query("""
SELECT l_orderkey AS set_id, CASE max(CASE WHEN l_tax > 0.07 THEN 3 WHEN l_discount > 0.09 THEN 2 WHEN l_quantity > 45 THEN 1 ELSE 0 END)
  WHEN 3 THEN 'invalid' WHEN 2 THEN 'needs_review' WHEN 1 THEN 'valid_with_warnings' ELSE 'valid' END AS status FROM lineitem GROUP BY 1
""")
def changeset_status(t: Tables) -> DataFrame:
    """Status of a set by its worst finding."""
    severity = F.when(F.col("l_tax") > 0.07, "error").when(F.col("l_discount") > 0.09, "review").when(F.col("l_quantity") > 45, "warning").otherwise("info")
    return diff.set_status(t.lineitem.select(F.col("l_orderkey").alias("set_id"), severity.alias("severity")), "set_id")


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
def latest_validation(t: Tables) -> DataFrame:
    """Newest validation of each set."""
    return diff.latest_valid(t.orders, "o_custkey", "o_orderdate", ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) - 1 AS sequence_index FROM lineitem")
def resequenced_rows(t: Tables) -> DataFrame:
    """Stable sequence numbers."""
    found = diff.resequenced(t.lineitem, ["l_orderkey"], ["l_shipdate", "l_linenumber"])
    return found.select("l_orderkey", "l_linenumber", F.col("sequence_index").cast("long").alias("sequence_index"))


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-02' OR (ts = TIMESTAMP '2024-01-02' AND event_id > 100) ORDER BY ts, event_id LIMIT 51")
def event_page(t: Tables) -> DataFrame:
    """O1, O3: ascending keyset page of the event log."""
    at = F.lit("2024-01-02").cast("timestamp")
    return paging.keyset_page(t.events.select("event_id", "ts"), ["ts", "event_id"], [at, 100])


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 101")
def newest_page(t: Tables) -> DataFrame:
    """O2: descending keyset page."""
    return paging.keyset_page(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], limit=100, descending=True)


@query("SELECT p_partkey, p_brand FROM part WHERE p_size > 20 ORDER BY p_brand, p_partkey LIMIT 25 OFFSET 40")
def filtered_offset_page(t: Tables) -> DataFrame:
    """Offset page after a computed filter."""
    return paging.offset_page(t.part.where("p_size > 20").select("p_partkey", "p_brand"), ["p_brand", "p_partkey"], 40, 25)


@query("SELECT event_id, '[\"' || CAST(event_id AS VARCHAR) || '\",\"' || event_type || '\"]' AS decoded FROM events")
def cursor_round_trip(t: Tables) -> DataFrame:
    """Cursors encode and decode."""
    coded = t.events.select("event_id", S.cursor_encode(F.col("event_id"), F.col("event_type")).alias("cursor"))
    return coded.select("event_id", F.to_json(S.cursor_decode(F.col("cursor"))).alias("decoded"))


@query("""
WITH RECURSIVE items AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_partkey - p_partkey % 17 END AS p, p_partkey % 17 AS m FROM part),
walk AS (SELECT k, 0 AS depth FROM items WHERE p IS NULL UNION ALL SELECT i.k, w.depth + 1 FROM items i JOIN walk w ON i.p = w.k)
SELECT i.k, i.p, w.depth FROM items i LEFT JOIN walk w ON i.k = w.k
""")
def dependency_order(t: Tables) -> DataFrame:
    """Depth below the root; rows under an absent parent have none."""
    k = F.col("p_partkey")
    rows = t.part.select(k.alias("k"), F.when(k % 17 != 0, k - k % 17).alias("p"))
    return paging.dependency_depth(rows, "k", "p")


@query(f"""
WITH {V_ENTITIES} SELECT revision_id, count(*) AS n_entities, count(DISTINCT kind) AS n_types, count(DISTINCT layer_ref) AS n_layers, sum(value > 45)::BIGINT AS n_review,
  sum(block_ref % 10 = 0)::BIGINT AS n_unmapped, round((count(*) - sum(block_ref % 10 = 0)) / count(*), 4) AS mapped_ratio FROM entities GROUP BY 1
""")
def coverage_report(t: Tables) -> DataFrame:
    """A3: counts and mapped ratio of a revision."""
    e = select_list(t.lineitem, ENTITIES)
    e = e.withColumn("unmapped", F.when(F.col("block_ref") % 10 == 0, "no_rule")).withColumn("review", F.col("value") > 45)
    return quality.coverage(e, ["revision_id"], "kind", "layer_ref", "unmapped", "review")


@query(f"""
WITH {V_ENTITIES}, placed AS (SELECT * FROM entities WHERE sequence_index > 1), blocks AS (SELECT DISTINCT revision_id, block_ref FROM entities),
n AS (SELECT revision_id, count(*) AS placed FROM placed GROUP BY 1),
s AS (SELECT revision_id, sum(3)::BIGINT AS stranded FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.revision_id = b.revision_id AND p.block_ref = b.block_ref) GROUP BY 1)
SELECT coalesce(n.revision_id, s.revision_id) AS revision_id, coalesce(placed, 0) AS placed, coalesce(stranded, 0) AS stranded, round(coalesce(placed, 0) / (coalesce(placed, 0) + coalesce(stranded, 0)), 4) AS ratio
FROM n FULL JOIN s ON n.revision_id = s.revision_id
""")
def block_placement(t: Tables) -> DataFrame:
    """A4: placed against stranded block content."""
    e = select_list(t.lineitem, ENTITIES)
    blocks = e.select("revision_id", "block_ref").distinct().withColumn("leaf_count", F.lit(3).cast("long"))
    instances = e.withColumn("block_ref", F.when(F.col("sequence_index") > 1, F.col("block_ref")))
    return quality.placement_ratio(instances, blocks, "revision_id")


@query("""
WITH declared AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > -900 AND c_nationkey <> 7 GROUP BY 1), actual AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1)
SELECT coalesce(d.k, a.k) AS k, d.n AS declared, coalesce(a.n, 0) AS actual, d.n - coalesce(a.n, 0) AS delta, CASE WHEN d.n IS NULL THEN 'not_applicable' WHEN d.n = coalesce(a.n, 0) THEN 'match' ELSE 'drift' END AS status
FROM declared d FULL JOIN actual a ON d.k = a.k
""")
def count_drift(t: Tables) -> DataFrame:
    """A5: declared against actual counts."""
    count = lambda df: df.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return quality.count_drift(count(t.customer.where("c_acctbal > -900 and c_nationkey <> 7")), count(t.customer), ["k"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def dangling_references(t: Tables) -> DataFrame:
    """References without a target."""
    return quality.dangling(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", t.customer.where("c_acctbal > 0"), "c_custkey")


@query("""
SELECT c_nationkey, min((c_custkey * 37) % 1000) AS min_x, min((c_custkey * 91) % 1000) AS min_y, max((c_custkey * 37) % 1000) AS max_x, max((c_custkey * 91) % 1000) AS max_y, count(*) AS n_located,
  min((c_custkey * 37) % 1000) = max((c_custkey * 37) % 1000) OR min((c_custkey * 91) % 1000) = max((c_custkey * 91) % 1000) AS degenerate FROM customer GROUP BY 1
""")
def drawing_extents(t: Tables) -> DataFrame:
    """Extents with a degenerate flag."""
    return quality.extents(t.customer.selectExpr("c_nationkey", "(c_custkey * 37) % 1000 AS x", "(c_custkey * 91) % 1000 AS y"), ["c_nationkey"], "x", "y")


@query("""
WITH i AS (SELECT l_orderkey AS revision_id, 'inv' || l_linenumber AS invariant, l_linenumber <> 3 AS gating, l_quantity > 40 AS drifts FROM lineitem)
SELECT revision_id, coalesce(string_agg(DISTINCT CASE WHEN gating AND drifts THEN invariant END, ',' ORDER BY CASE WHEN gating AND drifts THEN invariant END), '') AS drifted, CASE WHEN max(gating AND drifts) THEN 'drift' ELSE 'match' END AS status FROM i GROUP BY 1
""")
def reconciliation(t: Tables) -> DataFrame:
    """Drift where a gating invariant drifts."""
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("revision_id"), F.concat(F.lit("inv"), F.col("l_linenumber").cast("string")).alias("invariant"),
        (F.col("l_linenumber") != 3).alias("gating"), F.when(F.col("l_quantity") > 40, "drift").otherwise("match").alias("status"),
    )
    return quality.roll_up(rows, ["revision_id"]).withColumn("drifted", F.array_join("drifted", ","))


@query("""
SELECT source, CASE max(CASE WHEN toxic = 1 THEN 3 WHEN quality = 0 THEN 2 WHEN quality IS NULL THEN 1 ELSE 0 END) WHEN 3 THEN 'fail' WHEN 2 THEN 'review' WHEN 1 THEN 'warning' ELSE 'valid' END AS status
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1
""")
def status_lattice(t: Tables) -> DataFrame:
    """A10: worst status of a group."""
    status = F.when(F.col("toxic") == 1, "fail").when(F.col("quality") == 0, "review").when(F.col("quality").isNull(), "warning").otherwise("valid")
    return quality.worst_status(t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left").withColumn("status", status), ["source"], "status")


@query("""
SELECT lang, sum(quality = 1)::BIGINT AS n_good, sum(quality = 0)::BIGINT AS n_bad, count(*) AS n_total FROM documents JOIN labels USING (doc_id) GROUP BY 1
""")
def finding_counts(t: Tables) -> DataFrame:
    """Findings by severity."""
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id").withColumn("severity", F.when(F.col("quality") == 1, "good").otherwise("bad"))
    return quality.finding_counts(rows, ["lang"], "severity", ["good", "bad"])


@query("""
SELECT o_orderstatus AS k, 'orders' AS collection, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT l_linestatus, 'lines', count(*) FROM lineitem GROUP BY 1
""")
def manifest_counts(t: Tables) -> DataFrame:
    """Rows of each collection."""
    return quality.manifest({"orders": t.orders.withColumnRenamed("o_orderstatus", "k"), "lines": t.lineitem.withColumnRenamed("l_linestatus", "k")}, "k")


@query("""
WITH v AS (SELECT p_brand, CASE WHEN log10(p_retailprice) >= 2.99 THEN 0 WHEN log10(p_retailprice) >= 2.97 THEN 1 WHEN log10(p_retailprice) >= 2.9 THEN 2 END AS vote FROM part)
SELECT p_brand, count(*) AS n_votes, CASE quantile_disc(vote, 0.5) WHEN 0 THEN 'mm' WHEN 1 THEN 'cm' ELSE 'm' END AS unit FROM v WHERE vote IS NOT NULL GROUP BY 1
""")
def unit_inference(t: Tables) -> DataFrame:
    """Unit by the lower median of votes."""
    return quality.infer_unit(t.part, "p_brand", "p_retailprice", [("mm", 2.99, 99.0), ("cm", 2.97, 99.0), ("m", 2.9, 99.0)])


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN n = 1 THEN l_returnflag WHEN m = 1 THEN l_linestatus ELSE 'line-' || lpad(CAST(r AS VARCHAR), 6, '0') END AS unique_ref FROM (
  SELECT *, CASE WHEN n > 1 THEN row_number() OVER (PARTITION BY l_orderkey, l_linestatus, n > 1 ORDER BY r) END AS m FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY r) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM lineitem)))
""")
def unique_references_by_order(t: Tables) -> DataFrame:
    """The first candidate of a row that no earlier row took, else its sequence name."""
    rows = diff.resequenced(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], "r").withColumn("r", F.col("r") + 1)
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "r")
    found = unique_references(rows, ["l_orderkey"], ["r"], ["l_returnflag", "l_linestatus"], "line", "r")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "unique_ref")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus = 'F' AND (l_linenumber = 7 OR l_linenumber <= 3)")
def entity_scan(t: Tables) -> DataFrame:
    """Scan by type, layer, sheet and tier; an undetermined sheet stays."""
    e = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("entity_type"), F.col("l_linestatus").alias("layer_ref"),
        F.when(F.col("l_linenumber") != 7, F.col("l_linenumber") <= 3).alias("on_sheet"),
    )
    return tables.entity_scan(e, ["A", "R"], ["F"], exclude_off_sheet=True).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0 AND n_nationkey <> 3")
def active_lineage(t: Tables) -> DataFrame:
    """S3: rows whose parents aren't deleted."""
    gone = lambda c: F.when(c, F.lit("2024-01-01")).alias("deleted_at")
    revisions = t.orders.select("o_orderkey", F.col("o_custkey").alias("file_id"))
    files = t.customer.select(F.col("c_custkey").alias("file_id"), F.col("c_nationkey").alias("project_id"), gone(F.col("c_acctbal") < 0))
    projects = t.nation.select(F.col("n_nationkey").alias("project_id"), gone(F.col("n_nationkey") == 3))
    return tables.active_lineage(revisions, files, projects).select("o_orderkey")


@query("""
WITH m AS (SELECT *, lower(p_type) LIKE '%steel%' OR lower(p_type) LIKE '%tin%' AS hit FROM part)
SELECT p_partkey FROM m JOIN (SELECT p_brand, max(hit) AS any_hit FROM m GROUP BY 1) USING (p_brand) WHERE hit OR NOT any_hit
""")
def token_scan(t: Tables) -> DataFrame:
    """Layers by token, whole group where none matches."""
    return tables.token_scan(t.part, ["STEEL", "tin"], "p_type", ["p_brand"]).select("p_partkey")


@query("SELECT p_partkey::VARCHAR AS id, p_brand AS brand, coalesce(p_size::VARCHAR, '') AS size FROM part ORDER BY p_partkey")
def csv_export(t: Tables) -> DataFrame:
    """Export rows as text."""
    return tables.csv_rows(t.part, {"id": F.col("p_partkey"), "brand": F.col("p_brand"), "size": F.col("p_size")}, ["p_partkey"])


@query("""SELECT '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}' AS document FROM customer""")
def json_export(t: Tables) -> DataFrame:
    """Canonical JSON, keys sorted."""
    return tables.json_rows(t.customer, ["c_nationkey", "c_custkey", "c_name", "c_mktsegment"])


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS checksum_sha256 FROM documents")
def artifact_checksums(t: Tables) -> DataFrame:
    """Size and checksum of exported bodies."""
    return tables.artifact_metadata(t.documents, "doc_id", "text")


@query("SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 200000")
def append_absent(t: Tables) -> DataFrame:
    """Rows to append, absent keys once each."""
    key = ["o_custkey", "o_orderpriority"]
    return tables.insert_absent(t.orders.where("o_orderstatus = 'O'").select(*key), t.orders.where("o_totalprice > 200000"), key)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def document_fields(t: Tables) -> DataFrame:
    """Fields of a JSON document as columns."""
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
