"""Table scans, written intermediate tables, and sinks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import ANNOTATION_NAMES, ARCHITECTURE_NAMES, colour_key, symbol_anchor


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shared folders of sessions without spark.checkpoint.dir, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset in local mode, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="spark-plumbline-")
        where = _OWN[app]
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


#: Rows of a table of a few numbers that one task writes.
ROWS_PER_TASK = 1 << 18


def tasks_for(rows: int) -> int:
    """Tasks, and so files, for so many rows."""
    return max(1, -(-rows // ROWS_PER_TASK))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by the keys over as many tasks as so many rows need, so that a task's share doesn't grow with the table."""
    return df.repartition(tasks_for(rows), *keys)


def delete(spark: SparkSession, *paths: str) -> None:
    """Remove written tables that no later step reads."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Written tables of one job: ``with Scratch(spark) as s`` writes them by ``s.table`` and deletes them at the end.

    Tables named in ``keep`` stay, since a DataFrame that is returned still reads them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, *[p for p in self.paths if p not in self.kept])

    def table(self, df: DataFrame, name: str, keep: bool = False, rows: int | None = None) -> DataFrame:
        """df written and read back; ``rows`` bounds its rows where that is known, so that few rows aren't many files."""
        made, path = written(df if rows is None else df.coalesce(tasks_for(rows)), name)
        self.paths.append(path)
        if keep:
            self.kept.add(path)
        return made


def entity_scan(
    entities: DataFrame,
    types: Sequence[str] | None = None,
    layers: Sequence[str] | None = None,
    exclude_off_sheet: bool = False,
    tier: str | None = None,
) -> DataFrame:
    """Entities by type, layer, sheet membership and tier; an undetermined membership (null) stays."""
    if types is not None:
        entities = entities.where(F.col("entity_type").isin(list(types)))
    if layers is not None:
        entities = entities.where(F.col("layer_ref").isin(list(layers)))
    if exclude_off_sheet:
        entities = entities.where(~F.col("on_sheet").eqNullSafe(False))
    return entities if tier is None else entities.where(F.col("materialization_tier") == tier)


def active_lineage(revisions: DataFrame, files: DataFrame, projects: DataFrame) -> DataFrame:
    """Revisions whose file and project aren't soft-deleted (``deleted_at`` null)."""
    alive = lambda df: df.where(F.col("deleted_at").isNull())
    return revisions.join(alive(files).select("file_id", "project_id"), "file_id").join(alive(projects).select("project_id"), "project_id")


def token_scan(texts: DataFrame, tokens: Sequence[str], layer: str = "layer_ref", group: Sequence[str] = ()) -> DataFrame:
    """Rows whose layer contains a token; a group in which no layer does keeps all its rows."""
    hit = F.lit(False)
    for t in tokens:
        hit = hit | F.lower(F.col(layer)).contains(t.lower())
    marked = texts.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    any_hit = marked.groupBy(*group).agg(F.max("__hit").alias("__any"))
    joined = marked.join(any_hit, list(group)) if group else marked.crossJoin(F.broadcast(any_hit))
    return joined.where(F.col("__hit") | ~F.col("__any")).drop("__hit", "__any")


def versioned_scan(derived: DataFrame, version: str) -> DataFrame:
    """Derived rows of one algorithm version; rows without a version are of none."""
    return derived.where(F.col("algo_version") == version)


def csv_rows(df: DataFrame, columns: dict[str, Column], order: Sequence[str]) -> DataFrame:
    """The text form of an export: named string columns, null as empty, in a fixed order."""
    return df.orderBy(*order).select(*[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in columns.items()])


def write_csv(rows: DataFrame, path: str) -> None:
    """Write the rows of ``csv_rows`` with a header line, replacing what is there; part files keep the rows' order."""
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def json_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One compact JSON text for each row, keys sorted."""
    return df.select(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).alias("document"))


def artifact_metadata(df: DataFrame, key: str, body: str) -> DataFrame:
    """Size and checksum of exported bodies."""
    data = F.encode(F.col(body), "UTF-8")
    return df.select(key, F.octet_length(data).cast("long").alias("size_bytes"), F.sha2(data, 256).alias("checksum_sha256"))


def insert_absent(new: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows to append: one for each key that isn't stored yet; repeating the append adds nothing."""
    return new.dropDuplicates(list(key)).join(existing.select(*key), list(key), "left_anti")


def on_layers(rows: DataFrame, tokens: Sequence[str], layer: str = "layer_ref") -> DataFrame:
    """Rows whose layer's name contains a token, in any case; rows without a layer don't."""
    return rows.where(F.coalesce(F.lower(layer).rlike("|".join(re.escape(t.lower()) for t in tokens)), F.lit(False)))


def band_scan(entities: DataFrame, tokens: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """(key, entity_id, colour, pattern, ring): hatches on layers with a token, as rings of three points and more, by colour key."""
    found = on_layers(entities.where("entity_type = 'hatch'"), tokens).where(F.size("points") >= 3)
    return found.select(*key, "entity_id", colour_key(F.col("rgb"), F.col("colour_index")).alias("colour"), "pattern", F.col("points").alias("ring"))


def rise_drop_scan(entities: DataFrame, kind: str, key: Sequence[str] = ()) -> DataFrame:
    """(key, entity_id, kind, x, y, colour): arcs and hatches on layers that name the kind (rise or drop), at their anchors."""
    found = on_layers(entities.where(F.col("entity_type").isin("arc", "hatch")), [kind])
    at = symbol_anchor(F.col("centre"), F.col("points"), F.col("box"))
    out = found.select(*key, "entity_id", F.lit(kind).alias("kind"), at.alias("at"), colour_key(F.col("rgb"), F.col("colour_index")).alias("colour"))
    return out.where("at is not null").select(*key, "entity_id", "kind", "at.x", "at.y", "colour")


def text_scan(entities: DataFrame, tokens: Sequence[str], pattern: str | None = None, key: Sequence[str] = ()) -> DataFrame:
    """(key, entity_id, text, x, y): texts on layers with a token, and where a pattern is given those that match it."""
    found = on_layers(entities.where("entity_type = 'text' and text is not null"), tokens)
    return (found if pattern is None else found.where(F.col("text").rlike(pattern))).select(*key, "entity_id", "text", "centre.x", "centre.y")


def spline_scan(entities: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """(key, entity_id, vertices, closed, dropped): splines as vertex arrays; those with fewer than two vertices are marked dropped."""
    found = entities.where("entity_type = 'spline'")
    few = F.coalesce(F.size("points"), F.lit(0)) < 2
    return found.select(*key, "entity_id", F.col("points").alias("vertices"), F.coalesce("closed", F.lit(False)).alias("closed"), few.alias("dropped"))


def footprint_scan(entities: DataFrame, block_boxes: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """(key, entity_id, block_ref, box): placed blocks that may be devices, with their block's box moved and scaled to where they stand.

    Building fabric and annotation are left out by their names; a block without a box has none.
    """
    name = F.lower("block_ref")
    kept = entities.where("entity_type = 'insert' and block_ref is not null").where(~name.rlike("|".join(n.lower() for n in (*ARCHITECTURE_NAMES, *ANNOTATION_NAMES))))
    met = kept.join(block_boxes.select(*key, "block_ref", F.col("box").alias("__b")), [*key, "block_ref"], "left")
    side = lambda f, axis: f(*[F.col(f"centre.{axis}") + F.col(f"__b.{e}_{axis}") * F.coalesce(f"scale_{axis}", F.lit(1.0)) for e in ("min", "max")])
    box = F.struct(side(F.least, "x").alias("min_x"), side(F.least, "y").alias("min_y"), side(F.greatest, "x").alias("max_x"), side(F.greatest, "y").alias("max_y"))
    return met.select(*key, "entity_id", "block_ref", F.when(F.col("__b").isNotNull(), box).alias("box"))


def scale_context(documents: DataFrame, key: str, body: str) -> DataFrame:
    """(key, declared, factor, available): the units block of each revision's document; unavailable without a usable factor."""
    read = F.from_json(F.get_json_object(body, "$.units"), "declared string, factor double")
    good = (read["factor"] > 0) & (read["factor"] < float("inf"))
    return documents.select(key, read["declared"].alias("declared"), F.when(good, read["factor"]).alias("factor"), F.coalesce(good, F.lit(False)).alias("available"))
