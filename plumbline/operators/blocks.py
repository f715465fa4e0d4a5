"""Block instances: expansion of nested and arrayed inserts to world geometry, device enumeration, document rows.

A transform is a struct (a, b, c, d, e, f): x' = a x + c y + e, y' = b x + d y + f. Inserts have an instance id, the block
they place, an insertion point, scale, rotation in degrees and, for arrays, columns, rows and spacings; children of blocks
are leaves with points or inserts of their own. ``group`` columns keep drawings apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.tables import Scratch

#: Deepest nesting that is followed, as deep as drawings may nest.
MAX_DEPTH = 16


def affine(a, b, c, d, e, f) -> Column:
    cells = [x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b, c, d, e, f)]
    return F.struct(*[x.cast("double").alias(n) for x, n in zip(cells, "abcdef", strict=True)])


def composed(m: Column, n: Column) -> Column:
    """m after n."""
    return affine(
        m["a"] * n["a"] + m["c"] * n["b"], m["b"] * n["a"] + m["d"] * n["b"], m["a"] * n["c"] + m["c"] * n["d"], m["b"] * n["c"] + m["d"] * n["d"],
        m["a"] * n["e"] + m["c"] * n["f"] + m["e"], m["b"] * n["e"] + m["d"] * n["f"] + m["f"],
    )


def applied(m: Column, points: Column) -> Column:
    return F.transform(points, lambda p: F.struct((m["a"] * p["x"] + m["c"] * p["y"] + m["e"]).alias("x"), (m["b"] * p["x"] + m["d"] * p["y"] + m["f"]).alias("y")))


def conformal(m: Column, eps: float = 1e-9) -> Column:
    """Uniform scale and rotation: columns of equal length at right angles."""
    one, two = F.sqrt(m["a"] * m["a"] + m["b"] * m["b"]), F.sqrt(m["c"] * m["c"] + m["d"] * m["d"])
    square = F.abs(m["a"] * m["c"] + m["b"] * m["d"]) < eps * one * two
    return (one > 0) & (two > 0) & square & (F.abs(one - two) < eps * F.greatest(one, two))


def _placement(base: Column) -> Column:
    """The transform of an insert: its block's base point to the insertion point, scaled and rotated."""
    c, s = F.cos(F.radians("rotation")), F.sin(F.radians("rotation"))
    turned = affine(c * F.col("sx"), s * F.col("sx"), -s * F.col("sy"), c * F.col("sy"), F.col("x"), F.col("y"))
    return composed(turned, affine(1, 0, 0, 1, -base["x"], -base["y"]))


def expand_blocks(inserts: DataFrame, blocks: DataFrame, leaves: DataFrame, group: Sequence[str] = (), max_depth: int = MAX_DEPTH) -> DataFrame:
    """(group, instance_id, block, leaf, points, approximate): every leaf of every placed block in world coordinates.

    inserts: owner (null in the drawing itself, else the block whose child it is), insert_id, block, x, y, sx, sy, rotation,
    cols, rows, dx, dy (an array's spacing, along its insert's rotation; one cell without). blocks: block, base (x, y).
    leaves: block, leaf, points. An instance's id is its insert's with column and row, and those of the inserts inside it
    after a colon. A block inside itself isn't followed, nor nesting deeper than ``max_depth``; unknown blocks place nothing.
    """
    cell = F.struct("i", "j")
    listed = inserts.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.col("cols"), F.lit(1)) - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.greatest(F.col("rows"), F.lit(1)) - 1)))
    c, s = F.cos(F.radians("rotation")), F.sin(F.radians("rotation"))
    sx, sy = F.col("i") * F.col("dx"), F.col("j") * F.col("dy")
    offset = affine(1, 0, 0, 1, c * sx - s * sy, s * sx + c * sy)
    known = listed.join(blocks.select(*group, "block", "base"), [*group, "block"])
    known = known.select(*group, "owner", "block", F.concat_ws("#", F.col("insert_id").cast("string"), F.concat_ws(".", F.col("i").cast("string"), F.col("j").cast("string"))).alias("own"), composed(offset, _placement(F.col("base"))).alias("m"))
    del cell
    with Scratch(inserts.sparkSession) as t:
        known = t.table(known, "inserts")
        level = known.where("owner is null").select(*group, F.col("own").alias("instance_id"), "block", "m", F.array("block").alias("path"))
        placed = level = t.table(level, "level")
        children = known.where("owner is not null").select(*group, F.col("owner").alias("__in"), "own", F.col("block").alias("__block"), F.col("m").alias("__m"))
        for _ in range(max_depth):
            same = [level[g] == children[g] for g in group]
            met = level.join(children, [*same, F.col("block") == F.col("__in")]).where(~F.array_contains("path", F.col("__block")))
            level = t.table(met.select(*[level[g] for g in group], F.concat_ws(":", "instance_id", "own").alias("instance_id"), F.col("__block").alias("block"), composed(F.col("m"), F.col("__m")).alias("m"), F.array_append("path", F.col("__block")).alias("path")), "level")
            if level.isEmpty():
                break
            placed = placed.union(level)
        out = placed.join(leaves.select(*group, "block", "leaf", "points"), [*group, "block"])
        return t.table(out.select(*group, "instance_id", "block", "leaf", applied(F.col("m"), F.col("points")).alias("points"), (~conformal(F.col("m"))).alias("approximate")), "placed", keep=True)


def document_rows(documents: DataFrame, key: str, body: str, collections: dict[str, str]) -> dict[str, DataFrame]:
    """The rows of each collection of JSON documents, and their manifest: (key, sequence_index, item as JSON text).

    ``collections`` maps a name to its JSON array's field. A document without the field, or that isn't JSON, has no rows of it;
    ``manifest`` has the number of rows of each collection of each document, zero included.
    """
    read = {n: F.coalesce(F.from_json(F.get_json_object(body, f"$.{field}"), "array<string>"), F.array().cast("array<string>")) for n, field in collections.items()}
    out = {n: documents.select(key, F.posexplode(a).alias("sequence_index", "item")) for n, a in read.items()}
    counts = F.array(*[F.struct(F.lit(n).alias("collection"), F.size(a).cast("long").alias("n")) for n, a in read.items()])
    out["manifest"] = documents.select(key, F.inline(counts))
    return out


def parent_links(rows: DataFrame, parents: DataFrame, reference: str, identity: str, attributes: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Rows with the attributes of the row of their group that their reference names; nulls where there is none."""
    p = parents.select(*group, F.col(identity).alias(reference), *attributes)
    return rows.join(p, [*group, reference], "left")
