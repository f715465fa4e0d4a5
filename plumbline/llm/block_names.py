"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A text, with every run of ASCII white space replaced by one space, is cut into blocks of
``block_chars`` characters. Distinct blocks, combined before their one shuffle, are dealt by hash and
sorted by (hash, block) in each partition; a block's integer name is its partition and place there,
written once so that all later steps read the same names. Rows fetch their names by the block's 64-bit
hash, so texts don't cross the network again for naming. Should distinct blocks share a hash, the blocks of
those hashes are sorted once more and told apart by their rank, so names never collide. Then adjacent
names are paired and the pairs sorted into names the same way, level by level, until one name stands
for the whole document.

Null text counts as empty, and empty texts form one group. A group is known by (number of blocks,
name). Between levels a row is known by its id and its text's 64-bit hash: where ids are unique this never
decides anything, and only texts that share a null or repeated id rest on that hash. Repeated rows each
count in ``group_size``; of rows with the same id and text one is kept. A null id is larger than none: it
stays only if its whole group has null ids. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, written

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


#: Characters of a block.
BLOCK_CHARS = 4096


def _named(s: Scratch, rows: DataFrame, key: list[str], keep: list[str], hash_bits: int, tag: str, n: int | None = None) -> DataFrame:
    """rows' ``keep`` columns with the name (h, r) of ``key``; equal keys, and only they, get equal names. n bounds the rows.

    h is an integer name by sort order, one for each hash; r is 0 but where a hash has several keys.
    """
    rows = rows.withColumn("__hash", F.shiftrightunsigned(F.xxhash64(*key), 64 - hash_bits))
    ordered = rows.select("__hash", *key).distinct().sortWithinPartitions("__hash", *key)
    placed = ordered.select("__hash", F.monotonically_increasing_id().alias("h"))
    names = s.table(placed.groupBy("__hash").agg(F.min("h").alias("h"), F.count("*").alias("n")), f"{tag}-names", rows=n)
    named = rows.join(names.select("__hash", "h"), "__hash")
    clashing = names.where("n > 1").select("__hash")
    if clashing.isEmpty():
        return named.select(*keep, "h", F.lit(0).cast("long").alias("r"))
    among = rows.join(clashing, "__hash", "left_semi").select("__hash", *key).distinct()
    rank = F.row_number().over(Window.partitionBy("__hash").orderBy(*key)).cast("long")
    ranks = s.table(among.withColumn("r", rank), f"{tag}-ranks")
    same = F.expr(" and ".join(f"a.{k} <=> b.{k}" for k in ["__hash", *key]))
    met = named.alias("a").join(ranks.alias("b"), same, "left")
    return met.select(*[f"a.{c}" for c in keep], "a.h", F.coalesce("b.r", F.lit(0)).alias("r"))


def _identities(s: Scratch, docs: DataFrame, id_col: str, text_col: str, block_chars: int, hash_bits: int) -> DataFrame:
    text = docs.select(F.col(f"`{id_col}`").alias("id"), normalised(F.col(f"`{text_col}`")).alias("t"))
    cut = F.when(F.length("t") <= block_chars, F.array("t")).otherwise(F.regexp_extract_all("t", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
    text = text.select("id", F.xxhash64("t").alias("nonce"), F.sha2("t", 256).alias("sha"), cut.alias("blocks"))
    n_blocks = F.size("blocks").cast("long").alias("n_blocks")
    blocks = text.select("id", "nonce", "sha", n_blocks, F.posexplode("blocks").alias("pos", "block")).select(
        "id", "nonce", F.when(F.col("pos") == 0, F.col("sha")).alias("text_sha256"), "n_blocks", "pos", "block"
    )
    keep = ["id", "nonce", "n_blocks", "pos"]
    first = s.table(_named(s, blocks, ["block"], [*keep, "text_sha256"], hash_bits, "blocks"), "names")
    base = first.where("pos = 0").select("id", "nonce", "text_sha256", "n_blocks", "h", "r")
    span, n_long, total = base.agg(F.max("n_blocks"), F.count_if(F.col("n_blocks") > 1), F.sum(F.when(F.col("n_blocks") > 1, F.col("n_blocks")))).first()
    if (span or 1) == 1:
        return base
    rows, done, width = first.where("n_blocks > 1").select(*keep, "h", "r"), [], 1
    left, right = F.col("pos") % 2 == 0, F.col("pos") % 2 == 1
    while span > 1:
        width, span = width * 2, (span + 1) // 2
        n = total // width + n_long
        pairs = s.table(
            rows.groupBy("id", "nonce", "n_blocks", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
                *[F.max(F.when(side, F.col(c))).alias(side_name + c) for side_name, side in (("left_", left), ("right_", right)) for c in "hr"]
            ),
            "pairs", rows=n,
        )
        named = s.table(_named(s, pairs, ["left_h", "left_r", "right_h", "right_r"], keep, hash_bits, "pairs", n), "names", rows=n)
        done.append(named.where(F.col("n_blocks") <= width).drop("pos"))
        rows = named.where(F.col("n_blocks") > width)
    whole = reduce(DataFrame.union, done)
    long = base.where("n_blocks > 1").alias("b").join(whole.alias("w"), F.expr("b.id <=> w.id and b.nonce = w.nonce"))
    return base.where("n_blocks = 1").union(long.select("b.id", "b.nonce", "b.text_sha256", "b.n_blocks", "w.h", "w.r"))


def identities(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, hash_bits: int = 64
) -> DataFrame:
    """(id, nonce, text_sha256, n_blocks, h, r), a row for each of docs; (n_blocks, h, r) is the text's identity.

    ``nonce`` is the text's hash; it tells apart texts that come under one id. ``hash_bits`` below 64
    makes hashes clash, for tests of the exact way.
    """
    with Scratch(docs.sparkSession) as s:
        return s.table(_identities(s, docs, id_col, text_col, block_chars, hash_bits), "identities", keep=True)


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, hash_bits: int = 64
) -> DataFrame:
    """One row per row of docs: (id, keep_id = smallest id of the group, group_size, kept, text_sha256)."""
    known = identities(docs, id_col, text_col, block_chars, hash_bits)
    name = ["n_blocks", "h", "r"]
    # Written, so that the join with a large group's rows is an exchange on both sides, which Spark can split.
    groups, _ = written(
        known.groupBy(*name).agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "groups"
    )
    copy = F.row_number().over(Window.partitionBy("id", "nonce").orderBy("id"))
    met = known.withColumn("copy", copy).join(groups, name, "left")
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(size > 1, F.col("keep_id")).otherwise(F.col("id"))
    return met.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        size.alias("group_size"),
        (F.col("id").eqNullSafe(keep) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text an earlier id has; all columns stay.

    Rows that repeat an id with an equal text count as one document: one of them stays.
    """
    found = exact_groups(docs, id_col, text_col, **options).groupBy(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha")).agg(
        F.max("kept").alias("__any"), F.count("*").alias("__copies")
    )
    gone, _ = written(found.where("not __any or __copies > 1"), "gone")
    if gone.isEmpty():
        return docs
    marked = docs.withColumn("__own", F.sha2(normalised(F.col(f"`{text_col}`")), 256))
    alike = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha"))
    # Always by shuffle: what is dropped grows with the rows, and the plan should be one at every size.
    kept = marked.join(gone.hint("merge"), alike, "left_anti")
    again = gone.where("__any")
    if not again.isEmpty():
        kept = kept.union(marked.join(again.hint("merge"), alike, "left_semi").dropDuplicates([id_col, "__own"]))
    return kept.drop("__own")
