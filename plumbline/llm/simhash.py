"""SimHash near-duplicates: fingerprints, block joins at two differing bits, connected components.

``fingerprints`` lower-cases A-Z, takes words of non-white-space characters and hashes every
shingle of ``shingle`` words (repeats included) with XXH64, seed 42; a bit is set when more than
half of the hashes set it. A text with fewer words is one shingle; a null text, or one without
words, has fingerprint zero.

``near_groups`` links fingerprints that differ in at most ``max_bits`` bits. Only distinct
fingerprints are compared: copies weigh nothing. A fingerprint is split into ``blocks`` blocks;
two that differ in k bits agree in at least ``blocks - k`` whole blocks, so each choice of that
many blocks is a join key, and every pair that meets on a key is verified by its Hamming distance.
Buckets with more than ``bucket_pairs`` members are not paired up: each member joins the fixed
bits of the bucket with each one-bit variant of the remaining bits. Two members within two bits
always share such a variant, and sharing one proves two bits or fewer, so the links to the
smallest fingerprint of each variant give the same components with work linear in the bucket.
That holds for ``max_bits`` 2 only, so other distances are refused.

Nulls: a null doc_id is an ordinary id, larger than none (it never becomes a component id unless
its whole component has null ids). Repeated rows each return a row. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from plumbline.llm.common import Scratch, map_column, written
from plumbline.operators.graph import min_label_components

#: Shingle hashes whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return majority(np.array([xxh64_intdigest(joined[a:b], 42) for a, b in spans], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of some 64-bit hashes set."""
    hashes = np.ascontiguousarray(hashes, "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., fp): fp is the fingerprint as a signed 64-bit integer."""

    def make():
        def work(texts: list) -> list:
            out = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
            return [out.view(np.int64)]

        return work

    return map_column(docs, text_col, make, [T.StructField("fp", T.LongType())], [id_col, *keep])


def block_masks(blocks: int, shared: int) -> list[int]:
    """The bits of each choice of so many shared blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    wide = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(wide[i] for i in pick) for pick in combinations(range(blocks), shared)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def close_links(
    s: Scratch, distinct: DataFrame, n: int, max_bits: int = 2, blocks: int = 4, bucket_pairs: int = 256
) -> DataFrame:
    """Links (u, v) between n distinct fingerprints (column ``fp``) that connect all pairs within max_bits.

    Every returned link is within ``max_bits``; every pair within ``max_bits`` is linked, directly or,
    in buckets of more than ``bucket_pairs``, through the smallest member of a shared variant.
    """
    if max_bits != 2:
        raise ValueError("the exact way for crowded buckets holds for two bits only")
    if not 3 <= blocks <= 16:
        raise ValueError("blocks must be 3 to 16")
    masks = block_masks(blocks, blocks - max_bits)
    keys = F.array(*[F.struct(F.lit(i).alias("b"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])
    members = distinct.select("fp", F.explode(keys).alias("x")).select("fp", "x.b", "x.k")
    sizes = members.groupBy("b", "k").agg(F.count("*").alias("n")).where("n > 1")
    sizes = s.table(sizes, "sizes", rows=n * len(masks))
    crowded = sizes.where(F.col("n") > bucket_pairs).select("b", "k")
    cold = s.table(members.join(sizes.where(F.col("n") <= bucket_pairs).select("b", "k"), ["b", "k"], "left_semi"), "shared", rows=n * len(masks))
    left, right = cold.withColumnRenamed("fp", "u"), cold.withColumnRenamed("fp", "v")
    links = left.join(right, ["b", "k"]).where("u > v").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits).select("u", "v")
    if crowded.isEmpty():
        return links.distinct()
    free = [F.array(*[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks]
    flips = F.element_at(F.array(*free), F.col("b") + 1)
    variant = F.explode(F.concat(F.array(F.lit(0).cast("long")), flips)).alias("flip")
    hot = members.join(crowded, ["b", "k"], "left_semi").select("fp", "b", variant)
    hot = hot.select("fp", "b", F.col("fp").bitwiseXOR(F.col("flip")).alias("k"))
    lowest = s.table(hot.groupBy("b", "k").agg(F.min("fp").alias("v")), "lowest")
    more = hot.join(lowest, ["b", "k"]).where("fp <> v").select(F.col("fp").alias("u"), "v")
    return links.union(more).distinct()


def _groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, blocks: int, bucket_pairs: int) -> DataFrame:
    """(id, node, fp, component_id) of each document; node is a hash of the text."""
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("node"), F.col(f"`{text_col}`").alias("text"))
    with Scratch(docs.sparkSession) as s:
        marked = s.table(fingerprints(named, "id", "text", shingle, ("node",)), "fingerprints", keep=True)
        distinct = s.table(marked.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
        n = distinct.count()
        parts = min_label_components(close_links(s, distinct.select("fp"), n, max_bits, blocks, bucket_pairs))
        rooted = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "low", F.coalesce("component", "fp").alias("component"), F.col("component").isNotNull().alias("linked")
        )
        rooted = s.table(rooted, "rooted", keep=True, rows=n)
        lows = s.table(rooted.where("linked").groupBy("component").agg(F.min("low").alias("lowest")), "lows", keep=True, rows=n)
    classes = rooted.join(lows, "component", "left").select("fp", F.coalesce("lowest", "low").alias("component_id"))
    return marked.join(classes, "fp")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_bits: int = 2,
    blocks: int = 4,
    bucket_pairs: int = 256,
) -> DataFrame:
    """One row per document: (id, fingerprint as 16 hex digits, component_id = smallest id reachable)."""
    return _groups(docs, id_col, text_col, shingle, max_bits, blocks, bucket_pairs).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_bits: int = 2,
    blocks: int = 4,
    bucket_pairs: int = 256,
) -> DataFrame:
    """``docs`` without the rows whose group has a smaller id; all columns stay.

    A row is judged by its own text's group, also where another row has its id. Rows with a null id stay only
    where their group has no other id.
    """
    found = _groups(docs, id_col, text_col, shingle, max_bits, blocks, bucket_pairs)
    later = found.where(~F.col("id").eqNullSafe(F.col("component_id")))
    gone, _ = written(later.select(F.col("id").alias("__id"), F.col("node").alias("__gone")).distinct(), "gone")
    marked = docs.withColumn("__node", F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    alike = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__node") == F.col("__gone"))
    return marked.join(gone, alike, "left_anti").drop("__node")
