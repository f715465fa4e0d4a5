"""Near copies by Jaccard similarity of word shingles: SimHash and banded MinHash for candidates, every candidate pair verified.

Words are runs of characters other than ASCII white space, A-Z lower-cased. Two texts are near copies
when the sets of their ``SHINGLE``-word shingles (a shorter text is one shingle) have a Jaccard
similarity of at least ``similarity``; groups are the connected components of such pairs.

Candidates come from operator 7's SimHash: fingerprints of the shingle sets meet where they agree in two of four
blocks, as all that differ in two bits or fewer do. At similarity 0.8 fingerprints differ in 10 bits on average, and no
choice of blocks that stays selective reaches that far. So candidates are also those that agree in all ``ROWS`` minima
of one of ``BANDS`` bands: a pair at similarity s with probability 1 - (1 - s^4)^16, 0.9998 at 0.8, more above. Every
pair that meets in a bucket of either kind is compared by its whole shingle sets. A bucket over ``TILE`` members is dealt into slots, and each pair of slots is
a tile of its own, so that no task holds a bucket and a set is copied once for each slot, not for each pair;
the comparisons of one bucket still grow with the square of its members.

Null texts and texts without words are one group. Equal texts are one node, so copies weigh
nothing. Shingles and texts are known by 64-bit hashes. A null id is larger than none. Repeated rows each
return a row, extra columns are ignored or, by ``keep_one``, passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from plumbline.llm import simhash
from plumbline.llm.common import Scratch, map_column, ready_workers, written
from plumbline.operators.graph import min_label_components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
#: Members of a bucket that are compared at once.
TILE = 256
#: Shingles whose minima are taken at once, and shingle columns that are multiplied at once.
CHUNK = 1 << 14
#: Word hashes that a task keeps.
CACHE = 1 << 18
_SEEDS = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_XOR, _TIMES = _SEEDS[0][:, None], (_SEEDS[1] | np.uint64(1))[:, None]
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Pairs of 16-bit blocks of a fingerprint.
_BLOCKS = np.array(simhash.block_masks(4, 2), np.uint64)
#: Keys of a text.
KEYS = len(_BLOCKS) + BANDS


def _mixed(x: np.ndarray, y: np.ndarray | np.uint64) -> np.ndarray:
    x = (x ^ y) * _MIX
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def shingles(text: str | None, cache: dict | None = None) -> np.ndarray:
    """The sorted distinct shingle hashes of one text, one at least."""
    cache = {} if cache is None else cache
    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(cache) > CACHE:
        cache.clear()
    for w in words:
        if w not in cache:
            cache[w] = xxh64_intdigest(w, 42)
    hashes = np.fromiter((cache[w] for w in words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    out = np.full(max(1, len(words) - width + 1), width, np.uint64)
    for i in range(width):
        out = _mixed(out, hashes[i : i + len(out)])
    return np.unique(out)


def bands(found: np.ndarray) -> np.ndarray:
    """One key for each band of a shingle set."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), CHUNK):
        low = np.minimum(low, ((found[None, i : i + CHUNK] ^ _XOR) * _TIMES).min(axis=1))
    rows = low.reshape(BANDS, ROWS)
    key = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        key = _mixed(key, rows[:, r])
    return key.view(np.int64)


def blocks(found: np.ndarray) -> np.ndarray:
    """One key for each pair of blocks of a shingle set's SimHash fingerprint."""
    return (np.uint64(simhash.majority(found)) & _BLOCKS).view(np.int64)


def marks(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, node, keys) and (node, text); node is a hash of the text, keys those of its fingerprint and its bands."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("node"), text.alias("text"))

    def make():
        cache: dict = {}
        return lambda texts: [[np.concatenate((blocks(x), bands(x))) for x in (shingles(t, cache) for t in texts)]]

    return map_column(named, "text", make, [T.StructField("keys", T.ArrayType(T.LongType()))], ["id", "node"]), named.select("node", "text")


def linked(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (i, j), i < j, that connect all pairs of sets within the similarity, compared all with all."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = times[column] > 1
    dense = np.cumsum(times > 1) - 1
    row, column = row[shared], dense[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, CHUNK):
        a, b = np.searchsorted(column, (start, start + CHUNK))
        part = np.zeros((n, int(column[b - 1]) - start + 1), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        common += part @ part.T
    near = common >= similarity * (sizes[:, None] + sizes - common) - 1e-9
    links, left = [], set(range(n))
    while left:
        reach = [left.pop()]
        while reach:
            i = reach.pop()
            met = [j for j in np.flatnonzero(near[i]).tolist() if j in left]
            left.difference_update(met)
            links += [(min(i, j), max(i, j)) for j in met]
            reach += met
    return links


def tiles(s: Scratch, nodes: DataFrame, n: int, tile: int = TILE) -> DataFrame:
    """(t, node): which of the n nodes are to be compared with each other; buckets with the same members are one tile."""
    members = nodes.select("node", F.posexplode("keys").alias("b", "k"))
    # Written, so that the join with a large bucket's members is an exchange on both sides, which Spark can split.
    sizes = s.table(members.groupBy("b", "k").agg(F.count("*").alias("n")).where("n > 1"), "buckets", rows=n * KEYS)
    met = s.table(members.join(sizes, ["b", "k"]), "members", rows=n * KEYS)
    small = met.where(F.col("n") <= tile).groupBy("b", "k").agg(F.sort_array(F.collect_list("node")).alias("m")).select("m").distinct()
    small = small.select(F.sha2(F.concat_ws(" ", F.col("m").cast("array<string>")), 256).alias("t"), F.explode("m").alias("node"))
    slots = F.ceil(F.col("n") / F.lit(tile / 2))
    large = met.where(F.col("n") > tile).withColumn("slots", slots).withColumn("i", F.pmod(F.xxhash64("node"), F.col("slots")))
    large = large.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    return small.union(large.select(F.concat_ws(" ", "b", "k", F.least("i", "j"), F.greatest("i", "j")).alias("t"), "node"))


def near_links(s: Scratch, nodes: DataFrame, n: int, texts: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """Verified links (u, v) of nodes; texts has the text of each node (columns node and text)."""
    dealt = s.table(tiles(s, nodes, n, tile), "tiles")
    # Written, so that Spark knows how few they are and, where they are, leaves the other texts where they lie.
    wanted = s.table(dealt.select("node").distinct(), "candidates", rows=n)

    def make():
        cache: dict = {}
        return lambda found: [[shingles(t, cache).tobytes() for t in found]]

    some = map_column(texts.join(wanted, "node", "left_semi"), "text", make, [T.StructField("found", T.BinaryType())], ["node"])
    sets = some.groupBy("node").agg(F.first("found").alias("found"))
    ready_workers(nodes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for _, group in groupby(rows, key=lambda r: r[0]):
            held = {node: found for _, node, found in group}
            names = list(held)
            links = linked([np.frombuffer(x, np.uint64) for x in held.values()], similarity)
            if links:
                columns = [pa.array([names[x[side]] for x in links], pa.int64()) for side in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["u", "v"])

    sorted_tiles = dealt.join(sets, "node").select("t", "node", "found").repartition("t").sortWithinPartitions("t")
    return sorted_tiles.mapInArrow(run, "u long, v long")


#: The place of a document in its group: ids in order, null ids last, texts of one id by their hash.
def _place(id_col: str) -> Column:
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("node").alias("node"))


def _groups(docs: DataFrame, id_col: str, text_col: str, similarity: float, tile: int) -> DataFrame:
    """(id, node, low) of each document: the place of its group's first one."""
    found, texts = marks(docs, id_col, text_col)
    with Scratch(docs.sparkSession) as s:
        marked = s.table(found, "marks", keep=True)
        nodes = s.table(marked.groupBy("node").agg(F.min(_place("id")).alias("low"), F.first("keys").alias("keys")), "nodes")
        n = nodes.count()
        links = near_links(s, nodes.select("node", "keys"), n, texts, similarity, tile)
        parts = min_label_components(links)
        rooted = nodes.join(parts, "node", "left").select("node", "low", F.coalesce("component", "node").alias("component"))
        rooted = s.table(rooted, "rooted", keep=True, rows=n)
        lows = s.table(rooted.groupBy("component").agg(F.min("low").alias("low")), "lows", keep=True, rows=n)
    classes = rooted.select("node", "component").join(lows, "component").select("node", "low")
    return marked.select("id", "node").join(classes, "node")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """One row per document: (id, component_id = smallest id of its group)."""
    return _groups(docs, id_col, text_col, similarity, tile).select(F.col("id").alias(id_col), F.col("low.id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """``docs`` with the first document of each group only; all columns stay.

    The first is that of the smallest id (nulls last) and, of texts under one id, of the smallest hash. Only rows
    with that id and text stay: another text under a dropped id is judged by its own group. Repeated rows of the
    first document all stay.
    """
    found = _groups(docs, id_col, text_col, similarity, tile)
    later = found.where(~F.col("id").eqNullSafe(F.col("low.id")) | (F.col("node") != F.col("low.node")))
    gone, _ = written(later.select(F.col("id").alias("__id"), F.col("node").alias("__gone")).distinct(), "gone")
    marked = docs.withColumn("__node", F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    alike = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__node") == F.col("__gone"))
    return marked.join(gone, alike, "left_anti").drop("__node")
