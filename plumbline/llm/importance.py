"""Documents drawn towards a target distribution by importance resampling over hashed word n-grams.

``count_buckets`` counts the features of all texts of a table by bucket, ``gains`` turns the counts of source and
target into one integer for each bucket, ``weigh`` gives each document the floored mean of its features' gains, and
``resample`` adds Gumbel noise made from the id and draws the highest scores.

A batch's texts are joined with a sentinel byte that belongs to no word, one regular expression finds the words of
the whole batch, and ``searchsorted`` on the texts' offsets says which text a word is of; n-grams whose first and last
word are of different texts are masked before they are counted. Words are taken up in blocks that carry the last words
of the block before, so that a text of any length is read whole in bounded memory.

Words are runs of digits, letters and all characters beyond ASCII, A-Z lower-cased; features are all runs of 1 to
``n_max`` words. A null text, or one without a word, has no features and weight 0. Repeated rows each return a row and
count as often as they occur. A null id makes its noise from the empty text and comes after all others among equal
scores; equal rows of one id get their ranks in any order. An empty table draws nothing, an empty target makes the
gains those of no counts at all. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import Scratch, map_column, pieces, ready_workers

SENTINEL = b"\x00"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words that are taken up at once.
BLOCK = 1 << 16


def features(texts: list[bytes], buckets: int, n_max: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words of the n-gram, index of its text, its bucket) in blocks, over all texts."""
    joined = SENTINEL.join(texts).lower()
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    found, words, owner = _WORD.finditer(joined), [], np.zeros(0, np.int64)
    while block := list(islice(found, BLOCK)):
        old = len(words)
        words += [m[0] for m in block]
        at = np.fromiter((m.start() for m in block), np.int64, len(block))
        owner = np.concatenate([owner, np.searchsorted(offsets, at, "right") - 1])
        codes = list(map(crc32, words))
        follow = [b" " + w for w in words]
        for n in range(1, n_max + 1):
            if n > 1:  # the code of n words goes on from that of the first n - 1
                codes = list(map(crc32, follow[n - 1 :], codes))
            if not codes:
                break
            first, last = owner[: len(codes)], owner[n - 1 :]
            here = first == last
            here[: max(0, old - n + 1)] = False  # the block before has had them
            yield n, first[here], np.array(codes, np.int64)[here] % buckets
        keep = n_max - 1
        words, owner = (words[-keep:], owner[-keep:]) if keep else ([], owner[:0])


def count_buckets(docs: DataFrame, text_col: str = "text", buckets: int = 10_000, n_max: int = 2) -> np.ndarray:
    """Features in each bucket over all texts; the driver gets one number for each bucket."""
    ready_workers(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in pieces(batches, 0):
            texts = [t for t in batch.column(0).cast(pa.binary()).to_pylist() if t]
            for _, _, found in features(texts, buckets, n_max) if texts else ():
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["b", "n"])

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(buckets, np.int64)
    total[rows["b"].to_numpy()] = rows["n"].to_numpy()
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to source in each bucket, both with one more feature a bucket, floored."""
    more, source_all, target_all = len(source), int(source.sum()), int(target.sum())
    ratio = [((t + 1.0) * (source_all + more)) / ((s + 1.0) * (target_all + more)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n_max: int = 2) -> DataFrame:
    """(id, n_words, n_features, weight) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    fields = [T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")]

    def make():
        gain = shared.value

        def work(texts: list) -> list:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            words, count, total = np.zeros((3, len(raw)), np.int64)
            for n, owner, found in features(raw, len(gain), n_max):
                here = np.bincount(owner, minlength=len(raw))
                count += here
                words += here if n == 1 else 0
                total += np.bincount(owner, weights=gain[found], minlength=len(raw)).astype(np.int64)
            return [words, count, np.where(count > 0, total // np.maximum(count, 1), 0)]

        return work

    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    return map_column(rows, "__text", make, fields, ["__id"]).withColumnRenamed("__id", id_col)


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 25,
    min_words: int = 20,
    seed: int = 7,
    buckets: int = 10_000,
    n_max: int = 2,
) -> DataFrame:
    """Every row's (id, n_features, weight, score, rank): ranks 1, 2, ... of the drawn rows, null for the others.

    Ranks come from the counts of rows by score, without a sort of all rows in one place: scores are whole
    thousandths of logarithms, so there are some ten thousand different ones at any size, and of the rows
    with one score only those that may be drawn are numbered.
    """
    spark = docs.sparkSession
    gain = gains(count_buckets(docs, text_col, buckets, n_max), count_buckets(target, text_col, buckets, n_max))
    found = weigh(docs, gain, id_col, text_col, n_max)
    hexed = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    noise = F.floor(-1000 * F.log(-F.log((F.conv(hexed, 16, 10).cast("double") + 0.5) / 4294967296.0)))
    scored = found.withColumn("score", F.col("weight") + noise).withColumn("__able", F.col("n_words") >= min_words)
    with Scratch(spark) as scratch:
        scored = scratch.table(scored.drop("n_words"), "scored", keep=True)
        counts = scored.where("__able").groupBy("score").agg(F.count("*").alias("n")).toArrow().sort_by([("score", "descending")])
    by_score = counts["n"].to_numpy()
    above = np.cumsum(by_score) - by_score
    drawn = int(by_score.sum()) * percent // 100
    reached = above < drawn
    starts = spark.createDataFrame(
        list(zip(counts["score"].to_numpy()[reached].tolist(), above[reached].tolist())), "score long, __above long"
    )
    lowest = int(counts["score"].to_numpy()[reached].min()) if reached.any() else None
    out = [F.col(f"`{id_col}`"), "n_features", "weight", "score"]
    may = F.col("__able") & (F.col("score") >= lowest) if lowest is not None else F.lit(False)
    in_score = Window.partitionBy("score").orderBy(F.col(f"`{id_col}`").asc_nulls_last())
    place = scored.where(may).join(F.broadcast(starts), "score").withColumn("rank", F.col("__above") + F.row_number().over(in_score))
    ranked = place.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.where(~may).select(*out, F.lit(None).cast("long").alias("rank")))
