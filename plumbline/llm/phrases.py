"""Collocations of each language: phrases of two and three words, counted by Toivonen's sampling.

A part of the documents, chosen by a hash, proposes the words and pairs that are frequent there under a lowered threshold.
One pass over all texts then counts the proposals by their words, and by 64-bit hashes their negative border: the phrases
that aren't proposed, but all of whose shorter phrases are (of single words, all others; of triples, all whose pairs are proposed). A hash of the border that
reaches the threshold is a failure of the sample: a further pass counts its phrases by their words, and with them all
that have become possible above what was found since. Passes follow until nothing new is frequent. Every count that is
returned was made by words over all texts, so the result is exact, whatever the sample was and whatever hashes clash.

Which phrases are known is held in bit sets of a fixed size (``BITS``), by hash; two phrases that share a bit can only
let further phrases be counted. The driver and each worker hold these sets and nothing else of the corpus.

``score`` of a phrase with count a is floor(1000000 * a * a / (l * r)) at the cut into a first part (l occurrences)
and a rest (r) that scores lowest, the first such cut among equals; decimals of 38 digits hold it exactly up to
counts of 10^15.

A-Z are lower-cased; texts are split at ``[.,;:!?\\n\\v\\f\\r]`` into pieces and those at spaces and tabs into words; a
phrase lies within a piece. A null text is empty, a null language ``und``. Texts without words give no phrase;
repeated rows count as often as they occur; equal scores are ordered by count and then by the phrase's bytes. An empty
table gives an empty result. Extra columns are ignored. Texts of any length are read whole, in parts that overlap by
two words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, pieces, ready_workers

#: Bits of a set of words, pairs or triples: 8 MB each.
BITS = 1 << 26
#: Bytes of texts that a worker counts at once before it hands its counts on.
BLOCK = 1 << 20
#: Bytes of a text that are taken up at once.
PART = 1 << 20
#: A-Z as a-z, tabs as spaces, and each mark that ends a piece as a line feed.
_PLAIN = bytes(0x20 if b == 9 else 0x0A if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_EDGE = re.compile(rb"[ \n]")
UNKNOWN = "und"
#: First salts of the top rows of a language.
SALTS = 64


class Known(NamedTuple):
    """Bit sets of the words and pairs that are proposed, and of all phrases that were found."""

    words: np.ndarray
    pairs: np.ndarray
    triples: np.ndarray


def packed(known: Known | None) -> list[bytes] | None:
    """The sets as they are sent to workers: mostly zeros, they take little."""
    return None if known is None else [zlib.compress(bits.tobytes(), 1) for bits in known]


def unpacked(sent: list[bytes] | None) -> Known | None:
    return None if sent is None else Known(*[np.frombuffer(zlib.decompress(bits), np.uint64) for bits in sent])


def _in(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    place = key >> np.uint64(2) & np.uint64(BITS - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def parts(raw: bytes) -> Iterator[tuple[bytes, int]]:
    """(part, how many of its tokens the part before had) of a text: words and ends of pieces (line feeds) with spaces between them."""
    plain, start, carried = raw.translate(_PLAIN), 0, []
    while start < len(plain):
        cut = _EDGE.search(plain, start + PART) if len(plain) - start > PART else None
        end = cut.start() if cut else len(plain)
        said = b" ".join([*carried, plain[start:end].replace(b"\n", b" \n ")])
        yield said, len(carried)
        if cut:
            carried = [t for t in said.split(b" ") if t][-2:]
        start = end


class Block(NamedTuple):
    """The tokens of some texts: their numbers, the spelling of each number, their languages, and which ones no earlier block had."""

    code: np.ndarray
    texts: pa.Array
    langs: np.ndarray
    new: np.ndarray


def block_of(said: list[bytes], langs: list[int], old: list[int]) -> Block:
    """The block of parts of texts; each ends a piece."""
    lists = pc.split_pattern(pa.array([x + b" \n" for x in said], pa.string()), " ")
    coded = lists.values.dictionary_encode()
    code, owner = coded.indices.to_numpy(), np.repeat(np.arange(len(said)), np.diff(lists.offsets.to_numpy()))
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:
        code, owner = code[code != empty], owner[code != empty]
    at = np.arange(len(code)) - np.searchsorted(owner, owner)
    return Block(code.astype(np.int64), coded.dictionary, np.array(langs, np.int64)[owner], at >= np.array(old, np.int64)[owner])


def count_block(block: Block, names: list[str], now: Known | None, before: Known | None, second: bool):
    """(key, lang, phrase, n) arrays of a block's phrases, languages by their ``names``.

    Without ``now``, in the sample, all words and pairs are counted by key. With it, the phrases it has by their words, and where
    there is no ``before``, those of its border by key; later the phrases that have become possible since ``before``, by their words,
    and in the second pass those of the border that have become known. A key is the phrase's hash with its number of words in
    the last two bits. The total of a language's words is counted under the empty phrase in the first pass over all texts.
    """
    new = block.new
    items, item = np.unique(block.langs * len(block.texts) + block.code, return_inverse=True)
    item_lang, item_code = items // len(block.texts), items % len(block.texts)
    is_word = item_code != pc.index(block.texts, "\n").as_py()
    texts = block.texts.cast(pa.binary()).to_pylist()
    seeds = [xxhash.xxh64_intdigest(n.encode(), 42) for n in names]
    hashed = np.fromiter((xxhash.xxh64_intdigest(texts[c], seeds[k]) for c, k in zip(item_code.tolist(), item_lang.tolist())), np.uint64, len(items))
    spelled, called, m = block.texts, pa.array(names, pa.string()), np.int64(len(items))
    out = []

    def emit(keys, lang, phrase, n) -> None:
        out.append((keys if keys is not None else pa.nulls(len(n), pa.int64()), lang if lang is not None else pa.nulls(len(n), pa.string()), phrase if phrase is not None else pa.nulls(len(n), pa.string()), pa.array(n.astype(np.int64))))

    if now is not None and before is None:
        total = np.bincount(item_lang, weights=np.bincount(item[new], minlength=len(items)) * is_word, minlength=len(names)).astype(np.int64)
        some = np.flatnonzero(total)
        emit(None, called.take(pa.array(some)), pa.array([""] * len(some), pa.string()), total[some])
    inside, key = is_word[item], hashed[item]
    possible = was_possible = inside  # all shorter phrases are known, now and before
    for k in (1, 2, 3):
        if len(item) < k or (now is None and k == 3):
            break
        if k > 1:
            inside = inside[:-1] & is_word[item[k - 1 :]]
            key = key[:-1] ^ _turn(hashed, 21 * (k - 1))[item[k - 1 :]]
        label = key & ~np.uint64(3) | np.uint64(k)
        fresh = new[k - 1 :] & inside
        if now is None:
            found, n = np.unique(label[fresh], return_counts=True)
            emit(pa.array(found.view(np.int64)), None, None, n)
            continue
        has = _in(now[k - 1], label)
        had = _in(before[k - 1], label) if before is not None else np.zeros(len(has), bool)
        if k > 1:
            possible = possible[:-1] & possible[1:]
            was_possible = was_possible[:-1] & was_possible[1:]
        if before is None:
            border = fresh & possible & ~has
            found, n = np.unique(label[border], return_counts=True)
            emit(pa.array(found.view(np.int64)), None, None, n)
            named = fresh & possible & has
        else:
            named = fresh & possible & (~was_possible | (has & ~had if second else False))
        places = np.flatnonzero(named)
        joined = item[places]
        for step in range(1, k):  # numbers of the phrase so far, so that they fit 64 bits with the next word
            joined = np.unique(joined, return_inverse=True)[1] * m + item[places + step]
        _, first, n = np.unique(joined, return_index=True, return_counts=True)
        at = places[first]
        said = [spelled.take(pa.array(item_code[item[at + step]])) for step in range(k)]
        phrase = pc.binary_join_element_wise(*said, " ") if k > 1 else said[0]
        emit(None, called.take(pa.array(item_lang[item[at]])), phrase, n)
        possible, was_possible = possible & has, was_possible & had
    return out


def counted(docs: DataFrame, now: Known | None, before: Known | None, second: bool = False) -> DataFrame:
    """(key, lang, phrase, n) over all rows of docs (columns lang, t), see ``count_block``; n is the sum over all texts."""
    spark = docs.sparkSession
    ready_workers(spark)
    shared = spark.sparkContext.broadcast((packed(now), packed(before), second))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before, second = shared.value
        now, before = unpacked(now), unpacked(before)
        said, langs, old, names, held = [], [], [], {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for found in count_block(block_of(said, langs, old), list(names), now, before, second):
                yield pa.RecordBatch.from_arrays(list(found), names=["key", "lang", "phrase", "n"])
            said.clear(), langs.clear(), old.clear(), names.clear()

        for batch in pieces(batches, 1):
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for part, carried in parts(raw):
                    said.append(part), langs.append(names.setdefault(lang, len(names))), old.append(carried)
                    held += len(part)
                    if held >= BLOCK:
                        yield from flush()
                        held = 0
        if said:
            yield from flush()

    rows = docs.select("lang", "t").mapInArrow(count, "key long, lang string, phrase string, n long")
    return rows.groupBy("key", "lang", "phrase").agg(F.sum("n").alias("n"))


def _bits(keys: DataFrame) -> np.ndarray:
    """The keys as a bit set; the driver gets one number for 64 bits at most."""
    at = keys.select(F.shiftrightunsigned("key", 2).bitwiseAND(F.lit(BITS - 1)).alias("p")).select(F.shiftright("p", 6).alias("s"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("m"))
    found = at.groupBy("s").agg(F.bit_or("m").alias("m")).toArrow()
    bits = np.zeros(BITS >> 6, np.uint64)
    bits[found["s"].to_numpy()] = found["m"].to_numpy().view(np.uint64)
    return bits


def phrase_key(lang: str, phrase: str) -> Column:
    """The key of a phrase of up to three words, as the workers make it."""
    words = F.split(phrase, " ")
    turned = lambda x, by: F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))
    hashed = lambda i: F.xxhash64(F.col(lang), F.get(words, F.lit(i)))
    key = hashed(0)
    for i in (1, 2):
        key = F.when(F.size(words) > i, key.bitwiseXOR(turned(hashed(i), 21 * i))).otherwise(key)
    return key.bitwiseAND(F.lit(-4)).bitwiseOR(F.size(words).cast("long"))


def known(rows: DataFrame, more: Known | None = None) -> Known:
    """Bit sets of the phrases among rows (key, or where it is null lang and phrase), with those of ``more``."""
    keys = rows.where("key is not null or phrase <> ''").select(F.coalesce("key", phrase_key("lang", "phrase")).alias("key"))
    made = [_bits(keys.where(F.col("key").bitwiseAND(F.lit(3)) == k)) for k in (1, 2, 3)]
    return Known(*made) if more is None else Known(*[x | y for x, y in zip(made, more, strict=True)])


def frequent(docs: DataFrame, min_count: int, share: float, lowered: float, scratch: Scratch) -> DataFrame:
    """(lang, phrase, n): every phrase of one to three words with at least min_count occurrences, and each language's words under ``''``."""
    place = F.pmod(F.xxhash64("id", "lang", "t"), F.lit(1 << 30)) / float(1 << 30)
    least = max(1, ceil(min_count * share * lowered))
    now, before = known(scratch.table(counted(docs.where(place < share), None, None).where(F.col("n") >= least), "proposed")), None
    passes = []
    while True:
        found = scratch.table(counted(docs, now, before, len(passes) == 1).where((F.col("n") >= min_count) | (F.col("phrase") == "")), "counted")
        passes.append(found.where("phrase is not null").select("lang", "phrase", "n"))
        more = known(found, now)
        # No phrase stands above a triple; only those of the first pass's border are still to be counted by their words.
        if all((x == y).all() for x, y in list(zip(more, now, strict=True))[: 3 if before is None else 2]):
            break
        now, before = more, now
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    return out


def cut_score(a: str | Column, left: str | Column, right: str | Column) -> Column:
    """floor(1000000 * a * a / (left * right)) of whole numbers up to 10^15."""
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide(a) * wide(a), wide(left) * wide(right))


def mine(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    id_col: str = "doc_id",
    min_count: int = 10,
    inside: int = 50,
    top: int = 2000,
    share: float = 0.2,
    lowered: float = 0.8,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``top`` phrases.

    A pair that lies inside a triple with at least ``inside`` percent of its occurrences is left out.
    """
    rows = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"),
        F.col(f"`{id_col}`").alias("id"),
    )
    with Scratch(rows.sparkSession) as scratch:
        found = scratch.table(frequent(rows, min_count, share, lowered, scratch), "frequent", keep=True)
    split = found.where("phrase <> ''").withColumn("w", F.split("phrase", " "))
    part = lambda *i: F.concat_ws(" ", *[F.col("w")[x] for x in i])
    single = found.where("phrase <> '' and instr(phrase, ' ') = 0")
    pairs, triples = split.where("size(w) = 2"), split.where("size(w) = 3")
    words = lambda name, n: single.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    twos = lambda name, n: pairs.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))

    cover = triples.select("lang", F.explode(F.array(part(0, 1), part(1, 2))).alias("phrase"), F.col("n").alias("m"))
    cover = cover.groupBy("lang", "phrase").agg(F.max("m").alias("m"))
    open_pairs = pairs.join(cover, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("m") < inside * F.col("n"), F.lit(True)))
    cut2 = open_pairs.select("lang", "phrase", F.col("n").alias("a"), part(0).alias("w0"), part(1).alias("w1"))
    cut2 = cut2.join(words("w0", "l"), ["lang", "w0"]).join(words("w1", "r"), ["lang", "w1"])
    cut2 = cut2.select("lang", "phrase", "a", F.array(F.struct("l", "r")).alias("cuts"))
    cut3 = triples.select("lang", "phrase", F.col("n").alias("a"), part(0).alias("w0"), part(1, 2).alias("p1"), part(0, 1).alias("p0"), part(2).alias("w2"))
    cut3 = cut3.join(words("w0", "l1"), ["lang", "w0"]).join(twos("p1", "r1"), ["lang", "p1"])
    cut3 = cut3.join(twos("p0", "l2"), ["lang", "p0"]).join(words("w2", "r2"), ["lang", "w2"])
    both = F.array(F.struct(F.col("l1").alias("l"), F.col("r1").alias("r")), F.struct(F.col("l2").alias("l"), F.col("r2").alias("r")))
    cut3 = cut3.select("lang", "phrase", "a", both.alias("cuts"))

    lowest = F.array_min(F.transform("cuts", lambda x, k: F.struct(cut_score("a", x["l"], x["r"]).alias("score"), k.alias("k"), x["l"].alias("l"), x["r"].alias("r"))))
    scored = cut2.unionByName(cut3).withColumn("best", lowest)
    scored = scored.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = scored.withColumn("__i", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("__i") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = found.where("phrase = ''").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
