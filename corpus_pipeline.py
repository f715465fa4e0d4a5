"""From raw documents to packed training sequences: language ID, quality, exact and near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs`` with the rows they keep. Whatever else the docs hold passes through unchanged, columns named like a
measurement too. Null texts count as empty: the language stage drops them. Repeated rows are one document from
the exact stage on; a null id is larger than none. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import block_names, language_mix, near_copies, packing, quality_bits
from plumbline.llm.common import delete, table, written
from plumbline.llm.queries import END_ID, byte_bpe_files


def _apart(docs: DataFrame) -> tuple[DataFrame, list[str], list]:
    """The docs under names that no measurement has, those names, and the way back."""
    names = [f"__{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names, [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language that makes up over a third of the text; not where an unknown one leads."""
    model = language_mix.with_background(language_mix.fit(docs))
    rows, names, back = _apart(docs)
    found = language_mix.predict(rows, model, text_col=names[docs.columns.index("text")], keep=names)
    return found.where((found["lang_pred"] != language_mix.UNKNOWN) & (found["score"] >= 0.34)).select(*back)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of policy v1."""
    rows, names, back = _apart(docs)
    found = quality_bits.ledger(rows, keep=names, text_col=names[docs.columns.index("text")])
    return quality_bits.apply_policy(found, quality_bits.POLICIES["v1"], into="__kept").where("__kept").select(*back)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each set of equal texts."""
    return block_names.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies: five-word shingles, SimHash blocks and MinHash bands, Jaccard similarity 0.8 and more."""
    return near_copies.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    files = byte_bpe_files()
    return packing.pack(docs, lambda: packing.byte_bpe(*files), END_ID)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", pack),
]

#: SQL can't express the language model, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again before the next, then deleted."""
    docs, old = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), name)
        delete(spark, *old)
        old = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
