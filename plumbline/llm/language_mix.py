"""Language proportions of documents by expectation-maximisation over word n-gram likelihoods.

``fit`` counts hashed character trigrams of labelled texts for each language; ``predict`` scores each
word of a text under each language and fits the document's language proportions by EM. The sets
{top 1}, {top 1, top 2}, ... up to ``max_languages`` (ordered by their share under all languages) are
refitted and the set with the best log-likelihood minus ``penalty * size * log(words)`` is selected.
The prediction is the selected language with the largest share, which is the score.

Words are runs of ASCII letters and of non-ASCII characters other than spaces and general punctuation,
lower-cased. A null text, or one without a letter, is ``und`` with score 0, as is every text when
nothing was learned. Labels that are null are not learned from. Repeated rows each return a row;
equal shares are decided by the language's name. Extra columns are ignored.

Fitting takes a bounded sample: about ``docs_per_language`` whole texts of each language, chosen by a
hash of id and text so that the choice is the same each time. Prediction covers every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import map_column, pieces, ready_workers

UNKNOWN = "und"
BUCKETS = 1 << 16
#: Characters whose trigrams are held at once.
CHUNK = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")


class Model(NamedTuple):
    languages: list[str]
    log_p: np.ndarray  # languages x BUCKETS, float32


def _trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets, one for each letter with its neighbours, and the index at which each word begins."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    low = codes | 32
    letter = ((low >= 97) & (low <= 122) & (codes < 128)) | ((codes > 160) & ((codes < 0x2000) | (codes > 0x206F)) & (codes != 0x3000))
    codes = np.where(letter, codes, 32).astype(np.uint32)
    at = np.flatnonzero(letter)
    with np.errstate(over="ignore"):
        mixed = codes[at - 1] * np.uint32(2654435761) + codes[at] * np.uint32(2246822519) + codes[at + 1] * np.uint32(3266489917)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(668265263)
    return (mixed >> np.uint32(16)).astype(np.int64), np.flatnonzero(~letter[at - 1])


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about CHUNK characters, cut at spaces."""
    start = 0
    while len(text) - start > CHUNK:
        end = text.find(" ", start + CHUNK)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


def fit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_language: int = 4000
) -> Model:
    """Trigram model of each non-null label of docs; the driver gets one count for each language and bucket."""
    ready_workers(docs.sparkSession)
    labelled = docs.select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").alias("id")
    ).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS), np.float32))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, docs_per_language / sizes[k])))])
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(place < share[F.col("lang")]).select("lang", "text")
    index = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in pieces(batches, 1):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece in _pieces(text):
                    totals[index[lang]] += np.bincount(_trigrams(piece)[0], minlength=BUCKETS)
        rows, cells = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(cells), pa.array(totals[rows, cells])], names=["l", "b", "n"])

    counts = sample.mapInArrow(count, "l long, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(languages), BUCKETS), 0.5)
    table[counts["l"].to_numpy(), counts["b"].to_numpy()] += counts["n"].to_numpy()
    return Model(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def with_background(model: Model) -> Model:
    """The model with ``und`` as one more component, under which all trigrams are equally likely.

    Text in a language or script without labels is likelier under it than under any learned language,
    so that ``und`` leads there instead of the language that was learned from the least text.
    """
    if not model.languages:
        return model
    flat = np.full((1, BUCKETS), -np.log(BUCKETS), np.float32)
    return Model([*model.languages, UNKNOWN], np.concatenate([model.log_p, flat]))


def _mixture(p: np.ndarray, doc: np.ndarray, first: np.ndarray, words: np.ndarray, share: np.ndarray, rounds: int) -> tuple:
    """EM: shares (documents x languages) and log-likelihoods, relative to each word's best language."""
    for _ in range(rounds):
        weighted = p * share[doc]
        total = weighted.sum(axis=1, dtype=np.float64)
        share = np.add.reduceat(weighted / total[:, None], first, axis=0) / words[:, None]
    fitted = np.log(np.maximum((p * share[doc]).sum(axis=1, dtype=np.float64), 1e-300))
    return share, np.add.reduceat(fitted, first)


def mixtures(texts: list[str], model: Model, max_languages: int, penalty: float, rounds: int) -> np.ndarray:
    """Selected shares (texts x languages) of texts that have a word each."""
    scores, words = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        for piece in _pieces(text):
            tri, starts = _trigrams(piece)
            if len(starts):
                scores.append(np.stack([np.add.reduceat(row[tri], starts) for row in model.log_p], axis=1))
                words[i] += len(starts)
    x = np.concatenate(scores)
    p = np.exp(x - x.max(axis=1, keepdims=True)).astype(np.float64) + 1e-12
    doc = np.repeat(np.arange(len(texts)), words)
    first = np.concatenate(([0], np.cumsum(words)[:-1]))
    n = p.shape[1]
    share, _ = _mixture(p, doc, first, words, np.full((len(texts), n), 1 / n), rounds)
    order = np.argsort(-share, axis=1, kind="stable")
    best, chosen = np.full(len(texts), -np.inf), share
    for size in range(1, min(max_languages, n) + 1):
        allowed = np.zeros_like(share)
        np.put_along_axis(allowed, order[:, :size], 1.0, axis=1)
        start = allowed * (share + 1e-6)
        kept, fitted = _mixture(p, doc, first, words, start / start.sum(axis=1, keepdims=True), rounds if size > 1 else 1)
        value = fitted - penalty * size * np.log(words + 1)
        better = value > best
        best = np.where(better, value, best)
        chosen = np.where(better[:, None], kept, chosen)
    return chosen


def predict(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_languages: int = 3,
    penalty: float = 1.0,
    rounds: int = 6,
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` (by default the id) with lang_pred, score and shares (a map of the selected languages)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    fields = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("shares", T.MapType(T.StringType(), T.DoubleType())),
    ]

    def make():
        model = shared.value

        def work(texts: list) -> list:
            langs, scores, shares = [UNKNOWN] * len(texts), [0.0] * len(texts), [{} for _ in texts]
            known = [i for i, t in enumerate(texts) if t and model.languages and _LETTER.search(t)]
            while known:
                some, size = [], 0
                while known and (not some or size + len(texts[known[-1]]) <= CHUNK):
                    some.append(known.pop())
                    size += len(texts[some[-1]])
                found = mixtures([texts[i] for i in some], model, max_languages, penalty, rounds)
                for i, row in zip(some, found, strict=True):
                    top = int(row.argmax())
                    langs[i], scores[i] = model.languages[top], min(1.0, float(row[top]))
                    shares[i] = {model.languages[j]: float(row[j]) for j in np.flatnonzero(row > 1e-3)}
            return [langs, scores, [list(s.items()) for s in shares]]

        return work

    return map_column(docs, text_col, make, fields, keep or [id_col])
