"""Toxicity by weak supervision: many voters, a label model of their accuracies and correlations, a linear classifier.

``fit`` takes a bounded sample of labelled rows (``fit_rows``, those with the smallest hashes of their ids). From it the stems
are mined that toxic texts have much oftener than others (words and beginnings of words, by the log-likelihood ratio of
the texts that have them). Voters then mark each text as toxic, clean or neither: general word lists, lists of mined stems,
the density of hits, shouting, an insult after "you", no hits at all, and the given label itself. The label model is a mixture of two
classes with a table for each voter, fitted by expectation-maximisation; voters whose votes agree beyond what the
class explains share their weight by their correlation. A logistic regression on counts of stems and lists is trained
on the model's posterior labels, and ``score`` applies it to every whole text.

Words are runs of ASCII letters and of non-ASCII characters, lower-cased. A null or empty text has no hits and the score of
none. Labels that are null or whose id isn't in the table are not learned from; of an id's labels the largest counts. Where
the labels hold one class only, or none, nothing is learned and every score is 0. Repeated rows each return a row; extra columns
are ignored. The driver gets counts by stem, and for each row of the sample its votes and hits.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from string import ascii_lowercase, ascii_uppercase
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import Scratch, map_column, pieces, ready_workers

#: General lists of abusive words, by kind.
LISTS: dict[str, tuple[str, ...]] = {
    "stupidity": tuple("idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile cretin halfwit dimwit fool fools brainless clown clowns dunce simpleton".split()),
    "contempt": tuple("loser losers pathetic worthless useless scum trash garbage vermin filth lowlife scumbag disgrace coward creep freak nobody parasite failure".split()),
    "disgust": tuple("disgusting gross vile repulsive nasty filthy revolting ugly hideous sickening rotten stinking".split()),
    "profanity": tuple("fuck fucking fucker shit bullshit bitch bastard asshole arse crap damn whore slut dick prick cunt".split()),
    "threat": tuple("kill die murder destroy hang burn hurt strangle smash beat choke".split()),
    "german": tuple("idiot dummkopf trottel depp arschloch scheiße abschaum versager widerlich erbärmlich blödmann wertlos hurensohn".split()),
    "french": tuple("idiot imbécile connard connasse salaud pourriture minable dégoûtant stupide crétin débile ordure merde".split()),
    "spanish": tuple("idiota imbécil estúpido estúpida basura escoria asqueroso patético inútil tonto cabrón mierda payaso".split()),
}
_YOU = re.compile(r"\b(?:you|your|you're|youre|u)\b(?:\W+\w+){0,3}?\W+(" + "|".join(sorted({w for k in ("stupidity", "contempt", "disgust", "profanity") for w in LISTS[k]})) + r")\b", re.I)
#: Bytes other than letters are spaces between words; bytes over 127 belong to letters beyond ASCII.
_LETTERS = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
#: Lengths of the beginnings of words that are stems.
STEM_LENGTHS = range(3, 9)
#: Bytes of texts that a worker splits at once.
BLOCK = 2 << 20
FOLDS = 4
TOXIC, CLEAN, NEITHER = 1, 2, 0


class Stem(NamedTuple):
    """A stem, whether it is a whole word, and how many toxic and other texts have it."""

    text: str
    whole: bool
    toxic: int
    other: int


class Model(NamedTuple):
    stems: list[Stem]
    weights: np.ndarray  # counts of stems, their share of the words, counts of lists, bias
    voters: list[str]
    accuracies: np.ndarray  # of each voter that votes
    correlations: np.ndarray


def _words(raw: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(different words, number of each word's spelling, index of its text) of texts."""
    blobs = [t.lower().encode("utf-8", "surrogatepass").translate(_LETTERS) for t in raw]
    lists = pc.split_pattern(pa.array(blobs, pa.string()), " ")
    coded = lists.values.dictionary_encode()
    code, owner = coded.indices.to_numpy(), np.repeat(np.arange(len(raw)), np.diff(lists.offsets.to_numpy()))
    texts = coded.dictionary.to_pylist()
    kept = np.fromiter(map(bool, texts), bool, len(texts))[code] if len(code) else np.zeros(0, bool)
    return texts, code[kept], owner[kept]


def _blocks(texts: list) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) in runs of about BLOCK characters, nulls as empty."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= BLOCK:
            yield start, [x or "" for x in texts[start : i + 1]]
            start, held = i + 1, 0
    if start < len(texts):
        yield start, [x or "" for x in texts[start:]]


def _all_stems(word: str) -> list[str]:
    """A word's stems: the beginnings, and the whole word with a mark."""
    return [f"={word}"] + [word[:k] for k in STEM_LENGTHS if len(word) >= k]


def _finder(stems: list[Stem]) -> Callable[[str], tuple[int, ...]]:
    """Columns that a word counts in: its stems, and after them its lists; remembered for some words."""
    place = {f"={s.text}" if s.whole else s.text: i for i, s in enumerate(stems)}
    lists = {}
    for k, words in enumerate(LISTS.values()):
        for w in words:
            lists.setdefault(w, []).append(len(stems) + k)
    seen: dict[str, tuple[int, ...]] = {}

    def find(word: str) -> tuple[int, ...]:
        found = seen.get(word)
        if found is None:
            found = tuple([place[s] for s in _all_stems(word) if s in place] + lists.get(word, []))
            if len(seen) < 1 << 18:
                seen[word] = found
        return found

    return find


def hits(texts: list[str], find: Callable[[str], tuple[int, ...]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, column, count) of all hits in texts, and the number of words of each."""
    spelled, code, owner = _words(texts)
    columns = [find(w) for w in spelled]
    many = np.fromiter(map(len, columns), np.int64, len(columns))
    here = many[code] > 0 if len(code) else np.zeros(0, bool)
    code, at = code[here], owner[here]
    flat = np.array([c for found in columns for c in found], np.int64)
    first = np.cumsum(many) - many
    n = many[code]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    key, count = np.unique(np.repeat(at, n) * width + flat[np.repeat(first[code], n) + step], return_counts=True)
    return key // width, key % width, count, np.bincount(owner, minlength=len(texts))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> DataFrame:
    """(text, y) of the labelled rows with the smallest hashes; at most fit_rows labels are sent to where the texts are."""
    ids = labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("__i")).agg(F.max((F.col(f"`{label_col}`") > 0).cast("int")).alias("y"))
    some = docs.select(F.col(f"`{id_col}`").alias("__i")).where("__i is not null").distinct().join(ids, "__i").orderBy(F.xxhash64("__i"), "__i").limit(fit_rows)
    return docs.select(F.col(f"`{id_col}`").alias("__i"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(some), "__i").select("text", "y")


def mine_stems(sample: DataFrame, least_texts: int, least_ratio: float, most: int) -> list[Stem]:
    """The stems with the highest log-likelihood ratio; of a stem and its longer ones in the same texts only the longest."""
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            toxic, other = Counter(), Counter()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if y else other).update({s for w in set(_words([text or ""])[0]) if w for s in _all_stems(w)})
            names = list(toxic.keys() | other.keys())
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([toxic[s] for s in names]), pa.array([other[s] for s in names])], names=["s", "a", "b"])

    counts = sample.select("text", "y").mapInArrow(count, "s string, a long, b long").groupBy("s").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b = F.col("a"), F.col("b")
    share = (a + b) / float(n1 + n0)
    term = lambda k, n, p: F.when(k > 0, k * F.log(k / (p * n))).otherwise(0.0)
    ratio = 2 * (term(a, n1, share) + term(b, n0, share) + term(n1 - a, n1, 1 - share) + term(n0 - b, n0, 1 - share))
    often = counts.where((a >= least_texts) & (a * n0 > 3 * b * n1)).withColumn("g", F.round(ratio, 6)).where(F.col("g") >= least_ratio)
    rows = often.orderBy(F.desc("g"), F.desc(F.length("s")), "s").limit(20 * most).collect()
    kept, spans = [], {}
    for r in rows:
        body = r["s"].removeprefix("=")
        longer = spans.setdefault((r["a"], r["b"]), [])
        if not any(x.startswith(body) for x in longer):
            longer.append(body)
            kept.append(Stem(body, r["s"].startswith("="), r["a"], r["b"]))
    return kept[:most]


def _voters() -> list[str]:
    return [*LISTS, *[f"mined {k}" for k in range(FOLDS)], "density", "shouting", "you", "no hits", "label"]


def _votes(text: str, counts: dict[int, int], words: int, stems: list[Stem], label: int) -> list[int]:
    """The votes of all voters on a text."""
    d = len(stems)
    votes = [TOXIC if counts.get(d + k) else NEITHER for k in range(len(LISTS))]
    strong = [0.0] * FOLDS
    for i, n in counts.items():
        if i < d:
            strong[i % FOLDS] += (1.0 if stems[i].toxic >= 4 * stems[i].other else 0.4) * min(n, 3)
    votes += [TOXIC if s >= 1 else NEITHER for s in strong]
    total = sum(strong)
    votes.append(TOXIC if 100 * total > words > 0 and total >= 2 else NEITHER)
    capitals = sum(map(text.count, ascii_uppercase))
    letters = capitals + sum(map(text.count, ascii_lowercase))
    votes.append(TOXIC if letters >= 40 and capitals > 0.7 * letters and "!!" in text else NEITHER)
    votes.append(TOXIC if any(counts.get(d + k) for k in range(4)) and _YOU.search(text) else NEITHER)
    votes.append(CLEAN if total < 1 and not any(counts.get(d + k) for k in range(len(LISTS))) else NEITHER)
    return [*votes, TOXIC if label else CLEAN]


def label_model(votes: np.ndarray, count: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each pattern, accuracies of voters, correlations) by EM over vote patterns with their counts.

    The last voter is the given label: it starts the classes, and then is a voter like others, whose accuracy is estimated.
    """
    patterns, j = votes.shape
    outcome = np.stack([votes == k for k in range(3)], axis=2).astype(float)
    post = np.where(votes[:, -1] == TOXIC, 0.97, 0.03)
    for _ in range(rounds):
        weight = np.stack([(1 - post) * count, post * count])
        table = np.einsum("cp,pjk->cjk", weight, outcome) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        rest = [outcome[:, :, TOXIC] - table[c, :, TOXIC] for c in (0, 1)]
        cov = sum(np.einsum("p,pi,pj->ij", weight[c], rest[c], rest[c]) for c in (0, 1)) / count.sum()
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        corr = np.clip(cov / np.outer(scale, scale), -1, 1)
        shared = np.maximum(corr - np.eye(j), 0)
        shared[-1], shared[:, -1] = 0, 0
        own = 1 / (1 + shared.sum(axis=1))
        log_ratio = np.log(table[1] / table[0])
        prior = (weight[1].sum() + 0.5) / (count.sum() + 1)
        odds = math.log(prior / (1 - prior)) + np.einsum("j,pjk,jk->p", own, outcome, log_ratio)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    said = outcome[:, :, TOXIC] * post[:, None] + outcome[:, :, CLEAN] * (1 - post[:, None])
    spoke = (outcome[:, :, TOXIC] + outcome[:, :, CLEAN]) * count[:, None]
    accuracy = (said * count[:, None]).sum(axis=0) / np.maximum(spoke.sum(axis=0), 1e-9)
    return post, accuracy, corr


def _inputs(column: np.ndarray, count: np.ndarray, words: np.ndarray, stems: int) -> tuple[np.ndarray, np.ndarray]:
    """The classifier's columns and values of hits: the logarithm of the count, and for stems the share of the text's words."""
    logs, share = np.log1p(count), 3 * np.minimum(1.0, 10 * count / np.maximum(words, 1))
    is_stem = column < stems
    return np.concatenate([column, column[is_stem] + stems + len(LISTS)]), np.concatenate([logs, share[is_stem]])


def train(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, width: int, ridge: float, rounds: int = 12, at_once: int = 2048) -> np.ndarray:
    """Weights and bias of a ridge logistic regression on soft labels, by Newton's method over blocks of rows."""
    w = np.zeros(width + 1)
    penalty = np.full(width + 1, ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        gradient, curve = penalty * w, np.diag(penalty)
        for s in range(0, len(y), at_once):
            x = np.zeros((len(y[s : s + at_once]), width + 1))
            x[:, -1] = 1
            for i, (c, v) in enumerate(zip(rows[s : s + at_once], values[s : s + at_once], strict=True)):
                x[i, c] = v
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient += x.T @ (p - y[s : s + at_once])
            curve += (x * (p * (1 - p))[:, None]).T @ x
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 20_000,
    least_texts: int = 4, least_ratio: float = 20.0, most_stems: int = 200, ridge: float = 0.1,
) -> Model:
    """The model of at most ``fit_rows`` labelled rows of docs; ``most_stems`` bounds its size."""
    spark = docs.sparkSession
    ready_workers(spark)
    voters = _voters()
    with Scratch(spark) as scratch:
        sample = scratch.table(_sample(docs, labels, id_col, text_col, label_col, fit_rows), "labelled")
        stems = mine_stems(sample, least_texts, least_ratio, most_stems)
        width = len(stems) + len(LISTS)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = _finder(stems)
            for batch in pieces(batches, 0):
                texts, ys = [t or "" for t in batch.column(0).to_pylist()], batch.column(1).to_pylist()
                owner, column, count, words = hits(texts, find, width)
                ends = np.searchsorted(owner, np.arange(len(texts) + 1))
                found = [(column[a:b].tolist(), count[a:b].tolist()) for a, b in zip(ends, ends[1:])]
                votes = [_votes(t, dict(zip(c, n)), int(w), stems, y) for t, (c, n), w, y in zip(texts, found, words, ys, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for c, _ in found], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.list_(pa.int32())), pa.array(words, pa.int64()), pa.array(votes, pa.list_(pa.int32()))],
                    names=["c", "n", "words", "votes"],
                )

        seen = sample.select("text", "y").mapInArrow(look, "c array<int>, n array<int>, words long, votes array<int>").toArrow()
    votes = np.array(seen["votes"].to_pylist(), np.int64).reshape(-1, len(voters))
    if len(set(votes[:, -1].tolist())) < 2:
        return Model([], np.zeros(0), voters, np.zeros(len(voters)), np.zeros((len(voters),) * 2))
    patterns, which, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, accuracy, corr = label_model(patterns, count.astype(float))
    inputs = [_inputs(np.array(c, np.int64), np.array(n, float), np.array(w), len(stems)) for c, n, w in zip(seen["c"].to_pylist(), seen["n"].to_pylist(), seen["words"].to_pylist(), strict=True)]
    w = train([c for c, _ in inputs], [v for _, v in inputs], posterior[which.ravel()], width + len(stems), ridge)
    return Model(stems, w, voters, accuracy, corr)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted): the chance that a text is toxic, and 1 where it is at least a half."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def make():
        model = shared.value
        find, d = _finder(model.stems), len(model.stems)

        def work(texts: list) -> list:
            out = np.zeros(len(texts))
            for start, some in _blocks(texts) if len(model.weights) else ():
                owner, column, count, words = hits(some, find, d + len(LISTS))
                c, v = _inputs(column, count, words[owner], d)
                total = np.bincount(np.concatenate([owner, owner[column < d]]), weights=v * model.weights[c], minlength=len(some)) + model.weights[-1]
                out[start : start + len(some)] = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            return [out, (out >= 0.5).astype(np.int32)]

        return work

    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    return map_column(rows, "__text", make, fields, ["__id"]).withColumnRenamed("__id", id_col)
