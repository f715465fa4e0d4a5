"""Toxicity: hits and the label model against slow versions, held-out accuracy, odd tables."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from plumbline.llm import queries, toxicity
from plumbline.llm.toxicity import CLEAN, NEITHER, TOXIC, Stem

LABELS = "doc_id long, quality int, toxic int"


def slow_words(text):
    return [w for w in "".join(c if c > "\x7f" or c.isalpha() else " " for c in (text or "").lower()).split(" ") if w]


def test_hits_equal_a_loop():
    stems = [Stem("clown", True, 9, 0), Stem("clo", False, 9, 1), Stem("rée", False, 5, 2), Stem("zzz", True, 4, 0)]
    r = random.Random(2)
    texts = [" ".join(r.choice(("clown", "CLOWN!", "clothes", "réeux", "Réex", "die", "idiot,idiot", "1a", "x")) for _ in range(r.randrange(30))) for _ in range(40)] + ["", "\n", "…"]
    width = len(stems) + len(toxicity.LISTS)
    owner, column, count, words = toxicity.hits(texts, toxicity._finder(stems), width)
    want = Counter()
    for i, t in enumerate(texts):
        for w in slow_words(t):
            want.update((i, k) for k, s in enumerate(stems) if (w == s.text if s.whole else w.startswith(s.text)))
            want.update((i, len(stems) + k) for k, said in enumerate(toxicity.LISTS.values()) if w in said)
    assert dict(zip(zip(owner.tolist(), column.tolist()), count.tolist())) == dict(want)
    assert words.tolist() == [len(slow_words(t)) for t in texts]


def test_label_model_finds_accuracies_and_correlations():
    r = random.Random(1)
    rows, truth = [], []
    for _ in range(6000):
        y = r.random() < 0.2
        say = lambda right: (TOXIC if y else CLEAN) if r.random() < right else (CLEAN if y else TOXIC)
        one = say(0.9)
        rows.append((one, one if r.random() < 0.95 else say(0.9), say(0.8) if r.random() < 0.5 else NEITHER, say(0.7), say(0.93)))
        truth.append(y)
    patterns, which, n = np.unique(np.array(rows), axis=0, return_inverse=True, return_counts=True)
    post, accuracy, corr = toxicity.label_model(patterns, n.astype(float))
    right = np.mean((post[which.ravel()] >= 0.5) == np.array(truth))
    assert right > 0.95 and right > np.mean([(x[-1] == TOXIC) == y for x, y in zip(rows, truth)])
    assert accuracy == pytest.approx([0.9, 0.9, 0.8, 0.7, 0.93], abs=0.05)
    assert corr[0, 1] > 0.7 and abs(corr[0, 3]) < 0.1 and abs(corr[2, 3]) < 0.1


def test_training_is_at_its_optimum():
    r = np.random.default_rng(0)
    rows = [np.unique(r.integers(0, 6, 3)) for _ in range(300)]
    values = [r.random(len(c)) + 0.1 for c in rows]
    y = np.clip([0.9 if 0 in c else 0.1 for c in rows], 0, 1)
    w = toxicity.train(rows, values, y, 6, 0.1, at_once=64)

    def loss(w):
        total = 0.05 * (w[:-1] ** 2).sum() + 5e-7 * w[-1] ** 2
        for c, v, t in zip(rows, values, y):
            z = w[c] @ v + w[-1]
            total += math.log1p(math.exp(-abs(z))) + max(z, 0) - t * z
        return total

    at = loss(w)
    assert all(loss(w + d) >= at - 1e-9 for d in np.concatenate([np.eye(7), -np.eye(7)]) * 1e-3)


def test_mined_stems_equal_counts(spark, make_docs):
    r = random.Random(3)
    rows = [(f"ok {r.choice('abc')}fine " + ("badly badness " if y and r.random() < 0.8 else "") + r.choice(("bank", "tree")), y) for y in (0, 0, 0, 1) for _ in range(40)]
    got = toxicity.mine_stems(spark.createDataFrame(rows, "text string, y int"), 4, 10.0, 50)
    for s in got:
        has = lambda t: any(w == s.text if s.whole else w.startswith(s.text) for w in slow_words(t))  # noqa: E731,B023
        assert (s.toxic, s.other) == (sum(has(t) for t, y in rows if y), sum(has(t) for t, y in rows if not y))
    assert {(s.text, s.whole) for s in got} == {("badly", True), ("badness", True)}


def test_held_out_accuracy_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    labels = {x["doc_id"]: x["toxic"] for x in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op12_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(x["held_out"] == (crc32(str(x["doc_id"]).encode()) % 5 == 0) and 0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in rows)
    held = [(x["score"], labels[x["doc_id"]]) for x in rows if x["held_out"] and x["doc_id"] in labels]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / (len(bad) * len(good)) > 0.9
    assert sum(s >= 0.5 for s in good) <= 0.02 * len(good)


def test_score_does_not_depend_on_blocks_and_ignores_other_columns(spark, make_docs, odd_rows, monkeypatch):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(("you", "fine", "tree", "idiot" if i % 4 == 0 else "house", "trash" if i % 4 == 0 else "road")) for _ in range(25))) for i in range(120)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)] + [(0, 1, 0), (None, 1, 1), (5, 1, None), (9999, 1, 1)], LABELS)
    model = toxicity.fit(make_docs(rows, clash=True), labels)
    assert {s.text for s in model.stems if s.whole} >= {"idiot", "trash"} and len(model.voters) == len(model.accuracies)
    docs = make_docs(rows + odd_rows + [(7777, "you are an idiot and trash " * 3), (8888, "tree " * 100_000)], clash=True)
    one = sorted(map(tuple, toxicity.score(docs, model).collect()), key=str)
    monkeypatch.setattr(toxicity, "BLOCK", 50)
    assert len(one) == len(rows) + len(odd_rows) + 2
    by_id = {i: (s, p) for i, s, p in one}
    assert by_id[1] == by_id[2] == by_id[3] and by_id[7777][1] == 1 and by_id[8888][1] == 0
    assert all(by_id[i][1] == int(i % 4 == 0) for i in range(20, 120))
    texts = [t for _, t in rows] + [None, "", "idiot " * 40]
    fresh = [list(b) for b in toxicity._blocks(texts)]
    assert [t for _, some in fresh for t in some] == [t or "" for t in texts] and [s for s, _ in fresh] == np.cumsum([0] + [len(s) for _, s in fresh])[:-1].tolist()


def test_nothing_to_learn_from(spark, make_docs, odd_rows):
    none = spark.createDataFrame([], LABELS)
    one_class = spark.createDataFrame([(1, 1, 0), (4, 1, 0)], LABELS)
    for labels in (none, one_class):
        model = toxicity.fit(make_docs(odd_rows), labels)
        assert {(x["score"], x["predicted"]) for x in toxicity.score(make_docs(odd_rows), model).collect()} == {(0.0, 0)}
    assert toxicity.score(make_docs([]), toxicity.fit(make_docs([]), one_class)).count() == 0
