"""Importance resampling and phrase mining against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import importance, phrases


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute_draw(docs, target):
    made = [(i, *brute_features(t)) for i, t in docs]
    s = Counter(crc32(f.encode()) % 10_000 for _, _, fs in made for f in fs)
    t = Counter(crc32(f.encode()) % 10_000 for x in target for f in brute_features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)]
    rows = []
    for i, n, fs in made:
        weight = sum(gain[crc32(f.encode()) % 10_000] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: 25 * len(able) // 100])}
    return Counter((i, n, w, s, rank.get(id(r))) for r in rows for i, _, n, w, s in [r])


@pytest.fixture(scope="module")
def benchmark_rows(spark):
    r = random.Random(3)
    return [" ".join(f"w{r.randrange(300)}" for _ in range(40)) for _ in range(20)] + [None, ""]


def test_resample_against_brute_force(spark, make_docs, odd_rows, benchmark_rows):
    r = random.Random(4)
    rows = odd_rows + [(100 + i, " ".join(r.choice((f"w{r.randrange(300)}", f"Größe{r.randrange(99)}", "x-1\x00y")) for _ in range(r.randrange(60)))) for i in range(200)]
    target = spark.createDataFrame([(t,) for t in benchmark_rows], "text string")
    got = importance.resample(make_docs(rows, clash=True).withColumn("rank", F.lit("x")), target).collect()
    assert Counter(tuple(x) for x in got) == brute_draw(rows, benchmark_rows)
    assert sorted(x["rank"] for x in got if x["rank"]) == list(range(1, sum(x["rank"] is not None for x in got) + 1))


def test_resample_of_empty_tables(spark, make_docs, odd_rows):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(make_docs([]), none).count() == 0
    got = importance.resample(make_docs(odd_rows), none).collect()
    assert Counter(tuple(x) for x in got) == brute_draw(odd_rows, [])


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 16])
def test_features_do_not_depend_on_blocks_or_batches(monkeypatch, block):
    monkeypatch.setattr(importance, "BLOCK", block)
    texts = ["one two", "", "Three", "ä ö-ü\x00é one", "a b c d e f g"]
    for n_max in (1, 2, 3):
        got = Counter()
        for _, owner, bucket in importance.features([t.encode() for t in texts], 97, n_max):
            got.update(zip(owner.tolist(), bucket.tolist()))
        want = Counter()
        for i, t in enumerate(texts):
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
            want.update((i, crc32(" ".join(words[k : k + n]).encode()) % 97) for n in range(1, n_max + 1) for k in range(len(words) - n + 1))
        assert got == want


def brute_mine(rows, min_count, inside, top):
    count, total = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            count.update((lang or "und", tuple(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    cover = defaultdict(int)
    for (lang, w), a in count.items():
        if len(w) == 3 and a >= min_count:
            for part in (w[:2], w[1:]):
                cover[lang, part] = max(cover[lang, part], a)
    rows = defaultdict(list)
    for (lang, w), a in count.items():
        if len(w) > 1 and a >= min_count and not (len(w) == 2 and (lang, w) in cover and 100 * cover[lang, w] >= inside * a):
            score, k = min((1_000_000 * a * a // (count[lang, w[:k]] * count[lang, w[k:]]), k) for k in range(1, len(w)))
            rows[lang].append((-score, -a, " ".join(w).encode(), count[lang, w[:k]], count[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for lang, v in rows.items() for i, (s, a, p, x, y) in enumerate(sorted(v)[:top]))


def talk(seed, n, words, langs=("en", "de", None)):
    r = random.Random(seed)
    pick = lambda: f"W{min(r.randrange(words), r.randrange(words))}"
    return [(r.choice(langs), "".join(pick() + r.choice(("  ", " ", " ", " ", "\t", ". ", ",", "\n")) for _ in range(r.randrange(120)))) for _ in range(n)]


def lang_docs(spark, rows):
    return spark.createDataFrame([(i, lang, t, 1, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, n int, phrase string")


@pytest.mark.parametrize("share", [0.25, 0.0, 1.0])
def test_mine_against_brute_force(spark, share):
    rows = talk(1, 150, 30) + [("en", None), ("en", ""), (None, None), ("fr", " \n. "), ("en", "a\x00b ▁ß"), ("x y", "one two one two")]
    rows += [("en", "Repeat repeat repeat repeat " * 10)] * 3
    got = phrases.mine(lang_docs(spark, rows), top=40, share=share)
    assert sorted(map(tuple, got.collect())) == brute_mine(rows, 10, 50, 40)


def test_mine_reads_long_texts_in_parts(spark, monkeypatch):
    rows = talk(2, 6, 12, langs=("en",)) + [("en", "x" * 300 + " y" * 50)]
    whole = [("en", " ".join(t or "" for _, t in rows))]
    everything = phrases.Known(*[np.full(phrases.BITS >> 6, 2**64 - 1, np.uint64)] * 3)
    for part in (1, 5, 64):
        monkeypatch.setattr(phrases, "PART", part)
        found = list(phrases.parts(whole[0][1].encode()))
        tokens = [t for said, old in found for t in [x for x in said.split(b" ") if x][old:]]
        assert [t for t in tokens if t != b"\n"] == re.findall(rb"[^\x20\x09.,;:!?\x0A-\x0D]+", whole[0][1].lower().encode())
        blocks = Counter()
        for said, old in found:
            for _, _, phrase, n in phrases.count_block(phrases.block_of([said], [0], [old]), ["en"], everything, None, False):
                blocks.update({p: k for p, k in zip(phrase.to_pylist(), n.to_pylist()) if p is not None})
        want = Counter()
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", whole[0][1].lower()):
            w = piece.split()
            want[""] += len(w)
            want.update(" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
        assert blocks == want


def test_keys_are_the_same_in_spark_and_in_workers(spark):
    found = phrases.count_block(phrases.block_of(["one two é".encode()], [0], [0]), ["x y"], None, None, False)
    workers = {k for keys, *_ in found for k in keys.to_pylist()}
    said = spark.createDataFrame([("x y", p) for p in ("one", "two", "é", "one two", "two é", "one two é")], "lang string, phrase string")
    everything = phrases.Known(*[np.zeros(phrases.BITS >> 6, np.uint64)] * 2, np.full(phrases.BITS >> 6, 0, np.uint64))
    for bits in everything[:2]:
        bits |= np.uint64(2**64 - 1)
    triples = phrases.count_block(phrases.block_of(["one two é".encode()], [0], [0]), ["x y"], everything, None, False)
    workers |= {k for keys, *_ in triples for k in keys.to_pylist() if k is not None}
    assert workers == {r[0] for r in said.select(phrases.phrase_key("lang", "phrase")).collect()}


def test_mine_of_nothing(spark):
    assert phrases.mine(lang_docs(spark, [])).count() == 0
    assert phrases.mine(lang_docs(spark, [(None, None), ("en", "few words")])).count() == 0


def test_scores_stay_exact_beyond_64_bits(spark):
    """Counts whose products pass 64 bits, through the same decimals."""
    a, left, right = 3_000_000_019, 5_000_000_029, 7_000_000_001
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert row.select(phrases.cut_score("a", "l", "r").alias("s")).first()["s"] == 1_000_000 * a * a // (left * right)
