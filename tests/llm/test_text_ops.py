"""Language mixture, rule ledger, chat rendering, SentencePiece and packing against brute force."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat_format, language_mix, packing, quality_bits, queries, sp_bpe

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_language_held_out_accuracy(spark):
    got = queries.op3_language_mixture(spark, "/root/testdata/sf0.01")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(lang, "doc_id").collect()
    assert len(rows) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang"] is not None]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)


def test_language_mixture_of_two(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_mix.fit(docs)
    en = docs.where("lang = 'en' and length(text) > 800").first()["text"][:800]
    fr = docs.where("lang = 'fr' and length(text) > 800").first()["text"][:800]
    row = language_mix.predict(spark.createDataFrame([(1, f"{en} {fr}")], "doc_id long, text string"), model).first()
    assert set(row["shares"]) == {"en", "fr"} and min(row["shares"].values()) > 0.3


def test_language_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows, clash=True)
    model = language_mix.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = language_mix.predict(docs, model).collect()
    assert len(rows) == len(odd_rows)
    by_id = {r["doc_id"]: r for r in rows}
    for i in (1, 2, 3, 11):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert by_id[4]["lang_pred"] != "und" and by_id[10]["lang_pred"] != "und"
    nothing = language_mix.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language_mix.predict(docs, nothing).collect()} == {"und"}
    assert language_mix.predict(docs.limit(0), model).count() == 0


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines, dup = [x for x in text.split("\n") if WORD.search(x)], 0
    for i, x in enumerate(lines):
        dup += x in lines[:i]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_ledger_against_brute_force(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows, clash=True)
    rows = quality_bits.ledger(docs, keep=["doc_id", "text"]).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert tuple(r[m] for m in quality_bits.MEASURES[:5]) == brute_measures(r["text"])
        assert bool(r["failed_bits"] & 1) == (r["n_words"] < 50)
    assert quality_bits.ledger(docs.limit(0)).count() == 0


def test_ablation_from_bits(spark):
    found = quality_bits.ledger(spark.read.parquet(f"{SF}/documents.parquet"))
    bits = [r["failed_bits"] for r in found.collect()]
    for version in quality_bits.POLICIES.values():
        mask = quality_bits.mask_of(version)
        for r in quality_bits.ablation(found, version).collect():
            bit = quality_bits.mask_of([r["rule"]])
            assert r["n_failed"] == sum(bool(b & bit) for b in bits)
            assert r["n_only"] == sum(b & mask == bit for b in bits)
            assert r["n_kept"] == sum(not b & mask for b in bits)
            assert r["n_kept_without"] == sum(not b & mask & ~bit for b in bits)
    assert {r["n_failed"] for r in quality_bits.ablation(found.limit(0), ["symbols"]).collect()} == {0}


def test_junk_is_rejected_and_clean_text_kept(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality_bits.apply_policy(quality_bits.ledger(docs), quality_bits.POLICIES["v1"]).join(labels, "doc_id")
    rows = found.where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words").collect()
    junk, clean = [r for r in rows if r["quality"] == 0], [r for r in rows if r["quality"] == 1]
    assert all(r["kept"] for r in clean)
    assert sum(r["kept"] for r in junk) <= 0.05 * len(junk)


PARTS = ["<", "[", "\\", "s>", "/s>", "/INST]", "INST]", "|end|>", "\n", "a", "<s>", "|start|>", "assistant"]


def test_escape_is_reversible():
    r = random.Random(1)
    for _ in range(20_000):
        s = "".join(r.choice(PARTS) for _ in range(r.randrange(9)))
        e = chat_format.escape(s)
        assert chat_format.unescape(e) == s
        assert not any(h + t in e for h, t in chat_format.CONTROL)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_chat_digests_against_the_rows(spark):
    got = {r["conv_id"]: r for r in queries.op5_chat_rendering(spark, SF).collect()}
    chats = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        chats[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    said = "</s>[INST] ok [/INST]"
    chats[-1] = [(0, "user", said), (1, "assistant", said)]
    assert set(got) == set(chats)
    for conv, turns in chats.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for _, role, t in turns))
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), sha(loss))
        assert not got[conv]["rewrites_history"]


def test_chat_odd_rows_and_rewriting_template(spark):
    schema = "conv_id long, turn long, role string, text string, n_turns string"
    rows = [(1, 0, None, None, "x"), (1, 0, None, None, "x"), (None, None, "assistant", "a\nb", "x"), (2, 1, "assistant", "", "x")]
    df = spark.createDataFrame(rows, schema)
    got = {r["conv_id"]: r for r in chat_format.chat_digests(df).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 2, None: 1, 2: 1}
    assert got[None]["loss_sha256"] == sha("a\nb") and got[2]["loss_chars"] == 0
    assert chat_format.chat_digests(df.limit(0)).count() == 0
    made = {r["conv_id"]: r for r in chat_format.format_chats(df).collect()}
    span = made[None]["spans"][0]
    assert chat_format.unescape(made[None]["formatted"][span["text_start"] : span["text_end"]]) == "a\nb" and span["loss"]
    forgets = lambda turns: "".join(f"[{r}]{t if i == len(turns) - 1 else '...'}\n" for i, (r, t) in enumerate(turns))
    assert chat_format.locate(forgets, [("user", "hello"), ("assistant", "x"), ("user", "y")])[2] == [1, 2]


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    return sp_bpe.piece_bpe(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_sentencepiece_fuzz(pieces):
    own, lib = pieces
    r = random.Random(0)
    parts = ["a", "b", " ", "  ", "   ", "\n", "\t", "\xa0", "é", "the", "ing", "1", "!", "<s>", "ﬁ", "́", "▁", "日", "𝒳", "\x00", "ation", "er", "$$$", "###"]
    for _ in range(5000):
        s = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        ids = lib.encode(s)
        assert own.encode(s) == ids and own.decode(ids) == lib.decode(ids)
        n, a, b = own.digest(s)
        assert (n, a, b) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))


def test_sentencepiece_query(spark, pieces, make_docs, odd_rows):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = make_docs(odd_rows, clash=True).unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = pieces[1].encode(r["text"] or "")
        want[(r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(pieces[1].decode(ids)))] += 1
    assert Counter(tuple(r) for r in sp_bpe.encode_decode(docs, path).collect()) == want
    some = make_docs([(1, "a  b\nc"), (2, None)])
    assert {r["doc_id"]: r["text"] for r in sp_bpe.decode(sp_bpe.encode(some, path), path).collect()} == {1: "a  b\nc", 2: ""}
    assert sp_bpe.encode_decode(docs.limit(0), path).count() == 0


def check_packing(rows, texts, capacity):
    """Each id in exactly one piece, sequences gapless and within capacity."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, text in texts:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            if r["start"] < at:  # a repeated row
                continue
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(array("I", ids[at : at + r["length"]]).tobytes())
            at += r["length"]
        assert at == len(ids)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return by_sequence


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op8_cost_packing(spark, SF).collect()
    held = check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 2048)
    assert sum(r["length"] for r in rows) > 0.95 * 2048 * len(held)


def test_packing_odd_rows(spark, make_docs, odd_rows):
    files = queries.byte_bpe_files()
    docs = make_docs([*odd_rows, (20, "x <|endoftext|> y"), (21, "a \n  \n b")], clash=True).coalesce(1)
    rows = packing.pack(docs, lambda: packing.byte_bpe(*files), 1, capacity=64, window_tokens=500).collect()
    texts = [(i, t) for i, t in odd_rows if i not in (10,)] + [(20, "x <|endoftext|> y"), (21, "a \n  \n b")]
    check_packing(rows, texts, 64)
    assert packing.pack(docs.limit(0), lambda: packing.byte_bpe(*files), 1).count() == 0


def test_balance_fills_and_balances():
    r = random.Random(2)
    lengths = sorted((r.randrange(1, 2048) for _ in range(500)), reverse=True)
    held = packing.balance(lengths, 2048, 1.0, 1 / 2048)
    totals = [sum(n for _, _, n in h) for h in held]
    assert len(held) == -(-sum(lengths) // 2048) and max(totals) <= 2048
    seen = Counter()
    for h in held:
        for doc, _, n in h:
            seen[doc] += n
    assert [seen[i] for i in range(len(lengths))] == lengths
    costs = [sum(n + n * n / 2048 for _, _, n in h) for h in held]
    assert max(costs) < 2.1 * min(costs)


def test_fast_ids_equal_the_library():
    files = queries.byte_bpe_files()
    fast, slow = packing.ByteBpe(*files), packing.ByteBpe(files[0])
    r = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\xa0", "\x1c", "é", "'s", "1", "!", "　", "<|endoftext|>", "ﬁ", "́", "\r\n", "½", "the"]
    for _ in range(5000):
        s = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        assert fast.ids(s) == slow.ids(s)
