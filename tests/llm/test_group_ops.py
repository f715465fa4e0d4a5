"""Duplicates, URL rules, web text and the pipeline against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from xxhash import xxh64_intdigest

import corpus_pipeline
from plumbline.llm import block_names, html_paths, near_copies, simhash, url_rules, warc
from plumbline.llm.queries import SITE_RULES, WORD_RULES
from plumbline.operators.graph import min_label_components

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, close):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = list(prints.items())
    for n, (i, a) in enumerate(items):
        for j, b in items[:n]:
            if close(a, b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in prints}


def test_fingerprint_matches_the_definition(spark):
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect():
        assert simhash.fingerprint(r["text"]) == brute_fingerprint(r["text"])
    for t in (None, "", " \n", "One", "one TWO Äé", "a b c d a b c"):
        assert simhash.fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize("bucket_pairs", [256, 2])
def test_near_groups_against_all_pairs(spark, make_docs, bucket_pairs):
    r = random.Random(7)
    base = [f"word{r.randrange(5000)}" for _ in range(400)]
    rows = [(i, " ".join([*base[: i * 3], "changed", *base[i * 3 + 1 :]])) for i in range(60)]
    rows += [(100 + i, " ".join(base)) for i in range(5)] + [(200, None), (201, ""), (202, "  ")]
    rows += [(300 + i, " ".join(f"o{r.randrange(900)}" for _ in range(30))) for i in range(40)]
    got = {x["doc_id"]: x for x in simhash.near_groups(make_docs(rows, clash=True), bucket_pairs=bucket_pairs).collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert len(set(want.values())) < len(rows) - 10
    assert {i: x["fingerprint"] for i, x in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: x["component_id"] for i, x in got.items()} == want


def test_near_groups_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows, clash=True)
    rows = simhash.near_groups(docs).collect()
    assert len(rows) == len(odd_rows)
    by_id = {r["doc_id"]: r["component_id"] for r in rows}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[8] == by_id[9] == 8
    assert simhash.near_groups(docs.limit(0)).count() == 0
    assert sorted(r["doc_id"] or 0 for r in simhash.keep_one(docs).select("doc_id").collect())[:2] == [0, 1]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 3)]
    got = min_label_components(spark.createDataFrame(links, "u long, v long")).collect()
    assert len(got) == len({r["node"] for r in got}) == 501
    assert all(r["component"] == (0 if r["node"] <= 200 else 1000) for r in got)


def brute_groups(rows):
    held = defaultdict(list)
    for i, t in rows:
        held[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return held


@pytest.mark.parametrize("bits", [64, 2, 0])
def test_exact_groups_with_clashing_hashes(spark, make_docs, odd_rows, bits):
    r = random.Random(3)
    rows = list(odd_rows) + [(100 + i, "".join(r.choice("ab ") for _ in range(r.randrange(40)))) for i in range(150)]
    rows += [(400 + i, rows[20 + i][1]) for i in range(60)]
    rows = [(i, t if t is None or len(t) < 1000 else t[:600]) for i, t in rows]
    options = {"hash_bits": max(bits, 1), "block_chars": 4}
    got = block_names.exact_groups(make_docs(rows, clash=True), **options).collect()
    assert len(got) == len(rows)
    want = brute_groups(rows)
    sizes = {i: (min(x for x in held if x is not None) if any(x is not None for x in held) else None, len(held)) for held in want.values() for i in held}
    for x in got:
        assert (x["keep_id"], x["group_size"]) == sizes[x["doc_id"]]
    assert sum(x["kept"] for x in got) == len(want)
    assert {x["doc_id"] for x in got if x["kept"]} == {k for k, _ in sizes.values()}


def test_keep_first_keeps_one_of_each(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = block_names.keep_first(docs).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([1, 3, 4, 5, 6, 7, 8, 10, None, 11, 12])
    assert block_names.keep_first(docs).columns == docs.columns
    assert block_names.exact_groups(docs.limit(0)).count() == 0 and block_names.keep_first(docs.limit(0)).count() == 0


def test_url_rules_against_plain_matching(spark):
    urls = [
        "http://a.example.net/en/1", "http://example.net/fr/1", "https://x.org/fr/", "https://x.org/frx", "http://EXAMPLE.com/de/?q", "http://myexample.com/de/x",
        "http://example.com/DE/x", "http://net/", "http://net", "no scheme", None, "", "://", "http://a.net?x/y", "http://cheap-pills.example.com/en/1",
        "http://x.org/fr/cheap-pills", "http://cheap-pillsx.com/", "ftp://h.org/fr/a#b", "http://u@example.com:80/de/", "http://a.example.net/en/1",
    ]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_rules.judge_urls(pages, SITE_RULES + WORD_RULES).collect()}
    assert len(got) == len(urls)
    listed = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [r for r in listed for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rule = max(fits, key=len, default=None)
        spam = re.search(r"(^|[^A-Za-z0-9])cheap-pills([^A-Za-z0-9]|$)", host + path)
        verdict = listed[rule] if rule else "block" if spam else "allow"
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict), u
    assert url_rules.judge_urls(pages.limit(0), SITE_RULES).count() == 0
    assert {r["verdict"] for r in url_rules.judge_urls(pages, []).collect()} == {"allow"}


def test_url_word_rules_on_other_hosts(spark):
    want = [
        ("http://royal-casino24.example.com/", "allow"), ("http://royal-casino.example.com/a", "block"), ("http://vip.poker.example.com/a", "block"),
        ("http://Mega-BETS.example.com/", "block"), ("http://a.example.com/shop/Diet-Pills/7", "block"), ("http://a.example.com/ADULT/", "block"),
        ("http://ads.tracker.example.com/p", "block"), ("http://tracking-ads.example.com/p", "block"), ("http://parcel-tracking.example.com/p", "allow"),
        ("http://a.example.com/ads/tracking", "allow"), ("http://a.example.com/quick_loans", "block"), ("http://a.example.com/loans", "allow"),
        ("http://no-spam.example.com/", "block"), ("http://spammy.example.com/", "allow"), ("http://abets.example.com/", "allow"), ("http://a.example.com/watch-replica.html", "block"),
        ("http://alphabets.example.com/free/money", "allow"), ("http://example.net/en/casino", "allow"),
    ]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(want)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(pages, SITE_RULES + WORD_RULES).collect()}
    assert [(u, got[i]) for i, (u, _) in enumerate(want)] == want


PAGE = """<html><body class="has-sidebar"><header><a href=/>Site name</a> <p>The daily paper, since 1900.</p></header>
<div class="nav-menu"><ul><li><a>Home</a><li><a>About</a></ul></div><div id="wrap"><div class="post-body"><h2>A headline</h2>
<p>First paragraph, with <a href=x>a link</a>, of the text. It goes on and on, with more words.<p>Second&nbsp;paragraph &lt;tag&gt; &#233;, is
here. And it has sentences, too.<ul><li>item one, yes<li>item two</ul><script>var x = "<p>no</p>";</script></div>
<div class="sidebar"><p>Related: something long that could be content, but is not. Really, it is not.</p></div>
<div class="comments"><p>User: great article, thanks a lot. I liked it, very much indeed.</p></div></div>
<div class=cookie-notice>We use cookies, and so on. Accept?</div><form><p>Subscribe, now.</p></form><footer>&copy; 2020</footer></body></html>"""


def test_main_text_of_pages():
    assert html_paths.main_text(PAGE) == (
        "A headline\n\nFirst paragraph, with a link, of the text. It goes on and on, with more words.\n\n"
        "Second paragraph <tag> é, is here. And it has sentences, too.\n\nitem one, yes\n\nitem two"
    )
    assert [html_paths.main_text(x) for x in (None, "", "just text &amp; more", "<p>a", "<nav>x</nav>", "<b" * 50)] == ["", "", "just text & more", "a", "", ""]
    deep = "<div>" * 3000 + "deep, text."
    assert html_paths.main_text(deep) == "deep, text."
    assert html_paths.main_text("<article><p>one<p>two <br>three</article>") == "one\n\ntwo three"


BODY = " ".join(f"Sentence number {i}, with words in it, and more." for i in range(6))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div class='top'><a href=/>Home</a> <a href=/a>News</a></div><div class='x1'><h1>T</h1><p>{b}</p></div><div class='x2'><ul><li><a href=1>one</a></li></ul></div><div class='z'>Copyright, all.</div>", "T|{b}"),
        ("<article><header><h1>T</h1></header><p>{b}</p><aside>Ad, here.</aside><p>x</p><section id='comments'><p>{b}</p></section><footer>Tags: a, b</footer></article>", "T|{b}|x"),
        ("<body><div class='notice'>Down, sorry.</div><main><h1>T</h1><p>{b}</p><div class='newsletter'>Get news.<form><input></form></div><p>End.</p></main></body>", "T|{b}|End."),
        ("<article><h1>T</h1><p><a href=x>{b}</a></p><ul><li><a>menu</a></li><li><a>items</a></li></ul><table><tr><td>1<td>2</table></article>", "T|{b}|menu|items|1|2"),
        ("<article><h1>T</h1><p>{b}</p><ul><li><a>A</a></li><li><a>B</a></li></ul><p>{b}</p><div><a>C</a><a>D</a></div><nav><a>E</a> <a>F</a></nav><div class='breadcrumb'>G, h.</div></article>", "T|{b}|A|B|{b}|CD"),
        ("<article><h1>T</h1><div class='post-header'><h2>S</h2></div><p>{b}</p><ins class='adsbygoogle'>x</ins><!-- <p>gone</p> --><p hidden>y</p></article>", "T|S|{b}"),
        ("<nav><ul><li>a<article><h1>T</h1><p>{b}", "T|{b}"),
        ("<div id='content'><h1>T</h1><p>{b}</p></div><div id='disqus_thread'><p>{b}</p></div>", "T|{b}"),
    ],
)
def test_main_text_of_page_shapes(page, want):
    assert html_paths.main_text(page.replace("{b}", BODY)) == want.replace("{b}", BODY).replace("|", "\n\n")


def test_main_text_of_the_pages_table(spark):
    import html

    for r in html_paths.extract_main_text(spark.read.parquet(f"{SF}/pages.parquet"), keep=("url", "html")).collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_warc_derivatives(spark):
    pages = spark.createDataFrame([(1, "http://x/", PAGE), (2, None, None), (3, "http://y/", "<title>t</title>hello <b>wörld</b>")], "page_id long, url string, html string")
    rows = warc.derive(warc.from_pages(pages), keep=["page_id"]).collect()
    assert Counter((r["page_id"], r["record_type"]) for r in rows) == Counter((i, k) for i in (1, 2, 3) for k in ("metadata", "conversion"))
    for r in rows:
        assert r["problem"] is None and r["refers_to"].startswith("<urn:uuid:") and r["block_digest"] == warc.digest(r["content"].encode())
        assert r["source_headers"]["warc:WARC-Record-ID"] == r["refers_to"] and r["content_length"] == len(r["content"].encode())
        if r["record_type"] == "metadata":
            assert f"refersTo: {r['refers_to']}" in r["content"] and r["source_payload_digest"] in r["content"]
    text = {r["page_id"]: r["content"] for r in rows if r["record_type"] == "conversion"}
    assert text[3] == "hello wörld" and text[2] == "" and "Site name" in text[1] and "var x" not in text[1]
    assert len({r["record_id"] for r in rows}) == 6


def test_warc_broken_records(spark, tmp_path):
    import gzip

    body = gzip.compress(b"<p>zipped")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: gzip\r\n\r\n" + body
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\n%sContent-Length: %d\r\n\r\n"
    good = head % (b"", len(block)) + block + b"\r\n\r\n"
    wrong = head % (b"WARC-Block-Digest: sha1:AAAA\r\n", len(block)) + block
    rows = [(0, None), (1, b"junk"), (2, good[:150]), (3, good), (4, wrong), (5, good.replace(b"response", b"request"))]
    df = spark.createDataFrame(rows, "n long, record binary").withColumnRenamed("n", "content")
    got = defaultdict(list)
    for r in warc.derive(df.withColumnRenamed("content", "n"), keep=["n"]).collect():
        got[r["n"]].append(r)
    assert [len(got[i]) for i in range(6)] == [1, 1, 1, 2, 2, 1]
    assert [got[i][0]["problem"] for i in (0, 1, 2, 5)] == ["empty record", "no WARC header", "truncated record", "not a response record"]
    assert got[3][1]["content"] == "zipped" and "does not match" in got[4][0]["problem"]
    assert warc.derive(df, keep=["content"]).count() == 8 and warc.derive(df.limit(0)).count() == 0
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(good) + gzip.compress(good))
    back = warc.read_warc(spark, str(tmp_path))
    assert back.count() == 2 and warc.derive(back).where("record_type = 'conversion' and content = 'zipped'").count() == 2
    made = warc.to_records(warc.derive(back)).first()["record"]
    assert next(warc.split_warc(bytes(made))).startswith(b"WARC/1.1\r\nWARC-Type: metadata")


def _record(http, body):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + http + b"\r\n" + body
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: %d\r\n\r\n" % len(block) + block


def test_warc_keeps_repeated_headers(spark):
    raw = _record(b"Set-Cookie: a=1\r\nVia: x\r\nset-cookie: b=2, c\r\n", b"<p>text")
    meta = warc.derive(spark.createDataFrame([(raw,)], "record binary")).where("record_type = 'metadata'").first()
    assert meta["source_headers"]["http:Set-Cookie"] == "a=1\nb=2, c" and meta["source_headers"]["http:Via"] == "x"
    assert "http:Set-Cookie: a=1\r\nhttp:Set-Cookie: b=2, c\r\n" in meta["content"] and meta["problem"] is None


def test_warc_bodies_that_go_on_or_end_early():
    import gzip

    noise = " ".join(f"{random.Random(i).random()}" for i in range(400))
    whole = gzip.compress(b"<p>first ") + gzip.compress(b"second")
    zipped, gz, ch = gzip.compress(noise.encode()), b"Content-Encoding: gzip\r\n", b"Transfer-Encoding: chunked\r\n"
    cases = [
        (gz, whole, "first second", None), (gz, whole + b"\0\0", "first second", None), (gz, whole + b"junk", "first second", "bytes after"),
        (gz, zipped[: len(zipped) // 2], None, "compressed stream ends early"), (gz, b"", "", None), (gz, zipped, noise, None),
        (ch, b"5\r\n<p>ab\r\n2;x=y\r\ncd\r\n0\r\n\r\n", "abcd", None), (ch, b"5\r\n<p>ab\r\n9\r\ncd", "abcd", "chunks end early"),
        (ch, b"5\r\n<p>ab\r\n", "ab", "chunks end early"), (gz + ch, b"%x\r\n" % len(whole) + whole + b"\r\n0\r\n\r\n", "first second", None),
    ]
    for http, body, text, problem in cases:
        made = {r[0]: r for r in warc.derivatives(_record(http, body))}
        got, said = made["conversion"][11], made["metadata"][12]
        assert got == text if text is not None else noise.startswith(got.strip()) and got
        assert said is None if problem is None else problem in said


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        assert kept.join(docs, "doc_id", "left_anti").count() == 0
        docs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
    groups = simhash.near_groups(docs)
    assert groups.where("doc_id <> component_id").count() == 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def brute_shingles(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("tile", [256, 4])
def test_near_copies_against_all_pairs(spark, make_docs, tile):
    r = random.Random(11)
    base = [f"word{r.randrange(5000)}" for _ in range(200)]
    rows = [(i, " ".join(["changed" if r.random() < (i % 12) / 400 else w for w in base])) for i in range(60)]
    rows += [(200, None), (201, ""), (202, "  "), (203, "one two"), (204, "One two"), (205, "one three")]
    rows += [(300 + i, " ".join(f"o{r.randrange(900)}" for _ in range(30))) for i in range(40)]
    got = {x["doc_id"]: x["component_id"] for x in near_copies.near_groups(make_docs(rows, clash=True), tile=tile).collect()}
    want = brute_components({i: brute_shingles(t) for i, t in rows}, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    assert 45 < len(set(want.values())) < 80 and got == want


def test_near_dedup_drops_planted_near_copies(spark, make_docs, odd_rows):
    r = random.Random(13)
    texts = [[f"w{r.randrange(4000)}" for _ in range(60 + 10 * i)] for i in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, " ".join([*t[:-1], "changed"])) for i, t in enumerate(texts)]
    rows += [(200 + i, " ".join([*t[:20], "put", "in", *t[20:]])) for i, t in enumerate(texts)]
    rows += [(300 + i, " ".join(t[: len(t) // 2] + texts[i - 1])) for i, t in enumerate(texts) if i]
    kept = {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, make_docs(rows), SF).collect()}
    assert kept == set(range(40)) | {300 + i for i in range(1, 40)}
    odd = make_docs(odd_rows, clash=True)
    left = corpus_pipeline.near_dedup(spark, odd, SF)
    assert left.columns == odd.columns and Counter(x["doc_id"] for x in left.collect()) == Counter([1, 4, 5, 8, 10, 10, None, 11, 12])


def test_near_dedup_takes_candidates_from_simhash(spark, make_docs, monkeypatch):
    r = random.Random(19)
    base = [f"w{r.randrange(4000)}" for _ in range(5000)]
    texts = [base, [*base[:-1], "changed"], [*base[:700], "put", *base[700:]], [f"w{r.randrange(4000)}" for _ in range(5000)]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    prints = [simhash.majority(near_copies.shingles(t)) for _, t in rows]
    assert all((prints[0] ^ p).bit_count() <= 2 for p in prints[1:3])
    monkeypatch.setattr(near_copies, "bands", lambda found: np.full(16, zlib.crc32(found.tobytes())))  # no two texts agree in one
    assert {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, make_docs(rows), SF).collect()} == {0, 3}


def test_fingerprints_within_two_bits_share_blocks():
    r = np.random.default_rng(3)
    for bits in ([], [5], [0, 63], [15, 16], [31, 47]):
        fp = int(r.integers(0, 1 << 63))
        other = fp
        for b in bits:
            other ^= 1 << b
        assert simhash.majority(np.array([fp], np.uint64)) == fp
        keys = near_copies.blocks(np.array([fp], np.uint64)), near_copies.blocks(np.array([other], np.uint64))
        assert (keys[0] == keys[1]).any()


def test_language_stage_drops_unlearned_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = random.Random(17)
    some = [x["text"] for x in docs.where("lang is not null and length(text) between 600 and 3000").limit(2).collect()]
    greek = " ".join("".join(r.choice("αβγδεζηθικλμνξοπρστυφχψω") for _ in range(r.randrange(2, 9))) for _ in range(120))
    russian = "Съешь же ещё этих мягких французских булок да выпей чаю, потому что вечером будет холодно и темно. " * 8
    polish = "Źdźbło trawy chwiało się przy ścieżce, a żółw szedł powoli wzdłuż brzegu jeziora, gdzie rosły wysokie trzciny. " * 8
    rows = [(900_000, greek), (900_001, russian), (900_002, polish), (900_003, some[0]), (900_004, some[0] + " " + russian[:100]), (900_005, f"{some[0]} {some[1]}")]
    new = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x["doc_id"] for x in corpus_pipeline.language_id(spark, docs.unionByName(new.select([new[c].cast(docs.schema[c].dataType) for c in docs.columns])), SF).collect()}
    assert {i for i, _ in rows} & kept == {900_003, 900_004, 900_005}
    assert docs.where("length(text) > 200").count() * 0.97 < len(kept)
