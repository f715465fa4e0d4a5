"""The text operators' methods against slow, independent versions, on long and adversarial texts, and with clashing columns."""

import gzip
import html
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import block_names, html_paths, language_mix, near_copies, packing, quality_bits, queries, simhash, sp_bpe, url_rules, warc

SF = "/root/testdata/sf0.001"
BODY = " ".join(f"Sentence number {i}, with words in it, and more." for i in range(6))


def slow_values(nodes, smoothing):
    """The path values by loops over path texts."""
    key = [(html_paths.path_of(n.element), n.element.lowered) for n in nodes]
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~。、，；：？！…«»“”‘’„¿¡—–"
    fused = {}
    for k in set(key):
        own = [n for n, x in zip(nodes, key, strict=True) if x == k]
        fused[k] = ((sum(len(n.text.strip()) for n in own) / len(own)) * (sum(c in marks for n in own for c in n.text) / len(own) + 0.1)) ** 0.5
    out, half = {}, len(smoothing) // 2
    for k in fused:
        total, links, menus, size = 0.0, 0, 0, 0
        places = [i for i, x in enumerate(key) if x == k]
        for i in places:
            near = [fused[key[min(max(i + d, 0), len(key) - 1)]] for d in range(-half, half + 1)]
            total += sum(a * b for a, b in zip(near, smoothing, strict=True)) / sum(smoothing)
            size += nodes[i].size
            links += nodes[i].size * nodes[i].element.link
            menus += nodes[i].size * nodes[i].element.menu
        out[k] = 0.5 * (total / len(places) + fused[k]) * (1 - links / size) * (1 - 0.95 * menus / size) * (0.05 if k[1] else 1.0)
    return out


def test_path_values_against_loops(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").limit(15).collect()]
    pages.append(f"<nav><a>x</a> y</nav><div class='a b'><h1>T</h1><p>{BODY}<p><b>Bold</b>, one.</div><div class=ad>Buy, now!</div><ul><li><a>l</a><li>m</ul>")
    for page in pages:
        nodes = [n for n in html_paths.parse(page) if n.size]
        names = {n.path: (html_paths.path_of(n.element), n.element.lowered) for n in nodes}
        got = {names[k]: v for k, v in html_paths.path_values(nodes, (1, 2, 4, 2, 1)).items()}
        want = slow_values(nodes, (1, 2, 4, 2, 1))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


SHAPES = {
    "has-sidebar": (f"<div class='layout has-sidebar'><article><h1>T</h1><p>{BODY}</p></article></div>", f"T|{BODY}"),
    "apostrophe": (f"<article><h1>T</h1><div data-x=it's><p>{BODY}</p><p>Second, para.</p></div><p>it's</p></article>", f"T|{BODY}|Second, para.|it's"),
    "share price": (f"<article><h1>T</h1><p>{BODY}</p><p class='share-price'>Shares rose.</p><p id='search-for-gold'>Gold, found.</p></article>", f"T|{BODY}|Shares rose.|Gold, found."),
    "deep advert": ("<div>" * 300 + f"<article><h1>T</h1><p>{BODY}</p><div class=advert>Buy now, cheap.</div></article>", f"T|{BODY}"),
    "one form": (f"<form id=aspnetForm><div id=content><h1>T</h1><p>{BODY}</p></div><div class='footer'>x, y</div></form>", f"T|{BODY}"),
    "many comments": (f"<div id=content><h1>T</h1><p>{BODY}</p></div><section class=comments>" + f"<article class=comment-body><p>{BODY}</p></article>" * 9 + "</section>", f"T|{BODY}"),
    "plain blocks": (f"<div class=top><a href=/>Home</a> | <a href=/b>B</a></div><h1>Title</h1><div class=c><p>{BODY}</p><p>Short.</p></div><div class=bottom-bar>All, rights.</div>", f"Title|{BODY}|Short."),
    "wrappers": (f"<div class='site-wrapper page'><div class='header-wrap'><a>x</a></div><div class='main-content'><h2>T</h2><p>{BODY}</p><div class='ad-slot'>Ad, text.</div></div><div class='widget-area'><p>Recent, posts. Some.</p></div></div>", f"T|{BODY}"),
}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_main_text_keeps_the_article(name):
    page, want = SHAPES[name]
    assert html_paths.main_text(page) == want.replace("|", "\n\n")


def test_path_values_decide(monkeypatch):
    """With the ratios constant and the factor of lowered paths kept, the texts change: on the given pages, and on most shapes."""
    around = f"<nav>Home, news, and more. {BODY[:90]}</nav>{{}}<footer>Imprint, terms, and all. {BODY[:120]}</footer>"
    pages = [around.format(page) for page, _ in SHAPES.values()] + [around.format(f"<div><p>{BODY}</p></div>"), around.format(f"<section><p>{BODY}</p></section><aside>Side, bar.</aside>")]
    given = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    before = [html_paths.main_text(p) for p in pages + given]
    monkeypatch.setattr(html_paths, "path_values", lambda nodes, smoothing: {n.path: html_paths.LOWERED if n.path[1] else 1.0 for n in nodes})
    after = [html_paths.main_text(p) for p in pages + given]
    changed = [a != b for a, b in zip(before, after, strict=True)]
    assert sum(changed[: len(pages)]) > len(pages) / 2 and sum(changed[len(pages) :]) > 0.9 * len(given)


def slow_text(page):
    """The choice of text written out over all elements; null where no article or main element holds most of the content."""
    nodes = [n for n in html_paths.parse(page) if n.text]
    solid = [n for n in nodes if n.text.strip()]
    marked = lambda n: n.element.lowered or n.element.menu
    if all(map(marked, solid)):
        return ""
    named = slow_values(solid, (1, 2, 4, 2, 1))
    value = {id(n): named[html_paths.path_of(n.element), n.element.lowered] for n in solid}
    values = list(value.values())
    mean = sum(values) / len(values)
    spread = (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5
    top = max(values)
    limit = min(max(0.8 * spread, 0.1 * top), top)
    limits = limit - 1e-9 * top
    content = {id(n) for n in solid if value[id(n)] >= limits}
    paths = {(html_paths.path_of(n.element), n.element.lowered) for n in solid if id(n) in content}
    is_content = lambda n: (html_paths.path_of(n.element), n.element.lowered) in paths

    def around(e):
        while e is not None:
            yield e
            e = e.parent

    counted = [n for n in solid if id(n) in content and not n.element.link] or [n for n in solid if id(n) in content]
    total = sum(n.size for n in counted)
    elements = {id(e): e for n in counted for e in around(n.element)}.values()
    enough = [e for e in elements if sum(n.size for n in counted if any(x is e for x in around(n.element))) >= 0.9 * total]
    best = max(enough, key=lambda e: e.depth)
    grown = [e for e in around(best) if e.tag in ("article", "main") and not e.own]
    if not grown:
        return None
    best = grown[-1]
    inside = lambda n: any(x is best for x in around(n.element))
    own = [n for n in solid if inside(n) and id(n) in content]
    mean = sum(value[id(n)] * n.size for n in own) / sum(n.size for n in own)
    beside = {(html_paths.path_of(n.element), n.element.lowered) for n in solid if id(n) in content and value[id(n)] >= mean * (1 - 1e-9)}
    kept = [n for n in nodes if (is_content(n) or not marked(n) if inside(n) else (html_paths.path_of(n.element), n.element.lowered) in beside)]
    blocks = {}
    for n in kept:
        blocks.setdefault(n.block, []).append(n.text)
    with_text = [" ".join("".join(t).split()) for _, t in sorted(blocks.items())]
    return "\n\n".join(b for b in with_text if b)


def test_the_choice_of_text_equals_a_slow_version():
    r = random.Random(9)
    said = lambda n: " ".join(f"word{r.randrange(50)}" + r.choice(("", "", ",", ".")) for _ in range(n))
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()
    for _ in range(150):
        article = "".join(r.choice(("<p>{}</p>", "<h2>{}</h2>", "<ul><li><a>{}</a><li>{}</ul>", "<p class=ad>{}</p>", "<nav><a>{}</a></nav>", "<div><p>{}</p></div>", "<blockquote>{}</blockquote>")).replace("{}", said(r.randrange(1, 40))) for _ in range(r.randrange(1, 8)))
        beside = lambda: r.choice(("<nav><a>{}</a></nav>", "<div class=sidebar><p>{}</p></div>", "<div><p>{}</p></div>", "<div><a>{}</a></div>", "<footer>{}</footer>")).replace("{}", said(r.randrange(1, 30)))
        pages.append(f"<body>{beside()}<{(tag := r.choice(('article', 'main')))}><h1>{said(4)}</h1><p>{said(60)}.</p><p>{said(50)}.</p>{article}</{tag}>{beside()}{beside()}</body>")
    texts = [slow_text(page) for page in pages]
    assert sum(t is not None for t in texts) > 0.7 * len(pages)
    for page, want in zip(pages, texts):
        assert want is None or html_paths.main_text(page) == want, page


def test_deep_and_broken_pages_are_quick():
    began = time.time()
    assert html_paths.main_text("<div>" * 100_000 + "x, y") == "x, y"
    for piece in ("<b>", "</x>", "<li>", "<p><b>", "<a href='", "&amp;", "<!--", "<td>", "<article>", "<form>"):
        html_paths.main_text(piece * 20_000)
    assert time.time() - began < 20


class Visible(HTMLParser):
    """Text of a page by Python's own parser: blocks at every tag that isn't inline."""

    def __init__(self):
        super().__init__()
        self.blocks, self.skip = [[]], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")
        if tag == "br":
            self.blocks[-1].append(" ")
        elif tag not in ("b", "a"):
            self.blocks.append([])

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")
        if tag not in ("b", "a", "br"):
            self.blocks.append([])

    def handle_data(self, data):
        if not self.skip:
            self.blocks[-1].append(data)


def test_warc_conversion_against_another_parser(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in warc.derive(warc.from_pages(pages), keep=["page_id"]).where("record_type = 'conversion'").collect()}
    for r in pages.collect():
        page = Visible()
        page.feed(r["html"])
        want = "\n\n".join(x for x in (" ".join("".join(b).split()) for b in page.blocks) if x)
        made = got[r["page_id"]]
        assert made["content"] == want and made["target_uri"] == r["url"] and made["source_payload_digest"] == warc.digest(r["html"].encode())


def test_warc_files_of_many_members(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>page %06d"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%06d>\r\nContent-Length: %d\r\n\r\n"
    made = []
    for i in range(10_000):
        body = block % i
        made.append(gzip.compress(record % (i, len(body)) + body + b"\r\n\r\n", 1))
    (tmp_path / "many.warc.gz").write_bytes(b"".join(made))
    began = time.time()
    found = warc.derive(warc.read_warc(spark, str(tmp_path))).where("record_type = 'conversion'").agg(F.count("*"), F.min("content"), F.max("content"), F.count_distinct("content")).first()
    assert tuple(found) == (10_000, "page 000000", "page 009999", 10_000) and time.time() - began < 60
    assert [(len(list(warc.split_warc(m))), p is None) for m, p in warc.members(b"".join(made[:3])[:-5])] == [(1, True), (1, True), (1, False)]


def test_damaged_and_padded_warc_files(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>page %02d " + b"x" * 400
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%02d>\r\nContent-Length: %d\r\n\r\n"
    made = [gzip.compress(record % (i, len(block % i)) + block % i + b"\r\n\r\n") for i in range(5)]
    broken = bytearray(made[1])
    broken[len(broken) // 2] ^= 0xFF
    files = {
        "damaged": (b"".join([made[0], bytes(broken), *made[2:]]), 4, 1), "padded": (made[0] + b"\0\0" + made[1] + b"\0" * 600 + made[2], 3, 0), "junk": (made[0] + b"junk" + made[1], 2, 1),
        "cut": (made[0] + made[1][:-6], 1, 1), "gone": (made[0][:20] + made[1], 1, 1), "trailing": (made[0] + b"\0" * 5, 1, 0), "head": (b"\x1f\x8bxx" + made[2], 1, 1),
    }
    for name, (data, whole, wrong) in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc.gz").write_bytes(data)
        rows = warc.read_warc(spark, str(tmp_path / name)).collect()
        assert (sum(r["problem"] is None for r in rows), sum(r["problem"] is not None for r in rows)) == (whole, wrong), name
        assert all(r["record"].startswith(b"WARC/1.0") for r in rows if r["problem"] is None)
    derived = warc.derive(warc.read_warc(spark, str(tmp_path / "damaged")), keep=["path"])
    assert derived.where("record_type = 'conversion' and problem is null").count() == 4


def test_tokens_beside_what_is_no_border():
    assert url_rules.whole_tokens(r"\bads\b") == ("ads",) and url_rules.whole_tokens(r"\Bads\b") == url_rules.whole_tokens(r"\bads\B") == ()
    assert url_rules.whole_tokens(r"\Bads/track\b") == ("track",)


def test_mixtures_against_plain_em():
    r = random.Random(6)
    model = language_mix.Model(["a", "b", "c"], np.log(np.random.default_rng(1).dirichlet(np.ones(language_mix.BUCKETS), 3)).astype(np.float32))
    texts = [" ".join("".join(r.choice("abcdefg") for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 40))) for _ in range(8)]
    got = language_mix.mixtures(texts, model, 3, 1.0, 6)
    for text, shares in zip(texts, got, strict=True):
        tri, starts = language_mix._trigrams(text)
        words = [tri[a:b] for a, b in zip(starts, [*starts[1:], len(tri)], strict=True)]
        logs = [[sum(float(model.log_p[k][t]) for t in w) for k in range(3)] for w in words]
        p = [[2.718281828459045 ** (x - max(row)) + 1e-12 for x in row] for row in logs]

        def em(share, rounds):
            for _ in range(rounds):
                parts = [[q * s for q, s in zip(row, share, strict=True)] for row in p]
                share = [sum(row[k] / sum(row) for row in parts) / len(p) for k in range(3)]
            return share, sum(float(np.log(sum(q * s for q, s in zip(row, share, strict=True)))) for row in p)

        first, _ = em([1 / 3] * 3, 6)
        order, best, chosen = sorted(range(3), key=lambda k: (-first[k], k)), -np.inf, first
        for size in (1, 2, 3):
            start = [first[k] + 1e-6 if k in order[:size] else 0.0 for k in range(3)]
            kept, fitted = em([s / sum(start) for s in start], 6 if size > 1 else 1)
            value = fitted - size * np.log(len(p) + 1)
            if value > best:
                best, chosen = value, kept
        assert list(shares) == pytest.approx(chosen, abs=1e-4)


LONG = {"spaces": " " * 200_000 + "x", "letters": "".join(random.Random(1).choice("abcdefghij") for _ in range(200_000)), "lines": "\n" * 100_000 + "x y", "divs": "<div>" * 300 + "deep, text"}


def test_long_texts_in_every_operator(spark, make_docs):
    docs = make_docs([(i, t) for i, t in enumerate(LONG.values())])
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x/").alias("url"), F.col("text").alias("html"))
    assert warc.derive(warc.from_pages(pages)).count() == 8 and html_paths.extract_main_text(pages).where("n_chars > 0").count() == 4
    model = language_mix.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    assert language_mix.predict(docs, model).where("lang_pred <> 'und'").count() == 4
    assert quality_bits.ledger(docs).count() == 4
    assert simhash.near_groups(docs).select("component_id").distinct().count() == 4 and near_copies.near_groups(docs).count() == 4
    assert block_names.exact_groups(docs).where("kept").count() == 4
    path = queries.public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    assert {r["doc_id"]: r["n_tokens"] for r in sp_bpe.encode_decode(docs, path).collect()} == {i: len(lib.encode(t)) for i, t in enumerate(LONG.values())}
    files = queries.byte_bpe_files()
    slow = packing.ByteBpe(files[0])
    got = packing.pack(docs, lambda: packing.byte_bpe(*files), 1).groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert {r["doc_id"]: r["n"] for r in got.collect()} == {i: len(slow.ids(t)) + 1 for i, t in enumerate(LONG.values())}


def test_space_runs_merge_as_the_library_does():
    import sentencepiece

    path = queries.public_tokenizers.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), sp_bpe.piece_bpe(path)
    for n in (31, 32, 33, 63, 64, 65, 200, 1001):
        for tail in ("", "x", "the", " ", "▁y"):
            assert own.encode("ab" + " " * n + tail) == lib.encode("ab" + " " * n + tail)
    began = time.time()
    assert own.encode(" " * 1_000_000 + "x") == lib.encode(" " * 1_000_000 + "x") and time.time() - began < 60


def test_long_space_takes_the_exact_library():
    files = queries.byte_bpe_files()
    fast, slow = packing.ByteBpe(*files), packing.ByteBpe(files[0])
    for t in (" " * 1_000_001 + "x", "x" + "\n" * 300 + "y", " \t" * 200 + "z"):
        assert fast.ids(t) == slow.ids(t)


def test_whole_tokens_of_patterns():
    for regex, want in ((r"(^|[^a])/ads/(banner|b)/top/", ("ads", "top")), (r"^example\.com/de/", ("example", "com", "de")), (r"/a+/b/", ("b",)), (r"(?:foo)?/bar[.]", ("bar",)), (r"/x{2}/y/", ("y",)), (r"(?i)/Big/", ("Big",)), (r"free", ()), (r"a|b", ())):
        assert url_rules.whole_tokens(regex) == want, regex


def test_ten_thousand_rules_against_plain_matching(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rules = []
    for i in range(10_000):
        a, b = r.choice(words), r.choice(words)
        regex = [rf"^{a}\.[a-z]+/{b}/", rf"/{a}/[0-9]+/{b}\.html", rf"(^|[.]){a}\.com/", rf"[?/]{a}-{b}/"][i % 4]
        rules.append(url_rules.pattern_rule("block" if i % 3 else "allow", f"r{i:05d}", regex, rank=i % 7, listed=True))
    urls = [f"http://{r.choice(words)}.com/{r.choice(words)}/" for _ in range(200)] + [f"http://x.{r.choice(words)}.com/{r.choice(words)}/{r.randrange(99)}/{r.choice(words)}.html" for _ in range(200)] + ["http://none.org/", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x["page_id"]: (x["rule"], x["verdict"]) for x in url_rules.judge_urls(pages, rules).collect()}
    compiled = [(x, re.compile(x.regex)) for x in rules]
    hits = 0
    for i, u in enumerate(urls):
        site = u.split("://", 1)[1] if u else ""
        fits = [x for x, p in compiled if p.search(site)]
        win = max(fits, key=lambda x: (x.rank, x.name), default=None)
        hits += win is not None
        assert got[i] == ((win.name, win.action) if win else (None, "allow"))
    assert hits > 100


def test_clashing_columns_survive_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 400").limit(60)
    for name in ("score", "n_words", "lang_pred", "shares", "failed_bits", "fp", "node", "h", "bands", "id"):
        docs = docs.withColumn(name, F.concat(F.lit(f"{name}-"), F.col("doc_id").cast("string")))
    want = {r["doc_id"]: tuple(r) for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and all(want[r["doc_id"]] == tuple(r) for r in kept.collect())


def test_near_dedup_drops_rows_not_ids(spark, make_docs):
    r = random.Random(2)
    text = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(80))
    a, b, c = text(), text(), text()
    docs = make_docs([(1, a), (5, a + " end"), (5, b), (7, c), (7, c + " end"), (None, c), (None, a)])
    for kept in (corpus_pipeline.near_dedup(spark, docs, SF).collect(), near_copies.keep_one(docs, tile=2).collect()):
        assert Counter(x["doc_id"] for x in kept) == Counter([1, 5, 7]) and {x["text"] for x in kept if x["doc_id"] == 5} == {b}


def test_rule_ablation_query(spark):
    got = {r["rule"]: r for r in queries.rule_ablation(spark, SF).collect()}
    bits = [r["failed_bits"] for r in queries.op4_rule_ledger(spark, SF).collect()]
    assert len(got) == len(quality_bits.RULES) and all(got[x.name]["n_failed"] == sum(b >> i & 1 for b in bits) for i, x in enumerate(quality_bits.RULES))
    assert html.unescape("&amp;") == "&"
