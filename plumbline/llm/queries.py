"""The text operators' registered queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import block_names, chat_format, html_paths, importance, language_mix, packing, phrases, quality_bits, simhash, sp_bpe, toxicity, url_rules, warc
from plumbline.llm.common import table

#: Id that ends a packed document.
END_ID = 1
#: The listed site rules of op9, host and path prefix.
SITE_RULES = [
    url_rules.site_rule("block", "net/"),
    url_rules.site_rule("allow", "example.net/en/"),
    url_rules.site_rule("block", "example.com/de/"),
    url_rules.site_rule("allow", "org/fr/"),
]
WORD_RULES = [url_rules.word_rule("block", p) for p in url_rules.SPAM_PHRASES]


def byte_bpe_files() -> tuple[str, str, str]:
    """Paths of the byte-level vocabulary, its ranks, and the pattern of its words."""
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.derive(warc.from_pages(pages), keep=["page_id"])


def op2_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paths.extract_main_text(table(spark, sf_dir, "pages"))


def _held_out():
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(5)) == 0


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_mix.fit(docs.where(~_held_out()))
    found = language_mix.predict(docs, model)
    return found.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "shares")


def op4_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_bits.ledger(table(spark, sf_dir, "documents"))
    found = quality_bits.apply_policy(found, quality_bits.POLICIES["base"], into="base_kept")
    found = quality_bits.apply_policy(found, quality_bits.POLICIES["v1"])
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "failed_bits"
    )


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 fails, alone or with others, and what would stay without it, over all documents."""
    return quality_bits.ablation(quality_bits.ledger(table(spark, sf_dir, "documents")), quality_bits.POLICIES["v1"])


def op5_chat_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat_format.chat_digests(rows.union(more))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op8_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = byte_bpe_files()
    return packing.pack(table(spark, sf_dir, "documents"), lambda: packing.byte_bpe(*files), END_ID)


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), SITE_RULES + WORD_RULES)


def op10_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.exact_groups(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs.where(~_held_out()), table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_warc_derivatives, op2_tag_path_text, op3_language_mixture, op4_rule_ledger, op5_chat_rendering,
        op6_sentencepiece, op7_simhash_groups, op8_cost_packing, op9_url_rules, op10_exact_groups, op11_importance_resampling, op12_toxicity,
        op13_phrase_collocations, rule_ablation, pipeline,
    ]
    return {f.__name__: f for f in found}


_WORD_PATTERN = "|".join(f"(^|[^A-Za-z0-9]){p}([^A-Za-z0-9]|$)" for p in url_rules.SPAM_PHRASES)

OP9_SQL = f"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host || path, '{_WORD_PATTERN}') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""

OP10_SQL = r"""
WITH plain AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM plain WINDOW w AS (PARTITION BY t)
"""

OP4_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), often AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), inside AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM often, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id
), measured AS (
  SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    len(l) AS n_lines,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper_words,
    strlen(regexp_replace(t, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) AS n_letter_bytes,
    strlen(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS n_word_bytes
  FROM words LEFT JOIN inside ON words.doc_id = inside.doc_id
), failed AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
    + 8 * (2 * n_dup_lines > n_lines AND n_lines >= 4)::INT + 16 * (2 * n_upper_words > n_words)::INT
    + 32 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT + 64 * (10 * n_letter_bytes < 6 * n_word_bytes)::INT AS BIGINT) AS failed_bits
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM failed
"""


ABLATION_SQL = OP4_SQL.split("SELECT doc_id, n_words, word_chars")[0] + ", rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{r.name}', {1 << i})" for i, r in enumerate(quality_bits.RULES)) + """) r(rule, bit))
SELECT rule, sum((failed_bits & bit <> 0)::INT)::BIGINT AS n_failed, sum((failed_bits = bit)::INT)::BIGINT AS n_only, sum((failed_bits = 0)::INT)::BIGINT AS n_kept, sum((failed_bits & ~CAST(bit AS BIGINT) = 0)::INT)::BIGINT AS n_kept_without
FROM failed, rules GROUP BY rule
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 is computed bit by bit for the 256 bytes, and then byte by byte for each feature.
OP11_SQL = rf"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS steps
  FROM (SELECT unnest(range(256)) AS b)
), words AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), found AS (
  SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words
), placed AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(f) + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, steps[xor(c, b) % 256 + 1]))) % 10000 AS bucket
  FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM found)), crc
), counts AS (
  SELECT bucket, sum((side = 0)::INT)::DOUBLE AS s, sum((side = 1)::INT)::DOUBLE AS t FROM found JOIN placed USING (f) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM counts
), weights AS (
  SELECT id, count(*) AS n, sum(gain) AS g FROM found JOIN placed USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY id
), scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight,
    coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (id) WHERE side = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS i, count(*) OVER (PARTITION BY n_words >= 20) AS able FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND i <= 25 * able // 100 THEN i END AS rank FROM ranked
"""

OP13_SQL = rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY ALL
), totals AS (SELECT lang, sum(a)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang
), often AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE a >= 10
), inner_pairs AS (
  SELECT lang, phrase, max(a) AS m FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM often WHERE k = 3) GROUP BY ALL
), cuts AS (
  SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:k], ' ') AS rest
  FROM (SELECT o.*, unnest(range(1, k)) AS c FROM often o LEFT JOIN inner_pairs USING (lang, phrase) WHERE k > 1 AND coalesce(100 * m < 50 * a, true))
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, c, x.a AS l, y.a AS r, (1000000::HUGEINT * cuts.a * cuts.a // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts JOIN often x ON x.lang = cuts.lang AND x.phrase = head JOIN often y ON y.lang = cuts.lang AND y.phrase = rest
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest JOIN totals USING (lang) QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "rule_ablation": ABLATION_SQL,
        "op4_rule_ledger": OP4_SQL,
        "op9_url_rules": OP9_SQL,
        "op10_exact_groups": OP10_SQL,
        "op11_importance_resampling": OP11_SQL,
        "op13_phrase_collocations": OP13_SQL,
    }
