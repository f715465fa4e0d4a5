"""Quality rules as a ledger of failure bits, policies over the ledger, and ablations of policies.

``ledger`` measures each text once, evaluates every rule on the measurements and stores the failures
as bits of one integer beside the measurements. ``apply_policy`` keeps a document whose bits don't
meet a policy's mask; a policy is a version name and the rules it uses, so that a new version needs
no new pass over the texts. ``ablation`` counts from the ledger, for each rule of a policy, the
documents that the rule fails, those that it alone fails, and what would stay without it.

Words are runs of characters other than ASCII white space. A null or empty text has no words and
fails ``few_words``. Repeated rows each return a row; an empty table gives an empty ledger, and an
ablation with zero counts. Input columns named like a measurement give way to it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import map_column

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_letter_bytes", "n_word_bytes")
_SPACE = b" \t\n\x0b\x0c\r"
_NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())


class Rule(NamedTuple):
    """A rule fails a document where ``fails`` holds on the measurements."""

    name: str
    fails: Callable[[], Column]


#: Bit i of the ledger is rule i. Rules are only ever appended, so that stored bits keep their meaning.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda: F.col("n_words") < 50),
    Rule("repeated_words", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    Rule("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("repeated_lines", lambda: (2 * F.col("n_dup_lines") > F.col("n_lines")) & (F.col("n_lines") >= 4)),
    Rule("shouting", lambda: 2 * F.col("n_upper_words") > F.col("n_words")),
    Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
    Rule("letters", lambda: 10 * F.col("n_letter_bytes") < 6 * F.col("n_word_bytes")),
)
#: Policies by version: the names of the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(r.name for r in RULES),
}


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    n_symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    n_dup_lines = len(lines) - len(set(lines))
    n_upper = sum(w.isupper() for w in words)
    packed = raw.translate(None, _SPACE)
    return (n, word_chars, n_symbols, n_dup_lines, _repeated(words), len(lines), n_upper, len(raw.translate(None, _NOT_LETTERS)), len(packed))


def _repeated(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs at least twice, all its occurrences included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    inside = bytearray(len(words))
    for i, w in enumerate(windows):
        if w in often:
            inside[i : i + 3] = b"\1\1\1"
    return sum(inside)


def ledger(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """``keep`` columns, the measurements, and ``failed_bits``: bit i is set where rule i fails."""
    if len(rules) > 63:
        raise ValueError("a ledger holds 63 rules")

    def make():
        return lambda texts: list(zip(*map(measure, texts), strict=True))

    fields = [T.StructField(m, T.LongType()) for m in MEASURES]
    kept = [c for c in keep if c.lower() != "failed_bits"]
    measured = map_column(docs, text_col, make, fields, kept)
    bits = sum((F.when(r.fails(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)), F.lit(0).cast("long"))
    return measured.withColumn("failed_bits", bits)


def mask_of(policy: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    place = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << place[name] for name in set(policy))


def apply_policy(found: DataFrame, policy: Sequence[str], rules: Sequence[Rule] = RULES, into: str = "kept") -> DataFrame:
    """The ledger with a boolean column: no rule of the policy fails."""
    return found.withColumn(into, F.col("failed_bits").bitwiseAND(F.lit(mask_of(policy, rules))) == 0)


def ablation(found: DataFrame, policy: Sequence[str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per rule of the policy: (rule, n_failed, n_only, n_kept, n_kept_without).

    Documents are first counted by their bits, of which there are few, so one small table answers all rules.
    """
    mask = mask_of(policy, rules)
    counts = found.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    places = [(r.name, i) for i, r in enumerate(rules) if r.name in set(policy)]
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0).cast("long"))
    per_rule = [
        F.struct(
            F.lit(name).alias("rule"),
            total(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0).alias("n_failed"),
            total(F.col("bits") == 1 << i).alias("n_only"),
            total(F.col("bits") == 0).alias("n_kept"),
            total(F.col("bits").bitwiseAND(F.lit(mask & ~(1 << i))) == 0).alias("n_kept_without"),
        )
        for name, i in places
    ]
    return counts.agg(F.array(*per_rule).alias("r")).select(F.inline("r"))
