"""URL verdicts by pattern rules that are indexed by their rarest literal token; DataFrame operations only.

A rule is a regular expression over host and path with the literal tokens (runs of letters and
digits) that every matching URL must contain whole. Token counts over all URLs choose each rule's
rarest token, A-Z lower-cased; a URL's tokens fetch the rules filed under them, and only those rules' expressions
run. A rule without a token is filed under the empty token, which every URL has.

``host``: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; ``path``:
from there up to ``?``, ``#`` or the end. A null URL, or one without ``://``, has both empty.
Null URLs get the default verdict. Repeated rows each return a row, null page ids are ordinary,
extra columns are ignored, an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written

try:  # Python's own parser of regular expressions
    from re import _parser as _patterns
except ImportError:
    import sre_parse as _patterns

TOKEN = "[A-Za-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A rule index of at most this many rows is broadcast (about 100 bytes a row); a larger one is joined by shuffle.
BROADCAST_RULES = 100_000


def whole_tokens(regex: str) -> tuple[str, ...]:
    """The literal tokens that every match holds whole: runs of letters and digits between other literal characters or anchors.

    Only what must occur counts: alternatives, classes and repeats that may be empty break a run, and so does the
    start or end of an expression that isn't anchored, where a longer token may go on.
    """
    runs: list[str] = []

    def walk(items) -> None:
        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                runs.append(chr(value))
            elif name == "AT":  # a token may go on over what isn't a border
                runs.append("\0" if "NON_BOUNDARY" in str(value) else " ")
            elif name == "SUBPATTERN":
                walk(value[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] == value[1] == 1:
                walk(value[2])
            else:
                runs.append("\0")

    walk(_patterns.parse(regex))
    text = "\0" + "".join(runs) + "\0"
    found = re.finditer(f"(?<=[^\0A-Za-z0-9]){TOKEN}(?=[^\0A-Za-z0-9])", text)
    return tuple(dict.fromkeys(m[0] for m in found))


class Rule(NamedTuple):
    name: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    rank: int
    listed: bool


def site_rule(action: str, rule: str) -> Rule:
    """``host/path`` prefix rule: fits the host, its subdomains, and paths that start with the rule's path."""
    host, slash, rest = rule.partition("/")
    whole = re.findall(TOKEN, host) + [m[0] for m in re.finditer(TOKEN, slash + rest) if m.end() < len(slash + rest)]
    return Rule(rule, action, f"^([^/]*[.])?{re.escape(host)}{re.escape(slash + rest)}", tuple(whole), len(rule), True)


def pattern_rule(action: str, name: str, regex: str, rank: int = 0, listed: bool = False) -> Rule:
    """A rule of any regular expression over host and path, filed by the tokens that its matches must hold."""
    return Rule(name, action, regex, whole_tokens(regex), rank, listed)


#: Between the words of a combination: characters of one host label or path part, dots between labels included.
GAP = "[^A-Za-z0-9/]+"


def word_rule(action: str, word: str) -> Rule:
    """Words that host or path hold whole, side by side, between other characters; ``(?i:...)`` ignores case, GAP stands between words."""
    folded = word.startswith("(?i:") and word.endswith(")")
    inner = word[4:-1] if folded else word
    parts = inner.split(GAP)
    regex = GAP.join(map(re.escape, parts))
    whole = [t for p in parts for t in re.findall(TOKEN, p)]
    return Rule(" ".join(parts), action, f"(^|[^A-Za-z0-9]){'(?i:' if folded else '('}{regex})([^A-Za-z0-9]|$)", tuple(whole), 0, False)


#: Words that block a URL by themselves where no listed rule fits, by topic.
SPAM_WORDS = (
    *("casino", "casinos", "poker", "roulette", "blackjack", "jackpot", "jackpots", "gambling", "bets", "betting", "sportsbook", "bookmaker", "bookmakers"),
    *("pills", "viagra", "cialis", "levitra", "xanax", "tramadol", "phentermine"),
    *("adult", "porn", "porno", "xxx", "hentai", "nudes", "escorts", "camgirls", "milf"),
    *("spam", "spammer", "spammers", "spamming", "linkfarm", "clickbait", "malware", "warez", "keygen", "phishing"),
    *("adserver", "adservers", "adserv", "adtrack", "adtracker", "adclick", "doubleclick", "popunder", "popunders", "clicktrack", "clicktracker"),
)
#: Words that block a URL only side by side, in either order; each alone is ordinary.
SPAM_PAIRS = (
    *((a, b) for a in ("ad", "ads", "advert", "adverts", "banner", "banners", "click", "clicks") for b in ("track", "tracker", "trackers", "tracking", "server", "farm", "exchange", "redirect")),
    *((a, b) for a in ("free", "win", "online", "live", "bonus") for b in ("bet", "slots", "lottery", "spins")),
    *((a, b) for a in ("cheap", "discount", "buy", "online") for b in ("pill", "meds", "pharmacy", "steroids")),
    *((a, b) for a in ("free", "easy", "fast", "quick", "instant") for b in ("money", "cash", "loan", "loans")),
    *(("payday", b) for b in ("loan", "loans", "cash", "advance")),
    *((a, b) for a in ("replica", "fake") for b in ("watch", "watches", "rolex", "handbags", "bags")),
    *((a, b) for a in ("sex", "nude", "escort") for b in ("cam", "cams", "chat", "video", "videos", "dating", "girls", "service", "x")),
    *((a, b) for a in ("link", "seo") for b in ("farm", "farms", "exchange")),
)
#: The rules as patterns that ignore case.
SPAM_PHRASES = tuple(f"(?i:{p})" for p in (*SPAM_WORDS, *(GAP.join(x) for a, b in SPAM_PAIRS for x in ((a, b), (b, a)))))


def url_parts(url: str | Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per page: (id, host, path, rule, verdict).

    Of the rules that match, the highest rank wins, then the name. ``rule`` is the winner's name if it
    is a listed rule, else null; ``verdict`` is the winner's action, else ``default``.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(f"`{url_col}`"))
    base = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    if not rules:
        return base.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    site = F.concat("host", "path")
    folded = F.translate("site", UPPER, LOWER)
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0))))
    urls = base.withColumn("site", site).select("site").distinct()
    tokened = urls.select("site", F.explode(tokens.alias("t")).alias("token"))
    table = spark.createDataFrame(
        [(i, *r._replace(tokens=tuple(t.lower() for t in r.tokens))) for i, r in enumerate(rules)],
        "rule_id long, name string, action string, regex string, tokens array<string>, rank int, listed boolean",
    )
    needed = table.select("rule_id", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    small = len(rules) <= BROADCAST_RULES
    wanted = needed.select("token").distinct()
    counts = tokened.join(F.broadcast(wanted) if small else wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    filed = needed.join(counts, "token", "left").groupBy("rule_id").agg(
        F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")
    )
    index, _ = written(table.drop("tokens").join(filed, "rule_id"), "rules")
    fetched = tokened.join(F.broadcast(index) if small else index, "token").where(F.expr("site rlike regex"))
    best = fetched.groupBy("site").agg(
        F.max_by(F.struct("name", "action", "listed"), F.struct("rank", "name")).alias("win")
    )
    best, _ = written(best.select("site", "win.*").withColumnRenamed("name", "rule"), "verdicts")
    # By shuffle at every size: the judged sites grow with the pages.
    met = base.withColumn("site", site).join(best.hint("merge"), "site", "left")
    return met.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.when(F.col("listed"), F.col("rule")).alias("rule"),
        F.coalesce("action", F.lit(default)).alias("verdict"),
    )
