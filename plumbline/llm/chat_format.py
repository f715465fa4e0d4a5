"""Chat formatting with a template seen only through its output: incremental rendering.

A template renders a list of turns to one string. ``locate`` renders the prefixes of a conversation,
compares each output with the one before to find the turn's span, and marks templates that rewrite
history, where an output no longer begins with the one before. Inside a span the text is found by
rendering the turn with two probe texts: their common prefix is the turn's head and their common
suffix its tail. The loss mask covers the texts of assistant turns and nothing else.

``ChatTemplate`` marks turns with control strings and escapes such strings inside roles and texts
reversibly: one backslash goes after a control string's first character, and into strings that
already look like that, so that unescaping takes exactly one away.

Turns are ordered by turn number (nulls first), then role, then text; turns with equal numbers and
repeated rows all stay. Null roles and texts count as empty. A null conv_id is a conversation of its
own. Prefix rendering copies a conversation once for each of its turns. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import map_column

Turns = list[tuple[str, str]]
#: First characters and rests of the control strings of common chat formats.
CONTROL = (
    ("<", "s>"), ("<", "/s>"), ("<", "|start|>"), ("<", "|end|>"), ("<", "|im_start|>"), ("<", "|im_end|>"), ("<", "|endoftext|>"),
    ("[", "INST]"), ("[", "/INST]"),
)
_RESTS = {head: "|".join(re.escape(r) for h, r in CONTROL if h == head) for head, _ in CONTROL}
_ESCAPE = re.compile("|".join(rf"(?<={re.escape(h)})\\*(?={'' if not r else f'(?:{r})'})" for h, r in _RESTS.items()))
_UNESCAPE = re.compile("|".join(rf"(?<={re.escape(h)})\\(?=\\*(?:{r}))" for h, r in _RESTS.items()))


#: Rendered turns that a template remembers.
REMEMBERED_TURNS = 4096


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub("", text)


class ChatTemplate:
    """``<|start|>role newline text <|end|> newline`` for each turn."""

    def __init__(self):
        self._known: dict[tuple[str, str], str] = {}

    def render(self, turns: Turns) -> str:
        return "".join([self._turn(r, t) for r, t in turns])

    def _turn(self, role: str, text: str) -> str:
        """One turn; those of the conversation at hand are remembered, since every prefix repeats them."""
        known = self._known.get((role, text))
        if known is None:
            if len(self._known) >= REMEMBERED_TURNS:
                self._known.clear()
            known = self._known[role, text] = f"<|start|>{self.plain_role(role)}\n{escape(text)}<|end|>\n"
        return known

    def plain_role(self, role: str) -> str:
        return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))

    def role_of(self, head: str) -> str:
        """The role that a turn's head names."""
        raw = unescape(head.removeprefix("<|start|>").removesuffix("\n"))
        return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", raw)


class Span(NamedTuple):
    start: int
    end: int
    text_start: int
    text_end: int


def _common(a: str, b: str, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` characters are known to agree."""
    low, high = known, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def locate(render: Callable[[Turns], str], turns: Turns) -> tuple[str, list[Span], list[int]]:
    """The full output, a span for each turn, and the numbers of the turns whose rendering rewrote history.

    Spans of turns before a rewrite are positions in the output in which they first appeared; they hold
    for the full output exactly when the list of rewrites is empty.
    """
    before, spans, rewrites = "", [], []
    for k in range(len(turns)):
        head, (role, _) = turns[:k], turns[k]
        now = render(turns[: k + 1])
        one, two = render([*head, (role, "a")]), render([*head, (role, "b")])
        start = len(before)
        if not now.startswith(before):
            rewrites.append(k)
            start = _common(before, now)
        shared = start if one.startswith(now[:start]) and two.startswith(now[:start]) else 0
        first = _common(one, two, shared)
        tail = _common(one[first:][::-1], two[first:][::-1])
        spans.append(Span(start, len(now), first, len(now) - tail))
        before = now
    return before, spans, rewrites


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def read_back(template, turns: Turns) -> tuple:
    """What the formatted output itself says: turns, texts under the loss mask, and their digests."""
    out, spans, rewrites = locate(template.render, turns)
    seen, loss = [], []
    for s in spans:
        role, text = template.role_of(out[s.start : s.text_start]), unescape(out[s.text_start : s.text_end])
        seen.append(f"{role}\n{text}\n")
        if role == "assistant":
            loss.append(text)
    masked = "".join(loss)
    return len(seen), _digest("".join(seen)), len(masked), _digest(masked), len(out), bool(rewrites)


def _gathered(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    turn = F.struct(
        F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    return rows.groupBy(F.col(f"`{conv_col}`").alias(conv_col)).agg(F.array_sort(F.collect_list(turn)).alias("__turns"))


def format_chats(
    rows: DataFrame, template=None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: (conv_id, formatted, spans, rewrites); loss spans have ``loss`` true."""
    template = template or ChatTemplate()
    span = T.StructType(
        [T.StructField(n, T.LongType()) for n in Span._fields] + [T.StructField("role", T.StringType()), T.StructField("loss", T.BooleanType())]
    )
    fields = [
        T.StructField("formatted", T.StringType()),
        T.StructField("spans", T.ArrayType(span)),
        T.StructField("rewrites", T.ArrayType(T.LongType())),
    ]

    def make():
        def work(chats: list) -> list:
            out = []
            for chat in chats:
                turns = [(t["role"], t["text"]) for t in chat]
                text, spans, rewrites = locate(template.render, turns)
                marked = [s._asdict() | {"role": r, "loss": r == "assistant"} for s, (r, _) in zip(spans, turns, strict=True)]
                out.append((text, marked, rewrites))
            return list(zip(*out, strict=True))

        return work

    return map_column(_gathered(rows, conv_col, turn_col, role_col, text_col), "__turns", make, fields, [conv_col])


def chat_digests(
    rows: DataFrame, template=None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation, read back from the formatted output: counts and digests."""
    template = template or ChatTemplate()
    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history")
    kinds = (T.LongType(), T.StringType(), T.LongType(), T.StringType(), T.LongType(), T.BooleanType())
    fields = [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]

    def make():
        return lambda chats: list(zip(*(read_back(template, [(t["role"], t["text"]) for t in c]) for c in chats), strict=True))

    return map_column(_gathered(rows, conv_col, turn_col, role_col, text_col), "__turns", make, fields, [conv_col])
