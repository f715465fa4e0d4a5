"""SentencePiece BPE encoding by backtracking over longest matches, and decoding.

For a vocabulary whose pieces merge by score, a sequence of pieces is the merge result of a text
exactly when each adjacent pair is what merging its own concatenation gives. So encoding needs no
merging of the text: an Aho-Corasick automaton finds the pieces that match at each position; from
the left the longest match is taken, a pair that doesn't survive re-merging is refused, and the
search falls back to a shorter match or to the piece before, with a bitfield of the positions from
which nothing worked. Pair verdicts and words are remembered in bounded caches.

No piece of such a vocabulary holds a space mark after another character, so a text falls into
words that start with their space mark; runs of two or more marks, where scores tie, are merged
directly, with a queue. A character without a piece becomes its UTF-8 bytes. The text is taken as it is (identity
normalisation) with one space mark before it, like the models this is for; other models are refused.

``encode_decode`` treats null text as empty; the empty text has no ids and decodes to itself.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Sequence

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.common import map_column

MARK = "▁"
#: Texts up to this length are merged by looking at all pairs again after each merge.
SHORT = 32
#: Entries of one of the two generations of words, and of pairs, that a Python worker remembers; a text may add its own beyond.
CACHE_WORDS, CACHE_PAIRS = 500_000, 1_000_000
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class PieceBpe:
    """Encoder and decoder of a sentencepiece BPE model file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(len(sp))]
        normal = [i for i in range(len(sp)) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_ids = {int(self.pieces[i][1:-1], 16): i for i in range(len(sp)) if sp.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.id_of = {self.pieces[i]: i for i in normal}
        self.score = {self.pieces[i]: sp.get_score(i) for i in normal}
        if len(self.byte_ids) != 256 or any(MARK in p.lstrip(MARK) or p.startswith(MARK * 2) and p.strip(MARK) for p in self.id_of):
            raise ValueError("a BPE model with byte fallback and no piece across words is needed")
        if sp.encode("a  b ", out_type=str)[0][:1] != MARK or sp.decode(sp.encode(" a  b ")) != " a  b ":
            raise ValueError("a model without normalisation and with a leading space mark is needed")
        self.characters = frozenset(p for p in self.id_of if len(p) == 1)
        self.plain = [None if i in self.bytes_of else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.pairs: dict[int, bool] = {}
        self.words, self.older = _Words(self), {}
        self.lossy: set[str] = set()
        # A piece that merging its own characters doesn't give can't occur in an encoding.
        self.reachable = {p: i for p, i in self.id_of.items() if self.merge(p) == [p]}
        self.longest = max(map(len, self.reachable))
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.reachable.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()

    def merge(self, text: str) -> list[str]:
        """Pieces of a text by merging itself: the best score first, the leftmost of equals."""
        if len(text) > SHORT:
            return self._merge_long(text)
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merge_long(self, text: str) -> list[str]:
        """As ``merge``, from a queue of the pairs, so that a long run of spaces takes n log n steps."""
        parts: list[str | None] = list(text)
        last = len(parts)
        after, before = list(range(1, last + 1)), list(range(-1, last - 1))
        score, queue = self.score, []

        def push(i: int) -> None:
            j = after[i]
            if j < last and (s := score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-s, i, len(parts[i]), len(parts[j])))

        for i in range(last - 1):
            push(i)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if parts[i] is None or j >= last or len(parts[i]) != left or len(parts[j]) != right:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[i] < last:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [p for p in parts if p is not None]

    def _compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            left, right = self.pieces[a], self.pieces[b]
            known = self.pairs[key] = self.merge(left + right) == [left, right]
        return known

    def _match(self, text: str, pos: int, size: int) -> int:
        """Length of the longest piece at pos that is no longer than size, 0 if there is none."""
        known = self.reachable
        for n in range(size, 0, -1):
            if text[pos : pos + n] in known:
                return n
        return 0

    def _backtrack(self, text: str) -> list[int]:
        """Ids of a text all of whose characters have pieces: greedy longest matches, then repair."""
        ids, starts, pos = [], [], 0
        pairs, last = self.pairs, -1
        for end, i in self.automaton.iter_long(text):
            if last >= 0 and not (pairs[k] if (k := last << 20 | i) in pairs else self._compatible(last, i)):
                break
            ids.append(i)
            starts.append(pos)
            pos, last = end + 1, i
        n, reachable, longest = len(text), self.reachable, self.longest
        failed, size = 0, min(longest, n - pos)
        while pos < n:
            size = self._match(text, pos, size)
            while size:
                if not failed >> (pos + size) & 1:
                    i = reachable[text[pos : pos + size]]
                    if not ids or self._compatible(ids[-1], i):
                        break
                size = self._match(text, pos, size - 1)
            if size:
                ids.append(i)
                starts.append(pos)
                pos += size
                size = min(longest, n - pos)
            elif ids:
                failed |= 1 << pos
                ids.pop()
                start = starts.pop()
                pos, size = start, pos - start - 1
            else:
                raise ValueError(f"no exact encoding of {text!r}")
        return ids

    def _word_ids(self, word: str) -> list[int]:
        if word.startswith(MARK * 2):
            return [x for p in self.merge(word) for x in self._piece_or_bytes(p)]
        if self.characters.issuperset(word):
            return self._backtrack(word)
        ids, run = [], ""
        for c in word:
            if c in self.characters:
                run += c
                continue
            ids += self._backtrack(run) if run else []
            run = ""
            ids += self._piece_or_bytes(c)
        return ids + (self._backtrack(run) if run else [])

    def _piece_or_bytes(self, piece: str) -> list[int]:
        i = self.id_of.get(piece)
        return [i] if i is not None else [self.byte_ids[b] for b in piece.encode()]

    def split(self, text: str) -> list[str]:
        """Words, each without the first of its space marks."""
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in _WORD.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode(self, text: str) -> list[int]:
        return [i for w in self.split(text) for i in self._word_ids(MARK + w)]

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids: byte pieces joined and decoded, marks as spaces, the leading space dropped."""
        return self._joined(ids).removeprefix(" ")

    def _joined(self, ids: Sequence[int]) -> str:
        plain = self.plain
        try:
            return "".join([plain[i] for i in ids])
        except TypeError:  # byte pieces
            pass
        out, raw = [], bytearray()
        for i in ids:
            b = self.bytes_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(plain[i])
        return "".join(out) + raw.decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids in decimal joined by commas, SHA-256 of the decoded text)."""
        if len(self.words) >= CACHE_WORDS:
            self.words, self.older = _Words(self), self.words
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        split = self.split(text)
        ids = ",".join(map(self.words.__getitem__, split))
        if self.lossy.isdisjoint(split):
            decoded = text.replace(MARK, " ")
        else:
            decoded = self.decode(list(map(int, ids.split(","))))
        total = ids.count(",") + 1 if ids else 0
        return total, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


class _Words(dict):
    """Word -> its ids in decimal joined by commas. A missing word is encoded, and decoded again: ``lossy``
    gets those whose ids don't decode to themselves, so that the others' text stands for what is decoded."""

    def __init__(self, model: PieceBpe):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> str:
        model = self.model
        known = dict.get(model.older, word)
        if known is None:
            got = model._word_ids(MARK + word)
            known = ",".join(map(str, got))
            if model._joined(got) != " " + word.replace(MARK, " "):
                model.lossy.add(word)
        if len(word) <= 64:
            self[word] = known
        return known


_MODELS: dict[str, PieceBpe] = {}


def piece_bpe(path: str) -> PieceBpe:
    """The model of a file, built once in a Python worker."""
    if path not in _MODELS:
        _MODELS[path] = PieceBpe(path)
    return _MODELS[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): exact ids of every text, without begin or end ids."""

    def make():
        model = piece_bpe(model_path)
        return lambda texts: [[model.encode(t or "") for t in texts]]

    return map_column(docs, text_col, make, [T.StructField("ids", T.ArrayType(T.IntegerType()))], [id_col])


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from an array of ids; a null array is the empty text."""

    def make():
        model = piece_bpe(model_path)
        return lambda rows: [[model.decode(r or []) for r in rows]]

    return map_column(encoded, ids_col, make, [T.StructField("text", T.StringType())], [id_col])


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the text decoded from them."""
    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]

    def make():
        model = piece_bpe(model_path)
        return lambda texts: list(zip(*(model.digest(t or "") for t in texts), strict=True))

    return map_column(docs, text_col, make, fields, [id_col])
