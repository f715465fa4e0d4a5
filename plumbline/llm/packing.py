"""Cost-balanced packing of tokenised documents into sequences of fixed capacity.

A document's token ids end with ``end_id``. Its first floor(n / capacity) * capacity ids fill
sequences alone. The rest of each document goes, in descending length, to the open sequence of
lowest estimated attention cost, ``linear * length + quadratic * length ** 2`` summed over its
pieces, among those with room for all of it; where no sequence has that room, the one of lowest
cost with any room takes what fits and the remainder is placed next. A window of documents opens
exactly ceil(tokens / capacity) sequences, so its padding is below one sequence in all.

Windows are runs of at most ``window_tokens`` rest tokens inside a task: token ids never cross the
network and a task's memory is bounded by one window. A sequence id is the task's partition number
times 2**32 plus a counter.

Null text counts as empty (the end id alone). Equal lengths are ordered by doc_id (nulls first),
then by place in the task. Repeated rows are packed each. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.common import pieces, ready_workers

SCHEMA = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


#: White space that the rank library's pattern backs out of step by step; it gives up on very long runs.
_LONG_SPACE = re.compile(r"\s{256}")


class ByteBpe:
    """Ids of whole texts as ``tokenizers`` gives them, as bytes of little-endian unsigned 32-bit integers.

    ``ranks_path`` names the same vocabulary as ranks: texts without the string of an added token and without long
    white space then take the faster library, with equal ids. The rest, and all texts without it, take ``tokenizers``.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.ranks = None
        if ranks_path and pattern:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.ranks is None or any(a in text for a in self.added) or _LONG_SPACE.search(text):
            return self.model.encode(text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", self.ids(t)).tobytes() for t in texts]


_MODELS: dict[tuple, ByteBpe] = {}


def byte_bpe(*where: str) -> ByteBpe:
    """The model of ByteBpe's arguments, loaded once in a Python worker."""
    if where not in _MODELS:
        _MODELS[where] = ByteBpe(*where)
    return _MODELS[where]


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document number, start, length) pieces for documents of given lengths, longest first."""
    count = -(-sum(lengths) // capacity)
    room, cost = np.full(count, capacity), np.zeros(count)
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    for doc, n in enumerate(lengths):
        start = 0
        while n:
            i = int(np.where(room >= n, cost, np.inf).argmin())
            if room[i] < n:
                i = int(np.where(room > 0, cost, np.inf).argmin())
            take = min(n, int(room[i]))
            held[i].append((doc, start, take))
            room[i] -= take
            cost[i] += linear * take + quadratic * take * take
            start, n = start + take, n - take
    return held


def pack(
    docs: DataFrame,
    encoder: Callable[[], object],
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1 / 2048,
    window_tokens: int = 1 << 20,
) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    ``encoder()`` runs in a worker and returns an object whose ``encode(texts)`` gives each text's ids
    as bytes of little-endian unsigned 32-bit integers.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    ready_workers(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    schema = T.StructType([source.schema[id_col], *T._parse_datatype_string(SCHEMA).fields])
    out = to_arrow_schema(schema)
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder()
        base, used = TaskContext.get().partitionId() << 32, 0
        rests: list[tuple] = []
        waiting = 0

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(v, type=f.type) for v, f in zip(zip(*pieces, strict=True), out, strict=True)], schema=out
            )

        def flush() -> pa.RecordBatch:
            nonlocal used
            rests.sort(key=lambda r: (-len(r[2]), r[0] is not None, r[0] if r[0] is not None else 0))
            pieces = []
            for held in balance([len(r[2]) // 4 for r in rests], capacity, linear, quadratic):
                at = 0
                for doc, start, n in held:
                    key, before, ids, total = rests[doc]
                    crc = zlib.crc32(ids[4 * start : 4 * (start + n)])
                    pieces.append((key, before + start, n, crc, total, base + used, at))
                    at += n
                used += 1
            rests.clear()
            return rows(pieces)

        for batch in pieces(batches, 1):
            full = []
            for key, ids in zip(batch.column(0).to_pylist(), model.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                total = len(ids) // 4
                whole = total - total % capacity
                for start in range(0, whole, capacity):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + capacity)])
                    full.append((key, start, capacity, crc, total, base + used, 0))
                    used += 1
                if whole < total:
                    rests.append((key, whole, ids[4 * whole :], total))
                    waiting += total - whole
                if waiting >= window_tokens:
                    yield flush()
                    waiting = 0
            if full:
                yield rows(full)
        if rests:
            yield flush()

    return source.mapInArrow(run, schema)
