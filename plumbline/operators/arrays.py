"""Passes over rows that come sorted by drawing: whole drawings, many at once, as arrays in a task; and what such passes are made of."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kind of a row that names a drawing too large for a task.
LARGE = 3
#: Rows that are worked on at once, and pairs.
ROWS, MET = 1 << 17, 1 << 20
#: Rows of a drawing that a task holds.
IN_A_TASK = 1 << 20


def column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def codes(given: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(codes in the values' order, -1 for null; the values in order)."""
    coded = given.dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    at = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.where(at < 0, -1, rank[at]) if len(order) else np.full(len(given), -1), coded.dictionary.take(order)


def values(at: np.ndarray, known: pa.Array) -> pa.Array:
    """The values of codes, null for -1."""
    return known.take(pa.array(at, pa.int64(), mask=at < 0))


def numbers(given: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers with 0 for null, which aren't null)."""
    return given.fill_null(0.0).to_numpy(zero_copy_only=False), given.is_valid().to_numpy(zero_copy_only=False)


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    first = np.ones(len(keys[0]), bool)
    if len(first) > 1:
        first[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return first


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) for every place of the ranges [low, high)."""
    n = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def slices(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Slices with counts of at most ``most`` in all, or of one member."""
    total, start = np.cumsum(counts), 0
    while start < len(counts):
        end = max(int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right")), start + 1)
        yield start, end
        start = end


def before(group: np.ndarray, value: np.ndarray, asked: np.ndarray, at: np.ndarray, equal: bool) -> np.ndarray:
    """How many of the rows sorted by (group, value) come before each asked (group, value), those that are equal too if ``equal``."""
    own = np.concatenate([np.ones(len(group), bool), np.zeros(len(asked), bool)])
    order = np.lexsort((own != equal, np.concatenate([value, at]), np.concatenate([group, asked])))
    told = np.cumsum(own[order])
    out = np.empty(len(own), np.int64)
    out[order] = told
    return out[len(group) :]


def rows_of(lead: pa.Table, keys: Sequence[str], schema: pa.Schema, made: Sequence[tuple[np.ndarray, dict]]) -> pa.Table:
    """Rows of ``schema`` from (drawing, columns): keys by the drawing, what isn't given is null. lead: the keys of each drawing."""
    tables = []
    for drawing, out in made:
        of = lead.take(pa.array(drawing, pa.int64()))
        given = {**{k: column(of, k) for k in keys}, **out}
        tables.append(pa.table([pa.array(given[f.name]).cast(f.type) if isinstance(given.get(f.name), np.ndarray) else given[f.name].cast(f.type) if f.name in given else pa.nulls(len(drawing), f.type) for f in schema], schema=schema))
    return pa.concat_tables(tables)


def passes(keys: Sequence[str], most: int, schema_of: Callable[[pa.Schema], list], work: Callable[[pa.Table, np.ndarray, pa.Schema], pa.Table]):
    """A pass over batches of rows sorted by drawing (the keys): what ``work`` makes of whole drawings (rows, each one's drawing 0, 1, ..., schema), and a row of kind
    ``LARGE`` that names each drawing of more than ``most`` rows, whose rows aren't held. Results have the keys, their kind ``__o`` and the fields of ``schema_of``."""

    def changes(table: pa.Table) -> np.ndarray:
        out = np.zeros(len(table), bool)
        for k in keys:
            c = column(table, k)
            a, b = c.slice(1), c.slice(0, max(len(c) - 1, 0))
            differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
            out[1:] |= differ.to_numpy(zero_copy_only=False)
        return out

    def schema(table: pa.Table) -> pa.Schema:
        return pa.schema([*[pa.field(k, table.schema.field(k).type) for k in keys], ("__o", pa.int32()), *schema_of(table.schema)])

    def mark(table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from rows_of(table, keys, schema(table), [(np.arange(len(table)), {"__o": np.full(len(table), LARGE)})]).to_batches()

    def told(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not len(table):
            return
        g = np.cumsum(changes(table))
        few = np.bincount(g) <= most
        if not few.all():
            yield from mark(table.take(pa.array(np.flatnonzero(firsts(g) & ~few[g]))))
            table, g = table.filter(pa.array(few[g])), g[few[g]]
        if len(table):
            yield from work(table, np.cumsum(firsts(g)) - 1, schema(table)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large, n = [], False, 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < ROWS and not large:
                continue
            table = pa.Table.from_batches(held)
            cuts = np.flatnonzero(changes(table))
            if large:
                table, large = (table.slice(int(cuts[0])), False) if len(cuts) else (table.slice(len(table) - 1), True)
            else:
                last = int(cuts[-1]) if len(cuts) else 0
                yield from told(table.slice(0, last))
                table = table.slice(last)
                if len(table) > most:
                    yield from mark(table.slice(0, 1))
                    table, large = table.slice(len(table) - 1), True
            held, n = table.to_batches(), len(table)
        if n and not large:
            yield from told(pa.Table.from_batches(held))

    return run


def of_drawings(rows: DataFrame, drawings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of the drawings, a null key being one too."""
    named = drawings.select(*[F.col(k).alias(f"__d_{k}") for k in keys])
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__d_{k}"))
    return rows.join(named.hint("merge"), met, "left_semi")
