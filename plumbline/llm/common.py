"""Shared pieces of the text operators: Arrow maps over text, written intermediate tables, settings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.sources.tables import Scratch, delete, table, written  # noqa: F401  (used by the operators)
from plumbline.sources.workers import ready_workers  # noqa: F401

#: Words everywhere in this package: runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a column that are turned into Python objects at once. Spark bounds the batches themselves
#: (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless the session says otherwise).
PIECE_BYTES = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in runs of about PIECE_BYTES of one column, a row at least."""
    for batch in batches:
        values = batch.column(column)
        if batch.num_rows == 0:
            continue
        step = max(1, int(batch.num_rows * PIECE_BYTES / max(1, values.nbytes)))
        start = 0
        while start < batch.num_rows:
            part = batch.slice(start, step)
            while part.num_rows > 1 and part.column(column).nbytes > 2 * PIECE_BYTES:
                part = part.slice(0, part.num_rows // 2)
            yield part
            start += part.num_rows


def map_column(
    df: DataFrame,
    column: str,
    make: Callable[[], Callable[[list], list[Sequence]]],
    fields: list[T.StructField],
    keep: Sequence[str],
) -> DataFrame:
    """Append columns computed from one column in Arrow batches; ``keep`` passes through untouched.

    ``make()`` runs once in each task and returns a function from the column's values (nulls
    included) to one list per new field. A kept column that has a new field's name gives way to it.
    Each column goes to the workers once, the computed one too where it is kept.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in keep if c.lower() not in new]
    ready_workers(df.sparkSession)
    twice = column in kept
    source = df.select(*[F.col(f"`{c}`") for c in kept], *([] if twice else [F.col(f"`{column}`").alias("__in")]))
    at = kept.index(column) if twice else len(kept)
    schema = T.StructType([source.schema[c] for c in kept] + fields)
    types = [to_arrow_schema(T.StructType([f])).field(0).type for f in fields]
    out_names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in pieces(batches, at):
            made = work(batch.column(at).to_pylist())
            arrays = [pa.array(v, type=t) for v, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *arrays], names=out_names)

    return source.mapInArrow(run, schema)
