"""Ordered operators: runs, gaps, greedy spacing, islands, first claims."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.tables import Scratch
from plumbline.sources.workers import ready_workers

#: Rounds whose results are one plan's union; then they are written as one table.
PLAN_STEPS = 16
#: The first rows of a group, whose names one task holds; rows after them take names in rounds of joins.
PASS_ROWS = 10_000


def _by(group: Sequence[str], order: Sequence[str | Column]):
    return Window.partitionBy(*group).orderBy(*order)


def run_length(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(group, run, value, n): maximal runs of one value in order."""
    w = _by(group, order)
    starts = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    w_so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("__s", starts).withColumn("run", F.sum("__s").over(w_so_far))
    return numbered.groupBy(*group, "run").agg(F.first(value).alias(value), F.count("*").alias("n"))


def gap_segments(rows: DataFrame, group: Sequence[str], low: str, high: str, gap: float, order: Sequence[str] = ()) -> DataFrame:
    """Rows with a segment number; a new segment begins where an interval starts more than gap after all before it."""
    w = _by(group, [low, *order])
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (F.col(low) - reach > gap), 1).otherwise(0)
    return rows.withColumn("__s", starts).withColumn("segment", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def in_order(rows: DataFrame, group: Sequence[str], value: str, step: Callable, schema: str) -> DataFrame:
    """A pass over each group's values in ascending order that holds only a state: rows of ``step`` by ``schema`` (group, then what it yields).

    ``step(state, value)`` returns (new state, row or null); the state is null at a group's first value, and value is null at its end.
    A group's rows come sorted to one task, which never holds more than a batch of them. Null values are left out.
    """
    ready_workers(rows.sparkSession)
    keys = list(group)
    sized = rows.select(*keys, F.col(value).cast("double").alias("__v")).where("__v is not null")
    ordered = (sized.repartition(*keys) if keys else sized.repartition(1)).sortWithinPartitions(*keys, "__v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state, types, out = None, None, None, []

        def told() -> pa.RecordBatch:
            columns = list(zip(*out))
            arrays = [pa.array(c, t) for c, t in zip(columns, types)] + [pa.array(c) for c in columns[len(types) :]]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            owners = zip(*[batch.column(k).to_pylist() for k in keys]) if keys else iter(lambda: (), None)
            for owner, v in zip(owners, batch.column("__v").to_pylist()):
                if owner != here or state is None:
                    if state is not None and (row := step(state, None)[1]) is not None:
                        out.append((*here, *row))
                    here, state = owner, None
                state, row = step(state, v)
                if row is not None:
                    out.append((*owner, *row))
            if out:
                yield told()
        if state is not None and (row := step(state, None)[1]) is not None:
            out.append((*here, *row))
            yield told()

    made = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + [schema])
    names = [*keys, *[part.split()[0] for part in schema.split(", ")]]
    return ordered.mapInArrow(run, made)


def spaced(rows: DataFrame, group: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """(group, value): values further than tolerance from the last kept one, in ascending order; a pass that holds the last kept value."""
    def step(last: float | None, v: float | None) -> tuple:
        if v is None:
            return last, None
        return (v, (v,)) if last is None or v - last > tolerance else (last, None)

    return in_order(rows, group, value, step, f"{value} double")


def stable_runs(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: str, least: int) -> DataFrame:
    """Runs of at least ``least`` rows of one value."""
    return run_length(rows, group, order, value).where(F.col("n") >= least)


def outlier_gap(rows: DataFrame, group: Sequence[str], value: str, ratio: float, least: float = 0.0) -> DataFrame:
    """(group, cut_after, gap): the largest gap, where it is at least ``least`` and over ratio times the second."""
    w = _by(group, [value])
    gaps = rows.select(*group, value).distinct().withColumn("gap", F.lead(value).over(w) - F.col(value)).where("gap is not null")
    ranked = gaps.withColumn("__r", F.row_number().over(_by(group, [F.desc("gap"), value])))
    two = ranked.where("__r <= 2").groupBy(*group).agg(
        F.max(F.when(F.col("__r") == 1, F.col(value))).alias("cut_after"), F.max(F.when(F.col("__r") == 1, F.col("gap"))).alias("gap"), F.max(F.when(F.col("__r") == 2, F.col("gap"))).alias("__second")
    )
    return two.where((F.col("gap") >= least) & (F.col("__second").isNull() | (F.col("gap") > ratio * F.col("__second")))).drop("__second")


def clustered_rows(rows: DataFrame, group: Sequence[str], value: str, width: float) -> DataFrame:
    """(group, centre, n): ascending values join the current cluster while within width of its running mean; a pass that holds one cluster."""
    def step(cluster: tuple | None, v: float | None) -> tuple:
        if v is None:
            return cluster, (cluster[0] / cluster[1], cluster[1])
        if cluster is None:
            return (v, 1), None
        total, n = cluster
        return ((total + v, n + 1), None) if v - total / n <= width else ((v, 1), (total / n, n))

    return in_order(rows, group, value, step, "centre double, n long")


def consecutive(rows: DataFrame, group: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows paired with the next of their group: columns and next_columns."""
    w = _by(group, order)
    paired = rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).withColumn("__last", F.lead(F.lit(1)).over(w))
    return paired.where("__last = 1").drop("__last")


def best_with_margin(rows: DataFrame, group: Sequence[str], score: str, order: Sequence[str], margin: float) -> DataFrame:
    """The lowest score of each group, where its lead over the second is at least the margin or it is alone."""
    w = _by(group, [score, *order])
    ranked = rows.withColumn("__n", F.row_number().over(w)).withColumn("__next", F.lead(score).over(w))
    return ranked.where((F.col("__n") == 1) & (F.col("__next").isNull() | (F.col("__next") - F.col(score) >= margin))).drop("__n", "__next")


def first_claims(claims: DataFrame, item: str, claimant: str) -> DataFrame:
    """Each item goes to the lowest claimant that lists it."""
    return claims.groupBy(item).agg(F.min(claimant).alias(claimant))


def numbered_ids(rows: DataFrame, group: Sequence[str], order: Sequence[str], prefix: str, into: str) -> DataFrame:
    """Rows with an id of the prefix and their place in the group's order, from 0; the order must be total for ids to be stable."""
    return rows.withColumn(into, F.concat(F.lit(prefix), (F.row_number().over(_by(group, order)) - 1).cast("string")))


def _in_one_pass(asking: DataFrame, kept: Sequence[str], most: int) -> DataFrame:
    """(kept, __place, __names, __name): rows up to place ``most`` of their group with a name; later ones keep their place and names.

    A group's rows lie together in order of ``__place``, as the window that counts it leaves them; the task holds the names of
    one group's first rows.
    """
    ready_workers(asking.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, suffixes = set(), {}
        for batch in batches:
            places, asks, found = batch.column("__place").to_pylist(), batch.column("__names").to_pylist(), []
            for place, names in zip(places, asks):
                if place == 1:
                    taken, suffixes = set(), {}
                name = None
                if place <= most:
                    name = next((x for x in names if x not in taken), None)
                    if name is None and (base := names[-1]) is not None:
                        i = suffixes.get(base, 1)
                        while (name := f"{base}-{i}") in taken:
                            i += 1
                        suffixes[base] = i + 1
                    if name is not None:
                        taken.add(name)
                found.append(name)
            late = [p if p > most else None for p in places]
            left = [x if p > most else None for p, x in zip(places, asks)]
            arrays = [pa.array(late, pa.int32()), pa.array(left, pa.list_(pa.string())), pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *arrays], names=[*kept, "__place", "__names", "__name"])

    told = [T.StructField("__place", T.IntegerType()), T.StructField("__names", T.ArrayType(T.StringType())), T.StructField("__name", T.StringType())]
    schema = T.StructType([asking.schema[c] for c in kept] + told)
    return asking.mapInArrow(run, schema)


def unique_references(
    rows: DataFrame, group: Sequence[str], order: Sequence[str], candidates: Sequence[str], prefix: str, sequence: str, into: str = "unique_ref"
) -> DataFrame:
    """Each row's first candidate that no earlier row of its group took, else ``prefix-000001`` by its sequence number,
    with -1, -2, ... appended while that is taken. Null and blank candidates are passed over. References are unique in a
    group; only a candidate that looks like another row's number with a suffix may go to a later row than in order, and
    that only behind a group's first ``PASS_ROWS`` rows.

    These first rows get their names in one pass over the sorted rows. Later ones take in rounds: a row gets the name it asks
    for where no earlier pending row has that name among those it may still ask for, and asks for its next one where the
    name is gone. Rounds end when all rows have one.
    """
    names = F.filter(F.transform(F.array(*[F.col(c).cast("string") for c in candidates]), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    base = F.concat(F.lit(f"{prefix}-"), F.lpad(F.col(sequence).cast("string"), 6, "0"))
    asking = rows.withColumn("__names", F.array_append(names, base)).withColumn("__place", F.row_number().over(_by(group, order)))
    with Scratch(rows.sparkSession) as s:
        passed = s.table(_in_one_pass(asking, rows.columns, PASS_ROWS), "refs")
        pending = passed.where("__place is not null").drop("__name").withColumn("__extra", F.lit(0))
        named, rounds = passed.where("__place is null").select(*rows.columns, "__name"), 0
        if pending.isEmpty():
            s.kept.update(s.paths)
            return named.withColumnRenamed("__name", into)
        while not pending.isEmpty():
            ask = F.when(F.size("__names") > 0, F.get("__names", F.lit(0))).otherwise(F.concat(base, F.lit("-"), F.col("__extra").cast("string")))
            asked = pending.withColumn("__name", ask)
            own = F.concat(base, F.lit("\n"))
            claims = asked.select(*group, "__place", F.explode(F.concat("__names", F.array("__name", own))).alias("__name"))
            first = claims.groupBy(*group, "__name").agg(F.min("__place").alias("__first"))
            met = asked.join(first, [*group, "__name"]).withColumn("__own", F.when(F.size("__names") == 0, own).otherwise(F.col("__name")))
            met = met.join(first.withColumnsRenamed({"__name": "__own", "__first": "__before"}), [*group, "__own"]).drop("__own")
            met = met.join(named.select(*group, "__name", F.lit(True).alias("__taken")), [*group, "__name"], "left")
            gone = F.coalesce("__taken", F.lit(False))
            met = met.withColumn("__won", ~gone & (F.col("__first") == F.col("__place")) & (F.col("__before") == F.col("__place"))).withColumn("__gone", gone)
            step = s.table(met.drop("__first", "__before", "__taken"), "refs")
            named, rounds = named.union(step.where("__won").select(*rows.columns, "__name")), rounds + 1
            if rounds % PLAN_STEPS == 0:
                named = s.table(named, "named")
            shorter = F.when(F.col("__gone"), F.slice("__names", 2, F.greatest(F.size("__names") - 1, F.lit(0)))).otherwise(F.col("__names"))
            spent = F.when(F.col("__gone") & (F.size("__names") <= 1), F.col("__extra") + 1).otherwise(F.col("__extra"))
            rest = step.where("not __won").withColumn("__more", shorter).withColumn("__spent", spent).drop("__names", "__extra", "__name", "__won", "__gone")
            pending = rest.withColumnsRenamed({"__more": "__names", "__spent": "__extra"})
        result = s.table(named, "named", keep=True)
    return result.withColumnRenamed("__name", into)


def dominant(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group, the first in order on a tie."""
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*group).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), value)).alias("__d")).select(*group, f"__d.{value}", "__d.n")


def reading_axis(rows: DataFrame, group: Sequence[str], x: str, y: str, ratio: float = 0.1) -> DataFrame:
    """``horizontal`` or ``vertical`` where the narrow spread is at most ratio of the wide one, else ``none``."""
    spread = rows.groupBy(*group).agg((F.max(x) - F.min(x)).alias("dx"), (F.max(y) - F.min(y)).alias("dy"))
    axis = F.when((F.col("dx") > 0) & (F.col("dy") <= ratio * F.col("dx")), "horizontal").when((F.col("dy") > 0) & (F.col("dx") <= ratio * F.col("dy")), "vertical")
    return spread.withColumn("axis", axis.otherwise("none"))
