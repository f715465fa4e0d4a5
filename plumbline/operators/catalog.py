"""Price catalogs: selection as of a date with scope precedence, explicit references, supersession."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_as_of(as_of: Column, start: Column, end: Column) -> Column:
    """Half-open window; an open end is null."""
    return (start <= as_of) & (end.isNull() | (as_of < end))


def select_as_of(
    requests: DataFrame, entries: DataFrame, key: Sequence[str], request_id: str, as_of: str = "as_of", project: str = "project_id"
) -> DataFrame:
    """(request columns, entry_id, value, status) for each request.

    Entries of the request's project win over global ones (project null) even where both are valid; more
    than one entry in the winning scope is ``ambiguous`` and none is ``missing``, never an arbitrary pick.
    Superseded entries must be filtered out before (``without_superseded``). Each project and date is looked up once for a key,
    and entries of one window are counted before: the work grows with the different ones, not with requests times entries.
    """
    windows = entries.groupBy(*key, project, "effective_start", "effective_end").agg(F.count("*").alias("n"), F.min("entry_id").alias("entry_id"), F.min("value").alias("value"))

    def valid(name: str, of: DataFrame, on: Sequence[str]) -> DataFrame:
        asked = requests.select(*on, as_of).distinct()
        met = asked.join(of, list(on)).where(valid_as_of(F.col(as_of), F.col("effective_start"), F.col("effective_end")))
        return met.groupBy(*on, as_of).agg(F.sum("n").alias(f"n_{name}"), F.min("entry_id").alias(f"{name}_entry_id"), F.min("value").alias(f"{name}_value"))

    own = valid("own", windows.where(F.col(project).isNotNull()), [*key, project])
    global_ = valid("any", windows.where(F.col(project).isNull()).drop(project), key)
    joined = requests.join(own, [*key, project, as_of], "left").join(global_, [*key, as_of], "left")
    joined = joined.withColumn("n_all", F.nullif(F.coalesce("n_own", F.lit(0)) + F.coalesce("n_any", F.lit(0)), F.lit(0)))
    n = F.when(F.col("n_own") > 0, F.col("n_own")).otherwise(F.col("n_all"))
    status = F.when(n.isNull(), "missing").when(n > 1, "ambiguous").otherwise("selected")
    pick = lambda v: F.when(status == "selected", F.coalesce(f"own_{v}", f"any_{v}")).alias(v)
    return joined.select(*requests.columns, pick("entry_id"), pick("value"), status.alias("status"))


def without_superseded(entries: DataFrame, supersessions: DataFrame) -> DataFrame:
    """Entries that no other one follows; null ids stay."""
    return entries.join(supersessions.select(F.col("predecessor_id").alias("entry_id")), "entry_id", "left_anti")


def supersession_view(entries: DataFrame, supersessions: DataFrame) -> DataFrame:
    """Entries with predecessor and successor where they have one."""
    after = supersessions.select(F.col("predecessor_id").alias("entry_id"), "successor_id")
    before = supersessions.select(F.col("successor_id").alias("entry_id"), "predecessor_id")
    return entries.join(after, "entry_id", "left").join(before, "entry_id", "left")


def check_references(refs: DataFrame, entries: DataFrame) -> DataFrame:
    """(ref columns, status) for explicit references: matched, checksum_mismatch or missing."""
    found = entries.select(F.col("entry_id").alias("__id"), F.col("checksum").alias("__sum"))
    joined = refs.join(found, refs["entry_id"] == found["__id"], "left")
    status = F.when(F.col("__id").isNull(), "missing").when(F.col("__sum").eqNullSafe(F.col("checksum")), "matched").otherwise("checksum_mismatch")
    return joined.withColumn("status", status).drop("__id", "__sum")


def entry_checksum(columns: Sequence[str]) -> Column:
    """SHA-256 of the columns' canonical text, in name order."""
    return F.sha2(F.concat_ws("|", *[F.concat(F.lit(c + "="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in sorted(columns)]), 256)


def listing(entries: DataFrame, as_of: Column | None = None, superseded: DataFrame | None = None) -> DataFrame:
    """Catalog list, optionally as of a date and without superseded entries."""
    if as_of is not None:
        entries = entries.where(valid_as_of(as_of, F.col("effective_start"), F.col("effective_end")))
    return entries if superseded is None else without_superseded(entries, superseded)


def entry_problems(entries: DataFrame, currency: str = "GBP") -> DataFrame:
    """Entries with the first rule they break: currency, value, scope, window."""
    e = F.col
    problem = (
        F.when(e("currency") != currency, "currency")
        .when(e("value").isNull() | (e("value") <= 0), "value")
        .when((e("scope_type") == "project") != e("project_id").isNotNull(), "scope")
        .when(e("effective_end") <= e("effective_start"), "window")
    )
    return entries.withColumn("problem", problem).where("problem is not null")


def select_formulas(requests: DataFrame, formulas: DataFrame, request_id: str, project: str = "project_id") -> DataFrame:
    """(request columns, entry_id, status) of formulas by id and, where the request names one, version.

    Formulas have entry_id, formula_id, version, project_id (null for global). The request's project wins over global ones; without a
    version the newest of the winning scope is meant. Equal requests are looked up once, formulas of one version and scope counted before. ``missing`` and ``ambiguous`` (one version twice in the winning scope) have no entry.
    """
    asked = ["formula_id", "version", project]
    f = formulas.groupBy(F.col("formula_id").alias("__f"), F.col("version").alias("__v"), F.col(project).alias("__p")).agg(F.min("entry_id").alias("entry_id"), F.count("*").alias("n"))
    wanted = F.col("version").isNull() | (F.col("version") == F.col("__v"))
    met = requests.select(*asked).distinct().join(f, (F.col("formula_id") == F.col("__f")) & wanted & (F.col("__p").isNull() | (F.col("__p") == F.col(project))))
    rank = F.struct(F.col("__p").isNotNull().alias("own"), F.col("__v").alias("v"))
    best = met.groupBy(*asked).agg(F.max_by(F.struct("entry_id", "n"), rank).alias("b")).withColumnsRenamed({c: f"__{i}" for i, c in enumerate(asked)})
    same = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(asked)]
    out = requests.join(best, same, "left")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("b.n") > 1, "ambiguous").otherwise("selected")
    return out.select(*requests.columns, F.when(status == "selected", F.col("b.entry_id")).alias("entry_id"), status.alias("status"))


def resolve_requests(requests: DataFrame, entries: DataFrame, supersessions: DataFrame, key: Sequence[str], request_id: str) -> DataFrame:
    """(request columns, entry_id, value, status) of all catalog references of estimates in one pass.

    A request that names an entry (entry_ref, checksum) gets it where the checksum agrees: ``matched``, ``checksum_mismatch``, ``stale``
    (superseded) or ``missing``; one that doesn't is selected by key, scope and date among what isn't superseded.
    """
    old = supersessions.select(F.col("predecessor_id").alias("entry_ref"), F.lit(True).alias("__old")).distinct()
    known = entries.select(F.col("entry_id").alias("entry_ref"), F.col("value").alias("__value"), F.col("checksum").alias("__sum"))
    named = requests.where(F.col("entry_ref").isNotNull()).join(known, "entry_ref", "left").join(old, "entry_ref", "left")
    status = F.when(F.col("__value").isNull(), "missing").when(~F.col("__sum").eqNullSafe(F.col("checksum")), "checksum_mismatch").when(F.col("__old"), "stale").otherwise("matched")
    named = named.withColumn("status", status)
    good = F.col("status") == "matched"
    by_ref = named.select(*requests.columns, F.when(good, F.col("entry_ref")).alias("entry_id"), F.when(good, F.col("__value")).alias("value"), "status")
    return by_ref.unionByName(select_as_of(requests.where(F.col("entry_ref").isNull()), without_superseded(entries, supersessions), key, request_id))


def load_entries(new: DataFrame, existing: DataFrame, columns: Sequence[str], currency: str = "GBP") -> tuple[DataFrame, DataFrame]:
    """(accepted with checksum, refused with problem): a catalog load.

    Refused: a value with more than six places, and what ``entry_problems`` finds. Entries that are there already with an equal checksum
    are left out of both.
    """
    places = F.col("value").cast("decimal(38,18)") != F.round(F.col("value").cast("decimal(38,18)"), 6)
    fine = new.where(~F.coalesce(places, F.lit(False)))
    refused = new.where(F.coalesce(places, F.lit(False))).withColumn("problem", F.lit("places")).unionByName(entry_problems(fine, currency))
    accepted = fine.join(entry_problems(fine, currency).select("entry_id"), "entry_id", "left_anti").withColumn("checksum", entry_checksum(columns))
    return accepted.join(existing.select("entry_id", "checksum"), ["entry_id", "checksum"], "left_anti"), refused
