"""Estimates in exact decimals: priced lines, formulas, tax, totals, guards."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import money
from plumbline.sources.tables import dealt

NUMBER = "decimal(38,12)"


def priced_lines(lines: DataFrame, quantity: str, rate: str, unit: str | None = None, rate_unit: str | None = None) -> DataFrame:
    """Lines with amount = money(rate * quantity); a unit mismatch has no amount and says so in status."""
    amount = money(F.col(quantity).cast("decimal(18,6)") * F.col(rate).cast("decimal(18,6)"))
    match = F.lit(True) if unit is None else F.col(unit).eqNullSafe(F.col(rate_unit))
    status = F.when(~match, "unit_mismatch").when(F.col(rate).isNull(), "no_rate").otherwise("priced")
    return lines.withColumn("status", status).withColumn("amount", F.when(status == "priced", amount))


def estimate_totals(lines: DataFrame, group: Sequence[str], tax_rate: str) -> DataFrame:
    """Subtotal as the sum of rounded lines, tax = money(subtotal * rate), total."""
    rate = F.lit(tax_rate).cast("decimal(9,6)")
    sums = lines.groupBy(*group).agg(F.sum("amount").alias("subtotal"), F.count("amount").alias("n_lines"))
    taxed = sums.withColumn("tax", money(F.col("subtotal").cast("decimal(28,2)") * rate))
    return taxed.withColumn("total", F.col("subtotal") + F.col("tax"))


def repeated_keys(lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that more than one line has."""
    return lines.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


class FormulaError(ValueError):
    """A formula that the typed expression rules refuse."""


#: Contract of a product, by the operands' contracts.
PRODUCTS = {("scalar", "scalar"): "scalar", ("rate", "quantity"): "money", ("money", "scalar"): "money", ("quantity", "scalar"): "quantity", ("rate", "scalar"): "rate"}
MAX_DEPTH = 64


def compile_formula(node: Mapping, inputs: Mapping[str, tuple[str, str]], depth: int = 0) -> tuple[Column, str]:
    """(Column, contract) of a typed expression; inputs maps a name to (column, contract).

    Kinds: literal, input, add, subtract, multiply, divide, negate, min, max, sum, round. Division by
    zero gives null, which ``formula_lines`` reports.
    """
    if depth > MAX_DEPTH:
        raise FormulaError("expression too deep")
    kind = node["kind"]
    if kind == "literal":
        return F.lit(str(node["value"])).cast(NUMBER), node.get("contract", "scalar")
    if kind == "input":
        if node["name"] not in inputs:
            raise FormulaError(f"unknown input {node['name']}")
        column, contract = inputs[node["name"]]
        return F.col(column).cast(NUMBER), contract
    args = [compile_formula(a, inputs, depth + 1) for a in node["args"]]
    columns, contracts = [a for a, _ in args], [c for _, c in args]
    if kind == "round":
        if len(args) != 1:
            raise FormulaError("round takes one argument")
        return F.round(columns[0], int(node["scale"])).cast(NUMBER), contracts[0]
    if kind == "negate":
        return (-columns[0]).cast(NUMBER), contracts[0]
    if kind == "multiply":
        out, contract = columns[0], contracts[0]
        for column, other in zip(columns[1:], contracts[1:], strict=True):
            made = PRODUCTS.get((contract, other)) or PRODUCTS.get((other, contract))
            if made is None:
                raise FormulaError(f"{contract} times {other}")
            out, contract = (out.cast("decimal(28,9)") * column.cast("decimal(28,9)")).cast(NUMBER), made
        return out, contract
    if kind == "divide":
        if contracts[1] != "scalar":
            raise FormulaError("only a scalar divides")
        return (columns[0].cast("decimal(28,9)") / F.nullif(columns[1].cast("decimal(28,9)"), F.lit(0))).cast(NUMBER), contracts[0]
    if len(set(contracts)) != 1:
        raise FormulaError(f"{kind} of {', '.join(contracts)}")
    if kind in ("min", "max"):
        return (columns[0] if len(columns) == 1 else (F.least if kind == "min" else F.greatest)(*columns)), contracts[0]
    if kind in ("add", "sum", "subtract"):
        out = columns[0]
        for column in columns[1:]:
            out = (out - column if kind == "subtract" else out + column).cast(NUMBER)
        return out, contracts[0]
    raise FormulaError(f"unknown kind {kind}")


def formula_lines(lines: DataFrame, expression: Mapping, inputs: Mapping[str, tuple[str, str]], output: str = "money") -> DataFrame:
    """Lines with amount by a formula whose output contract must match."""
    column, contract = compile_formula(expression, inputs)
    if contract != output:
        raise FormulaError(f"the formula makes {contract}, not {output}")
    valued = lines.withColumn("amount", money(column) if output == "money" else column)
    return valued.withColumn("status", F.when(F.col("amount").isNull(), "division_by_zero").otherwise("computed"))


def assumption_lines(lines: DataFrame, amount: str, anchor: str) -> DataFrame:
    """Non-negative amounts with an anchor are accepted; the others say why not."""
    status = F.when(F.col(amount) < 0, "negative").when(F.col(anchor).isNull(), "unanchored").otherwise("accepted")
    return lines.withColumn("status", status)


def snapshot(parts: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Frozen inputs of an estimate: (entry_kind, entry_key, payload, checksum), one row per used entry."""
    out = None
    for kind, df in sorted(parts.items()):
        payload = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
        rows = df.select(F.lit(kind).alias("entry_kind"), F.col(key).cast("string").alias("entry_key"), payload.alias("payload"))
        out = rows if out is None else out.union(rows)
    return out.withColumn("checksum", F.sha2("payload", 256))


#: Limits of a formula definition.
MAX_NODES, MAX_ARGS, MAX_PLACES = 512, 64, 12


def check_formula(expression: Mapping, inputs: Mapping[str, tuple[str, str]], output: str = "money") -> list[str]:
    """What is wrong with a formula's definition, in the order found; none for a good one.

    Checked: its shape (kinds, arguments, canonical decimal texts, rounding scale 0 to ``MAX_PLACES``), its size (depth, nodes, arguments),
    unknown and unused inputs, the contracts of every operation, and the output's contract.
    """
    problems, used, nodes = [], set(), 0

    def walk(node, depth: int) -> None:
        nonlocal nodes
        nodes += 1
        if not isinstance(node, Mapping) or not isinstance(node.get("kind"), str):
            problems.append("not an expression")
            return
        if depth > MAX_DEPTH:
            problems.append("too deep")
            return
        kind, args = node["kind"], node.get("args", ())
        if kind == "literal":
            text = str(node.get("value"))
            if not re.fullmatch(r"-?(0|[1-9][0-9]*)([.][0-9]*[1-9])?", text) or text == "-0":
                problems.append(f"{text} isn't a canonical decimal")
        elif kind == "input":
            used.add(node.get("name"))
            if node.get("name") not in inputs:
                problems.append(f"unknown input {node.get('name')}")
        elif kind not in ("add", "subtract", "multiply", "divide", "negate", "min", "max", "sum", "round"):
            problems.append(f"unknown kind {kind}")
        else:
            least, most = {"negate": (1, 1), "round": (1, 1), "divide": (2, 2), "subtract": (2, 2)}.get(kind, (1 if kind in ("min", "max", "sum") else 2, MAX_ARGS))
            if not least <= len(args) <= most:
                problems.append(f"{kind} of {len(args)} arguments")
            if kind == "round" and not (isinstance(node.get("scale"), int) and 0 <= node["scale"] <= MAX_PLACES):
                problems.append(f"rounding scale {node.get('scale')}")
            for a in args:
                walk(a, depth + 1)

    walk(expression, 0)
    if nodes > MAX_NODES:
        problems.append("too many nodes")
    problems += [f"unused input {n}" for n in sorted(set(inputs) - used)]
    if not problems:
        try:
            _, contract = compile_formula(expression, inputs)
            if contract != output:
                problems.append(f"the formula makes {contract}, not {output}")
        except FormulaError as e:
            problems.append(str(e))
    return problems


def assemble_lines(lines: DataFrame, quantities: DataFrame, entries: DataFrame) -> DataFrame:
    """(line_key, kind, quantity, rate, amount, status) of estimate lines with their quantity and rate, material or assumption.

    lines: line_key, kind (rate, material, assumption), quantity_key, entry_key, unit. quantities: quantity_key, value, unit. entries: kind,
    entry_key, value, unit. The first that holds is the status: missing_quantity (but for assumptions, whose value is the amount),
    missing_entry, kind_mismatch (the entry is of another kind), unit_mismatch, priced. Repeated keys on the right are ``ambiguous``.
    """
    n = max(df.count() for df in (lines, quantities, entries))
    q = dealt(quantities, n, "quantity_key").groupBy("quantity_key").agg(F.min("value").alias("quantity"), F.min("unit").alias("__q_unit"), F.count("*").alias("__q"))
    e = dealt(entries, n, "entry_key").groupBy("entry_key").agg(F.min("value").alias("rate"), F.min("unit").alias("__e_unit"), F.min("kind").alias("__e_kind"), F.count("*").alias("__e"))
    met = dealt(lines, n, "quantity_key").join(q.hint("merge"), "quantity_key", "left")
    met = dealt(met, n, "entry_key").join(e.hint("merge"), "entry_key", "left")
    alone = F.col("kind") == "assumption"
    status = (
        F.when((F.col("__q") > 1) | (F.col("__e") > 1), "ambiguous").when(~alone & F.col("quantity").isNull(), "missing_quantity").when(F.col("rate").isNull(), "missing_entry")
        .when(F.col("__e_kind") != F.col("kind"), "kind_mismatch").when(~alone & (~F.col("__q_unit").eqNullSafe(F.col("unit")) | ~F.col("__e_unit").eqNullSafe(F.col("unit"))), "unit_mismatch").otherwise("priced")
    )
    product = F.when(alone, F.col("rate").cast("decimal(38,12)")).otherwise(F.col("quantity").cast("decimal(18,6)") * F.col("rate").cast("decimal(18,6)"))
    return met.select("line_key", "kind", "quantity", "rate", F.when(status == "priced", money(product)).alias("amount"), status.alias("status"))
