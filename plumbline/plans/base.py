"""Registration of queries over the driver's tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(sql: str | None = None):
    """Register a function of Tables under its own name."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Drawing tables made of the given ones: the same text is the Spark select list and the oracle's view.
POINTS = "c_custkey AS point_id, CAST((c_custkey * 37) % 1000 AS DOUBLE) AS x, CAST((c_custkey * 91) % 1000 AS DOUBLE) AS y, c_nationkey AS sheet"
LABELS = "s_suppkey AS label_id, CAST((s_suppkey * 53) % 1000 AS DOUBLE) AS x, CAST((s_suppkey * 71) % 1000 AS DOUBLE) AS y, s_nationkey AS sheet"
SEGMENTS = (
    "o_orderkey AS segment_id, o_custkey AS run_id, o_orderpriority AS layer_ref, CAST((o_orderkey * 37) % 1000 AS DOUBLE) AS x0, CAST((o_orderkey * 91) % 1000 AS DOUBLE) AS y0, "
    "CAST((o_orderkey * 37) % 1000 + (o_custkey % 41) - 20 AS DOUBLE) AS x1, CAST((o_orderkey * 91) % 1000 + (o_custkey % 29) - 14 AS DOUBLE) AS y1"
)
ENTITIES = (
    "l_orderkey * 10 + l_linenumber AS entity_id, l_linestatus AS revision_id, l_returnflag AS layer_ref, l_linenumber % 4 AS kind, l_orderkey AS parent_id, "
    "l_linenumber AS sequence_index, l_partkey AS block_ref, l_quantity AS value"
)


def select_list(df: DataFrame, text: str) -> DataFrame:
    """df with a select list that has no commas inside parentheses."""
    return df.selectExpr(*text.split(", "))


def view(name: str, text: str, source: str) -> str:
    return f"{name} AS (SELECT {text} FROM {source})"


V_POINTS, V_LABELS = view("points", POINTS, "customer"), view("labels_at", LABELS, "supplier")
V_SEGMENTS, V_ENTITIES = view("segments", SEGMENTS, "orders"), view("entities", ENTITIES, "lineitem")
