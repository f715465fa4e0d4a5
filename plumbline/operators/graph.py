"""Graphs of snapped endpoints: components, circuits, trees, shortest paths, greedy pairing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import grid_cell
from plumbline.sources.tables import Scratch, delete, tasks_for, written

#: Each pair of rounds at least halves the depth of a component; more than this means a defect.
MAX_ROUNDS = 60
#: Rounds whose pairs are one plan's union; then they are written as one table.
PLAN_STEPS = 16


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


#: Links that a task contracts at once.
CHUNK = 1 << 19


def _contracted(links: DataFrame) -> DataFrame:
    """Links (u > v) of the same components: those that one task holds at once become stars. Links of other than whole numbers and texts stay."""
    if not isinstance(links.schema["u"].dataType, (T.IntegralType, T.StringType)):
        return links.distinct()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def stars(held):
            ends = pa.Table.from_batches(held)
            coded = pa.chunked_array([c for name in ("u", "v") for c in ends.column(name).chunks]).combine_chunks().dictionary_encode()
            names = coded.dictionary
            order = pc.sort_indices(names).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            code = rank[coded.indices.to_numpy()]
            a, b = code[: len(ends)], code[len(ends) :]
            low = np.arange(len(order))
            while len(a):
                x, y = low[a], low[b]
                np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
                while (low[low] != low).any():
                    low = low[low]
                apart = low[a] != low[b]
                a, b = a[apart], b[apart]
            hung = np.flatnonzero(low != np.arange(len(low)))
            return pa.RecordBatch.from_arrays([names.take(pa.array(order[hung])), names.take(pa.array(order[low[hung]]))], names=["u", "v"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield stars(held)
                held, n = [], 0
        if n:
            yield stars(held)

    most = CHUNK
    return links.mapInArrow(run, links.schema)


def min_label_components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (columns u, v); component is the smallest node.

    The links that a task holds at once become stars first; components that are one star then are done, the others' links go
    through rounds. Links with a null end and self-links are ignored.
    """
    spark = links.sparkSession
    ordered = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges, path = written(_contracted(ordered), "links")
    ends = edges.select(F.col("u").alias("node"), "v", F.lit(False).alias("r")).union(edges.select(F.col("v").alias("node"), F.lit(None).cast(edges.schema["v"].dataType), F.lit(True)))
    per = ends.groupBy("node").agg(F.min("v").alias("m"), F.max("v").alias("x"), F.max("r").alias("r"))
    # A node under two others, or under one and over one, is in no single star.
    nodes, path_nodes = written(per.select("node", F.coalesce("m", "node").alias("component"), (F.col("m").isNotNull() & (F.col("r") | (F.col("m") != F.col("x")))).alias("bad")), "nodes")
    bad = nodes.where("bad").select(F.col("node").alias("u"))
    if bad.isEmpty():
        delete(spark, path)
        return nodes.select("node", "component")
    open_ = edges.join(bad, "u", "left_semi")
    centres, path_centres = written(open_.select("v").union(edges.join(bad.withColumnRenamed("u", "v"), "v", "left_semi").select("v")).distinct(), "centres")
    rest, path_rest = written(edges.join(centres, "v", "left_semi").select("u", "v").distinct(), "links")
    done, _ = written(nodes.join(centres.withColumnRenamed("v", "component"), "component", "left_anti").select("node", "component"), "stars")
    delete(spark, path, path_nodes, path_centres)
    return done.union(_rounds(rest, path_rest))


def _rounds(edges: DataFrame, path: str) -> DataFrame:
    """(node, component) of written links (u > v, each once).

    Large-star hangs every larger neighbour of a node on the smallest of its neighbourhood, small-star the
    smaller ones; both keep components and end in one star for each. A node's minimum is pre-aggregated
    before the shuffle and written, so that the join with a hub's many links is an exchange on both
    sides, which Spark can split. A round writes as many files as its links need, not one for each shuffle
    partition.
    """
    spark, old = edges.sparkSession, []
    mark = _mark(edges)
    for _ in range(MAX_ROUNDS):
        if mark[0] == 0:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        few = tasks_for(mark[0])
        low, p1 = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(2 * few), "stars")
        large, p2 = written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(few), "links")
        low2, p3 = written(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(few), "stars")
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        turned = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        new, p4 = written(turned.union(low2.select("u", F.col("m").alias("v"))).distinct().coalesce(few), "links")
        old += [path, p1, p2, p3]
        path, edges, before, mark = p4, new, mark, _mark(new)
        delete(spark, *old)
        old.clear()
        if mark == before:
            break
    else:
        raise RuntimeError(f"components still change after {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def component_sizes(rows: DataFrame, row_id: str, nodes: Sequence[str]) -> DataFrame:
    """(row, component, size): rows that share a node are one component; size counts rows. Rows without nodes are alone.

    Each row links its nodes; a row's component is that of its first node.
    """
    first = F.coalesce(*nodes)
    links = rows.select(first.alias("u"), F.explode(F.array(*nodes)).alias("v")).where("v is not null")
    parts = min_label_components(links)
    met = rows.select(row_id, first.alias("node")).join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    met, _ = written(met.select(row_id, "component"), "members")
    sizes = met.where("component is not null").groupBy("component").agg(F.count("*").alias("size"))
    return met.join(sizes, "component", "left").select(row_id, "component", F.coalesce("size", F.lit(1).cast("long")).alias("size"))


def topology(segments: DataFrame, tolerance: float, segment_id: str = "segment_id", closed: str | None = None, group: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of segments whose endpoints snap to grid cells: degree, mean point, terminal.

    Node names begin with the group's values, so that nodes of several drawings stay apart also by name alone.
    """
    cell = lambda x, y: F.concat_ws(":", *[F.col(g).cast("string") for g in group], grid_cell(F.col(x), tolerance).cast("string"), grid_cell(F.col(y), tolerance).cast("string"))
    edges = segments.withColumn("u", cell("x0", "y0")).withColumn("v", cell("x1", "y1"))
    shut = F.col(closed) if closed else F.lit(False)
    end = lambda n, i: edges.select(*group, F.col(n).alias("node"), F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"), shut.alias("c"))
    nodes = end("u", 0).union(end("v", 1)).groupBy(*group, "node").agg(F.count("*").alias("degree"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.max("c").alias("c"))
    return nodes.withColumn("terminal", (F.col("degree") == 1) & ~F.col("c")).drop("c"), edges


def circuits(edges: DataFrame, devices: DataFrame, edge_id: str, device: str) -> tuple[DataFrame, DataFrame]:
    """(circuits, members) of a topology's edges (u, v): connected edges are a circuit, named by its smallest node.

    circuits: circuit_id, n_edges, anchor (the lowest device at one of its nodes; devices have node and the device column);
    members: the edge and its circuit. An edge without a node (null u or v) has no circuit.
    """
    parts = min_label_components(edges.select("u", "v"))
    own = edges.select(edge_id, F.least("u", "v").alias("node")).where("node is not null")
    # A closed edge links no two nodes; its node alone names its circuit.
    members, _ = written(own.join(parts, "node", "left").select(edge_id, F.coalesce("component", "node").alias("circuit_id")), "members")
    at = devices.join(parts, "node", "left").select(F.coalesce("component", "node").alias("circuit_id"), device).groupBy("circuit_id").agg(F.min(device).alias("anchor"))
    sizes = members.groupBy("circuit_id").agg(F.count("*").alias("n_edges"))
    return sizes.join(at, "circuit_id", "left"), members


def tree_walk(rows: DataFrame, key: str, parent: str, roots: DataFrame, max_depth: int) -> DataFrame:
    """(key, root, depth, path) of every node reached from the roots (column key), level by level.

    A node on its own path is a cycle and isn't followed.
    """
    level = roots.select(F.col(key), F.col(key).alias("root"), F.lit(0).alias("depth"), F.array(key).alias("path"))
    found = level
    children = rows.select(F.col(key).alias("__k"), F.col(parent).alias("__p")).where("__p is not null")
    for depth in range(1, max_depth + 1):
        level = level.join(children, F.col(key) == F.col("__p")).where(~F.array_contains("path", F.col("__k")))
        level = level.select(F.col("__k").alias(key), "root", F.lit(depth).alias("depth"), F.array_append("path", F.col("__k")).alias("path"))
        level, _ = written(level, "level")
        if level.isEmpty():
            break
        found = found.union(level)
    return found


def shortest_paths(edges: DataFrame, sources: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(source, node, distance) by relaxing all sources at once until nothing improves.

    edges: u, v, weight (both directions are walked, weights not below zero); sources: source, node. Only improved
    nodes send on and only improvements are written; every few rounds they are merged. More than ``max_rounds``
    rounds, the edges of the longest shortest path, are an error.
    """
    both = edges.select("u", "v", "weight").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
    merge = lambda df: df.groupBy("source", "node").agg(F.min("distance").alias("distance"))
    with Scratch(edges.sparkSession) as s:
        both = s.table(both.groupBy("u", "v").agg(F.min("weight").cast("double").alias("weight")), "edges")
        moved = best = s.table(sources.select("source", "node", F.lit(0.0).alias("distance")).distinct(), "reach")
        for rounds in range(1, max_rounds + 1):
            sent = moved.join(both, F.col("node") == F.col("u")).groupBy("source", F.col("v").alias("node")).agg(F.min(F.col("distance") + F.col("weight")).alias("new"))
            met = sent.join(merge(best), ["source", "node"], "left").where(F.col("distance").isNull() | (F.col("new") < F.col("distance")))
            moved = s.table(met.select("source", "node", F.col("new").alias("distance")), "moved")
            if moved.isEmpty():
                return s.table(merge(best), "reach", keep=True)
            best = best.union(moved)
            if rounds % PLAN_STEPS == 0:
                best = s.table(merge(best), "reach")
    raise RuntimeError(f"paths still improve after {max_rounds} rounds")


def _pairs_of_components(rest: DataFrame, left: str, right: str, small: int) -> tuple[DataFrame, DataFrame]:
    """(pairs won, candidates left): candidates that reach each other are passed over in order in one task, where they are at most ``small``.

    A pair with a null end keeps its other end from later pairs, as in the rounds.
    """
    parts = min_label_components(rest.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.col(left).alias("u"), F.col(right).alias("v")))
    end = F.coalesce(left, right)
    tagged = rest.join(parts, end.eqNullSafe(F.col("node")), "left").withColumn("__part", F.coalesce("component", end))
    sizes = tagged.groupBy("__part").agg(F.count("*").alias("__n")).where(F.col("__n") <= small)
    few = tagged.join(sizes, tagged["__part"].eqNullSafe(sizes["__part"]), "left_semi")
    schema = rest.select(left, right, "cost").schema

    def settle(table):
        import pyarrow as pa

        def key(v):
            return tuple(v.values()) if isinstance(v, dict) else v

        def low(v):  # null comes first, as in Spark's order
            return tuple((x is not None, x) if x is not None else (False, 0) for x in (key(v) if isinstance(key(v), tuple) else (v,)))

        rows = sorted(table.to_pylist(), key=lambda r: (low(r["cost"]), low(r[left]), low(r[right])))
        taken, won, last = set(), [], None
        for r in rows:
            i, j = key(r[left]), key(r[right])
            if (i, j, r["cost"]) == last:
                won.append(r)
            elif i not in taken and j not in taken:
                taken |= {i, j} - {None}
                if i is not None and j is not None:
                    won.append(r)
                    last = (i, j, r["cost"])
        return pa.Table.from_pylist(won, schema=table.schema)

    won = few.select(left, right, "cost", "__part").groupBy("__part").applyInArrow(settle, few.select(left, right, "cost", "__part").schema).select(*schema.names)
    return won, tagged.join(sizes, tagged["__part"].eqNullSafe(sizes["__part"]), "left_anti").select(*rest.columns)


def greedy_pairs(candidates: DataFrame, cost: str, left: str = "i", right: str = "j", small: int = 10_000, rounds: int = 4) -> DataFrame:
    """Pairs taken greedily by (cost, i, j), each end used once: in rounds, pairs that are the best of both ends are taken.

    Both ends have one type; structs name their fields alike.
    After some rounds what is left is cut into the candidates that reach each other: those of at most ``small`` are settled in
    order, each such part in a task of its own, and the rounds go on with the larger ones until none is left.
    """
    ends = lambda df: df.select(F.col(left).alias("e"), "rank").union(df.select(F.col(right).alias("e"), "rank"))
    with Scratch(candidates.sparkSession) as s:
        rest, taken, done = s.table(candidates.select(left, right, F.col(cost).alias("cost"), F.struct(cost, left, right).alias("rank")), "pairs"), None, 0
        while not rest.isEmpty():
            if done and done % rounds == 0 and small:
                won, rest = _pairs_of_components(rest, left, right, small)
                won, rest = s.table(won, "won"), s.table(rest, "pairs")
            else:
                best = ends(rest).groupBy("e").agg(F.min("rank").alias("best"))
                a, b = best.select(F.col("e").alias(left), F.col("best").alias("best_i")), best.select(F.col("e").alias(right), F.col("best").alias("best_j"))
                won = s.table(rest.join(a, left).join(b, right).where("rank = best_i and rank = best_j").select(left, right, "cost"), "won")
                if won.isEmpty():
                    break
                used = won.select(F.col(left).alias("e")).union(won.select(F.col(right).alias("e")))
                rest = s.table(rest.join(used.withColumnRenamed("e", left), left, "left_anti").join(used.withColumnRenamed("e", right), right, "left_anti").select(rest.columns), "pairs")
            taken, done = won if taken is None else taken.union(won), done + 1
            if done % PLAN_STEPS == 0:
                taken = s.table(taken, "taken")
        return s.table(rest.select(left, right, "cost") if taken is None else taken, "taken", keep=True)
