"""Greedy pairing of members that stand in classes: a class's members have the same candidates, so candidates are kept between classes only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.graph import min_label_components
from plumbline.sources.tables import Scratch

#: Members and edges that one task settles in order.
SMALL = 1 << 21
TAKEN = "a long, b long, n long"


def _settled(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, n): the pairs of each part, taken in order in a task of its own that holds the part's members and edges, but none of its candidates."""

    def settle(held, joins):
        from array import array
        from bisect import bisect_right

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        ids = held.column("id").combine_chunks()
        if pa.types.is_nested(ids.type):
            listed = [tuple((v is not None, v if v is not None else 0) for v in r.values()) for r in ids.to_pylist()]
            order = np.array(sorted(range(len(listed)), key=listed.__getitem__), np.int64)
        else:
            order = pc.sort_indices(ids).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        owner = held.column("cls").to_numpy()
        by_class = np.lexsort((rank, owner))
        names, start = np.unique(owner[by_class], return_index=True)
        end = np.append(start[1:], len(owner)).tolist()
        start, ranks = start.tolist(), array("q", rank[by_class].tobytes())
        code = np.repeat(np.arange(len(names)), np.diff(np.append(start, len(owner)))).astype(np.int64) if len(names) else np.empty(0, np.int64)
        of = array("q", code.tobytes())
        a, b, cost, ordered = (joins.column(c).to_numpy() for c in ("a", "b", "cost", "ordered"))
        at = [np.minimum(np.searchsorted(names, v), max(len(names) - 1, 0)) for v in (a, b)]
        known = (names[at[0]] == a) & (names[at[1]] == b) if len(names) else np.zeros(len(a), bool)
        a, b, cost, ordered = at[0][known], at[1][known], cost[known], ordered[known]
        turn = np.argsort(cost, kind="stable")
        a, b, cost, ordered = a[turn], b[turn], cost[turn], ordered[turn]
        cuts = np.flatnonzero(np.diff(cost)) + 1
        levels = zip([0, *cuts.tolist()], [*cuts.tolist(), len(cost)]) if len(cost) else ()
        a, b, ordered = array("q", a.astype(np.int64).tobytes()), array("q", b.astype(np.int64).tobytes()), bytearray(ordered.astype(np.uint8).tobytes())
        following = array("q", range(len(owner) + 1))  # the next free place at or behind each, shortened as it is followed

        def free(p):
            while following[p] != p:
                following[p] = following[following[p]]
                p = following[p]
            return p

        def first(target, least, p):
            return free(bisect_right(ranks, ranks[p], start[target], end[target]) if least else start[target])

        won = {}
        for low, high in levels:
            if high - low == 1:
                one, two, least = a[low], b[low], ordered[low]
                p, n = free(start[one]), 0
                while p < end[one]:
                    q = first(two, least, p)
                    if q >= end[two]:
                        break
                    following[p], following[q], n = p + 1, q + 1, n + 1
                    p = free(p)
                if n:
                    won[one, two] = won.get((one, two), 0) + n
                continue
            targets, waiting = {}, []
            for k in range(low, high):
                if free(start[b[k]]) < end[b[k]]:
                    targets.setdefault(a[k], []).append((b[k], ordered[k]))
            for one in targets:
                p = free(start[one])
                while p < end[one]:
                    waiting.append(p)
                    p = free(p + 1)
            waiting.sort(key=ranks.__getitem__)
            for p in waiting:
                if following[p] != p:
                    continue
                best = chosen = -1
                for two, least in targets[of[p]]:
                    q = first(two, least, p)
                    if q < end[two] and (best < 0 or ranks[q] < ranks[best]):
                        best, chosen = q, two
                if best >= 0:
                    following[p], following[best] = p + 1, best + 1
                    won[of[p], chosen] = won.get((of[p], chosen), 0) + 1
        pairs = list(won)
        name = lambda k: pa.array([int(names[p[k]]) for p in pairs], pa.int64())
        return pa.table({"a": name(0), "b": name(1), "n": pa.array(list(won.values()), pa.int64())})

    return members.groupBy("part").cogroup(edges.groupBy("part")).applyInArrow(settle, TAKEN)


def _heads(members: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((a, b, i, j) won, edges whose classes still have candidates): the pairs that are the first of all candidates of both their classes."""
    ends = members.groupBy("cls").agg(F.min("id").alias("head"), F.max("id").alias("top")).where("head is not null")
    one, two = ends.select(F.col("cls").alias("a"), F.col("head").alias("i")), ends.select(F.col("cls").alias("b"), "top")
    open_ = edges.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where("not ordered or i < top").withColumn("key", F.struct("cost", "i"))
    best = open_.select(F.explode(F.array("a", "b")).alias("cls"), "key").groupBy("cls").agg(F.min("key").alias("best"))
    for end in "ab":
        open_ = open_.join(best.select(F.col("cls").alias(end), F.col("best").alias(f"best_{end}")).hint("merge"), end)
    mine = open_.where("key = best_a").withColumn("ready", F.expr("key = best_b"))
    ready = mine.groupBy("a").agg(F.min("ready").alias("all")).where("all").select("a")
    met = mine.join(ready.hint("merge"), "a", "left_semi").join(members.select(F.col("cls").alias("b"), F.col("id").alias("j")).hint("merge"), "b").where("not ordered or j > i")
    won = met.groupBy("a", "i").agg(F.min(F.struct("j", "b")).alias("w")).select("a", "w.b", "i", "w.j")
    return won, open_.select(edges.columns)


def greedy_class_pairs(members: DataFrame, edges: DataFrame, small: int = SMALL, rounds: int = 4) -> DataFrame:
    """(a, b, n): how many pairs each edge gets, taken greedily by (cost, i, j), each member once.

    members (part, cls, id): classes of whole numbers, ids that differ. edges (part, a, b, cost, ordered): every member i of a is a candidate
    with every j of b, or where ``ordered`` with those of greater id. Parts share no class. Candidates are never made as rows: they grow with the
    square of a class's members, members and edges don't. A part of at most ``small`` members and edges is settled in order in a task; larger ones
    are cut into classes that reach each other, and those still larger go through rounds of joins until they are small. A null id is no candidate.
    """
    with Scratch(edges.sparkSession) as s:
        members, taken, cut = members.where("id is not null"), [], False
        while True:
            counts = members.groupBy("part").agg(F.count("*").alias("n")).union(edges.groupBy("part").agg(F.count("*")))
            large = s.table(counts.groupBy("part").agg(F.sum("n").alias("n")).where(F.col("n") > small).select("part"), "large")
            if large.isEmpty():
                taken.append(s.table(_settled(members, edges), "taken", keep=True))
                break
            of = lambda df, how: df.join(large.hint("merge"), "part", how).select(df.columns)
            taken.append(s.table(_settled(of(members, "left_anti"), of(edges, "left_anti")), "taken", keep=True))
            members, edges = s.table(of(members, "left_semi"), "members"), s.table(of(edges, "left_semi"), "edges")
            for _ in range(rounds if cut else 0):
                won, open_ = _heads(members, edges)
                won, edges = s.table(won, "won"), s.table(open_, "edges")
                used = won.select(F.inline(F.array(F.struct(F.col("a").alias("cls"), F.col("i").alias("id")), F.struct(F.col("b").alias("cls"), F.col("j").alias("id")))))
                members = s.table(members.join(used.hint("merge"), ["cls", "id"], "left_anti").select(members.columns), "members")
                taken.append(s.table(won.groupBy("a", "b").agg(F.count("*").alias("n")), "taken", keep=True))
            parts = min_label_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
            named = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(parts.hint("merge"), "node", "left").select(F.col("node").alias("cls"), F.coalesce("component", "node").alias("part"))
            named, cut = s.table(named, "parts"), True
            members = s.table(members.drop("part").join(named.hint("merge"), "cls").select(members.columns), "members")
            edges = s.table(edges.drop("part").join(named.withColumnRenamed("cls", "a").hint("merge"), "a").select(edges.columns), "edges")
    pairs = taken[0]
    for t in taken[1:]:
        pairs = pairs.union(t)
    return pairs
