"""Co-registration of sheets: baseline rotation and scale, members of a floor, home runs over two sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.graph import shortest_paths
from plumbline.operators.hull import widest_pairs
from plumbline.operators.takeoff import register_sheets, shifted


def baseline(matches: DataFrame, group: str, label: str) -> DataFrame:
    """(group, label_i, label_j, rotation, scale) from matched points (group, label, x, y, tx, ty): the two source points that lie
    farthest apart (ties by label), and how the vector between their targets is turned (degrees, -180 to 180) and scaled.
    """
    ends = widest_pairs(matches, [group], label)
    one = matches.select(group, F.col(label).alias("i"), F.struct(*[F.col(k) for k in ("x", "y", "tx", "ty")]).alias("p"))
    two = one.withColumnsRenamed({"i": "j", "p": "q"})
    met = ends.join(one, [group, "i"]).join(two, [group, "j"])
    best = met.select(group, F.struct(F.col("i").alias(label), F.col("j").alias("l2"), "p.*", *[F.col(f"q.{k}").alias(f"{k}2") for k in ("x", "y", "tx", "ty")]).alias("b"))
    c = lambda n: F.col(f"b.{n}")
    turn = F.degrees(F.atan2(c("ty2") - c("ty"), c("tx2") - c("tx")) - F.atan2(c("y2") - c("y"), c("x2") - c("x")))
    turn = F.pmod(turn + 180, F.lit(360.0)) - 180
    size = lambda a, b: F.sqrt((c(f"{a}x2") - c(f"{a}x")) ** 2 + (c(f"{b}y2") - c(f"{b}y")) ** 2)
    return best.select(group, c(label).alias("label_i"), c("l2").alias("label_j"), turn.alias("rotation"), (size("t", "t") / F.nullif(size("", ""), F.lit(0.0))).alias("scale"))


def floor_members(source: DataFrame, target: DataFrame, group: str, label: str = "label", max_turn: float = 0.5, max_scale: float = 0.01) -> DataFrame:
    """(group, dx, dy, rotation, scale, quality, outcome, reason): sheets that register well by shift, rotation and scale are ``ok``;
    the others ``failed``, for the first of quality, rotation and scale that is out of tolerance."""
    frames = register_sheets(source, target, group, label)
    once = lambda df: df.join(df.groupBy(group, label).agg(F.count("*").alias("__n")).where("__n = 1"), [group, label], "left_semi")
    matches = once(source).select(group, label, "x", "y").join(once(target).select(group, label, F.col("x").alias("tx"), F.col("y").alias("ty")), [group, label])
    met = frames.join(baseline(matches, group, label), group, "left")
    reason = F.when(F.col("quality") != "good", F.col("quality")).when(F.abs("rotation") > max_turn, "rotation").when(F.abs(F.col("scale") - 1) > max_scale, "scale")
    return met.withColumn("reason", reason).withColumn("outcome", F.when(F.col("reason").isNull(), "ok").otherwise("failed"))


def two_sheet_home_runs(circuits: DataFrame, tray_nodes: DataFrame, tray_edges: DataFrame, frames: DataFrame, group: str, reach: float) -> DataFrame:
    """(group, circuit_id, distance, status) of circuits (group, circuit_id, x, y) to the nearest board over the trays of another sheet.

    frames: shifts (dx, dy) of each group's tray sheet into the circuits' frame; tray_nodes: node, x, y, board (true at boards);
    tray_edges: u, v, weight. A circuit enters at the tray node nearest to it within ``reach`` (ties by node). A group without a
    frame is ``no_containment_sheet``; a circuit without a node in reach ``no_anchor``, one whose node reaches no board ``unreachable``.
    """
    from plumbline.operators.spatial import nearest_within

    moved = shifted(tray_nodes, frames, group)
    near = nearest_within(circuits, moved.select(group, "node", "x", "y"), reach, "circuit_id", ["node"], ["node"], [group])
    near = near.join(frames.select(group, F.lit(True).alias("__framed")), group, "left")
    boards = moved.where("board").select(F.lit(0).alias("source"), "node")
    runs = shortest_paths(tray_edges, boards).groupBy("node").agg(F.min("distance").alias("run"))
    met = near.withColumnRenamed("distance", "entry").join(runs, "node", "left")
    status = F.when(F.col("__framed").isNull(), "no_containment_sheet").when(F.col("node").isNull(), "no_anchor").when(F.col("run").isNull(), "unreachable").otherwise("ok")
    return met.select(group, "circuit_id", F.when(status == "ok", F.col("run") + F.col("entry")).alias("distance"), status.alias("status"))


def good_frames(members: DataFrame, group: Sequence[str]) -> DataFrame:
    """The shifts of the members that are ok."""
    return members.where("outcome = 'ok'").select(*group, "dx", "dy")
