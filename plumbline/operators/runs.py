"""Runs of routed services: consensus of ordered tags and bands, and mean points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import round_tag
from plumbline.operators.rooms import pair_in_order
from plumbline.operators.spatial import within_radius


def sequence_consensus(stacks: DataFrame, scans: DataFrame, group: Sequence[str], stack: str, scan: str) -> DataFrame:
    """(group, colour, service, n_votes): services of ordered tag stacks given to the bands of scans of equal length.

    ``stacks`` has group, stack, place, service and ``scans`` group, scan, place, colour, places from 0. A colour
    that gets two services abstains (null service). Both sides are counted by place before they meet.
    """
    def counted(df: DataFrame, key: str, value: str) -> DataFrame:
        """How often a value stands at a place of the group's stacks or scans of a length."""
        sized = df.join(df.groupBy(*group, key).agg(F.count("*").alias("length")), [*group, key])
        return sized.groupBy(*group, "length", "place", value).agg(F.count("*").alias(f"n_{value}"))

    met = counted(stacks, stack, "service").join(counted(scans, scan, "colour"), [*group, "length", "place"])
    votes = met.groupBy(*group, "colour").agg(F.min("service").alias("low"), F.max("service").alias("high"), F.sum(F.col("n_service") * F.col("n_colour")).alias("n_votes"))
    return votes.select(*group, "colour", F.when(F.col("low") == F.col("high"), F.col("low")).alias("service"), "n_votes")


def run_anchors(segments: DataFrame, run: str) -> DataFrame:
    """(run, x, y): mean midpoint of each run's segments."""
    return segments.groupBy(run).agg(F.avg((F.col("x0") + F.col("x1")) / 2).alias("x"), F.avg((F.col("y0") + F.col("y1")) / 2).alias("y"))


def reassembled(numbers: DataFrame, fragments: DataFrame, radius: float, group: Sequence[str] = (), eps: float = 1e-6) -> DataFrame:
    """(group, number_id, fragment_id, tag) of size numbers with the service fragment that completes them.

    Numbers (number_id, x, y, text) act in order of their ids: each takes the nearest fragment (fragment_id, x, y, text) within the
    radius that no earlier one took, none where two are within eps of each other, and the joined text must read as a tag. A
    number that takes none has nulls.
    """
    near = within_radius(numbers.select(*group, "number_id", "x", "y"), fragments.select(*group, "fragment_id", "x", "y"), radius, group)
    pairs = pair_in_order(near, "number_id", "fragment_id", "distance", group, eps)
    texts = fragments.select(*group, "fragment_id", F.col("text").alias("__t"))
    met = numbers.join(pairs, [*group, "number_id"], "left").join(texts, [*group, "fragment_id"], "left").withColumn("tag", round_tag(F.concat("text", "__t")))
    return met.select(*group, "number_id", F.when(F.col("tag").isNotNull(), F.col("fragment_id")).alias("fragment_id"), "tag")
