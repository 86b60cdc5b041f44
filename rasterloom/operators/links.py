"""List ranking: rows that name their successor become ordered loops, in as many joins as the longest has binary digits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.sources.written import written


def loops(links: DataFrame) -> DataFrame:
    """plane, node, loop, pos and n of the nodes on closed loops; those on chains that end are left out.

    links: plane, node (long) and next, at most one row for a node, and each node is next of at most one. loop is the
    smallest node of the loop, which has pos 0, and n the number of its nodes. A round doubles how far each node sees:
    it takes over what its farthest node knows of the smallest node ahead. Rounds end when nothing has changed and no
    chain has been cut; then every node has seen its whole loop. Joins are by plane and node, so one large plane or
    loop is spread like many small ones."""
    state = written(links.select("plane", "node", "next", F.col("node").alias("low"), F.lit(0).cast("long").alias("ahead"), F.lit(True).alias("moved")))
    left, seen = state.count(), 1
    while left:
        far = state.select("plane", F.col("node").alias("next"), F.col("next").alias("far_next"), F.col("low").alias("far_low"), F.col("ahead").alias("far_ahead"))
        nearer = F.col("far_low") < F.col("low")
        step = state.join(far, ["plane", "next"]).select(
            "plane",
            "node",
            F.col("far_next").alias("next"),
            F.least("low", "far_low").alias("low"),
            F.when(nearer, F.col("far_ahead") + seen).otherwise(F.col("ahead")).alias("ahead"),
            nearer.alias("moved"),
        )
        state = written(step, state)
        before, (left, moved) = left, state.agg(F.count(F.lit(1)), F.count_if("moved")).first()
        seen *= 2
        if left == before and not moved:
            break
    sizes = state.groupBy("plane", "low").agg(F.count(F.lit(1)).alias("n"))
    ranked = state.join(sizes, ["plane", "low"]).select("plane", "node", F.col("low").alias("loop"), F.pmod(F.col("n") - F.col("ahead"), F.col("n")).alias("pos"), "n")
    return written(ranked, state)
