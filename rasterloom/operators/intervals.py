"""Interval-set algebra: sets of the x axis, one for each key, as rows with x0 and x1.

Sets are [x0, x1) and need not be disjoint or sorted; results are disjoint, sorted by nothing, and as few as possible.
Everything is one sweep over sorted ends: ends at one place are added up before they move, running sums say which sets
cover what follows. Work is linear in the ends, however many overlap; no pairs are made. A key's ends meet in one
task, so keys should be rows of a mask or the like; the row of a mask has a bounded width."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNION: Callable[[Column, Column], Column] = lambda a, b: a | b
DIFFERENCE: Callable[[Column, Column], Column] = lambda a, b: a & ~b
INTERSECTION: Callable[[Column, Column], Column] = lambda a, b: a & b
EXCLUSIVE: Callable[[Column, Column], Column] = lambda a, b: a != b


#: Ends that a task sorts at once; with fewer rows than that one task is enough.
TASK_ENDS = 1 << 20


def dealt(rows: DataFrame, keys: Sequence[str], ends: int) -> DataFrame:
    """rows by their keys over as many tasks as that many ends need.

    Spark joins small partitions by their bytes as they are written, and sorted ends take up to twenty times those bytes."""
    return rows.repartition(max(1, -(-ends // TASK_ENDS)), *keys)


def _ends(rows: DataFrame, keys: Sequence[str], a: int, b: int) -> DataFrame:
    both = F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d"))))
    return rows.where("x0 < x1").select(*keys, both.alias("e")).select(*keys, "e.x", (F.col("e.d") * a).alias("a"), (F.col("e.d") * b).alias("b"))


def combined(a: DataFrame, b: DataFrame, keys: Sequence[str], keep: Callable[[Column, Column], Column]) -> DataFrame:
    """keys, x0 and x1 of the places that keep() takes, given whether a and whether b covers them."""
    ends = _ends(a, keys, 1, 0).unionByName(_ends(b, keys, 0, 1)).groupBy(*keys, "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ends = dealt(ends, keys, 2 * (a.count() + b.count()))  # the sets should be cheap to count, as written tables are
    along = Window.partitionBy(*keys).orderBy("x")
    covers = lambda c: F.sum(c).over(along) > 0
    inside = ends.select(*keys, "x", keep(covers("a"), covers("b")).alias("inside"))
    turns = inside.withColumn("before", F.lag("inside", 1, False).over(along)).where("inside <> before")
    return turns.select(*keys, F.col("x").alias("x0"), F.lead("x").over(along).alias("x1"), "inside").where("inside").drop("inside")


def united(a: DataFrame, keys: Sequence[str]) -> DataFrame:
    return combined(a, a.limit(0), keys, UNION)


def from_runs(runs: DataFrame) -> DataFrame:
    """Runs of pixels, of which the last is x1, as intervals."""
    return runs.withColumn("x1", F.col("x1") + 1)


def to_runs(intervals: DataFrame) -> DataFrame:
    return intervals.withColumn("x1", F.col("x1") - 1)
