"""Palettes: colours of a group's channels that lie far apart in OKLab, found by exchanges; locked ones stay.

The objective is the smallest distance of two colours of the group. A step takes the next unlocked channel and gives it
the candidate that lies farthest from all others, if that is farther than its own colour; so the smallest distance
never falls. Restarts are rows: the first begins with the colours as they are, the others with candidates chosen by a
hash of group, restart and channel; the best one is taken. Everything is an expression on one row for a restart."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of the candidates' grid for each of red, green and blue; least lightness of a candidate; sweeps and restarts.
GRID, LEAST_LIGHT, SWEEPS, RESTARTS = 6, 0.55, 4, 6

# From linear sRGB to cone responses, and from their cube roots to OKLab.
_CONES = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def oklab(r: Column, g: Column, b: Column) -> Column:
    """Lightness and the two opponent axes of a colour with parts of 0..255."""

    def linear(c: Column) -> Column:
        s = c / 255.0
        return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    rgb = [linear(c) for c in (r, g, b)]
    cones = [F.cbrt(sum(k * c for k, c in zip(row, rgb))) for row in _CONES]
    light, green_red, blue_yellow = (sum(k * c for k, c in zip(row, cones)) for row in _LAB)
    return F.struct(light.alias("l"), green_red.alias("a"), blue_yellow.alias("b"))


def _with_lab(c: Column) -> Column:
    return F.struct(c["r"].cast("int").alias("r"), c["g"].cast("int").alias("g"), c["b"].cast("int").alias("b"), oklab(c["r"], c["g"], c["b"]).alias("lab"))


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(sum((x[k] - y[k]) * (x[k] - y[k]) for k in ("l", "a", "b")))


def _nearest(c: Column, colours: Column, slot: Column) -> Column:
    """Distance of a colour to the nearest of the others."""
    others = F.filter(colours, lambda _, i: i != slot)
    return F.array_min(F.transform(others, lambda o: distance(c["lab"], o["lab"])))


def spread(colours: Column) -> Column:
    """The smallest distance of two colours; null for fewer."""
    return F.array_min(F.filter(F.transform(colours, lambda c, i: _nearest(c, colours, i)), lambda d: d.isNotNull()))


def optimised(groups: DataFrame, seed: int = 0) -> DataFrame:
    """group, colours and spread of groups (group, colours: array of r, g, b, locked: array of booleans).

    Groups of fewer than two channels, or with locked ones only, keep their colours."""
    steps = [round(255 * k / (GRID - 1)) for k in range(GRID)]
    cube = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip("rgb", c))) for c in product(steps, repeat=3)))
    candidates = F.filter(F.transform(cube, _with_lab), lambda c: c["lab"]["l"] >= LEAST_LIGHT)
    g = groups.select("group", F.transform("colours", _with_lab).alias("now"), "locked").withColumn("cube", candidates)
    g = g.withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(RESTARTS - 1))))
    slot_hash = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("group"), F.col("restart"), i), F.size("cube").cast("long")).cast("int")
    begun = F.transform("now", lambda c, i: F.when((F.col("restart") == 0) | F.get("locked", i), c).otherwise(F.get("cube", slot_hash(i))))

    def exchanged(colours: Column, step: Column) -> Column:
        slot = step % F.size("now")
        scored = F.transform("cube", lambda c: F.struct(_nearest(c, colours, slot).alias("d"), c.alias("c")))
        best = F.array_max(scored)
        better = ~F.get("locked", slot) & (best["d"] > _nearest(F.get(colours, slot), colours, slot))
        return F.when(better, F.transform(colours, lambda c, i: F.when(i == slot, best["c"]).otherwise(c))).otherwise(colours)

    fit = F.aggregate(F.sequence(F.lit(0), SWEEPS * F.size("now") - 1), begun, exchanged)
    free = (F.size("now") >= 2) & F.exists("locked", lambda x: ~x)
    tried = g.withColumn("found", F.when(free, fit).otherwise(F.col("now")))
    best = tried.groupBy("group").agg(F.max_by("found", F.struct(F.coalesce(spread(F.col("found")), F.lit(0.0)), -F.col("restart"))).alias("found"))
    return best.select("group", F.transform("found", lambda c: F.struct(c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"))).alias("colours"), spread(F.col("found")).alias("spread"))


def applied(rows: DataFrame, palette: DataFrame) -> DataFrame:
    """rows (group, pos, locked, colour) with the colours of palette (group, colours) at their pos, but for locked ones."""
    out = rows.join(palette.select("group", F.col("colours").alias("new_")), "group", "left")
    return out.withColumn("colour", F.when(F.col("locked"), F.col("colour")).otherwise(F.coalesce(F.get("new_", F.col("pos").cast("int")), "colour"))).select(rows.columns)


def default_grouping(groups: DataFrame) -> DataFrame:
    """document and whether all its groups (document, name, n) are those of an import: 'Group 1' and so on, of one to four."""
    return groups.groupBy("document").agg(F.every(F.col("name").rlike(r"^Group \d+$") & F.col("n").between(1, 4)).alias("default"))
