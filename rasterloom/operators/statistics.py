"""Histograms, contrast limits and counts of planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.functions.pixels import sane_limits

BINS = 50


def thresholds(bits: int) -> list[int]:
    """Distinct upper bounds of the bins: powers of two, evenly spaced in the exponent."""
    return sorted({int(2 ** (bits * k / BINS)) for k in range(BINS)})


def sampled(i: Column, width: int, step: int = 4) -> Column:
    """Every fourth pixel, or every pixel of every fourth row."""
    return (i % step == 0) | (F.floor(i / width) % step == 0)


def log_histogram(pixels: DataFrame, bits: int, width: int) -> DataFrame:
    """channel, bin, upper and n of every bin; pixels has channel, i and v.

    Only positive values count, and those above the last bound do not. Empty bins are there: a grid of the
    channels and the at most 50 bounds is filled by the counts, which are aggregated before they move."""
    bounds = thresholds(bits)
    array = F.array(*map(F.lit, bounds))
    bin_of = F.size(F.filter(array, lambda t: t < F.col("v")))
    counts = pixels.where(sampled(F.col("i"), width) & (F.col("v") > 0) & (F.col("v") <= bounds[-1])).groupBy("channel", bin_of.alias("bin")).agg(F.count("*").alias("n"))
    grid = pixels.select("channel").distinct().select("channel", F.posexplode(array).alias("bin", "upper"))
    return grid.join(counts, ["channel", "bin"], "left").select("channel", "bin", "upper", F.coalesce("n", F.lit(0)).alias("n"))


def percentile_limits(pixels: DataFrame, low: float = 0.001, high: float = 0.999, least_positive: int = 64) -> DataFrame:
    """channel, lower and upper: exact ranks over a 16-bit histogram; positive values alone if zeros weigh too much."""
    hist = pixels.groupBy("channel", "v").agg(F.count("*").alias("n"))
    mass = hist.groupBy("channel").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("v") > 0, F.col("n")).otherwise(0)).alias("positive"))
    heavy = ((F.col("total") - F.col("positive")) / F.col("total") >= 0.001) & (F.col("positive") >= least_positive)
    ranked = hist.join(mass.withColumn("heavy", heavy), "channel").where(~F.col("heavy") | (F.col("v") > 0))
    size = F.when(F.col("heavy"), F.col("positive")).otherwise(F.col("total"))
    # a channel has 65,536 different values at most
    ranked = ranked.withColumn("cum", F.sum("n").over(W.partitionBy("channel").orderBy("v")))
    lo, hi = F.greatest(F.lit(0), F.floor(low * (size - 1))), F.least(size - 1, F.ceil(high * (size - 1)))
    found = ranked.groupBy("channel").agg(F.min(F.when(F.col("cum") > lo, F.col("v"))).alias("vmin"), F.min(F.when(F.col("cum") > hi, F.col("v"))).alias("vmax"))
    limits = sane_limits(F.col("vmin").cast("double"), F.col("vmax").cast("double"))
    return found.select("channel", limits.alias("l")).select("channel", F.col("l.lower").alias("lower"), F.col("l.upper").alias("upper"))


def missing_statistics(requests: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct requests that the cache doesn't hold."""
    return requests.select(*keys).distinct().join(cached.select(*keys), keys, "left_anti")


def merge_histograms(channels: DataFrame, fresh: DataFrame) -> DataFrame:
    """channels (id, counts) with fresh counts where there were none; what is there stays."""
    own = fresh.select(F.col("id"), F.col("counts").alias("__fresh"))
    return channels.join(own, "id", "left").withColumn("counts", F.when(F.size("counts") > 0, F.col("counts")).otherwise(F.coalesce("__fresh", "counts"))).drop("__fresh")


def merge_limits(channels: DataFrame, fits: DataFrame, overwrite: bool) -> DataFrame:
    """channels (id, lower, upper) with fitted limits; those that are there stay unless overwrite."""
    own = fits.select("id", F.col("lower").alias("__lo"), F.col("upper").alias("__hi"))
    take = F.col("__lo").isNotNull() & (F.lit(overwrite) | F.col("lower").isNull())
    joined = channels.join(own, "id", "left")
    return joined.withColumn("upper", F.when(take, F.col("__hi")).otherwise(F.col("upper"))).withColumn("lower", F.when(take, F.col("__lo")).otherwise(F.col("lower"))).drop("__lo", "__hi")


def looks_like_default(lower: Column, upper: Column) -> Column:
    """Whether limits are those that an import sets."""
    return ((lower == 32) & (upper == 16384)) | ((lower == 0) & upper.isin(65535, 255))


def foreground_ratio(pixels: DataFrame, threshold: float, inside: Column) -> DataFrame:
    """Share of the pixels inside the content whose value passes the threshold, for each plane."""
    return pixels.groupBy("plane").agg((F.count_if(inside & (F.col("v") > threshold)) / F.nullif(F.count_if(inside), F.lit(0))).alias("ratio"))


def argmax(values: DataFrame, key: str) -> DataFrame:
    """The first index of the largest value for each key."""
    return values.groupBy(key).agg(F.max_by("i", F.struct(F.col("v"), -F.col("i"))).alias("best"))


#: Bins of an octave, passes of the fit, and the least variance (in squared octaves) of a mode.
_OCTAVE, _PASSES, _LEAST_VARIANCE = 16, 60, 1 / (12 * 16**2)


def modes(pixels: DataFrame) -> DataFrame:
    """channel, n and modes: weight, mean and variance of three normal modes of the logarithm (base 2) of positive values.

    Expectation maximisation over counts of sixteenths of octaves: pixels are counted once, then a channel is one row of
    256 counts at most, and the passes are folds over it, for all channels in one job. A pass never lowers the
    likelihood; modes start evenly between the smallest and the largest value."""
    bins = pixels.where("v > 0").groupBy("channel", F.floor(F.log2(F.col("v").cast("double")) * _OCTAVE).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    rows = bins.groupBy("channel").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct(((F.col("bin") + 0.5) / _OCTAVE).alias("x"), F.col("n").cast("double").alias("n")))).alias("h"))  # 16 bins an octave
    low, high = F.get("h", 0)["x"], F.element_at("h", -1)["x"]
    mode = lambda w, m, v: F.struct(w.alias("w"), m.alias("m"), v.alias("v"))
    width = F.greatest((high - low) / 6, F.lit(1.0 / _OCTAVE))
    start = F.array(*(mode(F.lit(1 / 3), low + (high - low) * (k + 0.5) / 3, width * width) for k in range(3)))

    def passed(now: Column, _: Column) -> Column:
        def add(sums: Column, b: Column) -> Column:
            dense = F.transform(now, lambda k: k["w"] / F.sqrt(k["v"]) * F.exp(-(b["x"] - k["m"]) * (b["x"] - k["m"]) / (2 * k["v"])) + 1e-300)
            total = F.aggregate(dense, F.lit(0.0), lambda a, x: a + x)
            share = F.transform(dense, lambda d: d / total * b["n"])
            return F.zip_with(sums, share, lambda s, r: F.struct((s["n"] + r).alias("n"), (s["x"] + r * b["x"]).alias("x"), (s["xx"] + r * b["x"] * b["x"]).alias("xx")))

        none = F.array(*(F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("x"), F.lit(0.0).alias("xx")) for _ in range(3)))
        sums = F.aggregate("h", none, add)
        return F.transform(sums, lambda s: mode(s["n"] / F.col("n"), s["x"] / s["n"], F.greatest(F.lit(_LEAST_VARIANCE), s["xx"] / s["n"] - F.pow(s["x"] / s["n"], F.lit(2.0)))))

    fit = F.aggregate(F.sequence(F.lit(1), F.lit(_PASSES)), start, passed)
    ordered = F.transform(F.array_sort(F.transform(fit, lambda k: F.struct(k["m"].alias("m"), k["v"].alias("v"), k["w"].alias("w")))), lambda k: mode(k["w"], k["m"], k["v"]))
    return rows.select("channel", "n", ordered.alias("modes"))


def mixture_limits(pixels: DataFrame, least: int = 64) -> DataFrame:
    """channel, lower and upper by the three modes of a channel; by percentiles where it has fewer positive values than least.

    Own objective, not that of any other tool: lower is where the first and the second mode are as many of their own
    deviations away, upper two deviations above the third, and not above the largest value."""
    found = modes(pixels).where(F.col("n") >= least)
    k = lambda i: F.get("modes", i)
    one, two = F.sqrt(k(0)["v"]), F.sqrt(k(1)["v"])
    lower, upper = (k(0)["m"] * two + k(1)["m"] * one) / (one + two), k(2)["m"] + 2 * F.sqrt(k(2)["v"])
    top = pixels.groupBy("channel").agg(F.max("v").cast("double").alias("top"))
    fits = found.join(top, "channel").select("channel", sane_limits(F.floor(F.pow(F.lit(2.0), lower)), F.least("top", F.ceil(F.pow(F.lit(2.0), upper)))).alias("l"))
    rest = percentile_limits(pixels).withColumnsRenamed({"lower": "lower_", "upper": "upper_"})
    return rest.join(fits, "channel", "left").select("channel", F.coalesce("l.lower", "lower_").alias("lower"), F.coalesce("l.upper", "upper_").alias("upper"))
