"""Pixel values: transfer encodings, clamping and level arithmetic. All functions take and give columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U16, U8 = 65535, 255


def round_half_up(x: Column) -> Column:
    """floor(x + 0.5), which is not Spark's round for negative halves."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def encode_cube_root(v: Column) -> Column:
    """16 bits to 8 by the cube root."""
    return F.least(F.lit(U8).cast("long"), round_half_up(F.pow(v / F.lit(65536.0), F.lit(1.0 / 3.0)) * F.lit(256.0)))


def decode_cube_root(b: Column) -> Column:
    """8 bits back to 16."""
    return F.least(F.lit(U16).cast("long"), round_half_up(F.pow(b / F.lit(256.0), F.lit(3.0)) * F.lit(65536.0)))


def contrast_window(v: Column, low: Column, high: Column) -> Column:
    """v between the limits as 0..255, halves to even; 0 where the limits meet."""
    return F.when(high == low, F.lit(0).cast("long")).otherwise(F.bround(clamp((v - low) / (high - low) * F.lit(255.0), 0.0, 255.0)).cast("long"))


def composite_clamp(v: Column, low: Column, high: Column) -> Column:
    """v between the limits; the lower limit where they don't span anything."""
    return F.when(high <= low, low).otherwise(F.least(high, F.greatest(low, v)))


def baked_to_u16(b: Column) -> Column:
    return F.shiftleft(b.bitwiseAND(F.lit(255)), 8)


def raster_to_u16(v: Column, is_u8: Column) -> Column:
    """Any raster value as 16 bits: bytes move up, others are rounded and clamped, NaN is 0."""
    other = F.when(F.isnan(v), F.lit(0).cast("long")).otherwise(clamp(round_half_up(F.nanvl(v, F.lit(0.0))), 0, U16).cast("long"))
    return F.when(is_u8, F.shiftleft(F.floor(F.nanvl(v, F.lit(0.0))).cast("long"), 8)).otherwise(other)


def label_of(v: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), round_half_up(v))


def sane_limits(low: Column, high: Column) -> Column:
    """Limits as whole numbers of 16 bits with lower < upper, or null."""
    lo = clamp(round_half_up(low), 0, U16).cast("long")
    raw = clamp(round_half_up(high), 0, U16).cast("long")
    hi = F.when(raw <= lo, F.least(F.lit(U16).cast("long"), lo + 1)).otherwise(raw)
    finite = ~F.isnan(low) & ~F.isnan(high) & (F.abs(low) != F.lit(float("inf"))) & (F.abs(high) != F.lit(float("inf")))
    return F.when(finite & (hi > lo), F.struct(lo.alias("lower"), hi.alias("upper")))


def dtype_bits(dtype: Column) -> Column:
    """Bits that a histogram of this pixel type spans; floats count as 16."""
    digits = F.regexp_extract(dtype, r"(\d+)", 1)
    return F.when(dtype.rlike("(?i)float"), 16).when(digits != "", digits.cast("int")).otherwise(16)


def tiff_dtype(bits: Column, sample_format: Column) -> Column:
    """Pixel type from bits per sample and sample format (3 float, 2 signed, else unsigned)."""
    kind = F.when(sample_format == 3, "Float").when(sample_format == 2, "Int").otherwise("Uint")
    return F.concat(kind, bits.cast("string"))


def tile_size(width: Column, height: Column) -> Column:
    """The largest power of two that both tile sides hold."""
    return F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.lit(1.0), F.least(width, height).cast("double"))))).cast("long")


def levels(width: Column, height: Column, tile: int = 1024, most: int = 32) -> Column:
    """Levels of a pyramid whose sides are halved until both fit into a tile."""
    fits = F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.shiftright(F.greatest(width, height).cast("long"), 0) / F.pow(F.lit(2.0), k) < tile + 1)
    return F.least(F.lit(most), F.coalesce(F.element_at(fits, 1), F.lit(most - 1)) + 1)


def level_side(side: Column, level: Column, convention: str) -> Column:
    """A side at a level, by one of three conventions that differ: 'shift', 'round' or 'ceil'."""
    scaled = side / F.pow(F.lit(2.0), level)
    return {"shift": F.floor(scaled), "round": round_half_up(scaled), "ceil": F.ceil(scaled)}[convention].cast("long")


def ideal_level(long_side: Column, n_levels: Column, target: int = 1024) -> Column:
    """The level whose long side comes nearest to target from above."""
    return F.greatest(F.lit(0).cast("long"), F.least((n_levels - 1).cast("long"), F.floor(F.log2(F.greatest(long_side, F.lit(1)) / F.lit(float(target))))))


def slider_to_intensity(pos: Column, top: Column, log: bool, steps: int = 8192) -> Column:
    """Slider position 0..steps to an intensity, by powers of two or linearly."""
    share = clamp(pos / F.lit(float(steps)), 0.0, 1.0)
    return round_half_up(F.pow(F.lit(2.0), share * F.log2(top + F.lit(1.0))) - F.lit(1.0) if log else share * top)


def intensity_to_slider(v: Column, top: Column, log: bool, steps: int = 8192) -> Column:
    inside = F.least(top, F.greatest(F.lit(0.0), v))
    share = F.log2(inside + F.lit(1.0)) / F.log2(top + F.lit(1.0)) if log else inside / top
    return round_half_up(share * F.lit(float(steps)))
