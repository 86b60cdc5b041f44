"""Colours and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 32-bit FNV-1a.
FNV_BASIS, FNV_PRIME, MASK32 = 2166136261, 16777619, 0xFFFFFFFF

#: Multipliers of the label hash.
LABEL_MULTIPLIERS = (0x7FEB352D, 0x846CA68B)


def rgb_of_hex(text: Column) -> Column:
    """'#rrggbb' or 'rrggbb' as a struct of three ints."""
    n = F.conv(F.regexp_replace(text, "^#", ""), 16, 10).cast("long")
    part = lambda k: F.shiftright(n, k).bitwiseAND(F.lit(255).cast("long")).cast("int")
    return F.struct(part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


def hex_of_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0") for c in (r, g, b)))


def packed_rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Red to alpha from the top byte down, as a signed 32-bit number."""
    n = sum((F.shiftleft(c.cast("long"), k) for c, k in ((g, 16), (b, 8), (a, 0))), F.shiftleft(r.cast("long"), 24))
    return F.when(n >= 2**31, n - F.lit(2**32)).otherwise(n)


def unpacked_rgba(n: Column) -> Column:
    u = F.pmod(n.cast("long"), F.lit(2**32))
    part = lambda k: F.shiftright(u, k).bitwiseAND(F.lit(255).cast("long")).cast("int")
    return F.array(part(24), part(16), part(8), part(0))


def parsed_colour(text: Column) -> Column:
    """RGBA of a whole number (whatever its digits), of rgb()/rgba(), of eight hex digits as AARRGGBB, or of six as RRGGBB; else null."""
    hexed = F.regexp_extract(text, r"^#?([0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$", 1)
    wide = F.lpad(hexed, 8, "f")
    pair = lambda k: F.conv(F.substring(wide, k, 2), 16, 10).cast("int")
    call = r"^rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*(?:,\s*([\d.]+)\s*)?\)$"
    piece = lambda k: F.regexp_extract(text, call, k)
    share = piece(4).try_cast("double")
    alpha = F.when(piece(4) == "", 255).otherwise(F.floor(F.when(share <= 1, share * 255).otherwise(share) + 0.5).cast("int"))
    return (
        F.when(text.rlike(r"^-?\d{1,18}$"), unpacked_rgba(text.try_cast("long")))
        .when(text.rlike(call), F.array(piece(1).try_cast("int"), piece(2).try_cast("int"), piece(3).try_cast("int"), alpha))
        .when(hexed != "", F.array(pair(3), pair(5), pair(7), pair(1)))
    )


def display_rgb(x: Column) -> Column:
    """A linear share 0..1 as 0..255."""
    return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) * 255 + 0.5).cast("int")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the characters' codes (ASCII)."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(FNV_BASIS).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(MASK32).cast("long")))


def seed_colour(text: Column) -> Column:
    """A muted colour from the seed's hash."""
    h = fnv1a(text)
    part = lambda k: (F.shiftright(h, k).bitwiseAND(F.lit(0x9F).cast("long")) + 50).cast("int")
    return F.struct(part(0).alias("r"), part(8).alias("g"), part(16).alias("b"))


def _times32(x: Column, m: int) -> Column:
    """x * m modulo 2^32 without leaving 63 bits: by halves of m."""
    mask = F.lit(MASK32).cast("long")
    low = x * F.lit(m & 0xFFFF).cast("long")
    high = F.shiftleft((x * F.lit(m >> 16).cast("long")).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)
    return (low.bitwiseAND(mask) + high).bitwiseAND(mask)


def label_hash(label: Column, seed: Column) -> Column:
    """Xor-shift-multiply hash of a label, 32 bits unsigned."""
    x = label.cast("long").bitwiseXOR(seed.cast("long")).bitwiseAND(F.lit(MASK32).cast("long"))
    x = x.bitwiseXOR(F.shiftright(x, 16))
    x = _times32(x, LABEL_MULTIPLIERS[0])
    x = x.bitwiseXOR(F.shiftright(x, 15))
    x = _times32(x, LABEL_MULTIPLIERS[1])
    return x.bitwiseXOR(F.shiftright(x, 16))


def accent_hue(text: Column) -> Column:
    """Hue 0..359 from characters weighted by their place."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, i: F.ascii(c).cast("long") * (i + 1))
    return F.pmod(F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(360).cast("long"))


def canonical_hash(*columns: Column) -> Column:
    """SHA-256 of the columns' canonical JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
