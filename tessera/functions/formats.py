"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def megabytes(n: Column) -> Column:
    """Units of 2**20 bytes with one decimal; ties go to the even digit."""
    return F.format_string("%.1fMB", F.bround(n / float(1 << 20), 1))


def channel_name(i: Column, channels: Column) -> Column:
    """R, G, B and A where there are three or four channels, else C and the number."""
    plain = F.concat(F.lit("C"), i.cast("string"))
    rgb = F.get(F.array(*map(F.lit, "RGBA")), i.cast("int"))
    known = (channels >= 3) & (i >= 0) & ((i < 3) | ((i == 3) & (channels == 4)))
    return F.when(known, rgb).otherwise(plain)


def seconds(nanoseconds: Column) -> Column:
    """Whole seconds, nine decimals and the unit."""
    whole = F.floor(nanoseconds / 1_000_000_000)
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((nanoseconds % 1_000_000_000).cast("string"), 9, "0"), F.lit(" sec"))


def percent(part: Column, whole: Column) -> Column:
    return F.format_string("%.1f%%", F.bround(part.cast("double") * 100 / F.nullif(whole, F.lit(0)), 1))
