"""Bit fields of container headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format, by number.
ALPHA = ("Normal", "Opaque255", "Transparent0", "Mask1Bit")
TRANSFORMS = ("None", "SubGreen", "SubRed", "SubBlue")
PREDICTORS = ("None", "Delta", "Paeth", "Up")


def _bits(c: Column, n: int, mask: int) -> Column:
    return F.shiftright(c, n).bitwiseAND(F.lit(mask))


def label(names: tuple[str, ...], number: Column) -> Column:
    """The name of a number; null if there is none."""
    return F.get(F.array(*map(F.lit, names)), number.cast("int"))


def number(names: tuple[str, ...], name: Column) -> Column:
    """The number of a name; null if there is none."""
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), name), F.lit(0)).cast("int") - 1


def flags(pixel_format: Column, feature: Column, channels: Column) -> Column:
    return F.shiftleft(pixel_format, 16).bitwiseOR(F.shiftleft(feature, 8)).bitwiseOR(channels)


def parse_flags(c: Column) -> dict[str, Column]:
    return {"pixfmt": _bits(c, 16, 65535), "qval": _bits(c, 8, 255), "channels": _bits(c, 0, 255)}


def dimmask(width: Column, height: Column) -> Column:
    return F.shiftleft(width.cast("long"), 32).bitwiseOR(height.cast("long"))


def parse_dimmask(c: Column) -> dict[str, Column]:
    return {"width": F.shiftrightunsigned(c, 32), "height": c.bitwiseAND(F.lit(0xFFFFFFFF))}


def feature(predictor: Column, alpha: Column, has_meta: Column, transform: Column) -> Column:
    """predictor and has_meta are boolean, alpha and transform names."""
    parts = [predictor.cast("int"), F.shiftleft(number(ALPHA, alpha), 1), F.shiftleft(has_meta.cast("int"), 3), F.shiftleft(number(TRANSFORMS, transform), 4)]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]).bitwiseOR(parts[3])


def parse_feature(c: Column, version: Column | None = None) -> dict[str, Column]:
    """Before version 2 there is no transform."""
    transform = label(TRANSFORMS, _bits(c, 4, 3))
    if version is not None:
        transform = F.when(version < 2, F.lit("None")).otherwise(transform)
    return {"predictor": _bits(c, 0, 1) == 1, "alpha": label(ALPHA, _bits(c, 1, 3)), "has_meta": _bits(c, 3, 1) == 1, "transform": transform}


def legacy_predictors(feature_byte: Column, streams: Column) -> Column:
    """Predictors of a file without predictor bytes: Delta in all streams if its bit is set, but None for a mask."""
    parsed = parse_feature(feature_byte)
    kind = F.when(parsed["predictor"], F.lit("Delta")).otherwise(F.lit("None"))
    mask = parsed["alpha"] == "Mask1Bit"
    return F.transform(F.sequence(F.lit(0), streams - 1), lambda i: F.when((i == 3) & mask, F.lit("None")).otherwise(kind))
