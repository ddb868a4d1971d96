"""Raw sensor samples to sRGB: crop, levels, white balance, colour matrix, gamma and demosaicing, on tables of samples.

Samples are rows (image_id, y, x, v), of one component unless a function says otherwise. Levels and gains are fixed
numbers of a camera, so they are parameters, not columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: XYZ to linear sRGB.
XYZ_TO_RGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))


@dataclass(frozen=True)
class Camera:
    """black, white, gains: for the colours 0 to 3 (red, green, blue, second green); matrix: camera to XYZ, three rows of
    three, or None; cfa: colours of the filter pattern by row and column."""

    black: tuple[float, ...] = (0.0,) * 4
    white: tuple[float, ...] = (65535.0,) * 4
    gains: tuple[float, ...] = (1.0,) * 4
    matrix: tuple[tuple[float, ...], ...] | None = None
    cfa: tuple[tuple[int, ...], ...] = ((0, 1), (1, 2))

    def balance(self) -> tuple[float, ...]:
        """Gains relative to green; those that are no positive number are 1. If any is none, all are neutral."""
        good = lambda v: math.isfinite(v) and v > 0
        gains = self.gains if all(map(good, self.gains)) else (1.0,) * 4
        return tuple(v / gains[1] if good(v / gains[1]) else 1.0 for v in gains)

    def usable_matrix(self) -> tuple[tuple[float, ...], ...] | None:
        flat = [v for row in self.matrix or () for v in row]
        return self.matrix if flat and all(map(math.isfinite, flat)) and any(abs(v) > 1e-6 for v in flat) else None


def _clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def _of(values: tuple[float, ...], colour: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.least(colour, F.lit(3)) + 1).cast("int"))


def integer_level(v: Column, colour: Column, camera: Camera) -> Column:
    """An integer sample between black and white as 0 to 1, times its gain, at most 8."""
    black = _of(camera.black, colour)
    white = F.greatest(_of(camera.white, colour), black + 1)
    return _clip(_clip((v - black) / (white - black), 0.0, 1.0) * _of(camera.balance(), colour), 0.0, 8.0)


def float_level(v: Column, colour: Column, camera: Camera) -> Column:
    """A float sample times its gain, from 0 to 8; 0 if it is no finite number."""
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, 0.0).otherwise(_clip(F.greatest(v, F.lit(0.0)) * _of(camera.balance(), colour), 0.0, 8.0))


def gamma(linear: Column) -> Column:
    """A linear value as an 8-bit sRGB sample; 0 if it is no finite number."""
    v = F.when(linear.isNull() | F.isnan(linear), 0.0).otherwise(_clip(linear, 0.0, 1.0))
    s = F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)
    return F.floor(_clip(s * 255 + 0.5, 0.0, 255.0)).cast("long")


def to_srgb(rgb: list[Column], camera: Camera) -> list[Column]:
    """8-bit red, green and blue of a camera colour."""
    matrix = camera.usable_matrix()
    if matrix is not None:
        xyz = [sum((F.lit(m) * c for m, c in zip(row, rgb, strict=False)), F.lit(0.0)) for row in matrix]
        rgb = [sum((F.lit(m) * c for m, c in zip(row, xyz, strict=True)), F.lit(0.0)) for row in XYZ_TO_RGB]
    return [gamma(c) for c in rgb]


def crop_by(samples: DataFrame, width: Column, height: Column, top: int = 0, right: int = 0, bottom: int = 0, left: int = 0) -> DataFrame:
    """The samples inside the margins of images of these sides, counted from there; an image of which nothing is left is an error."""
    left_over = (width > left + right) & (height > top + bottom)
    inside = (F.col("x") >= left) & (F.col("x") < width - right) & (F.col("y") >= top) & (F.col("y") < height - bottom)
    checked = samples.where(F.when(left_over, inside).otherwise(F.raise_error(F.lit("the crop leaves nothing")).cast("boolean")))
    return checked.withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


def monochrome(samples: DataFrame, camera: Camera, *, floats: bool = False) -> DataFrame:
    """image_id, y, x, r, g, b, a of samples of one component."""
    level = (float_level if floats else integer_level)(F.col("v"), F.lit(1), camera)
    return samples.select("image_id", "y", "x", *[gamma(level).alias(c) for c in "rgb"], F.lit(255).alias("a"))


def camera_rgb(samples: DataFrame, camera: Camera, *, floats: bool = False) -> DataFrame:
    """image_id, y, x, r, g, b, a of samples of three components (v0, v1, v2)."""
    level = float_level if floats else integer_level
    rgb = [level(F.col(f"v{k}"), F.lit(k), camera) for k in range(3)]
    return samples.select("image_id", "y", "x", *[c.alias(n) for c, n in zip(to_srgb(rgb, camera), "rgb", strict=True)], F.lit(255).alias("a"))


def colour_at(y: Column, x: Column, camera: Camera) -> Column:
    h, w = len(camera.cfa), len(camera.cfa[0])
    flat = F.array(*[F.lit(v) for row in camera.cfa for v in row])
    return F.element_at(flat, ((y % h) * w + x % w + 1).cast("int"))


def needed_reach(camera: Camera, top: int, left: int) -> int:
    """The largest radius at which any pixel of any image first meets a colour that its search would find at all.

    Small images and borders decide it, so sizes up to two patterns and a sample are tried.
    """
    h, w = len(camera.cfa), len(camera.cfa[0])
    most, found = max(h, w, 2), 1
    for ih in range(1, 2 * h + 2):
        for iw in range(1, 2 * w + 2):
            places = {c: [(y, x) for y in range(ih) for x in range(iw) if (k := camera.cfa[(y + top) % h][(x + left) % w]) == c or (c == 1 and k == 3)] for c in range(3)}
            for at in places.values():
                if at:
                    far = (min(max(abs(y - ay), abs(x - ax)) for ay, ax in at) for y in range(ih) for x in range(iw))
                    found = max(found, *(d for d in far if d <= most), 1)
    return found


def demosaic(samples: DataFrame, camera: Camera, top: int = 0, left: int = 0, *, floats: bool = False) -> DataFrame:
    """image_id, y, x, r, g, b, a: each colour from the sample itself, or else the mean of the smallest square around it,
    up to the pattern's size (2 at least), that has any. Colour 3 counts as green; a colour that no square has is the sample.

    samples are cropped; top and left are the crop's margins, for the pattern. Each sample goes to the pixels whose
    squares hold it, with its distance, and a pixel sums by colour and distance: one exchange by pixel.
    """
    reach = needed_reach(camera, top, left)
    kind = colour_at(F.col("y") + top, F.col("x") + left, camera)
    level = (float_level if floats else integer_level)(F.col("v"), kind, camera)
    own = samples.select("image_id", "y", "x", level.alias("level"), F.when(kind == 3, 1).otherwise(kind).alias("colour"))
    near = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(max(abs(dy), abs(dx))).alias("far")) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)])
    sent = own.withColumn("n", F.explode(near)).select("image_id", (F.col("y") + F.col("n.dy")).alias("y"), (F.col("x") + F.col("n.dx")).alias("x"), "level", "colour", "n.far")
    sums = [F.struct(F.lit(d).alias("far"), F.sum(F.when((F.col("colour") == c) & (F.col("far") <= d), F.col("level"))).alias("s"), F.count_if((F.col("colour") == c) & (F.col("far") <= d)).alias("n")) for c in range(3) for d in range(reach + 1)]
    self_ = F.max(F.when(F.col("far") == 0, F.struct("level", "colour"))).alias("self")
    met = sent.groupBy("image_id", "y", "x").agg(self_, *[s.alias(f"c{i // (reach + 1)}_{i % (reach + 1)}") for i, s in enumerate(sums)]).where("self is not null")
    rgb = []
    for c in range(3):
        value = F.col("self.level")
        for d in range(reach, -1, -1):
            cell = F.col(f"c{c}_{d}")
            value = F.when(cell["n"] > 0, cell["s"] / cell["n"]).otherwise(value)
        rgb.append(value)
    return met.select("image_id", "y", "x", *[v.alias(n) for v, n in zip(to_srgb(rgb, camera), "rgb", strict=True)], F.lit(255).alias("a"))
