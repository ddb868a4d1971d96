"""A viewport on an image: scale, centre, zoom, pan and the pixels that it shows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import raster as R

#: The least and the greatest scale.
LEAST, GREATEST = 0.01, 8.0


def fit(image: tuple[int, int], window: tuple[int, int]) -> float:
    """The scale at which an image fits a window; never above 1."""
    if 0 in (*image, *window):
        return 1.0
    return min(max(min(window[0] / image[0], window[1] / image[1], 1.0), LEAST), GREATEST)


def fit_scale(width: Column, height: Column, window_width: int, window_height: int) -> Column:
    """fit() of images in columns."""
    s = F.least(F.lit(float(window_width)) / width, F.lit(float(window_height)) / height, F.lit(1.0))
    return F.when((width == 0) | (height == 0), 1.0).otherwise(F.least(F.greatest(s, F.lit(LEAST)), F.lit(GREATEST)))


@dataclass(frozen=True)
class Viewport:
    """image and window: width and height; scale: window pixels for each image pixel; centre: of the window, in the image."""

    image: tuple[int, int]
    window: tuple[int, int]
    scale: float
    centre: tuple[float, float]

    @classmethod
    def fitted(cls, image: tuple[int, int], window: tuple[int, int]) -> Viewport:
        return cls(image, window, fit(image, window), (image[0] / 2, image[1] / 2)).clamped()

    def clamped(self) -> Viewport:
        """Centred along a side that the window shows whole, else inside the image."""
        if 0 in (*self.image, *self.window):
            return self
        half = [w / self.scale / 2 for w in self.window]
        at = [n / 2 if 2 * h >= n else min(max(c, h), n - h) for c, h, n in zip(self.centre, half, self.image, strict=True)]
        return replace(self, centre=(at[0], at[1]))

    def to_image(self, x: float, y: float) -> tuple[float, float]:
        """The image point under a window point."""
        return (x - self.window[0] / 2) / self.scale + self.centre[0], (y - self.window[1] / 2) / self.scale + self.centre[1]

    def scaled(self, scale: float, x: float, y: float) -> Viewport:
        """At another scale, with the same image point under the window point (x, y)."""
        scale = min(max(scale, fit(self.image, self.window)), GREATEST)
        px, py = self.to_image(x, y)
        return replace(self, scale=scale, centre=(px - (x - self.window[0] / 2) / scale, py - (y - self.window[1] / 2) / scale)).clamped()

    def zoomed(self, factor: float, x: float, y: float) -> Viewport:
        return self.scaled(self.scale * factor, x, y)

    def one_to_one(self) -> Viewport:
        return self.scaled(1.0, self.window[0] / 2, self.window[1] / 2)

    def panned(self, dx: float, dy: float, *, in_image: bool = False) -> Viewport:
        """Moved by window pixels, as one drags an image, or by image pixels."""
        x, y = (self.centre[0] + dx, self.centre[1] + dy) if in_image else (self.centre[0] - dx / self.scale, self.centre[1] - dy / self.scale)
        return replace(self, centre=(x, y)).clamped()


def render(pixels: DataFrame, at: Viewport) -> DataFrame:
    """image_id, ty, tx, r, g, b: the window's pixels, each the image pixel below its middle, over black.

    pixels: image_id, y, x, r, g, b, a. Each image pixel says which window pixels it fills, so nothing is joined.
    """

    def span(c: str, axis: int):
        # Window pixel t shows floor((t + 0.5 - window / 2) / scale + centre).
        w, s, m = at.window[axis], at.scale, at.centre[axis]
        shown = lambda t: F.floor((t + 0.5 - w / 2) / s + m)
        low = F.floor((F.col(c) - m) * s + w / 2 - 0.5).cast("int") - 1
        high = F.ceil((F.col(c) + 1 - m) * s + w / 2 - 0.5).cast("int") + 1
        return F.filter(F.sequence(low, high), lambda t: (t >= 0) & (t < w) & (shown(t) == F.col(c)))

    inside = pixels.where((F.col("x") >= 0) & (F.col("x") < at.image[0]) & (F.col("y") >= 0) & (F.col("y") < at.image[1]))
    shown = inside.withColumn("tx", F.explode(span("x", 0))).withColumn("ty", F.explode(span("y", 1)))
    over = [R.premultiplied(F.col(c), F.col("a")).alias(c) for c in "rgb"]
    return shown.select("image_id", F.col("ty").cast("long").alias("ty"), F.col("tx").cast("long").alias("tx"), *over)


#: What an event does to a viewport: its name in op, with the arguments a, b and c.
MOVES = {
    "zoom": lambda v, a, b, c: v.zoomed(a, b, c),
    "pan": lambda v, a, b, c: v.panned(a, b),
    "move": lambda v, a, b, c: v.panned(a, b, in_image=True),
    "whole": lambda v, a, b, c: v.one_to_one(),
    "fit": lambda v, a, b, c: Viewport.fitted(v.image, v.window),
}


def replay(events: DataFrame, window: tuple[int, int]) -> DataFrame:
    """viewer, seq, scale, x, y after each event (viewer, seq, width, height, op, a, b, c) of viewers who begin with the
    image of their first event fitted into the window.

    Events are sorted by viewer and seq within their partition and pass by, with the state of one viewer at a time, so a
    viewer may have any number of them. An unknown op, or one whose arguments are null, changes nothing.
    """
    types = [("viewer", pa.int64()), ("seq", pa.int64()), ("scale", pa.float64()), ("x", pa.float64()), ("y", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, now = None, None
        for batch in batches:
            out = []
            for viewer, seq, w, h, op, *args in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or viewer != who:
                    who, now = viewer, Viewport.fitted((w, h), window)
                if op in MOVES and (op in ("whole", "fit") or None not in args[: 3 if op == "zoom" else 2]):
                    now = MOVES[op](now, *args)
                out.append((viewer, seq, now.scale, *now.centre))
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True) if out else [[]] * 5, types, strict=True)], names=[n for n, _ in types])

    some = events.selectExpr("cast(viewer as bigint) viewer", "cast(seq as bigint) seq", "cast(width as int) width", "cast(height as int) height", "op", "cast(a as double) a", "cast(b as double) b", "cast(c as double) c")
    ordered = some.repartition("viewer").sortWithinPartitions("viewer", "seq")
    return ordered.mapInArrow(run, "viewer long, seq long, scale double, x double, y double")
