"""Mip chains: level sizes, their layout in one image, and the images themselves."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import compose, kernels, resample
from tessera.operators.layout import mip_levels
from tessera.sources import packfile, shared

#: Padding around each level, and the longest side of an image.
PAD, MAX_SIDE = 1, 22_000


@dataclass(frozen=True)
class MipSpec:
    """levels: how many below the first, None for all; heights: of these levels, instead of halving."""

    levels: int | None = None
    heights: tuple[int, ...] = ()

    @classmethod
    def of(cls, levels: int | None, heights: tuple[int, ...] = ()) -> MipSpec | None:
        """From options: no levels is no chain, 0 levels is a whole one; heights need levels, and as many if these are given."""
        if levels is None:
            if heights:
                raise ValueError("heights need a mip chain")
            return None
        if levels and heights and len(heights) != levels:
            raise ValueError(f"{levels} levels need {levels} heights, not {len(heights)}")
        return cls(levels or None, tuple(heights))

    def checked_heights(self, height: int) -> tuple[int, ...]:
        last = height
        for h in self.heights:
            if not 0 < h < last:
                raise ValueError(f"heights must fall from {height} and stay above 0, {h} follows {last}")
            last = h
        return self.heights

    def sizes(self, width: int, height: int) -> list[tuple[int, int]]:
        """(width, height) of the levels below the first."""
        if self.heights:
            return [(min(width, max(1, (width * h + height // 2) // height)), h) for h in self.checked_heights(height)]
        out, (w, h) = [], (width, height)
        while max(w, h) > 1 and (self.levels is None or len(out) < self.levels):
            w, h = max(1, w // 2), max(1, h // 2)
            out.append((w, h))
        if self.levels is not None and len(out) != self.levels:
            raise ValueError(f"{width} x {height} has {len(out)} levels, not {self.levels}")
        return out


def scaled(value: Column | int, source: Column | int, target: Column | int):
    """A side that scales with its sheet, rounded, from 1 to its value. Columns or numbers."""
    if isinstance(value, int):
        return min(value, max(1, (value * target + source // 2) // source))
    return F.least(value, F.greatest(F.lit(1).cast("long"), F.floor((value * target + F.floor(source / 2)) / source)))


def explicit_levels(images: DataFrame, heights: list[int]) -> DataFrame:
    """id, level, w, h of images (id, w, h): the first level and those of the heights below an image's own."""
    level = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(h).cast("long").alias("th")) for i, h in enumerate([0, *heights])])).alias("l")
    at = images.select("id", "w", "h", level).select("id", "w", "h", "l.*").where("level = 0 or th < h")
    return at.select("id", "level", F.when(F.col("level") == 0, F.col("w")).otherwise(scaled(F.col("w"), F.col("h"), F.col("th"))).alias("w"), F.when(F.col("level") == 0, F.col("h")).otherwise(F.col("th")).alias("h"))


def layout(levels: DataFrame, pad: int = PAD) -> DataFrame:
    """id, side, width, height, level, x, y of the levels (id, level, w, h) of each image in one image of its own.

    The levels below the first stand in a column to its right or in a row below it: the layout with the smaller longest
    side, area and sum of sides; right if they are alike. An image's levels, some tens at most, are one row.
    """
    by = levels.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("level", (F.col("w") + 2 * pad).alias("w"), (F.col("h") + 2 * pad).alias("h")))).alias("l"))
    zero = F.lit(0).cast("long")
    rest = F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))
    top = lambda c: F.coalesce(F.array_max(F.transform(rest, lambda x: x[c])), zero)
    sum_ = lambda c: F.aggregate(rest, zero, lambda s, x: s + x[c])
    w0, h0 = F.col("l")[0]["w"], F.col("l")[0]["h"]
    sides = [("right", w0 + top("w"), F.greatest(h0, sum_("h"))), ("bottom", F.greatest(w0, sum_("w")), h0 + top("h"))]
    options = [F.struct(F.greatest(w, h).alias("a"), (w * h).alias("b"), (w + h).alias("c"), F.lit(k).alias("rank"), F.lit(n).alias("side"), w.alias("width"), h.alias("height")) for k, (n, w, h) in enumerate(sides)]
    best = by.select("id", "l", F.array_min(F.array(*options)).alias("best"))
    before = lambda c: F.transform("l", lambda x, i: F.when(i == 0, zero).otherwise(F.aggregate(F.slice("l", 2, F.greatest(i - 1, F.lit(0))), zero, lambda s, y: s + y[c])))
    right = F.col("best.side") == "right"
    xs = F.when(right, F.transform("l", lambda x, i: F.when(i == 0, zero).otherwise(F.col("l")[0]["w"]))).otherwise(before("w"))
    ys = F.when(right, before("h")).otherwise(F.transform("l", lambda x, i: F.when(i == 0, zero).otherwise(F.col("l")[0]["h"])))
    each = best.select("id", F.col("best.side").alias("side"), F.col("best.width").alias("width"), F.col("best.height").alias("height"), F.explode(F.arrays_zip(F.col("l.level").alias("level"), xs.alias("x"), ys.alias("y"))).alias("p"))
    return each.select("id", "side", "width", "height", "p.level", (F.col("p.x") + pad).alias("x"), (F.col("p.y") + pad).alias("y"))


def level_rows(rows: DataFrame, levels: int | None = None, channels: int = 4) -> DataFrame:
    """image_id, level, y, row: the levels of images (image_id, y, row), whose rows are of one width and count from 0.

    Each level comes from the one before it, of all images in one round of the kernel joins. The kernels of all rounds are
    made at once, in folders by round, and a round writes its level into the shared folder, so that the next doesn't make
    it again. Rounds end when all sides are one, or after levels.
    """
    spark, where = rows.sparkSession, shared.folder(rows.sparkSession, "levels")

    def kept(df: DataFrame, name: str, *by: str) -> DataFrame:
        df.write.partitionBy(*by).parquet(f"{where}/{name}")
        return spark.read.schema(df.schema).parquet(f"{where}/{name}")

    sizes = rows.groupBy(F.col("image_id").alias("id")).agg(F.first(F.floor(F.size("row") / channels)).alias("w"), F.count("*").alias("h"))
    sizes = kept(mip_levels(sizes), "sizes")
    after = sizes.select("id", (F.col("level") - 1).alias("level"), F.col("w").alias("nw"), F.col("h").alias("nh"))
    steps = sizes.join(after, ["id", "level"]).withColumn("radius", F.least("w", "h") * resample.ONE)
    if levels is not None:
        steps = steps.where(F.col("level") < levels)
    steps = kept(steps.withColumnRenamed("id", "image_id"), "steps")

    def made(kind: Callable[[DataFrame], DataFrame], side: str) -> DataFrame:
        need = steps.select(F.col(side).alias("src"), F.col(f"n{side}").alias("dst"), "radius", "level").distinct()
        return kept(kind(need).join(need, ["src", "dst", "radius"]), f"kernels-{side}", "level")

    across, down = made(kernels.blocks, "w"), made(kernels.bands, "h")
    now = kept(rows.select("image_id", F.col("y").cast("long").alias("y"), "row"), "0")
    every = now.select("image_id", F.lit(0).alias("level"), "y", "row")
    for k in range(steps.agg(F.max("level")).first()[0] + 1 if steps.limit(1).count() else 0):
        larger = now.join(steps.where(F.col("level") == k).select("image_id", "nw", "nh"), "image_id")
        own = tuple(table.where(F.col("level") == k).drop("level") for table in (across, down))
        now = kept(kernels.resize(larger, F.col("nw"), F.col("nh"), channels, kernels=own), str(k + 1))
        every = every.union(now.select("image_id", F.lit(k + 1), "y", "row"))
    return every


def chain_rows(rows: DataFrame, levels: int | None = None, pad: int = PAD, channels: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rows (sheet, y, row) of one image of all levels for each image (image_id, y, row), and where they stand on it:
    sheet, id (the level), x, y, w, h."""
    made = level_rows(rows, levels, channels)
    sizes = made.groupBy(F.col("image_id").alias("id"), "level").agg(F.first(F.floor(F.size("row") / channels)).alias("w"), F.count("*").alias("h"))
    spots = layout(sizes, pad)
    key = F.struct(F.col("id").alias("image_id"), "level")
    at = spots.join(sizes, ["id", "level"]).select(F.col("id").alias("sheet"), key.alias("id"), "x", "y", "w", "h")
    sheets = spots.groupBy(F.col("id").alias("sheet")).agg(F.first("width").alias("width"), F.first("height").alias("height"))
    keyed = made.select(F.struct("image_id", "level").alias("id"), "y", "row")
    return compose.sheets(keyed, at, sheets, pad, channels), at.withColumn("id", F.col("id.level"))


def place(sizes: list[tuple[int, int]], pad: int = PAD) -> tuple[int, int, list[tuple[int, int]]]:
    """Width, height and inner corners of all levels of one image, as layout() has them."""
    outer = [(w + 2 * pad, h + 2 * pad) for w, h in sizes]
    (w0, h0), rest = outer[0], outer[1:]
    right = w0 + max((w for w, _ in rest), default=0), max(h0, sum(h for _, h in rest))
    below = max(w0, sum(w for w, _ in rest)), h0 + max((h for _, h in rest), default=0)
    beside = min((right, below), key=lambda s: (max(s), s[0] * s[1], sum(s))) == right
    at, corners = 0, [(pad, pad)]
    for w, h in rest:
        corners.append((w0 + pad, at + pad) if beside else (at + pad, h0 + pad))
        at += h if beside else w
    return *(right if beside else below), corners


def blit(sheet: np.ndarray, px: np.ndarray, x: int, y: int, pad: int) -> None:
    """px at (x, y) with its edges and corners repeated pad times around it; what leaves the sheet is cut."""
    wide = np.pad(px, ((pad, pad), (pad, pad), (0, 0)), mode="edge")
    top, left = max(0, y - pad), max(0, x - pad)
    part = wide[top - (y - pad) :, left - (x - pad) :][: sheet.shape[0] - top, : sheet.shape[1] - left]
    sheet[top : top + part.shape[0], left : left + part.shape[1]] = part


def chain(px: np.ndarray, spec: MipSpec, max_side: int = MAX_SIDE) -> tuple[np.ndarray, list[tuple[int, int, int, int, int]], int]:
    """The image that holds all levels, (level, x, y, w, h) of each and the taps of all resizing; each level comes from the last."""
    sizes = [(px.shape[1], px.shape[0]), *spec.sizes(px.shape[1], px.shape[0])]
    width, height, corners = place(sizes)
    if max(width, height) > max_side:
        raise ValueError(f"{width} x {height} is over {max_side}")
    sheet, taps, last = np.zeros((height, width, 4), dtype=np.uint8), 0, px
    for k, ((w, h), (x, y)) in enumerate(zip(sizes, corners, strict=True)):
        if k:
            taps += resample.taps(last.shape[1], last.shape[0], w, h)
            last = resample.resize_pixels(last, w, h, resample.whole_radius(last.shape[1], last.shape[0]))
        blit(sheet, last, x, y, PAD)
    return sheet, [(k, x, y, w, h) for k, ((w, h), (x, y)) in enumerate(zip(sizes, corners, strict=True))], taps


_CHAIN = "image_id long, width long, height long, channels int, rgba binary, levels array<struct<level:long,x:long,y:long,w:long,h:long>>, meta binary, taps long, ops long, error string"


def chains(images: DataFrame, spec: MipSpec = MipSpec(), kind: str = "tessera.mipchain", max_side: int = MAX_SIDE) -> DataFrame:  # noqa: B008
    """One image of all levels for each image (image_id, width, height, rgba), with its levels as rows and as metadata.

    taps are the weights that all resizing has used, ops eight times as many. An image that can't have the levels says
    why in error. One image at a time.
    """
    level = pa.struct([(n, pa.int64()) for n in ("level", "x", "y", "w", "h")])
    types = pa.schema([("image_id", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("channels", pa.int32()), ("rgba", pa.binary()), ("levels", pa.list_(level)), ("meta", pa.binary()), ("taps", pa.int64()), ("ops", pa.int64()), ("error", pa.string())])

    def one(i: int, w: int, h: int, rgba: bytes) -> dict:
        try:
            sheet, levels, taps = chain(np.frombuffer(rgba, dtype=np.uint8).reshape(h, w, 4), spec, max_side)
        except ValueError as e:
            return {"image_id": i, "error": str(e)}
        return {"image_id": i, "width": sheet.shape[1], "height": sheet.shape[0], "channels": 4, "rgba": sheet.tobytes(), "levels": [dict(zip(("level", "x", "y", "w", "h"), v, strict=True)) for v in levels], "meta": packfile.levels_meta(kind, PAD, levels), "taps": taps, "ops": 8 * taps}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([one(*row.values())], schema=types)

    return images.selectExpr("cast(image_id as bigint) image_id", "width", "height", "rgba").mapInArrow(run, _CHAIN)
