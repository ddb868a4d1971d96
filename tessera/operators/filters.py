"""Neighbourhood filters on rasters, and what decides whether and how a raw fallback image is denoised."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import raster as R

#: Most pixels that the green-cast test reads, and the radii of colour and brightness blurs.
GREEN_SAMPLES, CHROMA_RADIUS, LUMA_RADIUS = 65_536, 5, 2


def blurred_rows(rows: DataFrame, radius: int) -> DataFrame:
    """image_id, y, x, mean of the samples within radius in the same row. No shuffle."""
    n = F.size("row")
    low, high = (lambda i: F.greatest(i - radius, F.lit(0))), (lambda i: F.least(i + radius, n - 1))
    mean = F.transform("row", lambda v, i: R.total(F.slice("row", low(i) + 1, high(i) - low(i) + 1)) / (high(i) - low(i) + 1))
    return rows.select("image_id", "y", F.posexplode(mean).alias("x", "mean")).withColumn("x", F.col("x").cast("long"))


def median3(rows: DataFrame) -> DataFrame:
    """image_id, y, x, median of each sample's 3 x 3 neighbourhood, which ends at the borders; of an even number the upper."""
    by = Window.partitionBy("image_id").orderBy("y")
    near3 = rows.withColumn("up", F.lag("row").over(by)).withColumn("down", F.lead("row").over(by))

    def near(c: str, i):
        part = F.slice(F.col(c), F.greatest(i, F.lit(1)), F.least(i + 2, F.size("row")) - F.greatest(i, F.lit(1)) + 1)
        return F.coalesce(part, F.expr("cast(array() as array<bigint>)"))

    sorted_ = F.transform("row", lambda v, i: F.sort_array(F.concat(near("row", i), near("up", i), near("down", i))))
    median = F.transform(sorted_, lambda s: F.element_at(s, F.floor(F.size(s) / 2).cast("int") + 1))
    return near3.select("image_id", "y", F.posexplode(median).alias("x", "median")).withColumn("x", F.col("x").cast("long"))


def green_cast(pixels: DataFrame, samples: int = GREEN_SAMPLES) -> DataFrame:
    """image_id, green: whether the mean green is over 100 and over six times the mean red and blue, of every n-th pixel.

    pixels: image_id, i (from 0, in order), r, g, b. n leaves about so many samples of an image, all if it has fewer than
    twice as many.
    """
    sizes = pixels.groupBy("image_id").agg((F.max("i") + 1).alias("pixels"))
    step = F.greatest(F.lit(1), F.floor(F.col("pixels") / samples))
    means = pixels.join(sizes, "image_id").where(F.col("i") % step == 0).groupBy("image_id").agg(*[F.avg(c).alias(c) for c in "rgb"])
    return means.select("image_id", ((F.col("g") > 100) & (F.col("g") > 6 * F.col("r")) & (F.col("g") > 6 * F.col("b"))).alias("green"))


def _median(plane: np.ndarray) -> np.ndarray:
    """Upper median of 3 x 3 neighbourhoods that end at the borders."""
    wide = np.pad(plane, 1, constant_values=np.nan)
    near = np.sort(np.stack([wide[dy : dy + plane.shape[0], dx : dx + plane.shape[1]] for dy in range(3) for dx in range(3)]), axis=0)
    n = (~np.isnan(near)).sum(0)
    return np.take_along_axis(near, (n // 2)[None], 0)[0]


def _blur(plane: np.ndarray, radius: int) -> np.ndarray:
    for axis in (1, 0):
        n = plane.shape[axis]
        total = np.concatenate([np.zeros_like(plane.take([0], axis)), plane.cumsum(axis, dtype=np.float64)], axis)
        low, high = np.maximum(np.arange(n) - radius, 0), np.minimum(np.arange(n) + radius, n - 1) + 1
        count = (high - low).reshape((1, n) if axis else (n, 1))
        plane = (total.take(high, axis) - total.take(low, axis)) / count
    return plane


def denoised(px: np.ndarray) -> np.ndarray:
    """An image (h, w, 4) with its colour, and its brightness in dark and even places, drawn towards blurred medians.

    Images with a side under 3 stay as they are; alpha always does. Fixed values: the weights and ranges below.
    """
    if min(px.shape[:2]) < 3:
        return px
    r, g, b = (px[..., k].astype(np.float64) for k in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    cb, cr = b - y, r - y
    smooth_b, smooth_r, smooth_y = _blur(_median(cb), CHROMA_RADIUS), _blur(_median(cr), CHROMA_RADIUS), _blur(_median(y), LUMA_RADIUS)
    dark, detail, bright = (np.clip(v, 0, 1) for v in ((170 - y) / 170, np.abs(y - smooth_y) / 45, (y - 175) / 80))
    colour = (0.70 + dark * 0.28) * (1 - bright * 0.55)
    light, grey = dark**0.85 * 0.70 * (1 - detail * 0.45), dark**1.25 * 0.18
    y2 = y + (smooth_y - y) * light
    cb2, cr2 = ((c + (s - c) * colour) * (1 - grey) for c, s in ((cb, smooth_b), (cr, smooth_r)))
    r2, b2 = y2 + cr2, y2 + cb2
    g2 = (y2 - 0.299 * r2 - 0.114 * b2) / 0.587
    out = px.copy()
    out[..., :3] = np.clip(np.stack([r2, g2, b2], -1) + 0.5, 0, 255).astype(np.uint8)
    return out


def denoise(images: DataFrame) -> DataFrame:
    """image_id, width, height, rgba of images denoised, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [denoised(np.frombuffer(p.as_buffer(), dtype=np.uint8).reshape(h.as_py(), w.as_py(), 4)).tobytes() for w, h, p in zip(*batch.columns[1:], strict=True)]
            yield pa.record_batch([*batch.columns[:3], pa.array(bodies, pa.binary())], names=["image_id", "width", "height", "rgba"])

    return images.selectExpr("cast(image_id as bigint) image_id", "cast(width as bigint) width", "cast(height as bigint) height", "rgba").mapInArrow(run, "image_id long, width long, height long, rgba binary")


def _near(c: str, i: Column) -> Column:
    part = F.slice(F.col(c), F.greatest(i, F.lit(1)), F.least(i + 2, F.size(c)) - F.greatest(i, F.lit(1)) + 1)
    return F.coalesce(part, F.expr("cast(array() as array<double>)"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _median_of(c: str) -> Column:
    lists = F.transform(c, lambda v, i: F.sort_array(F.concat(_near(c, i), _near(f"_up_{c}", i), _near(f"_down_{c}", i))))
    return F.transform(lists, lambda s: F.get(s, F.floor(F.size(s) / 2).cast("int")))


def _mean_along(c: str, radius: int) -> Column:
    low, high = (lambda i: F.greatest(i - radius, F.lit(0))), (lambda i: F.least(i + radius, F.size(c) - 1))
    return F.transform(c, lambda v, i: _sum(F.slice(c, low(i) + 1, high(i) - low(i) + 1)) / (high(i) - low(i) + 1))


def _mean_of(lines: str, c: str) -> Column:
    return F.transform(c, lambda v, i: F.aggregate(lines, F.lit(0.0), lambda a, line: a + F.get(line, i)) / F.size(lines))


def smoothed(rows: DataFrame, radii: dict[str, int]) -> DataFrame:
    """rows (image_id, y and planes of doubles) with _s_<plane> for each plane: its 3 x 3 median, then blurred by the plane's
    radius along and across; windows over whole rows of an image, which end at the borders."""
    by, out = Window.partitionBy("image_id").orderBy("y"), rows
    out = out.withColumns({f"{n}{c}": f(c).over(by) for c in radii for n, f in (("_up_", F.lag), ("_down_", F.lead))})
    out = out.withColumns({f"_m_{c}": _median_of(c) for c in radii})
    out = out.withColumns({f"_a_{c}": _mean_along(f"_m_{c}", r) for c, r in radii.items()})
    out = out.withColumns({f"_l_{c}": F.collect_list(f"_a_{c}").over(by.rowsBetween(-r, r)) for c, r in radii.items()})
    out = out.withColumns({f"_s_{c}": _mean_of(f"_l_{c}", c) for c in radii})
    return out.select(*rows.columns, *[f"_s_{c}" for c in radii])


def denoise_rows(rows: DataFrame) -> DataFrame:
    """image_id, y, row of images (image_id, y, row of RGBA) denoised, by column expressions on whole rows: what denoised()
    does to an image. Images with a side under 3 stay as they are."""
    n = F.floor(F.size("row") / 4).cast("int")
    at = lambda i, k: F.get("row", i * 4 + k).cast("double")
    px = rows.select("image_id", "y", "row").withColumn("_h", F.count("*").over(Window.partitionBy("image_id")))
    px = px.withColumn("_y", F.transform(F.sequence(F.lit(0), n - 1), lambda i: 0.299 * at(i, 0) + 0.587 * at(i, 1) + 0.114 * at(i, 2)))
    px = px.withColumns({"_b": F.transform("_y", lambda v, i: at(i, 2) - v), "_r": F.transform("_y", lambda v, i: at(i, 0) - v)})
    px = smoothed(px, {"_y": LUMA_RADIUS, "_b": CHROMA_RADIUS, "_r": CHROMA_RADIUS})
    part = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    s = lambda c, i: F.get(f"_s__{c}", i)
    told = F.transform("_y", lambda v, i: F.struct(v.alias("y"), part((170 - v) / 170).alias("dark"), part(F.abs(v - s("y", i)) / 45).alias("detail"), part((v - 175) / 80).alias("bright")))
    px = px.withColumn("_told", told)
    colour = lambda t: (0.70 + t["dark"] * 0.28) * (1 - t["bright"] * 0.55)
    grey = lambda t: F.pow(t["dark"], F.lit(1.25)) * 0.18
    drawn = lambda c, i, t: (F.get(f"_{c}", i) + (s(c, i) - F.get(f"_{c}", i)) * colour(t)) * (1 - grey(t))
    light = lambda i, t: t["y"] + (s("y", i) - t["y"]) * (F.pow(t["dark"], F.lit(0.85)) * 0.70 * (1 - t["detail"] * 0.45))
    px = px.withColumn("_new", F.transform("_told", lambda t, i: F.struct(light(i, t).alias("y"), drawn("b", i, t).alias("b"), drawn("r", i, t).alias("r"))))
    byte = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v + 0.5)))
    red, blue = (lambda t: t["y"] + t["r"]), (lambda t: t["y"] + t["b"])
    green = lambda t: (t["y"] - 0.299 * red(t) - 0.114 * blue(t)) / 0.587
    done = F.flatten(F.transform("_new", lambda t, i: F.array(byte(red(t)), byte(green(t)), byte(blue(t)), F.get("row", i * 4 + 3).cast("long"))))
    return px.select("image_id", "y", F.when((F.col("_h") < 3) | (n < 3), F.col("row")).otherwise(done).alias("row"))
