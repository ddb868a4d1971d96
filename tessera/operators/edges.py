"""Edge signatures: what an image shows along its four sides, at one length for all images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import raster as R
from tessera.operators import kernels, resample

#: Samples of a signature, lines of a band and the resampling radius in samples.
SAMPLES, BAND, RADIUS = 64, 2, 5


def band(px: np.ndarray, first: int, thickness: int) -> np.ndarray:
    """Per column the integer mean of premultiplied R, G and B over so many rows from the first; the last row repeats."""
    h = px.shape[0]
    t = max(1, min(thickness, h))
    rows = px[np.minimum(np.arange(t) + first, h - 1)].astype(np.int64)
    return ((rows[..., :3] * rows[..., 3:] + 127) // 255).sum(0).__floordiv__(t).astype(np.uint8)


def bucket(edge: np.ndarray) -> int:
    """The mean luma of an edge in 32 steps."""
    e = edge.astype(np.int64)
    return int(((77 * e[:, 0] + 150 * e[:, 1] + 29 * e[:, 2]) >> 8).sum() // len(e)) >> 3


def signature(px: np.ndarray, samples: int = SAMPLES, thickness: int = BAND, radius: int = RADIUS) -> dict[str, np.ndarray]:
    """top, bottom, left and right of an image (h, w, 4), each (samples, 3). A band at the bottom or right is its last line."""
    turned = px.swapaxes(0, 1)
    sides = {"top": (px, 0), "bottom": (px, px.shape[0] - 1), "left": (turned, 0), "right": (turned, px.shape[1] - 1)}
    samples, radius = max(4, samples), max(1, radius) * resample.ONE
    return {k: resample.resample(band(p, first, thickness), samples, radius) for k, (p, first) in sides.items()}


SIDES = ("top", "bottom", "left", "right")
_SCHEMA = "image_id long, area long, " + ", ".join(f"{s} array<int>" for s in SIDES) + ", " + ", ".join(f"{s}_q int" for s in SIDES)


def signatures(images: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """image_id, area, the four edges as arrays of 3 * samples numbers, and their buckets, of images (image_id, width,
    height, rgba). One image at a time, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, w, h, rgba in zip(*batch.columns, strict=True):
                w, h = w.as_py(), h.as_py()
                found = signature(np.frombuffer(rgba.as_buffer(), dtype=np.uint8).reshape(h, w, 4), samples)
                rows.append({"image_id": i.as_py(), "area": w * h, **{s: e.ravel().tolist() for s, e in found.items()}, **{f"{s}_q": bucket(e) for s, e in found.items()}})
            types = [("image_id", pa.int64()), ("area", pa.int64()), *((s, pa.list_(pa.int32())) for s in SIDES), *((f"{s}_q", pa.int32()) for s in SIDES)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(types))

    return images.selectExpr("cast(image_id as bigint) image_id", "width", "height", "rgba").mapInArrow(run, _SCHEMA)


def edge_lines(rows: DataFrame, thickness: int = BAND) -> DataFrame:
    """image_id, side, row: along each side of images (image_id, y, row of RGBA, y from 0) the premultiplied R, G and B, at the
    top and left as integer means of so many lines. Bands at the bottom and right are the last line."""
    pixel = lambda i: F.array(*[R.premultiplied(F.get("row", i * 4 + k), F.get("row", i * 4 + 3)).cast("long") for k in range(3)])
    w = F.floor(F.size("row") / 4).cast("int")
    px = rows.select("image_id", F.col("y").cast("long").alias("y"), F.transform(F.sequence(F.lit(0), w - 1), pixel).alias("px"))
    px = px.join(px.groupBy("image_id").agg(F.count("*").alias("_h")), "image_id")
    zero = F.array(*[F.lit(0).cast("long")] * 3)
    mean = lambda some: F.transform(F.aggregate(some, zero, lambda a, p: F.zip_with(a, p, lambda x, y: x + y)), lambda v: F.floor(v / F.size(some)))
    by_row = px.select("image_id", "y", mean(F.slice("px", 1, thickness)).alias("left"), F.element_at("px", -1).alias("right"))
    upright = by_row.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "left", "right"))).alias("l"))
    upright = upright.select("image_id", F.explode(F.create_map(F.lit("left"), F.flatten("l.left"), F.lit("right"), F.flatten("l.right"))).alias("side", "row"))
    first = px.where(F.col("y") < thickness).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "px"))).alias("l"))
    across = F.transform(F.sequence(F.lit(0), F.size(F.col("l")[0]["px"]) - 1), lambda i: mean(F.transform("l", lambda r: F.get(r["px"], i))))
    top = first.select("image_id", F.lit("top").alias("side"), F.flatten(across).alias("row"))
    bottom = px.where("y = _h - 1").select("image_id", F.lit("bottom").alias("side"), F.flatten("px").alias("row"))
    return upright.union(top).union(bottom)


def edge_signatures(rows: DataFrame, samples: int = SAMPLES, thickness: int = BAND, radius: int = RADIUS) -> DataFrame:
    """image_id, side, edge, q: the signatures of all sides of images as arrays of 3 * samples numbers, and their buckets,
    by the kernel join; images may be of any size, as only their bands meet."""
    lines = edge_lines(rows, thickness).select(F.struct("image_id", "side").alias("image_id"), F.lit(0).alias("line"), F.lit(max(4, samples)).alias("dst"), F.lit(max(1, radius) * resample.ONE).alias("radius"), "row")
    strips = kernels.resampled(lines, 3).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("block", "strip"))).alias("l"))
    edge = strips.select("image_id.image_id", "image_id.side", F.flatten("l.strip").alias("edge"))
    return edge.withColumn("q", edge_bucket(F.col("edge")))


def edge_bucket(edge: Column) -> Column:
    """The mean luma of an edge in 32 steps."""
    n = F.floor(F.size(edge) / 3).cast("int")
    luma = F.transform(F.sequence(F.lit(0), n - 1), lambda i: R.luma(*[F.get(edge, i * 3 + k) for k in range(3)]).cast("long"))
    return F.shiftright(F.floor(R.total(luma) / n).cast("int"), 3)
