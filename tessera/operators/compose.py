"""Sheets put together from the rows of many images, row by row, and images cut out of sheets again.

A placement turns each row of its image into a segment of a row of the sheet, and its first and last row into the padding
above and below. Segments meet by sheet and row, never by sheet, so a sheet may be larger than any task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segments(rows: DataFrame, placements: DataFrame, pad: int, channels: int) -> DataFrame:
    """sheet, y, x, part: rows (id, y, row) of placed images (sheet, id, x, y, w, h) where they stand on their sheets, with
    edges and corners repeated pad times. An image may be placed more than once."""
    at = placements.select("sheet", "id", "x", F.col("y").alias("top"), "h")
    return padded(rows.select("id", "y", "row").join(at, "id"), pad, channels)


def padded(placed: DataFrame, pad: int, channels: int) -> DataFrame:
    """As segments(), of rows that know their places: (sheet, x, top, h, y, row), y from 0 in an image of h rows at x and top.

    There is no join, so images need no name."""
    first = F.when(F.col("y") == 0, F.col("top") - pad).otherwise(F.col("top") + F.col("y"))
    last = F.when(F.col("y") == F.col("h") - 1, F.col("top") + F.col("y") + pad).otherwise(F.col("top") + F.col("y"))
    end = F.slice("row", F.size("row") - channels + 1, F.lit(channels))
    wide = F.concat(F.flatten(F.array_repeat(F.slice("row", 1, channels), pad)), F.col("row"), F.flatten(F.array_repeat(end, pad)))
    return placed.select("sheet", F.explode(F.sequence(first, last)).alias("y"), (F.col("x") - pad).alias("x"), wide.alias("part"))


def _cut(part: Column, x: Column, width: Column, channels: int) -> Column:
    """What of a part at x lies within a sheet of some width."""
    before = F.greatest(-x, F.lit(0))
    n = F.least(F.size(part) / channels, width - x) - before
    return F.slice(part, (before * channels + 1).cast("int"), F.greatest(n * channels, F.lit(0)).cast("int"))


def sheets(rows: DataFrame, placements: DataFrame, sizes: DataFrame, pad: int = 0, channels: int = 4) -> DataFrame:
    """sheet, y, row of every row of the sheets (sheet, width, height): the placed images, padded, and zeros between them.

    What leaves a sheet is cut. Images that overlap within a row are an error, as no order among them is given.
    """
    return composed(segments(rows, placements, pad, channels), sizes, channels)


def composed(parts: DataFrame, sizes: DataFrame, channels: int = 4) -> DataFrame:
    """As sheets(), of segments (sheet, y, x, part)."""
    wide = sizes.select("sheet", F.col("width").alias("_w"), F.col("height").alias("_h"))
    found = parts.join(wide, "sheet").where("y >= 0 and y < _h and x < _w")
    cut = found.select("sheet", "y", F.struct(F.greatest("x", F.lit(0)).alias("x"), _cut(F.col("part"), F.col("x"), F.col("_w"), channels).alias("part")).alias("seg")).where("size(seg.part) > 0")
    lines = cut.groupBy("sheet", "y").agg(F.array_sort(F.collect_list("seg")).alias("_segs"))
    every = wide.select("sheet", "_w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_h") - 1)).alias("y"))
    end = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("_segs", i - 1)["x"] + F.floor(F.size(F.get("_segs", i - 1)["part"]) / channels))
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), (n * channels).cast("int"))
    apart = lambda gap: F.when(gap < 0, F.raise_error(F.lit("images overlap on a sheet")).cast("long")).otherwise(gap)
    filled = F.flatten(F.transform("_segs", lambda s, i: F.concat(zeros(apart(s["x"] - end(i))), s["part"])))
    row = F.when(F.col("_segs").isNull(), zeros(F.col("_w"))).otherwise(F.concat(filled, zeros(F.col("_w") - end(F.size("_segs")))))
    return every.join(lines, ["sheet", "y"], "left").select("sheet", "y", row.alias("row"))


def cut_out(sheet_rows: DataFrame, placements: DataFrame, channels: int = 4) -> DataFrame:
    """sheet, id, y, row: the placed images (sheet, id, x, y, w, h) as the rows (sheet, y, row) of their sheets hold them."""
    at = placements.select("sheet", "id", F.col("x").alias("_x"), F.col("w").alias("_w"), F.col("y").alias("_y"), F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1)).alias("y"))
    part = F.slice("row", (F.col("_x") * channels + 1).cast("int"), (F.col("_w") * channels).cast("int"))
    return at.join(sheet_rows, ["sheet", "y"]).select("sheet", "id", (F.col("y") - F.col("_y")).alias("y"), part.alias("row"))
