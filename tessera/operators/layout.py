"""Rectangles: order, packing, padding, mip levels and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.raster import l1
from tessera.operators import packing, prefix

#: Of the orientations 1 to 8, those that swap the axes and those that then flip x and y.
SWAPS, FLIPS_X, FLIPS_Y = (5, 6, 7, 8), (2, 3, 6, 7), (3, 4, 7, 8)


def oriented(pixels: DataFrame, orientation: Column, w: Column, h: Column) -> DataFrame:
    """pixels with x and y as seen in an orientation from 1 to 8; w and h are the sides before it. No shuffle."""
    swap = orientation.isin(*SWAPS)
    x, y = F.when(swap, F.col("y")).otherwise(F.col("x")), F.when(swap, F.col("x")).otherwise(F.col("y"))
    right, low = F.when(swap, h).otherwise(w) - 1, F.when(swap, w).otherwise(h) - 1
    return pixels.withColumns({"x": F.when(orientation.isin(*FLIPS_X), right - x).otherwise(x).cast("long"), "y": F.when(orientation.isin(*FLIPS_Y), low - y).otherwise(y).cast("long")})


def area_order(rects: DataFrame) -> DataFrame:
    """ordinal, id: by area, longer side (both falling) and id.

    Rows are counted in cells of one area, longer side and run of ids; cumulative counts of areas, and of the cells of
    an area, say where each cell begins. So a window holds all areas, the cells of an area or the rows of a cell (65,536
    where ids are unique), never all rows, also where most rectangles are of one size.
    """
    key = ["area", "long", "run"]
    r = rects.select("id", (F.col("w") * F.col("h")).alias("area"), F.greatest("w", "h").alias("long"), F.floor(F.col("id") / 65536).alias("run"))
    cells = r.groupBy(*key).agg(F.count("*").alias("n"))
    areas = cells.groupBy("area").agg(F.sum("n").alias("n"))
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    areas = areas.select("area", upto(Window.orderBy(F.col("area").desc())).alias("first"))
    cells = cells.withColumn("inner", upto(Window.partitionBy("area").orderBy(F.col("long").desc(), "run"))).drop("n")
    starts = cells.join(areas, "area").select(*key, (F.col("first") + F.col("inner")).alias("start"))
    own = Window.partitionBy(*key).orderBy("id")
    return r.join(starts, key).select((F.col("start") + F.row_number().over(own) - 1).alias("ordinal"), "id")


def offsets(blobs: DataFrame, by: str, order: str, length: str) -> DataFrame:
    """blobs with the offset of each in the file of its group: the lengths before it, in an order without ties."""
    return prefix.running(blobs, [by], F.col(order), F.col(length), "offset")


def mip_levels(rects: DataFrame) -> DataFrame:
    """id, level, w, h: both sides halve, not below 1, until both are 1."""
    last = F.ceil(F.log2(F.greatest("w", "h").cast("double") + 1)).cast("int") - 1
    level = F.explode(F.sequence(F.lit(0), last))
    halve = lambda c: F.greatest(F.lit(1).cast("long"), F.expr(f"shiftright({c}, level)"))
    return rects.select("id", "w", "h", level.alias("level")).select("id", "level", halve("w").alias("w"), halve("h").alias("h"))


def pad_row(row: Column, pad: int) -> Column:
    """The row with its first and last sample repeated."""
    return F.concat(F.array_repeat(F.element_at(row, 1), pad), row, F.array_repeat(F.element_at(row, -1), pad))


def nearest(items: DataFrame, band: int = 3, newest: int = 64) -> DataFrame:
    """id, other, cost: the item of least L1 cost whose bucket is within the band; ties to the smaller id.

    items: id, bucket, edge. Of each bucket only the newest (largest id) are looked at, so a bucket is one row of at most
    so many edges. An item meets the buckets of its band by an equi-join on exploded buckets, where its edge travels once
    per bucket that exists, and finds the cheapest of each inside the row.
    """
    of = F.slice(F.sort_array(F.collect_list(F.struct("id", "edge")), False), 1, newest)
    latest = Window.partitionBy("bucket").orderBy(F.col("id").desc())
    right = items.withColumn("rn", F.row_number().over(latest)).where(F.col("rn") <= newest).groupBy(F.col("bucket").alias("at")).agg(of.alias("theirs"))
    left = items.select("id", "edge", F.explode(F.sequence(F.col("bucket") - band, F.col("bucket") + band)).alias("at"))
    costs = F.transform(F.filter("theirs", lambda t: t["id"] != F.col("id")), lambda t: F.struct(l1(F.col("edge"), t["edge"]).alias("cost"), t["id"].alias("other")))
    pairs = left.join(right, "at").select("id", F.array_min(costs).alias("best")).where("best is not null")
    return pairs.groupBy("id").agg(F.min("best").alias("best")).select("id", "best.other", "best.cost")


def shelve(sizes: list[tuple[int, int]], side: int, pad: int) -> list[tuple[int, int] | None]:
    """Inner corners of rectangles on the shelves of one sheet, in the order given; None where one doesn't fit."""
    sheet = packing.Sheet(side, pad)
    return [sheet.place(w, h) for w, h in sizes]


def search_side(sizes: list[tuple[int, int]], limit: int, pad: int) -> int:
    """Where a binary search up to limit ends for the least side that holds all sizes in their order."""
    low, high = max([1, *(max(s) + 2 * pad for s in sizes)]), limit
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if None in shelve(sizes, middle, pad) else (low, middle)
    return low


def placed_items(placements: DataFrame, items: DataFrame) -> DataFrame:
    """Placements (grp, id, x, y, w, h) with the columns of their items; one without an item raises an error.

    The join is by grp and id, so a large table of items is shuffled once by both.
    """
    joined = placements.join(items.withColumn("_found", F.lit(True)), ["grp", "id"], "left")
    missing = F.raise_error(F.concat(F.lit("no item "), F.col("id").cast("string")))
    return joined.withColumn("id", F.when(F.col("_found"), F.col("id")).otherwise(missing)).drop("_found")


def _pieces(at: str, size: str) -> Column:
    """Array of (level, cell): the stretch from at on as cells of 2 ** level, two at most of each level."""
    begin, end = F.ceil(F.col(at)), F.ceil(F.col(at) + F.col(size))

    def of(level: Column) -> Column:
        low, high = -F.call_function("shiftright", -begin, level), F.call_function("shiftright", end, level)
        odd = lambda c: (low < high) & (c.bitwiseAND(F.lit(1).cast("long")) == 1)
        cell = lambda c: F.struct(level.alias("level"), c.alias("cell"))
        return F.array_compact(F.array(F.when(odd(low), cell(low)), F.when(odd(high), cell(high - 1))))

    return F.flatten(F.transform(F.sequence(F.lit(0), _top(F.col(size))), of))


def _top(size: Column) -> Column:
    """The highest level that a stretch of some size may have a cell of."""
    return F.length(F.bin(F.ceil(size).cast("long"))) - 1


def rect_at(points: DataFrame, rects: DataFrame) -> DataFrame:
    """points (sheet, px, py) with the id of the rectangle (sheet, id, x, y, w, h) that holds each; null outside all.

    Points or rectangles are whole numbers. A rectangle is cut into cells of sides that are powers of two, at most two of
    each side and axis, and a cell keeps the smallest id of all that hold it. So a point meets one row for each pair of
    sides, however many rectangles overlap there, by an equi-join. Points and
    rectangles that repeat are looked at once.
    """
    r = rects.where("w > 0 and h > 0").groupBy("sheet", "x", "y", "w", "h").agg(F.min("id").alias("id"))
    tops = r.groupBy("sheet").agg(F.max(_top(F.col("w"))).alias("_tx"), F.max(_top(F.col("h"))).alias("_ty"))
    cells = r.select("sheet", "id", F.explode(_pieces("x", "w")).alias("_x"), _pieces("y", "h").alias("_ys")).select("sheet", "id", "_x", F.explode("_ys").alias("_y"))
    cells = cells.groupBy("sheet", "_x", "_y").agg(F.min("id").alias("id"))
    own = points.select("sheet", "px", "py").distinct().join(tops, "sheet")
    at = lambda c, top: F.explode(F.transform(F.sequence(F.lit(0), F.col(top)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", F.floor(F.col(c)), k).alias("cell"))))
    keyed = own.select("sheet", "px", "py", at("px", "_tx").alias("_x"), "_ty").select("sheet", "px", "py", "_x", at("py", "_ty").alias("_y"))
    found = keyed.join(cells, ["sheet", "_x", "_y"]).groupBy("sheet", "px", "py").agg(F.min("id").alias("id"))
    return points.join(found, ["sheet", "px", "py"], "left").select(*points.columns, "id")


def pad_image(rows: DataFrame, pad: int) -> DataFrame:
    """Rows (image_id, y, row) of images with their edges and corners repeated pad times on each side; y counts from 0."""
    by = Window.partitionBy("image_id")
    at = rows.withColumn("k", F.row_number().over(by.orderBy("y")).cast("long") - 1).withColumn("h", F.count("*").over(by))
    first = F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(F.col("k") + pad)
    last = F.when(F.col("k") == F.col("h") - 1, F.col("k") + 2 * pad).otherwise(F.col("k") + pad)
    return at.select("image_id", F.explode(F.sequence(first, last)).alias("y"), pad_row(F.col("row"), pad).alias("row"))


def box_blur(rows: DataFrame, radius: int) -> DataFrame:
    """image_id, y, x, mean: each row's means, then the means of these down the columns; windows end at the edges.

    All rows of an image are of one width, so the mean of means is the sum of sums over both windows' sizes.
    """
    n = F.size("row")
    low, high = (lambda i: F.greatest(i - radius, F.lit(0))), (lambda i: F.least(i + radius, n - 1))
    sums = F.transform("row", lambda v, i: F.struct(F.aggregate(F.slice("row", low(i) + 1, high(i) - low(i) + 1), F.lit(0).cast("long"), lambda a, x: a + x).alias("s"), (high(i) - low(i) + 1).alias("n")))
    near = F.collect_list("sums").over(Window.partitionBy("image_id").orderBy("y").rowsBetween(-radius, radius))
    both = rows.select("image_id", "y", sums.alias("sums")).withColumn("near", near)
    total = F.transform("sums", lambda v, i: F.aggregate("near", F.lit(0).cast("long"), lambda a, r: a + F.get(r, i)["s"]) / (v["n"] * F.size("near")))
    return both.select("image_id", "y", F.posexplode(total).alias("x", "mean")).withColumn("x", F.col("x").cast("long"))
