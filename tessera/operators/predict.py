"""Row predictors, colour transforms and the choice among them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import raster as R
from tessera.sources import container, shared

#: A dearer choice must bring the size to this share of the cheaper one's, in ten thousandths.
PAETH_SHARE, NONE_SHARE, TRANSFORM_SHARE = 9200, 9800, 9950
#: Tiles of the largest image each way at most, where Paeth is undone.
TILES = 16


def with_above(rows: DataFrame) -> DataFrame:
    """rows with the row above; a window per image over whole rows, not over samples."""
    return rows.withColumn("above", F.lag("row").over(Window.partitionBy("image_id").orderBy("y")))


def residuals(rows: DataFrame) -> DataFrame:
    """image_id, y and the rows none, delta, up, paeth."""
    return with_above(rows).select("image_id", "y", F.col("row").alias("none"), R.delta_row(F.col("row")).alias("delta"), R.up_row(F.col("row"), F.col("above")).alias("up"), R.paeth_row(F.col("row"), F.col("above")).alias("paeth"))


def undo_up(residual: DataFrame, column: str) -> DataFrame:
    """image_id, y, x, p: the samples of undo_up_rows()."""
    return undo_up_rows(residual.withColumn("image_id", F.col("image_id").cast("long")), column).select("image_id", "y", F.posexplode("row").alias("x", "p"))


def undo_up_rows(residual: DataFrame, column: str) -> DataFrame:
    """image_id, y, row from up residuals: running sums down each column of an image, in one pass over its whole rows.

    Rows of an image meet in one task in order of y and are folded with the sums so far, one row of memory for an image.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None
        for batch in batches:
            out = []
            for i, row in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                e = row.values.to_numpy(zero_copy_only=False)
                sums = (sums + e) % 256 if i == now and sums is not None else e % 256
                now = i
                out.append(sums)
            size = [len(r) for r in out]
            flat = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
            rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat.astype(np.int64)))
            yield pa.record_batch([batch.column(0), batch.column(1), rows], names=["image_id", "y", "row"])

    rows = residual.select("image_id", F.col("y").cast("long").alias("y"), F.col(column).cast("array<bigint>").alias("e"))
    ordered = rows.repartition("image_id").sortWithinPartitions("image_id", "y")
    return ordered.mapInArrow(run, f"image_id {rows.schema['image_id'].dataType.simpleString()}, y long, row array<bigint>")


def restored_lines(lines: DataFrame) -> DataFrame:
    """image_id, y, row of planes (image_id, predictor, y, row of residuals, y from 0), by each plane's own predictor."""
    of = lambda kind: lines.where(F.col("predictor") == kind).select("image_id", F.col("y").cast("long").alias("y"), F.col("row").cast("array<bigint>").alias("row"))
    delta = of("Delta").select("image_id", "y", R.undelta_row(F.col("row")).alias("row"))
    return of("None").union(delta).union(undo_up_rows(of("Up"), "row")).union(undo_paeth(of("Paeth"), "row"))


def assembled(planes: DataFrame) -> DataFrame:
    """image_id, y, row of RGBA samples of the planes (image_id, channel, y, row) of images (also width, channels, alpha and
    transform): the transform is undone, and an alpha without a plane is 255, or 0 where it is transparent."""
    key = ["image_id", "width", "channels", "alpha", "transform"]
    own = lambda c: F.max(F.when(F.col("channel") == c.upper(), F.col("row"))).alias(c)
    lines = planes.groupBy(*key, "y").agg(*[own(c) for c in "rgba"])
    more = lambda a, b: F.zip_with(a, b, lambda x, y: R.wrap(x + y))
    base = {"SubGreen": "g", "SubRed": "r", "SubBlue": "b"}
    undone = {}
    for c in "rgb":
        value = F.col(c)
        for kind, b in base.items():
            if b != c:
                value = F.when(F.col("transform") == kind, more(F.col(c), F.col(b))).otherwise(value)
        undone[c] = value
    flat = F.array_repeat(F.when((F.col("channels") == 4) & (F.col("alpha") == "Transparent0"), 0).otherwise(255).cast("long"), F.col("width").cast("int"))
    both = lines.select("image_id", "y", *[undone[c].alias(f"_{c}") for c in "rgb"], F.coalesce("a", flat).alias("_a"))
    return both.select("image_id", "y", R.interleaved([F.col(f"_{c}") for c in "rgba"]).alias("row"))


def _paeth_line(e: list[int], above: list[int], left: int, corner: int) -> list[int]:
    """Samples of a line of Paeth residuals from the line above, the sample to its left and the corner between them."""
    out = []
    for x, up in zip(e, above, strict=True):
        dl, du, dc = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
        left = (x + (left if dl <= du and dl <= dc else up if du <= dc else corner)) & 255
        corner = up
        out.append(left)
    return out


def undo_paeth(residual: DataFrame, column: str, tile: int = 64) -> DataFrame:
    """image_id, y, row of Paeth residuals (image_id, y, column), y from 0: the samples, as a wave over tiles.

    A tile needs the last row of the tile above, the last column of the one to its left and the corner between them. So
    tiles are undone by anti-diagonals, one round for each; all tiles of a round, of all images, are independent, an
    image is spread over as many tasks, and what tiles leave to their neighbours is written to the shared folder. A tile's
    lines pass by in order, and only the last one is in memory. Tiles have sides of tile at least, and so much more that
    the largest image has TILES of them each way, so rounds are 2 * TILES - 1 at most however large images are.
    """
    spark, where = residual.sparkSession, shared.folder(residual.sparkSession, "paeth")
    rows = residual.select("image_id", F.col("y").cast("long").alias("y"), F.col(column).cast("array<bigint>").alias("_e")).where("size(_e) > 0")
    rows.write.parquet(f"{where}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{where}/rows")
    height, width = rows.agg(F.max("y") + 1, F.max(F.size("_e"))).first()
    if height is None:
        return rows.withColumnRenamed("_e", "row")
    high, wide = (max(tile, -(-n // TILES)) for n in (height, width))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("_e") - 1) / wide).cast("int")), lambda k: F.struct(k.cast("long").alias("tx"), F.slice("_e", k * wide + 1, F.lit(wide)).alias("e")))
    cut = rows.select("image_id", F.floor(F.col("y") / high).alias("ty"), "y", F.inline(parts)).withColumn("wave", F.col("tx") + F.col("ty"))
    cut.write.partitionBy("wave").parquet(f"{where}/tiles")
    tiles = spark.read.schema(cut.schema).parquet(f"{where}/tiles")
    kind, own = rows.schema["image_id"].dataType.simpleString(), ["image_id", "ty", "tx", "y", "e"]
    schema = f"image_id {kind}, ty bigint, tx bigint, y bigint, row array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, above, left = None, [], 0
        for batch in batches:
            out, ids = [], batch.column(0).to_pylist()
            for i, ty, tx, e, first, own_left, corner in zip(ids, *(c.to_pylist() for c in batch.columns[1:3]), *(c.to_pylist() for c in batch.columns[4:]), strict=True):
                if (i, ty, tx) != now:
                    now, above, left = (i, ty, tx), first or [], corner or 0
                above = above[: len(e)] + [0] * (len(e) - len(above))
                above = _paeth_line(e, above, own_left or 0, left)
                left = own_left or 0
                out.append(above)
            yield pa.record_batch([*batch.columns[:4], pa.array(out, pa.list_(pa.int64()))], names=["image_id", "ty", "tx", "y", "row"])

    last, done = -(-height // high) + -(-width // wide) - 2, []
    below = (F.col("y") + 1) % high == 0
    end = F.element_at("row", -1)
    for wave in range(last + 1):
        now = tiles.where(F.col("wave") == wave).select(*own)
        at = lambda d, y, tx, value, name: d.select("image_id", (F.col("y") + y).alias("y"), (F.col("tx") + tx).alias("tx"), value.alias(name))
        key = ["image_id", "y", "tx"]
        for found, name, none in ((at(done[-1].where(below), 1, 0, F.col("row"), "_top") if wave else None, "_top", F.lit(None).cast("array<bigint>")), (at(done[-1], 0, 1, end, "_left") if wave else None, "_left", F.lit(None).cast("long")), (at(done[-2].where(below), 1, 1, end, "_corner") if wave > 1 else None, "_corner", F.lit(None).cast("long"))):
            now = now.withColumn(name, none) if found is None else now.join(found, key, "left")
        ordered = now.select(*own, "_top", "_left", "_corner").repartition("image_id", "ty", "tx").sortWithinPartitions("image_id", "ty", "tx", "y")
        ordered.mapInArrow(run, schema).write.parquet(f"{where}/done/{wave}")
        done.append(spark.read.schema(schema).parquet(f"{where}/done/{wave}"))
    every = spark.read.schema(schema).parquet(*[f"{where}/done/{k}" for k in range(last + 1)])
    strips = every.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("tx", "row"))).alias("strips"))
    return strips.select("image_id", "y", F.flatten(F.col("strips.row")).alias("row"))


def summary(rows: DataFrame, column: str) -> DataFrame:
    return rows.select("image_id", "y", R.total(F.col(column)).alias("total"), R.moment(F.col(column)).alias("moment"))


def transformed(pixels: DataFrame) -> DataFrame:
    """Each pixel under each colour transform: one channel is subtracted from the other two."""
    r, g, b = (F.col(c) for c in "rgb")
    kinds = [("None", r, g, b), ("SubGreen", R.wrap(r - g), g, R.wrap(b - g)), ("SubRed", r, R.wrap(g - r), R.wrap(b - r)), ("SubBlue", R.wrap(r - b), R.wrap(g - b), b)]
    each = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(k).alias("transform"), x.alias("r"), y.alias("g"), z.alias("b")) for i, (k, x, y, z) in enumerate(kinds)])
    return pixels.select("image_id", "y", "x", F.explode(each).alias("t")).select("image_id", "y", "x", "t.*")


def restored(t: DataFrame) -> DataFrame:
    r, g, b = (F.col(c) for c in "rgb")
    kind = F.col("transform")
    return t.withColumns(
        {
            "r": F.when(kind == "SubGreen", R.wrap(r + g)).when(kind == "SubBlue", R.wrap(r + b)).otherwise(r),
            "g": F.when(kind == "SubRed", R.wrap(g + r)).when(kind == "SubBlue", R.wrap(g + b)).otherwise(g),
            "b": F.when(kind == "SubGreen", R.wrap(b + g)).when(kind == "SubRed", R.wrap(b + r)).otherwise(b),
        }
    )


def transform_costs(pixels: DataFrame) -> DataFrame:
    t = transformed(pixels)
    return t.groupBy("image_id", "rank", "transform").agg(*[F.sum(R.magnitude(F.col(c))).alias(f"cost_{c}") for c in "rgb"])


def choose_predictor(none: Column, delta: Column, up: Column, paeth: Column) -> Column:
    """The cheaper of delta and up (ties: delta); paeth only if it saves enough; none only if it saves enough on that."""
    cheap = F.least(delta, up)
    name = F.when(delta <= up, "Delta").otherwise("Up")
    dear = paeth * 10000 <= cheap * PAETH_SHARE
    best = F.when(dear, paeth).otherwise(cheap)
    return F.when(none * 10000 <= best * NONE_SHARE, "None").when(dear, "Paeth").otherwise(name)


def choose_transform(costs: DataFrame) -> DataFrame:
    """The cheapest transform of each image, if it saves enough on none; ties go to the earlier."""
    cost = F.col("cost_r") + F.col("cost_g") + F.col("cost_b")
    best = costs.withColumn("cost", cost).groupBy("image_id").agg(F.min(F.struct("cost", "rank", "transform")).alias("best"), F.max(F.when(F.col("rank") == 0, F.col("cost"))).alias("plain"))
    return best.select("image_id", F.when(F.col("best.cost") * 10000 <= F.col("plain") * TRANSFORM_SHARE, F.col("best.transform")).otherwise("None").alias("transform"))


def candidate_costs(rows: DataFrame) -> DataFrame:
    """image_id, transform, channel, none, delta, up, paeth: the residuals' magnitudes of R, G and B of images (image_id, y,
    row of RGBA samples) under all transforms and predictors, from one pass over whole rows with the row above each."""
    planes = {c: R.deinterleaved(F.col(c), 4) for c in ("row", "above")}
    less = lambda a, b: F.zip_with(a, b, lambda x, y: R.wrap(x - y))

    def grid(of: str) -> list[tuple[str, str, Column]]:
        r, g, b = (planes[of][k] for k in range(3))
        kinds = {"None": (r, g, b), "SubGreen": (less(r, g), g, less(b, g)), "SubRed": (r, less(g, r), less(b, r)), "SubBlue": (less(r, b), less(g, b), b)}
        return [(t, "RGB"[k], plane) for t, three in kinds.items() for k, plane in enumerate(three)]

    cells = [F.struct(F.lit(t).alias("transform"), F.lit(c).alias("channel"), now.alias("line"), up.alias("over")) for (t, c, now), (_, _, up) in zip(grid("row"), grid("above"), strict=True)]
    each = with_above(rows).select("image_id", F.explode(F.array(*cells)).alias("c")).select("image_id", "c.*")
    cost = lambda e: F.sum(R.total(F.transform(e, R.magnitude)))
    line, over = F.col("line"), F.col("over")
    return each.groupBy("image_id", "transform", "channel").agg(cost(line).alias("none"), cost(R.delta_row(line)).alias("delta"), cost(R.up_row(line, over)).alias("up"), cost(R.paeth_row(line, over)).alias("paeth"))


def choose_candidates(costs: DataFrame) -> DataFrame:
    """costs of candidate_costs() with the predictor of each channel and whether its transform is the image's."""
    known = costs.withColumn("predictor", choose_predictor(*[F.col(c) for c in ("none", "delta", "up", "paeth")]))
    own = F.element_at(F.create_map(*[x for k in ("None", "Delta", "Up", "Paeth") for x in (F.lit(k), F.col(k.lower()))]), F.col("predictor"))
    sums = known.groupBy("image_id", "transform").agg(*[F.sum(F.when(F.col("channel") == c.upper(), own)).alias(f"cost_{c}") for c in "rgb"])
    rank = F.array_position(F.array(*[F.lit(t) for t in container.TRANSFORMS]), F.col("transform"))
    best = choose_transform(sums.withColumn("rank", rank - 1)).withColumnRenamed("transform", "best")
    return known.join(best, "image_id").withColumn("chosen", F.col("transform") == F.col("best")).drop("best")


def sample_rows(heights: DataFrame, budget: int = 256 * 1024) -> DataFrame:
    """image_id, i, y: evenly spread rows within a budget of samples; heights has image_id, w, h."""
    n = F.least("h", F.greatest(F.lit(1).cast("long"), F.floor(F.least(F.lit(budget), F.col("w") * F.col("h")) / F.col("w"))))
    return heights.withColumn("n", n).select("image_id", "h", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select("image_id", "i", F.floor(F.col("i") * F.col("h") / F.col("n")).alias("y"))


def candidate_sizes(images: DataFrame, level: int = 3) -> DataFrame:
    """image_id, transform, channel, predictor, size: the compressed size of each channel's sampled rows under all four
    transforms and all four predictors, of images (image_id, width, height, rgba). One image at a time, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, w, h, rgba in zip(*batch.columns, strict=True):
                px = np.frombuffer(rgba.as_buffer(), dtype=np.uint8).reshape(h.as_py(), w.as_py(), 4)
                rows = [(t, "RGB"[k], p, n) for t in container.TRANSFORMS for k, plane in enumerate(container.recolour([np.ascontiguousarray(px[..., k]) for k in range(3)], t, -1)) for p, n in container.sampled_sizes(plane, level).items()]
                cols = [pa.array([i.as_py()] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64())))]
                yield pa.record_batch(cols, names=["image_id", "transform", "channel", "predictor", "size"])

    return images.selectExpr("cast(image_id as bigint) image_id", "width", "height", "rgba").mapInArrow(run, "image_id long, transform string, channel string, predictor string, size long")
