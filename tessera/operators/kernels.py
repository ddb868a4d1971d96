"""Resizing as joins: tables of kernel weights meet the rows of images, which stay arrays.

Weights are fixed-point numbers with 32 fraction bits; products round down and quotients towards 0, in 128 bits. The
weights of one pair of sizes and radius are computed once, however many images need them, target samples dealt out to all
tasks. A row of an image joins the blocks of its width, a few target samples each, and each pair gives a strip: a few
samples of the resized row. Down the image, target lines are dealt out in bands: a strip goes to the bands whose kernels
reach its line, and a band of strips joins the kernels of its own lines only. So an image is spread over as many tasks as
it has rows, and then bands, and no task holds more than the strips that a band reaches, twice the kernel's width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.resample import C3, C5, C7, ONE, PI

#: Target samples of a block.
BLOCK = 32


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def product(a: Column, b: Column) -> Column:
    """a * b, rounded down: halves of 32 bits multiply, the lower ones in two steps, as 64 bits have no sign to spare."""
    a, b = a.cast("long"), b.cast("long")
    (ah, al), (bh, bl) = [(F.shiftright(c, 32), c.bitwiseAND(F.lit(ONE - 1))) for c in (a, b)]
    low = F.shiftright(F.shiftright(al, 16) * bl + F.shiftright(al.bitwiseAND(F.lit(65535)) * bl, 16), 16)
    return ah * bh * F.lit(ONE) + ah * bl + al * bh + low


def quotient(a: Column, b: Column) -> Column:
    """a / b, rounded towards 0: by 16 bits of the fraction at a time, or in decimals where 64 bits are too few."""
    a, b = a.cast("long"), b.cast("long")
    div, x, y = (lambda n, m: F.call_function("div", n, m)), F.abs(a), F.abs(b)
    first = x % y * 65536
    short = div(x, y) * F.lit(ONE) + div(first, y) * 65536 + div(first % y * 65536, y)
    long = div(_wide(x) * F.lit(ONE).cast("decimal(19,0)"), _wide(y).cast("decimal(38,0)"))
    return F.when((y < F.lit(1 << 47)) & (x < y * 65536), short).otherwise(long) * F.signum(a).cast("long") * F.signum(b).cast("long")


def _with_sinc(df: DataFrame, x: str, name: str) -> DataFrame:
    """df with the sinc of x, which is not negative: sine of the fraction's angle by its first terms, over the angle."""
    t, t2 = F.col("_t"), F.col("_t2")
    df = df.withColumn("_t", product(F.lit(PI), F.col(x) % ONE)).withColumn("_t2", product(t, t)).withColumn("_t3", product(t2, t))
    df = df.withColumn("_p", F.lit(C5) + product(F.lit(C7), t2)).withColumn("_p", F.lit(C3) + product(t2, F.col("_p"))).withColumn("_s", t + product(F.col("_t3"), F.col("_p")))
    sine = F.when(F.shiftright(x, 32) % 2 == 1, -F.col("_s")).otherwise(F.col("_s"))
    angle = F.greatest(product(F.lit(PI), F.col(x)), F.lit(1).cast("long"))
    return df.withColumn("_sine", sine).withColumn("_angle", angle).withColumn(name, F.when(F.col(x) == 0, F.lit(ONE)).otherwise(quotient(F.col("_sine"), F.col("_angle")))).drop("_t", "_t2", "_t3", "_p", "_s", "_sine", "_angle")


def _tasks(df: DataFrame) -> int:
    """Tasks for rows that are small and much work each; Spark would join partitions of little size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def targets(sizes: DataFrame) -> DataFrame:
    """src, dst, radius, i, taps: for target sample i the array of its (s, w), empty where it has none, for each row of
    sizes (src, dst, radius). A few sizes make many samples, so these are dealt out before they meet their sources."""
    one, key = F.lit(ONE), ["src", "dst", "radius", "i"]
    distinct = sizes.select(*[F.col(c).cast("long").alias(c) for c in ("src", "dst", "radius")]).distinct()
    at = distinct.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("dst") - 1)).alias("i")).repartition(_tasks(sizes), *key)
    same = at.where("src = dst").select(*key, F.array(F.struct(F.col("i").alias("s"), one.alias("w"))).alias("taps"))
    other = at.where("src <> dst").withColumn("_scale", F.call_function("div", F.col("src") * one, F.col("dst")))
    other = other.withColumn("_centre", product(F.col("i") * one + ONE // 2, F.col("_scale")) - ONE // 2)
    low = F.greatest(F.lit(0).cast("long"), F.shiftright(F.col("_centre") - F.col("radius"), 32))
    high = F.least(F.col("src") - 1, F.shiftright(F.col("_centre") + F.col("radius"), 32))
    near = F.when(F.col("_low") <= F.col("_high"), F.sequence("_low", "_high"))
    other = other.withColumns({"_low": low, "_high": high}).select(*key, "_centre", F.explode_outer(near).alias("s"))
    other = other.withColumn("_d", F.abs(F.col("_centre") - F.col("s") * one)).withColumn("_d", F.when(F.col("_d") < F.col("radius"), F.col("_d")))
    other = other.withColumn("_e", quotient(F.col("_d"), F.greatest("radius", F.lit(1))))
    other = _with_sinc(_with_sinc(other, "_d", "_sd"), "_e", "_se").withColumn("_w", product(F.col("_sd"), F.col("_se")))
    whole = other.groupBy(*key).agg(F.sum("_w").alias("_total"), F.array_sort(F.collect_list(F.when(F.col("_w") != 0, F.struct("s", "_w")))).alias("_taps"))
    taps = F.transform("_taps", lambda t: F.struct(t["s"].alias("s"), quotient(t["_w"], F.col("_total")).alias("w")))
    return same.union(whole.select(*key, F.when(F.col("_total") != 0, taps).otherwise(F.array().cast("array<struct<s:bigint,w:bigint>>"))))


def taps(sizes: DataFrame) -> DataFrame:
    """src, dst, radius, i, s, w: the weights that make target sample i of source samples s, for each row of sizes
    (src, dst, radius). They add up to one but for rounding; the same size takes every sample as it is."""
    return targets(sizes).select("src", "dst", "radius", "i", F.inline("taps"))


def blocks(sizes: DataFrame) -> DataFrame:
    """src, dst, radius, block, kernel: for each target sample of a block the array of its (s, w), empty where it has none."""
    by_block = targets(sizes).groupBy("src", "dst", "radius", F.floor(F.col("i") / BLOCK).alias("block"))
    return by_block.agg(F.array_sort(F.collect_list(F.struct("i", "taps"))).getField("taps").alias("kernel"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _reach() -> Column:
    """Source lines on either side that a target line may need, rounding included."""
    return F.when(F.col("src") == F.col("dst"), F.lit(0)).otherwise(F.shiftright("radius", 32) + 1) + 2


def _band() -> Column:
    """Target lines of a band: their own source lines are about as many as a kernel has, so that bands share few."""
    return F.greatest(F.lit(1), _div(F.greatest(F.shiftright("radius", 32), F.lit(BLOCK).cast("long")) * 2 * F.col("dst"), F.col("src")))


def bands(sizes: DataFrame) -> DataFrame:
    """src, dst, radius, band, part, kernel: the kernels of a band's target lines as an array of (i, taps), in parts of BLOCK."""
    at = targets(sizes).withColumn("band", _div(F.col("i"), _band()))
    return at.groupBy("src", "dst", "radius", "band", F.floor(F.col("i") / BLOCK).alias("part")).agg(F.collect_list(F.struct("i", "taps")).alias("kernel"))


def resampled(lines: DataFrame, channels: int, kernels: DataFrame | None = None) -> DataFrame:
    """image_id, line, block, strip of lines (image_id, line, dst, radius, row): strips of the resized lines, as arrays.
    kernels: blocks() of all sizes that lines have, if they are there already."""
    keyed = lines.withColumn("src", F.floor(F.size("row") / channels)).withColumns({c: F.col(c).cast("long") for c in ("dst", "radius")})
    kernels = blocks(keyed.select("src", "dst", "radius")) if kernels is None else kernels
    value = lambda taps, k: F.aggregate(taps, F.lit(0).cast("long"), lambda a, t: a + F.get("row", (t["s"] * channels + k).cast("int")) * t["w"])
    sample = lambda taps: F.array(*[F.least(F.lit(255), F.greatest(F.lit(0), F.shiftright(value(taps, k), 32))).cast("long") for k in range(channels)])
    return keyed.join(kernels, ["src", "dst", "radius"]).select("image_id", "line", "block", F.flatten(F.transform("kernel", sample)).alias("strip"))


def _reached() -> Column:
    """Bands, of lines (src, dst, radius, line), whose kernels reach a line."""
    src, twice, line, band, reach = F.col("src"), F.col("dst") * 2, F.col("line"), _band(), _reach()
    first = F.greatest(F.lit(0).cast("long"), _div(_div((line - reach) * twice, src), band * 2) - 1)
    last = F.least(_div(F.col("dst") - 1, band), _div(_div((line + reach + 1) * twice, src), band * 2))
    top = lambda b: _div((b * band * 2 + 1) * src, twice) - reach
    end = lambda b: _div(((b + 1) * band * 2 - 1) * src, twice) + reach
    return F.filter(F.sequence(first, last), lambda b: (top(b) <= line) & (line <= end(b)))


def stacked(strips: DataFrame, kernels: DataFrame) -> DataFrame:
    """image_id, line, row: lines resized from the strips (image_id, line, block, strip, src, dst, radius) of all of an
    image's lines, which count from 0. kernels: bands() of all sizes that strips have.

    The join never sends the kernels to all tasks, as they grow with the image.
    """
    sent = strips.select("image_id", "src", "dst", "radius", "block", F.explode(_reached()).alias("band"), F.struct("line", "strip").alias("l"))
    held = sent.groupBy("image_id", "src", "dst", "radius", "block", "band").agg(F.array_sort(F.collect_list("l")).alias("_lines"))
    value = lambda taps, k: F.aggregate(taps, F.lit(0).cast("long"), lambda a, t: a + F.get(F.get("_lines", (t["s"] - F.col("_lines")[0]["line"]).cast("int"))["strip"], k) * t["w"])
    sample = lambda taps: F.transform(F.sequence(F.lit(0), F.size(F.col("_lines")[0]["strip"]) - 1), lambda k: F.least(F.lit(255), F.greatest(F.lit(0), F.shiftright(value(taps, k), 32))).cast("long"))
    met = held.join(kernels.hint("merge"), ["src", "dst", "radius", "band"])
    made = met.select("image_id", "block", F.inline(F.transform("kernel", lambda x: F.struct(x["i"].alias("line"), sample(x["taps"]).alias("strip")))))
    return made.groupBy("image_id", "line").agg(F.flatten(F.array_sort(F.collect_list(F.struct("block", "strip"))).getField("strip")).alias("row"))


def resize(rows: DataFrame, width: Column, height: Column, channels: int = 4, radius: Column | None = None, kernels: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """image_id, y, row of images resized: rows (image_id, y, row) hold interleaved samples of 0 to 255, y counts from 0.

    width, height and radius are columns of an image; by default the radius is an image's smaller side, one sample at
    least. Rows of an image are of one width. An image without rows is none in the result. kernels: blocks() of all
    widths and bands() of all heights, if they are there already.
    """
    sides = rows.groupBy("image_id").agg(F.count("*").alias("_h"), F.first(F.floor(F.size("row") / channels)).alias("_w"), F.first(width).cast("long").alias("_width"), F.first(height).cast("long").alias("_height"), F.first(radius if radius is not None else F.lit(None)).cast("long").alias("_given"))
    sides = sides.withColumn("radius", F.coalesce("_given", F.greatest(F.lit(1).cast("long"), F.least("_w", "_h")) * ONE)).drop("_given")
    size = lambda src, dst: [F.col(src).alias("src"), F.col(dst).alias("dst"), "radius"]
    across, down = kernels or (blocks(sides.select(*size("_w", "_width"))), bands(sides.select(*size("_h", "_height"))))
    lines = rows.select("image_id", F.col("y").cast("long").alias("line"), "row").join(sides, "image_id").withColumn("dst", F.col("_width"))
    strips = resampled(lines, channels, across).join(sides.select("image_id", *size("_h", "_height")), "image_id")
    return stacked(strips, down).select("image_id", F.col("line").alias("y"), "row")


def resize_stats(sizes: DataFrame) -> DataFrame:
    """image_id, taps: weights that resizing images (image_id, width, height, new_width, new_height, radius) uses: those of
    each target sample of both passes, none if an image keeps its size."""
    changed = sizes.where("width <> new_width or height <> new_height")
    need = changed.select(F.col("width").alias("src"), F.col("new_width").alias("dst"), "radius").union(changed.select("height", "new_height", "radius"))
    counted = taps(need).groupBy("src", "dst", "radius").agg(F.count("*").alias("n"))
    side = lambda name, src, dst: counted.select(F.col("src").alias(src), F.col("dst").alias(dst), "radius", F.col("n").alias(name))
    both = changed.join(side("across", "width", "new_width"), ["width", "new_width", "radius"], "left").join(side("down", "height", "new_height"), ["height", "new_height", "radius"], "left")
    own = both.select("image_id", (F.coalesce("across", F.lit(0)) * F.col("height") + F.coalesce("down", F.lit(0)) * F.col("new_width")).alias("taps"))
    return own.union(sizes.where("width = new_width and height = new_height").select("image_id", F.lit(0).cast("long")))
