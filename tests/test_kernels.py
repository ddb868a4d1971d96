"""The kernel join against the resampling of single images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import kernels, resample

SIZES = [(8, 4, 4), (4, 8, 4), (5, 5, 2), (1, 7, 1), (7, 1, 3), (50, 33, 50), (33, 70, 5), (64, 2, 1)]


def test_weights_equal_those_of_one_image(spark):
    rows = [(s, d, r * resample.ONE) for s, d, r in SIZES] + [(9, 4, resample.ONE // 2), (3, 40, resample.ONE // 8)]
    got = {}
    for r in kernels.taps(spark.createDataFrame([*rows, rows[0]], "src int, dst int, radius long")).collect():
        assert got.setdefault((r["src"], r["dst"], r["radius"], r["i"]), {}).setdefault(r["s"], r["w"]) == r["w"]
    for s, d, r in rows:
        want = [{i: resample.ONE} for i in range(d)] if s == d else [dict(t) for t in resample.kernel(s, d, r)]
        assert [got.get((s, d, r, i), {}) for i in range(d)] == want


def test_products_and_quotients_round_as_told(spark):
    values = [0, 1, -1, 3, -3, resample.ONE - 1, -resample.ONE - 1, 94 * 10**12, -94 * 10**12, 12345678901, -7]
    pairs = [(a, b) for a in values for b in values]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", kernels.product(F.col("a"), F.col("b")).alias("p"), F.when(F.col("b") != 0, kernels.quotient(F.col("a"), F.when(F.col("b") != 0, F.col("b")).otherwise(1))).alias("q"))
    for r in df.collect():
        a, b = r["a"], r["b"]
        assert r["p"] == resample._mul(a, b)
        if b and abs(resample._div(a, b)) < 1 << 62:
            assert r["q"] == resample._div(a, b)


@pytest.mark.parametrize("channels", [1, 4])
def test_images_of_many_sizes(spark, channels):
    rng = np.random.default_rng(6)
    images = {k: rng.integers(0, 256, (h, w, channels), dtype=np.uint8) for k, (h, w) in enumerate([(5, 9), (40, 3), (1, 1), (12, 12), (2, 90)])}
    to = {0: (4, 7), 1: (70, 40), 2: (3, 2), 3: (12, 12), 4: (33, 5)}
    rows = [(k, y, [int(v) for v in px[y].ravel()], *to[k]) for k, px in images.items() for y in range(len(px))]
    df = spark.createDataFrame(rows, "image_id long, y long, row array<bigint>, nw int, nh int").repartition(5)
    got = {}
    for r in kernels.resize(df, F.col("nw"), F.col("nh"), channels).orderBy("image_id", "y").collect():
        got.setdefault(r["image_id"], []).append(r["row"])
    for k, px in images.items():
        want = resample.resize_pixels(px, *to[k], resample.whole_radius(px.shape[1], px.shape[0]))
        assert got[k] == want.reshape(to[k][1], -1).tolist()


def test_stats(spark):
    rows = [(1, 16, 9, 8, 8, None), (2, 5, 5, 5, 5, None), (3, 7, 3, 7, 9, 2), (4, 7, 3, 14, 3, 1)]
    radius = [r[5] * resample.ONE if r[5] else resample.whole_radius(r[1], r[2]) for r in rows]
    df = spark.createDataFrame([(*r[:5], v) for r, v in zip(rows, radius, strict=True)], "image_id long, width long, height long, new_width long, new_height long, radius long")
    want = {r[0]: resample.taps(*r[1:5], v) for r, v in zip(rows, radius, strict=True)}
    got = {r["image_id"]: r["taps"] for r in kernels.resize_stats(df).collect()}
    assert got == want


def test_bands_reach_all_their_samples_and_hold_few_lines(spark):
    sizes = [(s, d, r * resample.ONE) for s, d, r in [*SIZES, (5001, 2500, 16), (4000, 8, 16), (7, 3000, 3), (900, 450, 200)]]
    df = spark.createDataFrame(sizes, "src long, dst long, radius long")
    sent = df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("src") - 1)).alias("line")).select("src", "dst", "radius", "line", F.explode(kernels._reached()).alias("band"))
    need = kernels.bands(df).select("src", "dst", "radius", "band", F.inline("kernel")).select("src", "dst", "radius", "band", "i", F.inline("taps")).withColumnRenamed("s", "line")
    key = ["src", "dst", "radius", "band"]
    assert need.count() == kernels.taps(df).count() and need.join(sent, [*key, "line"], "left_anti").count() == 0
    held = sent.groupBy(*key).agg(F.count("*").alias("n"), (F.max("line") - F.min("line") + 1).alias("span"))
    assert held.where("n <> span").count() == 0
    # A line of a whole image was one row before, of as many samples as the image has lines.
    assert held.where("n > 4 * greatest(shiftright(radius, 32), 32) + 8 + ceil(src / dst)").count() == 0


def test_a_tall_image_in_many_bands(spark):
    px = np.random.default_rng(8).integers(0, 256, (701, 5, 4), dtype=np.uint8)
    df = spark.createDataFrame([(1, y, [int(v) for v in line.ravel()]) for y, line in enumerate(px)], "image_id long, y long, row array<bigint>").repartition(3)
    down = kernels.bands(spark.createDataFrame([(701, 350, 5 * resample.ONE)], "src long, dst long, radius long"))
    assert down.select("band").distinct().count() > 5
    got = [r["row"] for r in kernels.resize(df, F.lit(2), F.lit(350)).orderBy("y").collect()]
    assert got == resample.resize_pixels(px, 2, 350, 5 * resample.ONE).reshape(350, -1).tolist()
