"""Fixed small rasters: predictors and transforms undo each other, modes and rectangles."""

from pyspark.sql import functions as F

from tessera.functions import raster as R
from tessera.operators import layout, packing, predict


def test_delta_round_trip(spark):
    plane = [[(37 * x + 91 * y * y) % 256 for x in range(5)] for y in range(4)]
    df = spark.createDataFrame([(1, y, r) for y, r in enumerate(plane)], "image_id long, y long, row array<long>")
    out = df.select("y", R.undelta_row(R.delta_row(F.col("row"))).alias("r")).orderBy("y").collect()
    assert [r["r"] for r in out] == plane
    up = predict.undo_up(predict.residuals(df), "up").orderBy("y", "x").collect()
    assert [r["p"] for r in up] == [x for row in plane for x in row]


def test_every_transform_round_trips(spark):
    rgb = [((83 * k) % 256, (255 - 29 * k) % 256, (k * k * 7) % 256) for k in range(24)] + [(0, 0, 0), (255, 255, 255), (0, 255, 0)]
    df = spark.createDataFrame([(1, 0, i, *c) for i, c in enumerate(rgb)], "image_id long, y long, x long, r long, g long, b long")
    back = predict.restored(predict.transformed(df)).groupBy("transform").agg(F.sort_array(F.collect_list(F.struct("x", "r", "g", "b"))).alias("p")).collect()
    assert len(back) == 4 and len({str(r["p"]) for r in back}) == 1


def test_alpha_modes(spark):
    cases = {"Opaque255": [255, 255], "Transparent0": [0, 0], "Mask1Bit": [0, 255], "Normal": [7, 7]}
    df = spark.createDataFrame([(k, a) for k, v in cases.items() for a in v], "k string, a long")
    assert all(r["k"] == r["m"] for r in df.groupBy("k").agg(R.alpha_mode().alias("m")).collect())


def test_rect_with_top_bit(spark):
    df = spark.createDataFrame([(40000, 1, 2, 3)], "x long, y long, w long, h long")
    packed = df.select(R.pack_rect(*[F.col(c) for c in "xywh"]).alias("p"))
    assert tuple(packed.select(*R.unpack_rect(F.col("p"))).first()) == (40000, 1, 2, 3)


def test_mip_chain(spark):
    df = spark.createDataFrame([(1, 8, 4)], "id long, w long, h long")
    assert [(r["w"], r["h"]) for r in layout.mip_levels(df).orderBy("level").collect()] == [(8, 4), (4, 2), (2, 1), (1, 1)]


def test_blur_and_padding_reach_all_sides(spark):
    df = spark.createDataFrame([(1, 5, [0, 9]), (1, 7, [3, 6]), (2, 0, [4, 8])], "image_id long, y long, row array<long>")
    got = {(r["image_id"], r["y"], r["x"]): r["mean"] for r in layout.box_blur(df, 1).collect()}
    assert got == {(1, 5, 0): 4.5, (1, 5, 1): 4.5, (1, 7, 0): 4.5, (1, 7, 1): 4.5, (2, 0, 0): 6.0, (2, 0, 1): 6.0}
    tall = spark.createDataFrame([(1, y, [v]) for y, v in enumerate((0, 3, 9))], "image_id long, y long, row array<long>")
    assert [r["mean"] for r in layout.box_blur(tall, 1).orderBy("y").collect()] == [1.5, 4.0, 6.0]
    padded = [(r["y"], r["row"]) for r in layout.pad_image(df, 1).where("image_id = 1").orderBy("y").collect()]
    assert padded == [(0, [0, 0, 9, 9]), (1, [0, 0, 9, 9]), (2, [3, 3, 6, 6]), (3, [3, 3, 6, 6])]
    assert [r["y"] for r in layout.pad_image(df, 2).where("image_id = 2").orderBy("y").collect()] == [0, 1, 2, 3, 4]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, grp string, w long, h long")
    assert packing.shelf_pack(df, 64, 1).count() == 0
    assert layout.area_order(df).count() == 0
