"""Sheets by rows and mip chains by rounds, against NumPy on whole images."""

import duckdb
import numpy as np
import pytest

from tessera.operators import compose, mips
from tessera.plans import registry


def _rows(spark, images, channels):
    rows = [(k, y, [int(v) for v in px[y].ravel()]) for k, px in images.items() for y in range(len(px))]
    return spark.createDataFrame(rows, "id long, y long, row array<bigint>").repartition(4)


def _images(channels, sizes):
    rng = np.random.default_rng(channels)
    return {k: rng.integers(1, 256, (h, w, channels), dtype=np.uint8) for k, (w, h) in enumerate(sizes)}


@pytest.mark.parametrize(("channels", "pad"), [(4, 2), (1, 0), (3, 5)])
def test_sheets_like_blits(spark, channels, pad):
    images = _images(channels, [(5, 4), (1, 1), (9, 2), (3, 12)])
    # The last is placed twice, on another sheet with its sides cut off.
    at = [("a", 0, pad, pad), ("a", 1, 5 + 3 * pad, pad), ("a", 2, 5 + 3 * pad, 1 + 3 * pad), ("b", 3, -1, -2), ("b", 3, 3 + 2 * pad, 4), ("c", 0, 50, 50)]
    sizes = {"a": (5 + 9 + 4 * pad, 20), "b": (3 + 2 * pad + 2, 11), "c": (7, 3)}
    placed = spark.createDataFrame([(s, i, x, y, images[i].shape[1], images[i].shape[0]) for s, i, x, y in at], "sheet string, id long, x long, y long, w long, h long")
    wanted = spark.createDataFrame([(s, *wh) for s, wh in sizes.items()], "sheet string, width long, height long")
    got = {(r["sheet"], r["y"]): r["row"] for r in compose.sheets(_rows(spark, images, channels), placed, wanted, pad, channels).collect()}
    assert len(got) == sum(h for _, h in sizes.values())
    for s, (w, h) in sizes.items():
        sheet = np.zeros((h + 200, w + 200, channels), dtype=np.uint8)
        for t, i, x, y in at:
            if t == s:
                mips.blit(sheet, images[i], x + 100, y + 100, pad)
        for y in range(h):
            assert got[s, y] == sheet[100 + y, 100 : 100 + w].ravel().tolist()
    back = compose.cut_out(compose.sheets(_rows(spark, images, channels), placed.where("sheet = 'a'"), wanted, pad, channels), placed.where("sheet = 'a'"), channels)
    assert {(r["id"], r["y"]): r["row"] for r in back.collect()} == {(i, y): images[i][y].ravel().tolist() for i in (0, 1, 2) for y in range(len(images[i]))}


def test_overlaps_are_an_error(spark):
    images = _images(1, [(4, 4)])
    placed = spark.createDataFrame([("a", 0, 0, 0, 4, 4), ("a", 0, 3, 3, 4, 4)], "sheet string, id long, x long, y long, w long, h long")
    sizes = spark.createDataFrame([("a", 9, 9)], "sheet string, width long, height long")
    with pytest.raises(Exception, match="overlap"):
        compose.sheets(_rows(spark, images, 1), placed, sizes, 0, 1).collect()


def test_brand_sheets_of_parts_that_share_a_key(spark, tmp_path):
    parts = [(7, "a", 3), (7, "a", 5), (7, "b", 4), (8, "b", 2), (300, "a", 1), (300, "b", 50)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    got = registry.QUERIES["brand_sheets"](spark, str(tmp_path)).select("sheet", "y", "n", "total")
    assert sorted(tuple(r) for r in got.collect()) == sorted(db.execute(f"SELECT sheet, y, n, total FROM ({registry.ORACLES['brand_sheets']})").fetchall())


@pytest.mark.parametrize("levels", [None, 0, 2])
def test_chains_like_single_images(spark, levels):
    images = _images(4, [(12, 6), (1, 9), (1, 1), (33, 20)])
    rows = _rows(spark, images, 4).withColumnRenamed("id", "image_id")
    sheets, at = mips.chain_rows(rows, levels)
    got, spots = {}, {}
    for r in sheets.orderBy("sheet", "y").collect():
        got.setdefault(r["sheet"], []).append(r["row"])
    for r in at.orderBy("sheet", "id").collect():
        spots.setdefault(r["sheet"], []).append((r["id"], r["x"], r["y"], r["w"], r["h"]))
    for k, px in images.items():
        most = mips.MipSpec().sizes(px.shape[1], px.shape[0])
        sizes = most if levels is None else most[:levels]
        want = mips.chain(px, mips.MipSpec(len(sizes)) if sizes else mips.MipSpec(), 10**6) if sizes else None
        if want is None:
            padded = np.pad(px, ((1, 1), (1, 1), (0, 0)), mode="edge")
            assert np.array_equal(np.array(got[k], dtype=np.uint8).reshape(padded.shape), padded)
        else:
            assert spots[k] == want[1] and np.array_equal(np.array(got[k], dtype=np.uint8).reshape(want[0].shape), want[0])
