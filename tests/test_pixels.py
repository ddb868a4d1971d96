"""Waves over tiles, the grid of candidates and replayed viewports against plain versions."""

import numpy as np
import pytest

from tessera.operators import edges, filters, predict, view
from tessera.sources import container


def _rows(spark, images, schema="image_id long, y long, row array<bigint>"):
    return spark.createDataFrame([(k, y, [int(v) for v in line.ravel()]) for k, px in images.items() for y, line in enumerate(px)], schema).repartition(4)


@pytest.mark.parametrize("tile", [1, 3, 5, 64])
def test_paeth_in_tiles(spark, tile):
    rng = np.random.default_rng(tile)
    images = {k: rng.integers(0, 256, shape, dtype=np.uint8) for k, shape in enumerate([(1, 1), (1, 4), (4, 1), (6, 5), (3, 3)])}
    coded = {k: container.residual(px, np.pad(px, ((1, 0), (0, 0)))[:-1], "Paeth") for k, px in images.items()}
    got = {(r["image_id"], r["y"]): r["row"] for r in predict.undo_paeth(_rows(spark, coded, "image_id long, y long, e array<bigint>"), "e", tile).collect()}
    assert got == {(k, y): line.tolist() for k, px in images.items() for y, line in enumerate(px)}


def test_paeth_rounds_do_not_grow_with_the_image(spark, monkeypatch):
    rng = np.random.default_rng(4)
    images = {"tall": rng.integers(0, 256, (150, 3), dtype=np.uint8), "wide": rng.integers(0, 256, (2, 90), dtype=np.uint8)}
    coded = {k: container.residual(px, np.pad(px, ((1, 0), (0, 0)))[:-1], "Paeth") for k, px in images.items()}
    frame, wrote = type(spark.range(1).write), []
    parquet = frame.parquet
    monkeypatch.setattr(frame, "parquet", lambda self, *a, **k: (wrote.append(a), parquet(self, *a, **k))[1])
    monkeypatch.setattr(predict, "TILES", 4)
    back = predict.undo_paeth(_rows(spark, coded, "image_id string, y long, e array<bigint>"), "e", 2)
    assert {(r["image_id"], r["y"]): r["row"] for r in back.collect()} == {(k, y): line.tolist() for k, px in images.items() for y, line in enumerate(px)}
    assert len(wrote) <= 2 + 2 * 4 - 1


def test_paeth_of_nothing(spark):
    assert predict.undo_paeth(_rows(spark, {}, "image_id long, y long, e array<bigint>"), "e").count() == 0


def test_candidates_like_planes(spark):
    rng = np.random.default_rng(9)
    ramp = np.add.outer(np.arange(9) * 3, np.arange(14) * 5)[..., None] + np.array([0, 2, 7, 0])
    images = {0: rng.integers(0, 256, (6, 5, 4), dtype=np.uint8), 1: ramp.astype(np.uint8), 2: np.full((3, 2, 4), 200, dtype=np.uint8)}
    got = {}
    for r in predict.choose_candidates(predict.candidate_costs(_rows(spark, images))).collect():
        got.setdefault(r["image_id"], {})[r["transform"], r["channel"]] = r
    for k, px in images.items():
        assert len(got[k]) == 12 and len({t for (t, _), r in got[k].items() if r["chosen"]}) == 1
        for t in container.TRANSFORMS:
            for c, plane in zip("RGB", container.recolour([np.ascontiguousarray(px[..., i]) for i in range(3)], t, -1), strict=True):
                for kind in container.PREDICTORS:
                    e = container.residual(plane, np.pad(plane, ((1, 0), (0, 0)))[:-1], kind).astype(np.int64)
                    assert got[k][t, c][kind.lower()] == np.minimum(e, 256 - e).sum()


def test_replay(spark):
    moves = [("zoom", 2.0, 12.0, 8.0), ("pan", 5.0, -3.0, None), ("move", -40.0, 2.0, None), ("nothing", 1.0, 1.0, 1.0), ("zoom", 1.5, None, 1.0), ("whole", None, None, None), ("zoom", 0.1, 3.0, 3.0), ("fit", None, None, None)]
    rows = [(w, k, 100 + w, 80, *moves[(k * 7 + w) % len(moves)]) for w in (1, 2) for k in range(40)] + [(None, 1, 10, 10, "zoom", 2.0, 1.0, 1.0), (3, 1, 0, 5, "pan", 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "viewer long, seq long, width int, height int, op string, a double, b double, c double").repartition(6)
    got = {(r["viewer"], r["seq"]): (r["scale"], r["x"], r["y"]) for r in view.replay(df, (20, 20)).collect()}
    assert len(got) == len(rows)
    for w in (1, 2):
        now = view.Viewport.fitted((100 + w, 80), (20, 20))
        for _, k, _, _, op, a, b, c in (r for r in rows if r[0] == w):
            if op == "zoom" and b is not None:
                now = now.zoomed(a, b, c)
            elif op in ("pan", "move"):
                now = now.panned(a, b, in_image=op == "move")
            elif op == "whole":
                now = now.one_to_one()
            elif op == "fit":
                now = view.Viewport.fitted(now.image, now.window)
            assert got[w, k] == (now.scale, *now.centre)


def test_one_viewer_with_a_third_of_all_events(spark):
    df = spark.range(30000).selectExpr("if(id % 3 = 0, 0, id) viewer", "id seq", "64 width", "64 height", "'zoom' op", "1.0001 a", "3 b", "3 c")
    assert view.replay(df, (8, 8)).where("viewer = 0").count() == 10000


def test_edge_signatures_like_single_images(spark):
    rng = np.random.default_rng(11)
    images = {k: rng.integers(0, 256, (h, w, 4), dtype=np.uint8) for k, (w, h) in enumerate([(7, 5), (1, 1), (40, 3), (2, 70)])}
    got = {(r["image_id"], r["side"]): (r["edge"], r["q"]) for r in edges.edge_signatures(_rows(spark, images), 16).collect()}
    for k, px in images.items():
        for side, e in edges.signature(px, 16).items():
            assert got.pop((k, side)) == (e.ravel().tolist(), edges.bucket(e))
    assert not got


def test_denoise_rows_like_single_images(spark):
    rng = np.random.default_rng(12)
    y, x = np.mgrid[0:17, 0:13]
    ramp = np.stack([x * 9 + y, 255 - y * 7, x * y % 256, x + 0 * y], -1)
    images = {0: rng.integers(0, 256, (9, 14, 4)), 1: ramp, 2: rng.integers(0, 90, (3, 3, 4)), 3: rng.integers(0, 256, (2, 9, 4)), 4: np.full((6, 5, 4), 250)}
    images = {k: px.astype(np.uint8) for k, px in images.items()}
    got = {(r["image_id"], r["y"]): r["row"] for r in filters.denoise_rows(_rows(spark, images)).collect()}
    for k, px in images.items():
        want = filters.denoised(px)
        near = np.abs(np.array([got[k, j] for j in range(len(px))]) - want.reshape(len(px), -1).astype(int))
        # Values that fall on a half may round either way.
        assert near.max() <= 1 and (near > 0).mean() < 0.01
