"""Streamed packing and sheets of large groups against lists in memory."""

import random

import duckdb
import numpy as np
import pytest

from tessera.operators import atlas, layout, packing
from tessera.plans import registry


def _rects(spark, groups):
    return spark.createDataFrame([(g, i, w, h) for g, items in groups.items() for i, (w, h) in enumerate(items)], "grp string, id long, w long, h long").repartition(5)


def _ordered(items):
    return sorted(range(len(items)), key=lambda i: (-items[i][0] * items[i][1], -max(items[i]), i))


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(8)
    out = {g: [(rng.randrange(1, 30), rng.randrange(1, 30)) for _ in range(n)] for g, n in (("a", 60), ("b", 1), ("c", 200))}
    return out | {"same": [(5, 5)] * 40, None: [(3, 9), (9, 3)]}


def test_shelves_and_sides(spark, groups):
    placed = {(r["grp"], r["id"]): r for r in packing.shelf_pack(_rects(spark, groups | {"wide": [(90, 2), (4, 4)]}), 64, 1).collect()}
    sides = {r["grp"]: r["side"] for r in packing.least_side(_rects(spark, groups), 16384, 2).collect()}
    for g, items in (groups | {"wide": [(90, 2), (4, 4)]}).items():
        order = _ordered(items)
        for i, at in zip(order, layout.shelve([items[i] for i in order], 64, 1), strict=True):
            r = placed[g, i]
            assert ((r["x"], r["y"]) if r["placed"] else None, r["w"], r["h"]) == (at, *items[i])
    for g, items in groups.items():
        assert sides[g] == layout.search_side([items[i] for i in _ordered(items)], 16384, 2)


def test_a_search_that_finds_nothing(spark):
    assert [r["side"] for r in packing.least_side(_rects(spark, {"a": [(20, 20)] * 5}), 30, 0).collect()] == [layout.search_side([(20, 20)] * 5, 30, 0)]
    assert packing.least_side(_rects(spark, {}), 30, 0).count() == 0


def test_split_like_sheet_after_sheet(spark, groups):
    got = {(r["grp"], r["id"]): (r["sheet"], r["x"], r["y"]) for r in packing.split(_rects(spark, groups), 70, 1).collect()}
    for g, items in groups.items():
        rest, sheet = _ordered(items), 0
        while rest:
            at = layout.shelve([items[i] for i in rest], 70, 1)
            for i, c in zip(rest, at, strict=True):
                if c is not None:
                    assert got.pop((g, i)) == (sheet, *c)
            rest, sheet = [i for i, c in zip(rest, at, strict=True) if c is None], sheet + 1
        assert g in ("b", "same", None) or sheet > 1
    assert not got
    with pytest.raises(Exception, match="fits no sheet"):
        packing.split(_rects(spark, {"a": [(80, 1)]}), 70, 1).collect()


def test_area_sheets_like_those_in_memory(spark):
    rng = np.random.default_rng(3)
    sizes = {"a": [(9, 4), (4, 9), (12, 12), (7, 7), (16, 3), (3, 3)], "b": [(5, 5)]}
    images = {(g, i): rng.integers(1, 256, (h, w, 4), dtype=np.uint8) for g, items in sizes.items() for i, (w, h) in enumerate(items)}
    rows = spark.createDataFrame([(g, i, y, [int(v) for v in px[y].ravel()]) for (g, i), px in images.items() for y in range(len(px))], "grp string, id long, y long, row array<bigint>").repartition(4)
    made, placed = atlas.area_sheets(rows, 24, 1)
    got = {}
    for r in made.orderBy("sheet", "y").collect():
        got.setdefault(tuple(r["sheet"]), []).append(r["row"])
    spots = {(r["id"]["grp"], r["id"]["id"]): (r["sheet"]["sheet"], r["x"], r["y"]) for r in placed.collect()}
    for g, items in sizes.items():
        rest, sheet = [atlas.Item(i, images[g, i]) for i in range(len(items))], 0
        while rest:
            order = atlas.by_area(rest)
            fits = [i for i, c in zip(order, layout.shelve([rest[i].size for i in order], 24, 1), strict=True) if c]
            here = [rest[i] for i in fits]
            side = layout.search_side([t.size for t in here], 24, 1)
            corners = layout.shelve([t.size for t in here], side, 1)
            assert np.array_equal(np.array(got.pop((g, sheet)), dtype=np.uint8).reshape(side, side, 4), atlas.draw(here, corners, side, 1))
            assert all(spots[g, t.id] == (sheet, *c) for t, c in zip(here, corners, strict=True))
            rest, sheet = [t for i, t in enumerate(rest) if i not in fits], sheet + 1
    assert not got and len(spots) == len(images)


def test_one_group_with_all_rows(spark):
    rects = spark.range(60000).selectExpr("'one' grp", "id", "1 + id % 7 w", "1 + id % 5 h")
    assert packing.shelf_pack(rects, 16384, 0).where("placed").count() == 60000


@pytest.mark.parametrize("seed", range(6))
def test_sheets_in_turn_like_one_by_one(seed, monkeypatch):
    rng = random.Random(seed)
    top, limit = [(40, 70), (9, 12), (64, 64), (5, 128), (30, 33), (2, 7)][seed]
    items = [(rng.randrange(1, top + 1), rng.randrange(1, top + 1)) for _ in range(1500)]
    items = [i for i in items if max(i) + 2 <= limit]
    items = items if seed % 2 else [items[k] for k in _ordered(items)]
    slow, looks = [], 0
    place = packing.Sheet.place

    def counted(self, w, h):
        nonlocal looks
        looks += 1
        return place(self, w, h)

    monkeypatch.setattr(packing.Sheet, "place", counted)
    fast = packing.Sheets(limit, 1)
    got = [fast.place(w, h) for w, h in items]
    # A look places a rectangle or closes a shelf that holds one.
    assert looks <= 2 * len(items)
    for (w, h), found in zip(items, got, strict=True):
        for k in range(len(slow) + 1):
            if k == len(slow):
                slow.append(packing.Sheet(limit, 1))
            at = place(slow[k], w, h)
            if at is not None:
                break
        assert found == (k, *at)
    assert fast.place(limit, 1) is None


def test_sheets_of_images_longer_than_the_limit(spark):
    rng = np.random.default_rng(6)
    sizes = {"tall": [(3, 90), (20, 30), (9, 4), (22, 2)], "wide": [(60, 2), (5, 5), (30, 30)], "low": [(9, 4), (4, 9), (12, 12)]}
    images = {(g, i): rng.integers(1, 256, (h, w, 4), dtype=np.uint8) for g, items in sizes.items() for i, (w, h) in enumerate(items)}
    rows = spark.createDataFrame([(g, i, y, [int(v) for v in px[y].ravel()]) for (g, i), px in images.items() for y in range(len(px))], "grp string, id long, y long, row array<bigint>").repartition(4)
    made, placed = atlas.area_sheets(rows, 24, 1, longer=True)
    got = {}
    for r in made.orderBy("sheet", "y").collect():
        got.setdefault(tuple(r["sheet"]), []).append(r["row"])
    spots = {(r["id"]["grp"], r["id"]["id"]): (r["sheet"]["sheet"], r["x"], r["y"]) for r in placed.collect()}
    assert spots.keys() == images.keys() and len(got) == len({(g, s) for (g, _), (s, _, _) in spots.items()})
    for (g, i), (s, x, y) in spots.items():
        sheet = np.array(got[g, s], dtype=np.uint8).reshape(len(got[g, s]), -1, 4)
        h, w = images[g, i].shape[:2]
        assert np.array_equal(sheet[y - 1 : y + h + 1, x - 1 : x + w + 1], np.pad(images[g, i], ((1, 1), (1, 1), (0, 0)), mode="edge"))
        # Only the direction in which an image is too long goes beyond the limit, as far as the image needs.
        assert sheet.shape[1] <= (62 if g == "wide" else 24) and sheet.shape[0] <= {"tall": 92, "wide": 32, "low": 24}[g]
    plain, at = atlas.area_sheets(rows.where("grp = 'low'"), 24, 1)
    assert sorted(plain.collect()) == sorted(made.where("sheet.grp = 'low'").collect()) and sorted(at.collect()) == sorted(placed.where("sheet.grp = 'low'").collect())
    with pytest.raises(Exception, match="fits no sheet"):
        atlas.area_sheets(rows, 24, 1)


def test_atlas_rows_of_more_than_a_thousand_rows(spark, tmp_path):
    spark.range(1060).selectExpr("id vec_id", "int(if(id < 1050, 4, id % 3)) label", "transform(sequence(1, 64), k -> float((id * 7 + k * 13) % 50 / 50 - 0.4)) embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = registry.QUERIES["atlas_rows"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == sorted(db.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES['atlas_rows']})").fetchall())
