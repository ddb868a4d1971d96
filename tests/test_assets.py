"""Atlases, mip chains, files, packs, raw samples and the viewport on small fixtures, against slow or hand-made results."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import header
from tessera.functions import raster as R
from tessera.operators import atlas, develop, edges, filters, layout, mips, predict, resample, view
from tessera.sources import container, images, packfile, respack, tiff


def px(w, h, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 4), dtype=np.uint8)


def solid(w, h, *rgba):
    return np.tile(np.array(rgba, dtype=np.uint8), (h, w, 1))


# --- mip chains


def test_mip_chain_of_a_solid_image():
    sheet, levels, taps = mips.chain(solid(12, 6, 9, 40, 70, 255), mips.MipSpec(), 64)
    assert [v[3:] for v in levels] == [(12, 6), (6, 3), (3, 1), (1, 1)] and taps > 0
    for _, x, y, w, h in levels:
        inner = sheet[y : y + h, x : x + w]
        # Padding repeats the edge pixels, corners too.
        assert (sheet[y - 1, x - 1] == inner[0, 0]).all() and (sheet[y + h, x + w] == inner[-1, -1]).all()


def test_mip_rules():
    assert mips.MipSpec.of(None) is None and mips.MipSpec.of(0) == mips.MipSpec() and mips.MipSpec.of(2).levels == 2
    assert mips.MipSpec.of(3, (40, 20, 10)).sizes(160, 80) == [(80, 40), (40, 20), (20, 10)]
    for bad in (lambda: mips.MipSpec.of(None, (3,)), lambda: mips.MipSpec.of(2, (3,)), lambda: mips.MipSpec.of(5).sizes(4, 4), lambda: mips.MipSpec(heights=(4,)).sizes(9, 4), lambda: mips.MipSpec(heights=(2, 3)).sizes(9, 4), lambda: mips.MipSpec(heights=(0,)).sizes(9, 4)):
        with pytest.raises(ValueError):
            bad()
    assert mips.scaled(7, 64, 30) == (7 * 30 + 32) // 64 and mips.scaled(1, 64, 2) == 1


def test_layout_of_columns_equals_place(spark):
    sizes = [(1, 40, 7), (2, 7, 40), (3, 1, 1), (4, 16, 16)]
    rects = spark.createDataFrame(sizes, "id long, w long, h long")
    got = {}
    for r in mips.layout(layout.mip_levels(rects)).orderBy("id", "level").collect():
        got.setdefault(r["id"], (r["width"], r["height"], []))[2].append((r["x"], r["y"]))
    for i, w, h in sizes:
        assert got[i] == mips.place([(w, h), *mips.MipSpec().sizes(w, h)])


def test_chains_report_errors(spark):
    rows = [(1, 4, 4, px(4, 4).tobytes()), (2, 1, 1, px(1, 1).tobytes())]
    got = {r["image_id"]: r for r in mips.chains(spark.createDataFrame(rows, "image_id long, width int, height int, rgba binary"), mips.MipSpec(2)).collect()}
    assert got[1]["error"] is None and got[1]["ops"] == 8 * got[1]["taps"] and "0 levels" in got[2]["error"]
    assert packfile.read_meta(bytes(got[1]["meta"]))[1] == {"id": 1, "resource": None, "overlay": None, "x": 7, "y": 1, "w": 2, "h": 2}


def test_default_radius_is_the_sources_smaller_side(spark):
    row = spark.createDataFrame([(1, 16, 24, bytearray(px(16, 24, 3).tobytes()))], "image_id long, width int, height int, rgba binary")
    got = bytes(resample.resize(row, 8, 12).first()["rgba"])
    assert got == resample.resize_pixels(px(16, 24, 3), 8, 12, 16 * resample.ONE).tobytes()
    assert resample.taps(16, 24, 16, 24) == 0


# --- signatures and atlases


def slow_band(p, first):
    t = min(2, p.shape[0])
    out = []
    for x in range(p.shape[1]):
        sums = [0, 0, 0]
        for d in range(t):
            q = [int(v) for v in p[min(first + d, p.shape[0] - 1), x]]
            sums = [s + (c * q[3] + 127) // 255 for s, c in zip(sums, q[:3], strict=True)]
        out.append([s // t for s in sums])
    return np.array(out, dtype=np.uint8)


@pytest.mark.parametrize("size", [(1, 1), (7, 3), (64, 64)])
def test_signature(size):
    p = px(*size, seed=2)
    got = edges.signature(p)
    assert (edges.band(p, 0, 2) == slow_band(p, 0)).all() and (edges.band(p, p.shape[0] - 1, 2) == slow_band(p, p.shape[0] - 1)).all()
    assert all(e.shape == (64, 3) for e in got.values())
    if size == (64, 64):
        assert (got["left"] == slow_band(p.swapaxes(0, 1), 0)).all()
    y = [(77 * int(r) + 150 * int(g) + 29 * int(b)) >> 8 for r, g, b in got["top"]]
    assert edges.bucket(got["top"]) == sum(y) // 64 >> 3


def test_blit_repeats_edges_and_corners():
    sheet, p = np.zeros((9, 9, 4), dtype=np.uint8), px(3, 2, 5)
    mips.blit(sheet, p, 3, 3, 2)
    for y in range(9):
        for x in range(9):
            inside = 1 <= x <= 7 and 1 <= y <= 6
            want = p[min(max(y - 3, 0), 1), min(max(x - 3, 0), 2)] if inside else np.zeros(4)
            assert (sheet[y, x] == want).all()


def unpacked(content):
    head, rgba = container.unpack(content)
    return head, np.frombuffer(rgba, dtype=np.uint8).reshape(head["height"], head["width"], 4)


def test_atlas_holds_every_image(spark):
    sizes = [(4, 4), (2, 3), (9, 1), (5, 5), (5, 5)]
    rows = [("g", i, w, h, bytearray(px(w, h, i).tobytes())) for i, (w, h) in enumerate(sizes)] + [("g", 9, None, None, None), ("h", 0, 70, 1, bytearray(px(70, 1).tobytes()))]
    df = spark.createDataFrame(rows, "grp string, id long, width int, height int, rgba binary")
    got = atlas.sheets(df, atlas.Options(limit=64, pad=1, profile="fast")).collect()
    assert [r["error"] for r in got if r["grp"] == "h"] == ["no image fits a side of 64"]
    (sheet,) = [r for r in got if r["grp"] == "g"]
    head, whole = unpacked(bytes(sheet["content"]))
    found = packfile.read_meta(head["meta"])
    assert sorted(f["id"] for f in found) == list(range(5)) and sheet["items"] == 5
    for f in found:
        assert (whole[f["y"] : f["y"] + f["h"], f["x"] : f["x"] + f["w"]] == px(*sizes[f["id"]], f["id"])).all()
    assert sheet["side"] == layout.search_side(sorted(sizes, key=lambda s: (-s[0] * s[1], -max(s))), 64, 1)


def test_images_cut_out_of_sheets(spark):
    sizes = [(4, 4), (2, 300), (9, 1), (5, 5)]
    rows = [("7", i, w, h, bytearray(px(w, h, i).tobytes())) for i, (w, h) in enumerate(sizes)]
    df = spark.createDataFrame(rows, "grp string, id long, width int, height int, rgba binary")
    made = atlas.sheets(df, atlas.Options(pad=1, profile="fast")).select(F.col("grp").cast("long").alias("image_id"), "content")
    got = atlas.cut_out(made.union(spark.createDataFrame([(8, bytearray(b"no"))], "image_id long, content binary"))).collect()
    assert {(r["image_id"], r["id"], r["width"], r["height"], bytes(r["rgba"])) for r in got if r["error"] is None} == {(7, i, w, h, bytes(b)) for _, i, w, h, b in rows}
    assert [r["image_id"] for r in got if r["error"]] == [8] and len(got) == 5


def test_sheets_are_drawn_in_strips(monkeypatch):
    items = [atlas.Item(0, px(3, 2000, 1)), atlas.Item(1, px(40, 2, 2))]
    most, zeros = [0], np.zeros
    monkeypatch.setattr(container, "STRIP", 1 << 14)
    monkeypatch.setattr(np, "zeros", lambda shape, *a, **k: (most.append(int(np.prod(shape))), zeros(shape, *a, **k))[1])
    (sheet,) = atlas.build(items, atlas.Options(pad=1, profile="fast"))
    assert max(most) <= 4 << 14 < sheet["side"] ** 2 and len(unpacked(sheet["content"])[1]) == sheet["side"]


def test_smallest_file_of_the_orders_stays():
    items = [atlas.Item(i, px(8, 8, i % 3)) for i in range(6)]
    (best,) = atlas.build(items, atlas.Options(limit=64, profile="fast"))
    for order in [atlas.by_area(items), *atlas.edge_orders(items)]:
        made = atlas._sheet(items, order, best["side"], 2, atlas.Options(limit=64, profile="fast"))
        assert made is None or len(best["content"]) <= len(made[0])


def test_split_over_sheets_and_names(spark):
    rows = [("p", i, 8, 8, bytearray(px(8, 8, i).tobytes())) for i in range(2)]
    df = spark.createDataFrame(rows, "grp string, id long, width int, height int, rgba binary")
    made = atlas.sheet_names(atlas.sheets(df, atlas.Options(limit=10, pad=1)), F.lit("out/sheet"), "tile").orderBy("sheet").collect()
    assert [(r["sheet"], r["items"], r["path"]) for r in made] == [(0, 1, "out/sheet_0.tile"), (1, 1, "out/sheet_1.tile")]


def test_atlas_mip_sheets():
    whole = list(atlas.build([atlas.Item(0, solid(4, 4, 200, 10, 30, 255)), atlas.Item(1, solid(2, 3, 0, 220, 0, 128))], atlas.Options(limit=64, pad=1, channels=3, mips=mips.MipSpec())))
    assert [s["level"] for s in whole] == [0, 1, 2] and all(container.parse(s["content"])["channels"] == 3 for s in whole)
    last = packfile.read_meta(container.parse(whole[2]["content"])["meta"])
    assert [(f["w"], f["h"]) for f in last] == [(1, 1), (1, 1)]
    sides = list(atlas.build([atlas.Item(0, solid(24, 12, 5, 6, 7, 255))], atlas.Options(limit=64, pad=1, mips=mips.MipSpec.of(3, (20, 11, 6)))))
    assert [s["side"] for s in sides[1:]] == [20, 11, 6]
    with pytest.raises(ValueError):
        list(atlas.build([atlas.Item(0, solid(4, 4, 1, 1, 1, 1))], atlas.Options(mips=mips.MipSpec(9))))


def test_options_are_checked():
    for bad in ({"limit": 30_000}, {"channels": 2}, {"profile": "x"}, {"pack": {}, "channels": 3}, {"pack": {}, "mips": mips.MipSpec()}):
        with pytest.raises(ValueError):
            atlas.Options(**bad)


def test_pack_metadata_is_sorted_and_read_again():
    items = [atlas.Item(i, px(2, 2, i), {"resource": r, "overlay": o, "mcmeta": None}) for i, (r, o) in enumerate([("b:x", "patch"), ("b:x", None), ("a:x", None)])]
    pack = {"kind": "k", "pack_mcmeta": "{}", "sidecars": [{"resource": "z", "overlay": "o"}, {"resource": "y", "overlay": None, "mcmeta": "m"}]}
    (sheet,) = atlas.build(items, atlas.Options(limit=64, pack=pack))
    kind, meta = packfile.parse_meta(container.parse(sheet["content"])["meta"])
    assert kind == "pack" and [(e["overlay"], e["resource"]) for e in meta["entries"]] == [(None, "a:x"), (None, "b:x"), ("patch", "b:x")]
    assert [s["resource"] for s in meta["sidecars"]] == ["y", "z"] and meta["entries"][0]["source_width"] == 2


def test_area_order_of_equal_and_large_sets(spark):
    rows = [(i, 1 + i % 3, 4 - i % 3) for i in range(500)] + [(10**6 + i, 2, 2) for i in range(5)] + [(7, 9, 9)] * 2
    df = spark.createDataFrame(rows, "id long, w long, h long")
    got = [r["id"] for r in layout.area_order(df).orderBy("ordinal").collect()]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (-r[1] * r[2], -max(r[1:]), r[0]))]
    assert sorted(r["ordinal"] for r in layout.area_order(df).collect()) == list(range(len(rows)))


def test_missing_items_and_points_outside(spark):
    places = spark.createDataFrame([("a", 1, 0, 0)], "grp string, id long, x long, y long")
    with pytest.raises(Exception, match="no item 1"):
        layout.placed_items(places, spark.createDataFrame([("a", 2, 5)], "grp string, id long, w long")).collect()
    rects = spark.createDataFrame([("s", 3, 60, 60, 10, 10), ("s", 2, 65, 65, 200, 1), ("s", 1, 0, 0, 0, 5)], "sheet string, id long, x long, y long, w long, h long")
    points = spark.createDataFrame([("s", 69, 69), ("s", 69, 65), ("s", 0, 0), ("t", 69, 69), ("s", 200, 65), ("s", 200, 65)], "sheet string, px long, py long")
    assert sorted(((r["sheet"], r["px"], r["py"], r["id"]) for r in layout.rect_at(points, rects).collect()), key=str) == sorted([("s", 69, 69, 3), ("s", 69, 65, 2), ("s", 0, 0, None), ("t", 69, 69, None), ("s", 200, 65, 2), ("s", 200, 65, 2)], key=str)


def test_points_meet_few_rows_however_many_rectangles_overlap(spark):
    n, free = 3000, 40
    rects = [("s", 10 + k, k * 7 % free - 9, k * 13 % free - 9, 1 + k % 50, 51 - k % 50) for k in range(n)] + [("s", 1, -5, -5, 0, 9), ("t", 2, 3, 3, 1 << 20, 1 << 20)]
    points = [("s", k * 11 % 90 - 12, k * 17 % 90 - 12) for k in range(n)] + [("t", 1 << 19, 3), ("t", 2, 3), ("s", None, 1), (None, 1, 1)]
    df = layout.rect_at(spark.createDataFrame(points, "sheet string, px long, py long"), spark.createDataFrame(rects, "sheet string, id long, x long, y long, w long, h long"))
    inside = lambda p, r: p[0] == r[0] and None not in p and r[2] <= p[1] < r[2] + r[4] and r[3] <= p[2] < r[3] + r[5]
    known = {p: min((r[1] for r in rects if inside(p, r)), default=None) for p in set(points)}
    got = df.collect()
    assert sorted(((r["sheet"], r["px"], r["py"], r["id"]) for r in got), key=str) == sorted(((*p, known[p]) for p in points), key=str)
    # Pairs of points and rectangles of one place, which the lookup once made, are n * n / 4 here.
    plan = df._jdf.queryExecution().executedPlan()
    joined = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            joined.append(node.metrics().apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(plan)
    assert joined and max(joined) < n * 100


# --- files


def bmp(p, bits):
    h, w = p.shape[:2]
    row = (w * bits // 8 + 3) // 4 * 4
    body = b"".join(np.ascontiguousarray(r[:, [2, 1, 0, 3][: bits // 8]]).tobytes().ljust(row, b"\0") for r in p[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, len(body), 0, 0, 0, 0) + body


def tga(p, packed):
    h, w = p.shape[:2]
    rows = p[..., [2, 1, 0, 3]].reshape(-1, 4)
    body = b"".join(b"\x80" + r.tobytes() for r in rows) if packed else rows.tobytes()
    return bytes([0, 0, 10 if packed else 2]) + bytes(9) + struct.pack("<HHBB", w, h, 32, 0x28) + body


def test_decoders():
    p = px(5, 3, 1)
    opaque = p.copy()
    opaque[..., 3] = 255
    assert images.decode(images.encode_png(5, 3, 4, p.tobytes())) == (5, 3, p.tobytes())
    assert images.decode(images.encode_png(5, 3, 3, p[..., :3].tobytes())) == (5, 3, opaque.tobytes())
    assert images.decode(bmp(p, 24)) == (5, 3, opaque.tobytes()) == images.decode(bmp(p, 32))
    assert images.decode(tga(p, False), "a.TGA") == (5, 3, p.tobytes()) == images.decode(tga(p, True), "a.tga")
    for bad in (b"", b"\x89PNG\r\n\x1a\n", bmp(p, 24)[:60], tga(p, False)[:30]):
        with pytest.raises(ValueError):
            images.decode(bad, "x.tga")


def test_png_filters_and_kinds():
    p, w, h = px(4, 5, 9), 4, 5
    raw, up = b"", np.zeros(16, dtype=np.uint8)
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        line = p[y].reshape(-1)
        left, corner = np.concatenate([np.zeros(4, np.uint8), line[:-4]]), np.concatenate([np.zeros(4, np.uint8), up[:-4]])
        a, b, c = (v.astype(int) for v in (left, up, corner))
        pick = np.where((abs(b - c) <= abs(a - c)) & (abs(b - c) <= abs(a + b - 2 * c)), a, np.where(abs(a - c) <= abs(a + b - 2 * c), b, c))
        base = [0 * a, a, b, (a + b) // 2, pick][kind]
        raw += bytes([kind]) + (line - base.astype(np.uint8)).astype(np.uint8).tobytes()
        up = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = lambda w, h, depth, colour, raw, more=b"": b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + more + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert images.decode_png(png(w, h, 8, 6, raw)) == (w, h, p.tobytes())
    assert images.decode_png(png(3, 1, 1, 0, b"\0\xa0"))[2] == bytes([255] * 4 + [0, 0, 0, 255] + [255] * 4)
    assert images.decode_png(png(2, 1, 8, 3, b"\0\1\0", chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6])) + chunk(b"tRNS", b"\7")))[2] == bytes([4, 5, 6, 255, 1, 2, 3, 7])
    assert images.decode_png(png(1, 1, 16, 2, b"\0" + bytes([9, 1, 8, 1, 7, 1])))[2] == bytes([9, 8, 7, 255])


def test_directories(spark, tmp_path):
    root = tmp_path / "in"
    (root / "b").mkdir(parents=True)
    (root / "b" / "x.png").write_bytes(images.encode_png(2, 2, 4, px(2, 2).tobytes()))
    (root / "b-c.PNG").write_bytes(images.encode_png(3, 1, 3, px(3, 1)[..., :3].tobytes()))
    (root / "bad.png").write_bytes(b"no")
    (root / "note.txt").write_text("t")
    (root / "g.gif").write_bytes(bytes.fromhex("47494638396101000100800100ff0000ffffff2c00000000010001000002024401003b"))
    found = images.load(spark, [f"file://{root}"])
    named = {r["path"].rsplit("/in/")[1]: r for r in found.collect()}
    assert bytes(named["b/x.png"]["rgba"]) == px(2, 2).tobytes() and named["bad.png"]["error"] and named["b-c.PNG"]["width"] == 3
    assert bytes(named["g.gif"]["rgba"]) == bytes([255, 0, 0, 255])
    ids = {r["path"].rsplit("/in/")[1]: r["id"] for r in images.items(found).collect()}
    # By components, so the folder b comes before the file b-c.PNG; the broken file has no number.
    assert ids == {"b/x.png": 0, "b-c.PNG": 1, "g.gif": 2}
    done = images.encode_directory(spark, f"file://{root}", "fast")
    assert tuple(images.counts(done).first()) == (3, 1, 1)
    assert images.write_files(done, "output") == 3
    body = (tmp_path / "ENCODED" / "b" / "x.tile").read_bytes()
    assert container.unpack(body)[1] == px(2, 2).tobytes()
    assert images.scan(spark, [f"file://{root}", f"file://{root}/b"]).count() == 4
    assert images.scan(spark, [f"file://{root}/b"]).limit(0).count() == 0


def test_sinks(spark):
    p = px(4, 3, 7)
    files = spark.createDataFrame([(1, bytearray(container.pack(p.tobytes(), 4, 3))), (2, bytearray(container.pack(p.tobytes(), 4, 3, 3))), (3, bytearray(b"x"))], "image_id long, content binary")
    raw = {r["image_id"]: r for r in images.planar(files).collect()}
    assert bytes(raw[1]["content"]) == b"".join(p[..., k].tobytes() for k in range(4)) and len(raw[2]["content"]) == 36 and raw[3]["error"]
    png = {r["image_id"]: r for r in images.png(files).collect()}
    assert images.decode_png(bytes(png[1]["content"])) == (4, 3, p.tobytes()) and bytes(png[2]["content"])[25] == 2
    meta = container.pack(p.tobytes(), 4, 3, meta=packfile.rects_meta(1, [(5, 1 << 48 | 2 << 32 | 3 << 16 | 4)]))
    made = spark.createDataFrame([(1, bytearray(meta)), (2, bytearray(container.pack(p.tobytes(), 4, 3, meta=b"?")))], "image_id long, content binary")
    assert [tuple(r) for r in images.metadata_json(made).collect()] == [(1, "atlas", '{"pad":1,"entries":[{"id":5,"x":1,"y":2,"w":3,"h":4}]}')]


def test_legacy_containers(spark):
    p = px(3, 2, 4)
    for masked in (False, True):
        q = p.copy()
        q[..., 3] = [[0, 255, 0], [255, 0, 255]] if masked else q[..., 3]
        new = container.pack(q.tobytes(), 3, 2, predictor="Delta")
        head = container.parse(new)
        assert head["alpha"] == ("Mask1Bit" if masked else "Normal")
        flags, dims = struct.unpack_from("<IQ", new, 5)
        old = struct.pack("<IQ", flags & ~(0x30 << 8), dims) + b"".join(struct.pack("<QQ", s["orig_size"], s["comp_size"]) + new[s["offset"] : s["offset"] + s["comp_size"]] for s in head["streams"])
        got, rgba = container.unpack(old, strict=False)
        assert rgba == q.tobytes() and got["format"] == "Legacy" and got["version"] == 0
        with pytest.raises(ValueError):
            container.parse(old)
    rows = spark.createDataFrame([(1, bytearray(old))], "image_id long, content binary")
    assert container.inspect(rows, strict=False).first()["streams"][3]["predictor"] == "None"


def test_statistics(spark):
    p = px(8, 8, 4)
    heads = container.inspect(spark.createDataFrame([(1, bytearray(container.pack(p.tobytes(), 8, 8, meta=b"abc"))), (2, None)], "image_id long, content binary"))
    s = {r["channel"]: r for r in container.stream_stats(heads).collect()}
    assert set(s) == set("RGBA") and s["R"]["percent"] == f"{s['R']['comp_size'] * 100 / 64:.1f}%"
    t = container.totals(heads).first()
    assert (t["files"], t["raw"], t["meta"]) == (1, 256, 3) and t["streams"] == sum(r["comp_size"] for r in s.values())


# --- TIFF


def ifd(order, entries, after):
    return struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", t, k, n) + v for t, k, n, v in entries) + struct.pack(order + "I", after)


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff(spark, order):
    n = lambda v: struct.pack(order + "I", v)
    s = lambda *v: struct.pack(order + "H" * len(v), *v).ljust(4, b"\0")
    jpeg = b"\xff\xd8ab"
    first = [(0x112, 3, 1, s(6)), (0x14A, 4, 2, n(400)), (0x999, 2, 3, b"xy\0\0")]
    small = [(0x100, 3, 1, s(4)), (0x101, 3, 1, s(4)), (0x103, 3, 1, s(7)), (0x111, 4, 1, n(300)), (0x117, 4, 1, n(4))]
    equal = [(0x100, 3, 1, s(2)), (0x101, 3, 1, s(8)), (0x103, 3, 1, s(6)), (0x111, 4, 1, n(310)), (0x117, 4, 1, n(4)), (0x112, 3, 1, s(3))]
    data = bytearray(600)
    data[:8] = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    for at, body in ((8, ifd(order, first, 8)), (100, ifd(order, small, 0)), (200, ifd(order, equal, 0)), (300, jpeg), (310, b"\xff\xd8cd"), (400, n(100) + n(200))):
        data[at : at + len(body)] = body
    # The first of equally large ones stays; it has no orientation of its own, so the first directory's holds.
    assert tiff.embedded_jpeg(bytes(data)) == (300, 4, 16, 6)
    rows = spark.createDataFrame([("a", data), ("b", bytearray(b"II*\0\xff\0\0\0")), ("c", None)], "path string, content binary")
    got = {r["path"]: r for r in tiff.embedded(rows).collect()}
    assert bytes(got["a"]["content"]) == jpeg and got["b"]["error"] == "TIFF is cut" and got["c"]["error"] == "not a TIFF"
    numbers = {r["tag"]: r["numbers"] for r in tiff.entries(rows).where("directory = 8").collect()}
    assert numbers == {0x112: [6], 0x14A: [100, 200], 0x999: None}


def test_small_files_share_batches(spark, monkeypatch):
    made = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, schema: made.append(run))
    files = spark.createDataFrame([], "path string, content binary")
    data = struct.pack("<2sHI", b"II", 42, 8) + ifd("<", [(0x100, 3, 1, b"\1\0\0\0")], 0)
    batch = pa.record_batch([pa.array([f"f{k}" for k in range(500)]), pa.array([data] * 499 + [None], pa.binary())], names=["path", "content"])
    for of, each in ((tiff.entries, 1), (images.decoded, 1)):
        of(files)
        out = list(made.pop()(iter([batch])))
        assert len(out) == 1 and out[0].num_rows == 500 * each and out[0].column(0).to_pylist() == batch.column(0).to_pylist()


# --- resource packs


def test_resource_packs(spark):
    meta = '{"pack":{"description":"d"},"overlays":{"entries":[{"directory":"patch"},{"formats":1},{"directory":"gone"}]}}'
    paths = [("r/pack.mcmeta", meta), ("r/pack.png", None), ("r/assets/n/t/a.png", None), ("r/assets/n/t/a.png.mcmeta", "A"), ("r/assets/n/t/b.png.mcmeta", "B"), ("r/patch/assets/n/t/a.PNG", None), ("r/patch/assets/n/t/c.png.mcmeta", "C"), ("r/other/assets/n/z.png", None)]
    files = spark.createDataFrame(paths, "path string, text string")
    found = respack.layers(files, "r")
    assert sorted(tuple(r) for r in found.collect()) == [(0, None, "r/assets"), (1, "patch", "r/patch/assets")]
    assert sorted((r["resource"], r["overlay"], r["mcmeta"]) for r in respack.textures(files, found).fillna("-").collect()) == [("n:t/a.PNG", "patch", "-"), ("n:t/a.png", "-", "A")]
    assert [tuple(r) for r in respack.sidecars(files, found).collect()] == [("n:t/b.png", None, "B"), ("n:t/c.png", "patch", "C")]
    assert respack.textures(files.limit(0), respack.layers(files.limit(0), "r")).count() == 0
    with pytest.raises(Exception, match="broken"):
        respack.layers(spark.createDataFrame([("r/pack.mcmeta", "{")], "path string, text string"), "r").collect()
    with pytest.raises(Exception, match="no namespace"):
        spark.createDataFrame([("only",)], "p string").select(respack.location(F.col("p"))).collect()
    blobs = spark.createDataFrame([("r/pack.png", bytearray(b"i")), ("x/own.raw", bytearray(b"o"))], "path string, content binary")
    assert tuple(respack.icon(blobs, "r").first())[0] == "png" and tuple(respack.icon(blobs, "r", "x/own.raw").first())[0] == "raw"
    assert spark.range(1).select(respack.pack_name(F.lit("a/b/")), respack.pack_name(F.lit("/"))).first()[0] == "b"


# --- raw samples, filters, masks


def test_camera_parameters():
    c = develop.Camera(gains=(2.0, 0.5, 1.0, 1.0))
    assert c.balance() == (4.0, 1.0, 2.0, 2.0) and develop.Camera(gains=(1.0, 0.0, 1.0, 1.0)).balance() == (1.0,) * 4
    assert develop.Camera(matrix=((0.0,) * 3,) * 3).usable_matrix() is None
    with_four = develop.Camera(cfa=((0, 1, 1), (1, 2, 1), (1, 1, 3)))
    assert develop.needed_reach(develop.Camera(), 0, 0) == 1 and develop.needed_reach(with_four, 0, 0) >= 2


@pytest.mark.parametrize("cfa", [((0, 1), (1, 2)), ((0, 1, 1), (1, 2, 1), (1, 1, 3))])
def test_demosaic_against_a_slow_one(spark, cfa):
    cam = develop.Camera(white=(255.0,) * 4, cfa=cfa)
    for w, h in ((5, 4), (1, 3), (7, 2)):
        v = np.random.default_rng(w).integers(0, 256, (h, w))
        df = spark.createDataFrame([(1, y, x, int(v[y, x])) for y in range(h) for x in range(w)], "image_id long, y long, x long, v long")
        got = {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in develop.demosaic(df, cam, 1, 0).collect()}
        kind = lambda y, x: cfa[(y + 1) % len(cfa)][x % len(cfa[0])]
        most = max(len(cfa), 2)
        for y in range(h):
            for x in range(w):
                want = []
                for c in range(3):
                    value = v[y, x] / 255
                    for d in range(most + 1):
                        near = [v[b, a] / 255 for b in range(max(0, y - d), min(h, y + d + 1)) for a in range(max(0, x - d), min(w, x + d + 1)) if kind(b, a) == c or (c == 1 and kind(b, a) == 3)]
                        if near and (d or kind(y, x) == c or (c == 1 and kind(y, x) == 3)):
                            value = sum(near) / len(near)
                            break
                    s = value * 12.92 if value <= 0.0031308 else 1.055 * value ** (1 / 2.4) - 0.055
                    want.append(int(s * 255 + 0.5))
                assert got[y, x] == tuple(want)


def test_levels_of_odd_numbers(spark):
    cam = develop.Camera(black=(10.0,) * 4, white=(5.0,) * 4, gains=(1.0, 1.0, 20.0, 1.0))
    df = spark.createDataFrame([(9.0,), (11.0,), (float("nan"),), (float("inf"),), (None,), (-3.0,)], "v double")
    ints = [r[0] for r in df.where("v in (9.0, 11.0)").select(develop.integer_level(F.col("v"), F.lit(2), cam)).collect()]
    assert ints == [0.0, 8.0]
    assert [r[0] for r in df.select(develop.float_level(F.col("v"), F.lit(0), cam)).collect()] == [8.0, 8.0, 0.0, 0.0, 0.0, 0.0]
    with pytest.raises(Exception, match="leaves nothing"):
        develop.crop_by(spark.createDataFrame([(0, 0)], "x long, y long"), F.lit(3), F.lit(3), left=3).collect()


def slow_denoise(p):
    h, w = p.shape[:2]
    r, g, b = (p[..., k].astype(float) for k in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    near = lambda a, yy, xx, d: [a[j, i] for j in range(max(0, yy - d), min(h, yy + d + 1)) for i in range(max(0, xx - d), min(w, xx + d + 1))]
    median = lambda a: np.array([[sorted(v := near(a, j, i, 1))[len(v) // 2] for i in range(w)] for j in range(h)])
    blur = lambda a, d: np.array([[np.mean(near(a, j, i, d)) for i in range(w)] for j in range(h)])
    ys, bs, rs = blur(median(y), 2), blur(median(b - y), 5), blur(median(r - y), 5)
    out = p.copy()
    for j in range(h):
        for i in range(w):
            v = y[j, i]
            dark, detail, high = (min(max(t, 0), 1) for t in ((170 - v) / 170, abs(v - ys[j, i]) / 45, (v - 175) / 80))
            c, light, grey = (0.70 + dark * 0.28) * (1 - high * 0.55), dark**0.85 * 0.70 * (1 - detail * 0.45), dark**1.25 * 0.18
            v2 = v + (ys[j, i] - v) * light
            cb, cr = ((k + (s - k) * c) * (1 - grey) for k, s in ((b[j, i] - v, bs[j, i]), (r[j, i] - v, rs[j, i])))
            rr, bb = v2 + cr, v2 + cb
            out[j, i, :3] = [min(max(t + 0.5, 0), 255) for t in (rr, (v2 - 0.299 * rr - 0.114 * bb) / 0.587, bb)]
    return out


def test_denoise():
    p = px(9, 7, 11)
    assert np.abs(filters.denoised(p).astype(int) - slow_denoise(p)).max() <= 1 and (filters.denoised(p)[..., 3] == p[..., 3]).all()
    assert (filters.denoised(p[:2]) == p[:2]).all()


def test_masks_planes_and_saturation(spark):
    rows = spark.createDataFrame([([0, 255, 0, 0, 9, 0, 0, 1, 5],), ([],), ([0],)], "a array<int>")
    got = rows.select(R.mask_bytes(F.col("a")).alias("m"), F.size("a").alias("n")).select("m", R.mask_samples(F.col("m"), F.col("n")).alias("s")).collect()
    assert [r["m"] for r in got] == [[0b10010010, 1], [], [0]] and got[0]["s"] == [0, 255, 0, 0, 255, 0, 0, 255, 255]
    big = spark.createDataFrame([(R.LARGEST, 1), (2, 3), (None, 1)], "a long, b long").select(R.saturating_add(F.col("a"), F.col("b")), R.saturating_multiply(F.col("a"), F.col("b")))
    assert [tuple(r) for r in big.collect()] == [(R.LARGEST, R.LARGEST), (5, 6), (None, None)]
    assert spark.range(1).select(header.number(header.ALPHA, F.lit("?")), header.label(header.ALPHA, F.lit(9))).first() == (None, None)


def test_undo_rows_with_nulls(spark):
    df = spark.createDataFrame([([250, 10, 1],), (None,), ([],), ([255, 255],)], "r array<bigint>")
    assert [r[0] for r in df.select(R.undelta_row(F.col("r"))).collect()] == [[250, 4, 5], None, [], [255, 254]]
    rows = spark.createDataFrame([(i, y, [i + y, 200]) for i in (1, 2) for y in range(3)], "image_id long, y long, row array<bigint>")
    back = predict.undo_up(predict.residuals(rows), "up").collect()
    assert {(r["image_id"], r["y"], r["x"]): r["p"] for r in back} == {(i, y, x): [i + y, 200][x] for i in (1, 2) for y in range(3) for x in range(2)}


# --- viewport


def test_viewport():
    assert view.fit((300, 200), (1600, 900)) == 1.0 and view.fit((3000, 1500), (600, 600)) == 0.2 and view.fit((0, 5), (5, 5)) == 1.0
    v = view.Viewport((90, 90), (30, 30), 1.0, (40.0, 50.0))
    z = v.zoomed(2, 11, 7)
    assert np.allclose(v.to_image(11, 7), z.to_image(11, 7))
    assert v.panned(10, 0).centre == (30.0, 50.0) and v.panned(99, 0, in_image=True).centre == (75.0, 50.0)
    assert view.Viewport.fitted((10, 10), (40, 40)).centre == (5.0, 5.0) and v.zoomed(1000, 1, 1).scale == view.GREATEST
    assert v.scaled(0.5, 3, 3).one_to_one().scale == 1.0


def test_render_against_a_slow_one(spark):
    p = px(6, 5, 3)
    df = spark.createDataFrame([(1, y, x, *map(int, p[y, x])) for y in range(5) for x in range(6)], "image_id long, y long, x long, r long, g long, b long, a long")
    for v in (view.Viewport((6, 5), (9, 8), 1.7, (3.1, 2.4)), view.Viewport((6, 5), (4, 4), 0.4, (3.0, 2.5))):
        got = {(r["ty"], r["tx"]): (r["r"], r["g"], r["b"]) for r in view.render(df, v).collect()}
        want = {}
        for ty in range(v.window[1]):
            for tx in range(v.window[0]):
                x, y = (int(np.floor((t + 0.5 - w / 2) / v.scale + c)) for t, w, c in ((tx, v.window[0], v.centre[0]), (ty, v.window[1], v.centre[1])))
                if 0 <= x < 6 and 0 <= y < 5:
                    want[ty, tx] = tuple((int(c) * int(p[y, x, 3]) + 127) // 255 for c in p[y, x, :3])
        assert got == want
