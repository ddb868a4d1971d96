"""Folders of images and packs: what encoding a folder leaves, and how the source of packs plans and reads."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import registry
from tessera.sources import images, packfile, packs, tiles, walk


def _png(w, h, seed):
    px = np.random.default_rng(seed).integers(0, 256, (h, w, 4), dtype=np.uint8)
    return px, images.encode_png(w, h, 4, px.tobytes())


def _tree(top):
    return sorted(os.path.relpath(os.path.join(d, f), top) for d, _, names in os.walk(top) for f in names)


def test_encoding_a_folder(spark, tmp_path):
    root = tmp_path / "my pics+1" / "in"
    (root / "a" / "b").mkdir(parents=True)
    made = {}
    for k, name in enumerate(["a/x.png", "a/x.PNG", "a/b/y.png", "z.png"]):
        made[name], body = _png(3 + k, 4, k)
        (root / name).write_bytes(body)
    (root / "a" / "bad.png").write_bytes(b"\x89PNG")
    (root / "note.txt").write_text("no image")
    for _ in range(2):
        done = images.encode_folder(spark, f"file://{root}", profile="fast")
        fate = {r["path"].rpartition("/in/")[2]: r for r in done.collect()}
        assert {n: r["status"] for n, r in fate.items()} == {"a/x.png": "encoded", "a/x.PNG": "replaced", "a/b/y.png": "encoded", "z.png": "encoded", "a/bad.png": "failed", "note.txt": "skipped"}
        assert fate["a/bad.png"]["error"] and fate["note.txt"]["output"] is None and fate["z.png"]["bytes"] > 17
        assert tuple(images.counts(done).first()) == (4, 1, 1)
        assert _tree(root.parent / "ENCODED") == ["a/b/y.tile", "a/x.tile", "z.tile"]
    back = {r["path"].rpartition("/ENCODED/")[2]: bytes(r["rgba"]) for r in tiles.read(spark, f"file://{root.parent}/ENCODED", read="pixels").collect()}
    assert back == {"a/b/y.tile": made["a/b/y.png"].tobytes(), "a/x.tile": made["a/x.png"].tobytes(), "z.tile": made["z.png"].tobytes()}


def _pack(name, n, size):
    sheets = [{"index": i, "width": 10 + i, "height": 2, "entries": i % 3, "content": bytes([i]) * size} for i in range(n)]
    return packfile.build({"name": name, "atlases": sheets, "icon": b"icon"})


def test_one_pack_over_many_tasks(spark, tmp_path):
    (tmp_path / "one.pack").write_bytes(_pack("one", 20, 5000))
    reader = packs.PackReader({"path": str(tmp_path), "partitionBytes": "20000"})
    parts = reader.partitions()
    assert len(parts) == 5 and sum(len(p.rows) for p in parts) == 20
    df = packs.read(spark, str(tmp_path), partitionBytes="20000")
    assert df.rdd.getNumPartitions() == 5
    got = {r["index"]: r for r in df.collect()}
    assert all(bytes(got[i]["content"]) == bytes([i]) * 5000 and got[i]["name"] == "one" and got[i]["width"] == 10 + i for i in range(20))


def test_filters_are_applied_while_planning(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.pack").write_bytes(_pack(n, 6, 100))
    (tmp_path / "broken.pack").write_bytes(b"TESSPACK")
    reader = packs.PackReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([packs.ds.EqualTo(("name",), "a"), packs.ds.GreaterThan(("width",), 12), packs.ds.IsNotNull(("width",))]))
    assert len(left) == 1 and [r["index"] for p in reader.partitions() for r in p.rows] == [3, 4, 5]
    df = packs.read(spark, str(tmp_path))
    assert df.where("name = 'a' and width > 12").count() == 3 and df.where("index in (1, 2)").count() == 4
    bad = df.where(F.col("error").isNotNull()).collect()
    assert [os.path.basename(r["path"]) for r in bad] == ["broken.pack"] and bad[0]["content"] is None


def test_planning_reads_headers_alone(tmp_path):
    data = _pack("big", 3, 100_000)
    read = []

    def ranges(at, n):
        read.append((at, n))
        return data[at : at + n]

    head = packfile.header_of(ranges, len(data))
    assert [a["len"] for a in head["atlases"]] == [100_000] * 3 and sum(n for _, n in read) == head["blob_section_offset"] < 1000


def test_an_empty_folder(spark, tmp_path):
    assert packs.read(spark, str(tmp_path)).count() == 0 and tiles.read(spark, str(tmp_path / "none")).count() == 0


def test_walks_follow_links_and_end_at_circles(spark, tmp_path):
    top = tmp_path / "top [1]"
    (top / "a" / "b").mkdir(parents=True)
    for f in ("one.txt", "a/two.txt", "a/b/three.txt"):
        (top / f).write_text(f)
    (top / "again").symlink_to(top / "a" / "b")
    (top / "a" / "b" / "up").symlink_to(top / "a")
    (top / "gone").symlink_to(top / "nowhere")
    (top / "self").symlink_to(top / "self")
    rows = walk.files(spark, [str(top), str(top / "a"), str(top / "one.txt"), str(tmp_path / "missing")]).collect()
    good = sorted(r["path"].removeprefix(f"file:{top}/") for r in rows if r["error"] is None)
    # The link to b stands for a folder of its own, in which up leads to a, and there to b again, which ends it.
    assert good == sorted(["one.txt", "a/two.txt", "a/b/three.txt", "again/three.txt", "again/up/two.txt"])
    wrong = {r["path"].removeprefix(f"file:{tmp_path}/"): r["error"] for r in rows if r["error"] is not None}
    assert set(wrong) == {"top [1]/a/b/up", "top [1]/again/up/b", "top [1]/gone", "top [1]/self", "missing"}
    assert wrong["top [1]/a/b/up"] == f"a link back to {top}/a" and all(r["size"] is None for r in rows if r["error"])
    body = {r["path"].rpartition("/")[2]: r["content"] for r in walk.contents(walk.files(spark, [str(top / "a" / "b")])).collect() if r["error"] is None}
    assert body == {"three.txt": b"a/b/three.txt", "two.txt": b"a/two.txt"}


def test_encoding_a_folder_with_links(spark, tmp_path):
    root = tmp_path / "in"
    (root / "a").mkdir(parents=True)
    _, body = _png(3, 2, 1)
    (root / "a" / "x.png").write_bytes(body)
    (root / "b").symlink_to(root / "a")
    (root / "a" / "up").symlink_to(root)
    done = images.encode_folder(spark, str(root), profile="fast")
    assert tuple(images.counts(done).first()) == (2, 0, 2)
    assert _tree(tmp_path / "ENCODED") == ["a/x.tile", "b/x.tile"]


@pytest.mark.parametrize("name", ["png_roundtrip", "planar_raw", "container_inspect", "tile_headers", "folder_counts", "encoded_pixels"])
def test_images_over_the_strict_side(spark, tmp_path, name):
    spark.range(22_003).selectExpr("id vec_id", "int(if(id < 22001, 0, 2)) label", "transform(sequence(1, 64), k -> float((id * 7 + k * 13) % 50 / 50 - 0.4)) embedding").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(9).selectExpr("id s_suppkey", "concat('s', id) s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    db = duckdb.connect()
    for t in ("embeddings", "supplier"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = registry.QUERIES[name](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == sorted(db.execute(f"""SELECT {", ".join(f'"{c}"' for c in got.columns)} FROM ({registry.ORACLES[name]})""").fetchall())
