"""The data source of container folders: what it reads, what it leaves unread, and what a write publishes."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import container, tiles
from test_container import image


def _rows(n=12):
    alphas = [lambda x, y: 255, lambda x, y: 0, lambda x, y: x % 2 * 255, lambda x, y: x + y]
    return [(f"d{k % 3}/t{k:02}.tile", 4 + k, 3 + k % 5, bytearray(image(4 + k, 3 + k % 5, alphas[k % 4])), bytearray(b"m" * 5000) if k % 2 else None) for k in range(n)]


@pytest.fixture
def folder(spark, tmp_path):
    df = spark.createDataFrame(_rows(), "name string, width int, height int, rgba binary, meta binary").repartition(4)
    tiles.write(df, str(tmp_path / "out"), profile="fast")
    return tmp_path / "out"


def _files(top):
    return sorted(os.path.relpath(os.path.join(d, f), top) for d, _, names in os.walk(top) for f in names)


def test_round_trip(spark, folder):
    assert _files(folder) == sorted(r[0] for r in _rows())
    back = {r["path"][-11:]: r for r in tiles.read(spark, str(folder), read="pixels").collect()}
    for name, w, h, px, meta in _rows():
        r = back[name[-11:]]
        assert (r["width"], r["height"], bytes(r["rgba"]), r["meta"], r["error"]) == (w, h, bytes(px), meta and bytes(meta), None)


def test_headers_read_no_stream_byte(spark, folder):
    for r in tiles.read(spark, str(folder)).collect():
        whole = container.parse(open(r["path"], "rb").read())
        assert all(r[c] == whole[c] for c in ("width", "height", "channels", "alpha", "transform", "stream_offset", "end_offset"))
        assert [s.asDict() for s in r["streams"]] == whole["streams"]
        assert r["bytes_read"] == 17 + (4 if whole["meta"] is not None else 0) + 17 * len(whole["streams"]) < r["file_size"]


def test_pushed_filters(spark, folder):
    some = tiles.read(spark, str(folder)).where("width >= 10 and alpha in ('Normal', 'Mask1Bit') and path like '%/d1/%' and file_size > 10")
    left_to_spark = [line for line in some._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert not any(c in line for line in left_to_spark for c in (">= 10", "Contains", "> 10", " IN "))
    assert sorted((r["width"], r["alpha"]) for r in some.collect()) == sorted((w, container.classify_alpha(_alpha(px))) for n, w, h, px, _ in _rows() if w >= 10 and n.startswith("d1") and container.classify_alpha(_alpha(px)) in ("Normal", "Mask1Bit"))
    reader = tiles.TileReader({"path": str(folder), "partitionFiles": "2"})
    left = list(reader.pushFilters([tiles.ds.GreaterThan(("width",), 8), tiles.ds.StringContains(("path",), "/d0/"), tiles.ds.IsNull(("error",)), tiles.ds.EqualTo(("nowhere", "deep"), 1)]))
    assert len(left) == 2
    parts = reader.partitions()
    assert [len(p.files) for p in parts] == [2, 2] and all("/d0/" in f for p in parts for f, _, _ in p.files)
    fs, _ = tiles.opened(str(folder))
    small = next((f, s) for p in parts for f, s, _ in p.files if "t00" in f)
    assert reader._row(fs, *small, [t for t in reader.tests if t.column == "width"]) is None


def _alpha(px):
    import numpy as np

    return np.frombuffer(bytes(px), dtype=np.uint8)[3::4]


def test_bad_files_say_why_and_filters_drop_them(spark, folder):
    (folder / "bad.tile").write_bytes(b"VRTX")
    good = (folder / "d0" / "t00.tile").read_bytes()
    (folder / "cut.tile").write_bytes(good[:60])
    (folder / "empty.tile").write_bytes(b"")
    (folder / ".hidden").write_bytes(b"x")
    rows = tiles.read(spark, str(folder)).where("error is not null").collect()
    assert sorted(os.path.basename(r["path"]) for r in rows) == ["bad.tile", "cut.tile", "empty.tile"] and all(r["width"] is None for r in rows)
    assert tiles.read(spark, str(folder)).where("width > 0").count() == 12
    assert tiles.read(spark, str(folder)).where("width is null").count() == 3


def test_partitions_by_bytes(folder):
    reader = tiles.TileReader({"path": str(folder), "read": "pixels", "partitionBytes": "6000"})
    parts = reader.partitions()
    assert len(parts) > 2 and all(sum(s for _, s, _ in p.files[:-1]) < 6000 for p in parts)
    assert sum(len(p.files) for p in parts) == 12


def test_a_failing_task_leaves_nothing(spark, folder):
    before = {f: os.stat(folder / f).st_mtime_ns for f in _files(folder)}
    more = spark.range(40, numPartitions=4).select(F.format_string("n%d.tile", "id").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="lost"):
        tiles.write(more, str(folder))
    assert {f: os.stat(folder / f).st_mtime_ns for f in _files(folder)} == before


def test_append_overwrite_and_rerun(spark, folder):
    more = spark.createDataFrame([("new/a.tile", bytearray(b"1")), ("d0/t00.tile", bytearray(b"2"))], "name string, content binary")
    tiles.write(more, str(folder), overwrite=False)
    assert len(_files(folder)) == 13 and (folder / "d0" / "t00.tile").read_bytes() == b"2"
    for _ in range(2):
        tiles.write(more, str(folder))
        assert _files(folder) == ["d0/t00.tile", "new/a.tile"]


def test_bad_names_and_repeated_ones(spark, folder):
    for names in (["a", "a"], ["../a"], ["/a"], [None], ["_x/a"]):
        df = spark.createDataFrame([(n, bytearray(b"1")) for n in names], "name string, content binary")
        with pytest.raises(Exception):
            tiles.write(df, str(folder))
        assert len(_files(folder)) == 12
    with pytest.raises(Exception, match="tiles need"):
        tiles.write(df.drop("content"), str(folder))


def test_recover_after_the_driver_died(spark, folder):
    """A list that was written but not carried out, and one that was carried out in part."""
    writer = tiles.TileWriter({"path": str(folder)}, spark.createDataFrame([], "name string, content binary").schema, False)
    stage = folder / "_staging" / writer.job
    stage.mkdir(parents=True)
    (stage / "0").write_bytes(b"zero")
    (folder / "_pending").mkdir(exist_ok=True)
    (folder / "one.tile").write_bytes(b"one")
    todo = {"job": writer.job, "replace": False, "files": [["zero.tile", str(stage / "0")], ["one.tile", str(stage / "1")]]}
    (folder / "_pending" / f"{writer.job}.json").write_text(json.dumps(todo))
    assert tiles.recover(str(folder)) == 1 and tiles.recover(str(folder)) == 0
    assert (folder / "zero.tile").read_bytes() == b"zero" and (folder / "one.tile").read_bytes() == b"one" and not stage.exists()
    assert len(_files(folder)) == 14


def test_attempts_that_nobody_reports_are_dropped(spark, folder):
    writer = tiles.TileWriter({"path": str(folder)}, spark.createDataFrame([], "name string, content binary").schema, False)
    lost = folder / "_staging" / writer.job / "0-1-x"
    lost.mkdir(parents=True)
    (lost / "0").write_bytes(b"half")
    writer.commit([None, tiles.Staged([])])
    assert not (folder / "_staging" / writer.job).exists() and len(_files(folder)) == 12


def test_pixels_from_lines(spark, folder):
    """All alpha modes and chosen predictors, streams in tasks of their own; a bad file doesn't harm the others."""
    (folder / "bad.tile").write_bytes(b"VRTX")
    good = (folder / "d0" / "t00.tile").read_bytes()
    (folder / "cut.tile").write_bytes(good[:60])
    reader = tiles.TileReader({"path": str(folder), "read": "lines", "partitionFiles": "1"})
    assert len(reader.partitions()) == 4 * 14
    got = {}
    for r in tiles.pixel_rows(spark, str(folder), partitionFiles="5").orderBy("image_id", "y").collect():
        got.setdefault(r["image_id"][-11:], []).append(bytes(r["row"]))
    assert {n: b"".join(lines) for n, lines in got.items()} == {r[0][-11:]: bytes(r[3]) for r in _rows()}
    bad = tiles.read(spark, str(folder), read="lines").where("error is not null").collect()
    assert sorted(os.path.basename(r["path"]) for r in bad) == ["bad.tile", "cut.tile"]
    assert tiles.read(spark, str(folder), read="lines").where("width >= 10 and channel = 'G'").select("path").distinct().count() == sum(r[1] >= 10 for r in _rows())


@pytest.mark.parametrize("kind", container.PREDICTORS)
def test_lines_of_every_predictor(spark, tmp_path, kind):
    px = image(9, 7, lambda x, y: (x + y) % 2 * 255)
    df = spark.createDataFrame([("a.tile", 9, 7, bytearray(px)), ("b.tile", 9, 7, bytearray(image(9, 7)))], "name string, width int, height int, rgba binary")
    tiles.write(df, str(tmp_path / "t"), predictor=kind)
    rows = tiles.pixel_rows(spark, str(tmp_path / "t")).orderBy("image_id", "y").collect()
    assert b"".join(bytes(r["row"]) for r in rows) == px + image(9, 7)


def test_streams_are_read_once(spark, tmp_path):
    px = np.random.default_rng(3).integers(0, 256, (9, 5, 4), dtype=np.uint8)
    df = spark.createDataFrame([("a.tile", 5, 9, bytearray(px.tobytes()))], "name string, width int, height int, rgba binary")
    tiles.write(df, str(tmp_path / "in"), profile="fast", predictor="Paeth")
    rows = tiles.pixel_rows(spark, str(tmp_path / "in"))
    (tmp_path / "in" / "a.tile").unlink()
    assert {r["y"]: r["row"] for r in rows.collect()} == {y: line.ravel().tolist() for y, line in enumerate(px)}
