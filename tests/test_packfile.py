import pytest
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import layout, packing
from tessera.sources import msgpack, packfile


@pytest.mark.parametrize("v", [None, True, False, 0, 127, 128, 255, 256, 65535, 65536, 2**32, 2**64 - 1, -1, -32, -33, -128, -129, -32769, -(2**31) - 1, "", "x" * 31, "é" * 40, "x" * 70000, b"", b"\0" * 300, [], list(range(20)), {}, {f"k{i}": [i, None] for i in range(20)}])
def test_msgpack_round_trip(v):
    raw = msgpack.dumps(v)
    assert msgpack.loads(raw) == v
    for cut in (raw[:-1], raw + b"\0"):
        with pytest.raises(ValueError):
            msgpack.loads(cut)


def test_msgpack_known_bytes():
    assert msgpack.dumps({"a": [1, -1, None, 300]}) == b"\x81\xa1a\x94\x01\xff\xc0\xcd\x01\x2c"
    with pytest.raises(ValueError):
        msgpack.loads(b"\x91" * 100 + b"\x00")


def test_packs(spark):
    schema = "pack_id long, name string, description string, pack_mcmeta string, icon binary, icon_format string, atlases array<struct<index:long,width:long,height:long,entries:long,content:binary>>, error string"
    rows = [(1, "n", "d", "{}", bytearray(b"ic"), "png", [(1, 4, 5, 6, bytearray(b"b" * 70000)), (0, 1, 2, 3, bytearray(b"aa"))], "x"), (2, None, None, None, None, None, None, None)]
    files = packfile.write(spark.createDataFrame(rows, schema))
    got = {(r["pack_id"], r["index"]): (r["width"], r["entries"], bytes(r["content"])) for r in packfile.sheets(files).collect()}
    assert got == {(1, 0): (1, 3, b"aa"), (1, 1): (4, 6, b"b" * 70000)}
    whole = {r["pack_id"]: bytes(r["content"]) for r in files.collect()}
    head = packfile.header(whole[1])
    assert whole[1][head["icon"]["offset"] :][:2] == b"ic" and head["blob_section_offset"] == head["icon"]["offset"]
    bad = spark.createDataFrame([(1, bytearray(whole[1][:-1])), (2, bytearray(whole[2])), (3, None), (4, bytearray(b"")), (5, bytearray(whole[2][:40]))], "pack_id long, content binary")
    assert {r["pack_id"]: r["error"] for r in packfile.inspect(bad).collect()} == {1: "blob outside the pack", 2: None, 3: "not a pack", 4: "not a pack", 5: "pack header is cut"}
    assert packfile.sheets(files.limit(0)).count() == 0


def test_metadata(spark):
    flat = packfile.rects_meta(2, [(7, 1 << 48 | 2 << 32 | 3 << 16 | 4), (8, 65535 << 48 | 65535)])
    mips = packfile.levels_meta("k", 1, [(0, 1, 1, 8, 4)])
    named = msgpack.dumps({"kind": "k", "version": 2, "entries": [{"id": 5, "resource": "a:b", "overlay": None, "x": 1, "y": 2, "w": 3, "h": 4}]})
    files = spark.createDataFrame([(1, bytearray(flat)), (2, bytearray(mips)), (3, bytearray(named)), (4, None), (5, bytearray(b"\xc1"))], "f long, meta binary")
    got = sorted(tuple(r) for r in packfile.rects(files, F.col("meta")).drop("meta").collect())
    assert got == [(1, 7, None, None, 1, 2, 3, 4), (1, 8, None, None, 65535, 0, 0, 65535), (2, 0, None, None, 1, 1, 8, 4), (3, 5, "a:b", None, 1, 2, 3, 4)]


def test_least_side(spark):
    sizes = [(1, "a", 5, 3), (2, "a", 4, 4), (3, "a", 2, 2), (4, "b", 1, 1), (5, "c", 900, 1)]
    rects = spark.createDataFrame(sizes, "id long, grp string, w long, h long")
    got = {r["grp"]: r["side"] for r in packing.least_side(rects, 64, 1).collect()}
    # Too large an item gives its own padded side, beyond the limit.
    assert got["b"] == 3 and got["c"] == 902
    ordered = [(4, 4), (5, 3), (2, 2)]
    assert None not in layout.shelve(ordered, got["a"], 1) and None in layout.shelve(ordered, got["a"] - 1, 1)
    for side, all_in in ((got["a"], True), (got["a"] - 1, False)):
        assert (packing.shelf_pack(rects.where("grp = 'a'"), side, 1).where("x is not null").count() == 3) is all_in


def test_names(spark):
    paths = spark.createDataFrame([("d.x/a.tar.gz",), ("a",), (".hidden",), ("d.x/b",), (None,)], "p string")
    got = [tuple(r) for r in paths.select(names.stem(F.col("p")), names.extension(F.col("p")), names.with_extension(F.col("p"), "t"), names.numbered(F.col("p"), "_", F.lit(3), "t")).collect()]
    assert got == [("d.x/a.tar", "gz", "d.x/a.tar.t", "d.x/a.tar_3.gz"), ("a", None, "a.t", "a_3.t"), (".hidden", None, ".hidden.t", ".hidden_3.t"), ("d.x/b", None, "d.x/b.t", "d.x/b_3.t"), (None,) * 4]
    meta = spark.createDataFrame([('{"pack": {"description": "x"}}',), ('{"pack": {"description": {"b": 1}}}',), ("{}",), ("no",), (None,)], "m string")
    assert [r[0] for r in meta.select(names.description(F.col("m"))).collect()] == ["x", '{"b":1}', None, None, None]
