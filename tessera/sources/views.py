"""Views that let plain tables stand for rasters and rectangles."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, row: each embedding is a row of samples of the image that its label names."""
    sample = F.transform("embedding", lambda v: F.pmod(F.floor(v * 128) + 128, F.lit(256)).cast("long"))
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("image_id"), F.col("vec_id").cast("long").alias("y"), sample.alias("row"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, r, g, b, a: four samples of a row make a pixel. No shuffle."""
    quads = F.transform(F.sequence(F.lit(0), F.floor(F.size("row") / 4).cast("int") - 1), lambda i: F.struct(i.alias("x"), *[F.element_at("row", i * 4 + k + 1).alias(c) for k, c in enumerate("rgba")]))
    return rows(spark, sf_dir).select("image_id", "y", F.explode(quads).alias("p")).select("image_id", "y", F.col("p.x").cast("long").alias("x"), "p.r", "p.g", "p.b", "p.a")


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, grp, w, h: a rectangle of each part, in groups by brand."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), F.col("p_size").cast("long").alias("w"), (51 - F.col("p_size")).cast("long").alias("h"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, width, height, channels, rgba: the rows of an image, in order, as the bytes of one raster."""
    line = F.array_join(F.transform("row", lambda v: F.lpad(F.hex(v), 2, "0")), "")
    ordered = F.array_sort(F.collect_list(F.struct("y", line.alias("hex"))))
    whole = rows(spark, sf_dir).groupBy("image_id").agg(ordered.alias("lines"))
    return whole.select("image_id", F.lit(16).cast("long").alias("width"), F.size("lines").cast("long").alias("height"), F.lit(4).alias("channels"), F.unhex(F.array_join("lines.hex", "")).alias("rgba"))


#: Of a part: a file of a resource pack, in the pack's own layer or in a patch's, as SQL of either dialect.
PACK_PATH = "concat('d/pack/', CASE WHEN p_partkey % 5 = 0 THEN 'patch/' ELSE '' END, 'assets/', lower(replace(p_brand, '#', '_')), '/tex/', p_partkey, '.png')"
PACK_META = '{"overlays": {"entries": [{"formats": 3}, {"directory": "patch"}, {"directory": "none"}]}}'


def pack_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text: textures of parts (none for every seventh), sidecars for every third, and the pack's own file."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.expr(PACK_PATH).alias("path"))
    png = part.where("p_partkey % 7 != 0").select("path", F.lit(None).cast("string").alias("text"))
    side = part.where("p_partkey % 3 = 0").select(F.concat("path", F.lit(".mcmeta")).alias("path"), F.format_string('{"n":%d}', "p_partkey").alias("text"))
    own = spark.createDataFrame([("d/pack/pack.mcmeta", PACK_META), ("d/pack/readme.txt", None)], "path string, text string")
    return png.unionByName(side).unionByName(own)


def tiffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: of each part a small TIFF with two directories, each with a JPEG strip; odd ones are big-endian."""

    def one(key: int, size: int) -> bytes:
        order = ">" if key % 2 else "<"
        out = struct.pack(order + "2sHI", b"MM" if key % 2 else b"II", 42, 8)
        for k, (w, h) in enumerate(((size, key % 300 + 1), (51, key % 200 + 1))):
            end = 8 + (k + 1) * (2 + 12 * 6 + 4)
            fields = [(0x100, 4, w), (0x101, 4, h), (0x103, 3, 7), (0x111, 4, 8 + 2 * (2 + 12 * 6 + 4)), (0x112, 3, key % 8 + 1), (0x117, 4, 4)]
            out += struct.pack(order + "H", len(fields))
            for tag, kind, v in fields:
                out += struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "HH", v, 0) if kind == 3 else struct.pack(order + "I", v))
            out += struct.pack(order + "I", 0 if k else end)
        return out + b"\xff\xd8\xff\xd9"

    @F.arrow_udf("binary")
    def build(key: pa.Array, size: pa.Array) -> pa.Array:
        return pa.array([one(k, s) for k, s in zip(key.to_pylist(), size.to_pylist(), strict=True)], pa.binary())

    # A small file of keys makes a large table, so the keys are dealt out first.
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition("p_partkey")
    return part.select(F.concat(F.lit("t/"), F.col("p_partkey").cast("string"), F.lit(".dng")).alias("path"), build("p_partkey", "p_size").alias("content"))
