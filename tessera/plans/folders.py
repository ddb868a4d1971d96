"""Registered queries that write folders of files and read them again, each with its DuckDB SQL.

The containers are their own, of images as long as the tables make them, so they are not read strictly."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import names
from tessera.functions import raster as R
from tessera.plans.registry import _DIGEST, _RGBA, _WHOLE, _digest, query
from tessera.sources import container, images, packfile, packs, respack, shared, tiles, views

_ALPHA = f"WITH {_RGBA}, m AS (SELECT image_id, count(*) // 16 AS height, CASE WHEN min(a) = 255 THEN 'Opaque255' WHEN max(a) = 0 THEN 'Transparent0' WHEN bool_and(a IN (0, 255)) THEN 'Mask1Bit' ELSE 'Normal' END AS alpha FROM rgba GROUP BY image_id)"


def _written(spark, sf_dir) -> str:
    """A new folder of a container for each image of the table."""
    where = shared.folder(spark, "tiles")
    px = views.images(spark, sf_dir).withColumn("name", F.format_string("d%d/image-%d.tile", F.col("image_id") % 3, "image_id"))
    tiles.write(px, where, profile="fast")
    return where


def _id():
    return F.regexp_extract("path", r"image-(\d+)[.]tile$", 1).cast("long").alias("image_id")


@query(_ALPHA + " SELECT image_id, 'd' || image_id % 3 AS folder, 2 AS version, 16::BIGINT AS width, height, 4 AS channels, alpha, 17 + 17 * n::BIGINT AS bytes_read, true AS rest_unread FROM (SELECT *, CASE WHEN alpha IN ('Normal', 'Mask1Bit') THEN 4 ELSE 3 END AS n FROM m) WHERE height >= 48 AND image_id % 3 <> 1")
def tile_headers(spark, sf_dir):
    """Headers of a folder under filters that the source takes: no byte of a stream is read."""
    found = tiles.read(spark, _written(spark, sf_dir), strict="false").where("height >= 48 and (path like '%/d0/%' or path like '%/d2/%')")
    return found.select(_id(), F.regexp_extract("path", "/(d[0-9])/", 1).alias("folder"), "version", "width", "height", "channels", "alpha", "bytes_read", (F.col("bytes_read") < F.col("file_size")).alias("rest_unread"))


@query(_DIGEST)
def tile_pixels(spark, sf_dir):
    """Images written into a folder and read from it."""
    return _digest(tiles.read(spark, _written(spark, sf_dir), read="pixels", strict="false", partitionBytes="20000").where("error is null").select(_id(), "width", "height", "channels", "rgba"))


def _folder(spark, sf_dir) -> str:
    """A folder of PNG files, of texts, and of files that are called PNG but are none."""
    where = shared.folder(spark, "pictures") + "/in"
    name = lambda c, ext: F.concat(F.lit("d"), (F.col(c) % 3).cast("string"), F.lit("/image-"), F.col(c).cast("string"), F.lit(ext)).alias("name")
    png = images.png(container.encode(views.images(spark, sf_dir), "fast"), strict=False).where("error is null").select(name("image_id", ".PNG"), "content")
    some = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").cast("binary").alias("content"))
    text = some.where("id % 2 = 0").select(name("id", ".txt"), "content")
    bad = some.where("id % 5 = 3").select(name("id", ".bad.png"), "content")
    tiles.write(png.union(text).union(bad), where)
    return where


_FATES = """f AS (SELECT 'd' || label % 3 || '/image-' || label AS stem, '.PNG' AS ext, 'encoded' AS status FROM (SELECT DISTINCT label FROM embeddings)
UNION ALL SELECT 'd' || s_suppkey % 3 || '/image-' || s_suppkey, '.txt', 'skipped' FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'd' || s_suppkey % 3 || '/image-' || s_suppkey || '.bad', '.png', 'failed' FROM supplier WHERE s_suppkey % 5 = 3)"""


@query(f"WITH {_FATES} SELECT stem || ext AS path, CASE WHEN status <> 'skipped' THEN 'ENCODED/' || stem || '.tile' END AS output, status FROM f")
def encode_folder(spark, sf_dir):
    """What becomes of each file of a folder that is encoded."""
    done = images.encode_folder(spark, _folder(spark, sf_dir), profile="fast")
    return done.select(F.regexp_extract("path", "/in/(.*)$", 1).alias("path"), F.nullif(F.regexp_extract("output", "/(ENCODED/.*)$", 1), F.lit("")).alias("output"), "status")


@query(f"WITH {_FATES} SELECT count(*) FILTER (status = 'encoded') AS encoded, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed FROM f")
def folder_counts(spark, sf_dir):
    return images.counts(images.encode_folder(spark, _folder(spark, sf_dir), profile="fast"))


@query(_DIGEST)
def encoded_pixels(spark, sf_dir):
    """The images of a folder, found in the containers that encoding it has left."""
    where = _folder(spark, sf_dir)
    images.encode_folder(spark, where, profile="fast")
    found = tiles.read(spark, where.removesuffix("/in") + "/ENCODED", read="pixels", strict="false").where("error is null")
    return _digest(found.select(_id(), "width", "height", "channels", "rgba"))


_SHEETS = f"WITH {_WHOLE}, i AS (SELECT image_id, sum(p)::BIGINT AS total, sum(p * (pos + 1))::BIGINT AS moment, count(*) AS n FROM bytes GROUP BY image_id)"


@query(_SHEETS + " SELECT 'pack-' || image_id % 2 AS pack, image_id AS \"index\", 16::BIGINT AS width, n // 64 AS height, image_id % 4 AS entries, total, moment FROM i WHERE image_id >= 2")
def pack_sheets(spark, sf_dir):
    """Two packs of all images as sheets, read by ranges in several tasks; a filter on sheets is applied while planning."""
    sheet = F.struct(F.col("image_id").alias("index"), "width", "height", (F.col("image_id") % 4).alias("entries"), F.col("rgba").alias("content"))
    made = views.images(spark, sf_dir).groupBy((F.col("image_id") % 2).alias("pack_id")).agg(F.collect_list(sheet).alias("atlases"))
    none = {c: F.lit(None).cast(t) for c, t in (("pack_mcmeta", "string"), ("icon", "binary"), ("icon_format", "string"))}
    files = packfile.write(made.withColumns({"name": F.format_string("pack-%d", "pack_id"), "description": F.lit(""), **none}))
    where = shared.folder(spark, "packs")
    tiles.write(files.select(F.format_string("p%d.pack", "pack_id").alias("name"), "content"), where)
    found = packs.read(spark, where, partitionBytes="8000").where("index >= 2")
    return found.select(F.col("name").alias("pack"), "index", "width", "height", "entries", R.byte_total(F.col("content")).alias("total"), R.byte_moment(F.col("content")).alias("moment"))


@query("SELECT CASE p_partkey % 3 WHEN 0 THEN 'png' ELSE 'raw' END AS format, p_name AS content FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part)")
def pack_icon(spark, sf_dir):
    """The icon of a pack whose files are parts: its own is that of the smallest key."""
    part = views.table(spark, sf_dir, "part")
    least = part.agg(F.min("p_partkey").alias("least"))
    named = part.join(F.broadcast(least), part["p_partkey"] == least["least"], "left")
    path = F.when(F.col("least").isNotNull(), F.concat(F.lit("d/pack/icon."), F.when(F.col("p_partkey") % 3 == 0, "PNG").otherwise("webp"))).otherwise(F.concat(F.lit("d/pack/x/"), F.col("p_partkey").cast("string")))
    files = named.select(path.alias("path"), F.col("p_name").alias("content"))
    png = respack.icon(files, "d/pack", "d/pack/icon.PNG")
    return png.union(respack.icon(files, "d/pack", "d/pack/icon.webp"))


@query("SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN '{\"text\":\"' || p_name || '\"}' END AS description FROM part")
def pack_description(spark, sf_dir):
    """Descriptions of packs: a text, a value that is none, none at all, and broken JSON."""
    p = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_size")
    text = F.expr("""CASE p_size % 4 WHEN 0 THEN concat('{"pack": {"description": "', p_name, '", "pack_format": 3}}') WHEN 1 THEN concat('{"pack": {"description": {"text": "', p_name, '"}}}') WHEN 2 THEN '{"pack": {}}' ELSE '{"pack": ' END""")
    return p.select("id", names.description(text).alias("description"))


@query("""SELECT 'i' || label || '.dng' AS path, 16::BIGINT AS width, count(*) AS height, NULL::VARCHAR AS error FROM embeddings GROUP BY label
UNION ALL SELECT 't/' || p_partkey || '.dng', NULL, NULL, 'as an image: not an image that can be decoded; embedded JPEG: it needs a folder to pass through; sensor data: not decoded' FROM part
UNION ALL SELECT 's' || s_suppkey || '.dng', NULL, NULL, 'as an image: not an image that can be decoded; embedded JPEG: ' || CASE WHEN s_suppkey % 2 = 0 THEN 'not a TIFF' ELSE 'no embedded JPEG' END || '; sensor data: not decoded' FROM supplier""")
def raw_attempts(spark, sf_dir):
    """Raw files of several kinds, and all that was tried in vain: PNG files by another name, TIFF files, texts and empty ones."""
    png = images.png(container.encode(views.images(spark, sf_dir), "fast"), strict=False).where("error is null").select(F.format_string("i%d.dng", "image_id").alias("path"), "content")
    bare = F.unhex(F.lit("49492A00080000000000"))
    other = views.table(spark, sf_dir, "supplier").select(F.format_string("s%d.dng", "s_suppkey").alias("path"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name").cast("binary")).otherwise(bare).alias("content"))
    files = png.union(views.tiffs(spark, sf_dir)).union(other)
    return images.raw_files(files).select("path", "width", "height", "error")


@query(_DIGEST.replace("4 AS channels", "3 AS channels").replace("FROM bytes", "FROM (SELECT image_id, pos, CASE WHEN pos % 4 = 3 THEN 255 ELSE p END AS p FROM bytes)"))
def rgb_pixels(spark, sf_dir):
    """Images written with three channels: alpha is gone and reads as opaque."""
    where = shared.folder(spark, "rgb")
    tiles.write(views.images(spark, sf_dir).withColumns({"name": F.format_string("image-%d.tile", "image_id"), "channels": F.lit(3)}), where, profile="fast")
    return _digest(tiles.read(spark, where, read="pixels", strict="false").where("error is null").select(_id(), "width", "height", "channels", "rgba"))


@query("SELECT label::BIGINT AS image_id, label % 4 = 0 AS strict, label % 4 IN (0, 3) AS lenient, CASE label % 4 WHEN 1 THEN 'stream 3: size, predictor or end' WHEN 2 THEN 'not a container' WHEN 3 THEN 'bytes after the last stream' END AS error FROM embeddings GROUP BY label")
def container_faults(spark, sf_dir):
    """Containers as they are, cut short, without their magic and with a byte too many, read strictly and leniently."""
    whole = container.encode(views.images(spark, sf_dir), "fast")
    n, fault = F.octet_length("content"), F.col("image_id") % 4
    body = F.when(fault == 1, F.expr("substring(content, 1, octet_length(content) - 1)")).when(fault == 2, F.concat(F.lit(b"none"), F.expr("substring(content, 5)"))).when(fault == 3, F.concat("content", F.lit(b"x"))).otherwise(F.col("content"))
    files = whole.where(n > 0).select("image_id", body.alias("content"))
    strict, lenient = container.inspect(files).select("image_id", "error"), container.inspect(files, strict=False).select("image_id", F.col("error").alias("less"))
    return strict.join(lenient, "image_id").select("image_id", F.col("error").isNull().alias("strict"), F.col("less").isNull().alias("lenient"), "error")


@query(_DIGEST)
def plane_decode(spark, sf_dir):
    """Images whose predictors and transforms the encoder chose, or were told, decoded on rows from lines of streams."""
    where, px = shared.folder(spark, "planes"), views.images(spark, sf_dir)
    for k, kind in enumerate((None, "Paeth", "Up", "Delta", "None")):
        some = px.where(F.col("image_id") % 5 == k).withColumn("name", F.format_string("image-%d.tile", "image_id"))
        tiles.write(some, where, overwrite=False, profile="fast", **({"predictor": kind} if kind else {}))
    rows = tiles.pixel_rows(spark, where, strict="false", partitionBytes="20000").withColumnRenamed("image_id", "path").select(_id(), "y", "row")
    total = R.total(F.col("row"))
    sums = rows.groupBy("image_id").agg(F.max(F.floor(F.size("row") / 4)).alias("width"), F.count("*").alias("height"), F.lit(4).alias("channels"), F.sum(total).alias("total"), F.sum(R.moment(F.col("row")) + F.col("y") * F.size("row") * total).alias("moment"))
    return sums.select("image_id", "width", "height", "channels", "total", "moment")
