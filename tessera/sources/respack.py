"""Resource packs: layers, textures, sidecars and the metadata that goes with them, from a listing of files.

A listing has path and, for text files, text. All lookups are joins by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import names

SIDECAR = ".mcmeta"


def location(relative: Column) -> Column:
    """namespace:path of a path relative to an assets folder; an empty namespace or path is an error."""
    parts = F.filter(F.split(relative, "/"), lambda p: p != "")
    rest = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    bad = F.raise_error(F.concat(F.lit("no namespace or path: "), F.coalesce(relative, F.lit("null"))))
    return F.when((F.size(parts) > 1) & (rest != ""), F.concat(parts[0], F.lit(":"), rest)).otherwise(bad)


def overlays(pack_meta: Column) -> Column:
    """The directories that a pack's JSON declares as overlays, in order; entries without one are passed over. None if
    the JSON declares none; JSON that is broken is an error."""
    parsed = F.try_parse_json(pack_meta)
    checked = F.when(pack_meta.isNull() | parsed.isNotNull(), pack_meta).otherwise(F.raise_error(F.lit("the pack's JSON is broken")))
    listed = F.from_json(F.get_json_object(checked, "$.overlays.entries"), "array<struct<directory:string>>")
    return F.filter(F.coalesce(listed["directory"], F.expr("cast(array() as array<string>)")), lambda d: d.isNotNull())


def layers(listing: DataFrame, root: str) -> DataFrame:
    """ordinal, overlay, assets: the pack's own assets folder, then those of its overlays that have files. One row each."""
    top = root.rstrip("/")
    found = listing.where(F.col("path") == f"{top}/pack{SIDECAR}").select(F.posexplode(overlays(F.col("text"))).alias("k", "overlay"))
    declared = found.select((F.col("k") + 1).alias("ordinal"), "overlay", F.concat(F.lit(f"{top}/"), "overlay", F.lit("/assets")).alias("assets"))
    spark = listing.sparkSession
    base = spark.createDataFrame([(0, None, f"{top}/assets")], "ordinal int, overlay string, assets string")
    folders = listing.select(F.regexp_extract("path", "^(.*?/assets)/", 1).alias("assets")).distinct()
    return base.unionByName(declared).join(folders, "assets", "left_semi").select("ordinal", "overlay", "assets")


def placed(files: DataFrame, layers: DataFrame) -> DataFrame:
    """files with overlay and relative: the first layer whose folder holds each; files outside all layers are left out.

    The folder of a path is cut at each "assets" component that it has, so the prefix lookup is an equi-join.
    """
    parts = F.split("path", "/")
    heads = F.filter(F.transform(parts, lambda p, i: F.when(p == "assets", F.array_join(F.slice(parts, 1, i + 1), "/"))), lambda h: h.isNotNull())
    each = files.withColumn("assets", F.explode(heads)).join(F.broadcast(layers), "assets")
    first = each.groupBy(*files.columns).agg(F.min(F.struct("ordinal", "overlay", "assets")).alias("l"))
    return first.select(*files.columns, F.col("l.overlay").alias("overlay"), F.expr("substring(path, length(l.assets) + 2)").alias("relative"))


def textures(listing: DataFrame, layers: DataFrame) -> DataFrame:
    """path, resource, overlay, mcmeta of every PNG file in a layer, with the text of the sidecar beside it, if any."""
    png = placed(listing.where(F.lower(names.extension(F.col("path"))) == "png").select("path"), layers)
    side = listing.where(F.col("path").endswith(SIDECAR)).select(F.expr(f"left(path, length(path) - {len(SIDECAR)})").alias("path"), F.col("text").alias("mcmeta"))
    return png.join(side, "path", "left").select("path", location(F.col("relative")).alias("resource"), "overlay", "mcmeta")


def sidecars(listing: DataFrame, layers: DataFrame) -> DataFrame:
    """resource, overlay, mcmeta of every .png sidecar in a layer without its PNG, by overlay, none first, and resource."""
    side = listing.where(F.col("path").endswith(f".png{SIDECAR}")).select(F.expr(f"left(path, length(path) - {len(SIDECAR)})").alias("path"), F.col("text").alias("mcmeta"))
    alone = placed(side.join(listing.select("path"), "path", "left_anti"), layers)
    return alone.select(location(F.col("relative")).alias("resource"), "overlay", "mcmeta").orderBy(F.asc_nulls_first("overlay"), "resource")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path and text (of sidecars alone) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    return files.select("path", F.when(F.col("path").endswith(SIDECAR), F.col("content").cast("string")).alias("text"))


def pack_name(root: Column) -> Column:
    """The last part of a pack's path, or a fixed name."""
    last = F.regexp_extract(root, "([^/]*)/*$", 1)
    return F.when(last != "", last).otherwise(F.lit("Texture Pack"))


def icon(files: DataFrame, root: str, chosen: str | None = None) -> DataFrame:
    """At most one row (format, content) of files (path, content): the chosen icon, or else pack.png of the pack."""
    path = chosen or f"{root.rstrip('/')}/pack.png"
    return files.where(F.col("path") == path).select(names.blob_format(F.col("path")).alias("format"), "content")
