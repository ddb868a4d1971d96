"""Output names and texts that derive from paths and descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^((?:.*/)?)([^/]+?)(?:\.([^./]*))?$"


def stem(path: Column) -> Column:
    """The path without its last extension; a leading dot starts none."""
    return F.regexp_replace(path, _PARTS, "$1$2")


def extension(path: Column) -> Column:
    """Without its dot; null if there is none."""
    return F.nullif(F.regexp_extract(path, _PARTS, 3), F.lit(""))


def with_extension(path: Column, ext: str) -> Column:
    return F.concat(stem(path), F.lit("." + ext))


def numbered(path: Column, tag: str, n: Column, ext: str) -> Column:
    """stem, tag, n, then the path's own extension or else ext: one name per sheet ("_") or level ("_mip")."""
    return F.concat(stem(path), F.lit(tag), n.cast("string"), F.lit("."), F.coalesce(extension(path), F.lit(ext)))


def blob_format(path: Column, known: tuple[str, ...] = ("png", "raw")) -> Column:
    ext = F.lower(extension(path))
    return F.when(ext.isin(*known), ext).otherwise(F.lit("raw"))


def description(mcmeta: Column) -> Column:
    """pack.description of a JSON text: its text, or the JSON of any other value; null if missing or broken."""
    return F.get_json_object(mcmeta, "$.pack.description")
