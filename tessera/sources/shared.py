"""Folders that all machines of the cluster share."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import quote

import pyarrow.fs
from pyspark.sql import SparkSession


def folder(spark: SparkSession, tag: str) -> str:
    """The URI of a new folder in spark.checkpoint.dir; where that is unset, of a temporary one under a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it. As in Spark's paths, nothing in it is escaped."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return pyarrow.fs.LocalFileSystem(), os.path.abspath(uri)
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@?&=')}")
