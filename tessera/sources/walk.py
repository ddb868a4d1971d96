"""Walks of folder trees in rounds: tasks list the folders of a level, and what they find is the next level.

Links are followed. A folder that is its own ancestor by its real path ends there, with an error, so a cycle of links ends
the way down and nothing else; a folder that two links lead to is walked for each. What can't be read is a row with its
error. There are as many rounds as levels, each written to the shared folder, and no list of files is ever on the driver.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import shared

_FOUND = {"path": pa.string(), "kind": pa.string(), "size": pa.int64(), "above": pa.list_(pa.string()), "error": pa.string()}
_SQL = "path string, kind string, size bigint, above array<string>, error string"


def _named(uri: str, path: str) -> str:
    """A path of a file system with its scheme, as Spark writes it."""
    scheme, colon, _ = uri.partition(":")
    local = not colon or "/" in scheme or scheme == "file"
    return f"file:{path}" if local else f"{scheme}://{path.lstrip('/')}"


def _entries(uri: str, above: list[str]) -> Iterator[dict]:
    """What a folder holds; above are the real paths of the folders on the way to it."""
    try:
        fs, path = shared.opened(uri)
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        own = os.path.realpath(path) if local else path
        if own in above:
            yield {"path": uri, "kind": "error", "error": f"a link back to {own}"}
            return
        found = fs.get_file_info(pyarrow.fs.FileSelector(path))
        # Links to nothing are not in a local listing.
        for name in sorted(set(os.listdir(path)) - {f.base_name for f in found}) if local else ():
            yield {"path": f"{uri.rstrip('/')}/{name}", "kind": "error", "error": "a link to nothing"}
        for f in found:
            name = _named(uri, f.path)
            if f.type == pyarrow.fs.FileType.Directory:
                yield {"path": name, "kind": "folder", "above": [*above, own]}
            elif f.type == pyarrow.fs.FileType.File:
                yield {"path": name, "kind": "file", "size": f.size}
            else:
                yield {"path": name, "kind": "error", "error": "neither a file nor a folder"}
    except (OSError, ValueError) as e:
        yield {"path": uri, "kind": "error", "error": str(e)}


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, above in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_pylist(list(_entries(uri, above)), schema=pa.schema(_FOUND.items()))


def _start(uri: str) -> dict:
    fs, path = shared.opened(uri)
    info = fs.get_file_info(path)
    name = _named(uri, path)
    if info.type == pyarrow.fs.FileType.Directory:
        return {"path": name, "kind": "folder", "above": []}
    if info.type == pyarrow.fs.FileType.File:
        return {"path": name, "kind": "file", "size": info.size}
    return {"path": name, "kind": "error", "error": "no such file or folder"}


def files(spark: SparkSession, inputs: list[str], tasks: int = 200) -> DataFrame:
    """path, size, error of every file among and below the inputs, each once; rows with an error have no size."""
    where = shared.folder(spark, "walk")
    now = spark.createDataFrame([tuple(_start(p).get(c) for c in _FOUND) for p in dict.fromkeys(inputs)], _SQL)
    every, k = None, 0
    while True:
        now.write.parquet(f"{where}/{k}")
        now = spark.read.schema(_SQL).parquet(f"{where}/{k}")
        some = now.where("kind <> 'folder'").select("path", "size", "error")
        every = some if every is None else every.union(some)
        folders = now.where("kind = 'folder'").select("path", "above")
        n = folders.count()
        if not n:
            return every if len(set(inputs)) == 1 else every.dropDuplicates(["path"])
        now = folders.repartition(min(n, tasks)).mapInArrow(_listed, _SQL)
        k += 1


def contents(listed: DataFrame) -> DataFrame:
    """listed (path, size, error) with content: the bytes of each file, null with an error where it can't be read."""
    types = pa.schema([("path", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                body = None
                if row["error"] is None:
                    try:
                        fs, path = shared.opened(row["path"])
                        with fs.open_input_stream(path) as f:
                            body = f.read()
                    except OSError as e:
                        row["error"] = str(e)
                yield pa.RecordBatch.from_pylist([row | {"content": body}], schema=types)

    return listed.select("path", "size", "error").mapInArrow(run, "path string, size bigint, content binary, error string")
