"""Folders of container files as a data source: spark.read.format("tiles") and df.write.format("tiles").

Reading plans partitions from the listing, by bytes, or by files where headers alone are read, and takes nothing of a file
but the ranges that it needs: of a header-only read the fields and the stream headers, not one byte of a stream. Filters on
path and file_size drop files before a task is made for them, filters on header fields end the walk after 17 bytes.

Writing commits in two phases. Tasks write below _staging, each attempt in a folder of its own, and tell the driver what
is there. The driver writes down what is to be published, moves the files to their names and drops the folder. A task that
is killed or runs twice leaves nothing, as only what attempts report is moved. A driver that dies between the two
phases leaves a list that the next write, or recover(), carries out.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators import predict
from tessera.sources import container
from tessera.sources.shared import folder, opened

_STREAMS = "streams array<struct<channel string, orig_size bigint, comp_size bigint, predictor string, offset bigint>>"
_HEAD = {
    "format": pa.string(), "version": pa.int32(), "pixfmt": pa.int32(), "qval": pa.int32(), "width": pa.int64(), "height": pa.int64(), "channels": pa.int32(), "has_predictor": pa.bool_(),
    "alpha": pa.string(), "transform": pa.string(), "plane_size": pa.int64(), "raw_planar_size": pa.int64(),
}
_FIELDS = {"path": pa.string(), "file_size": pa.int64(), **_HEAD, "stream_offset": pa.int64(), "end_offset": pa.int64(), "streams": container._FIELDS["streams"], "bytes_read": pa.int64(), "error": pa.string()}
_SQL = {pa.list_(pa.int64()): "array<bigint>", pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary"}
#: What a read holds beside the fields above.
_LINES = {"channel": pa.string(), "predictor": pa.string(), "y": pa.int64(), "row": pa.list_(pa.int64())}
_MORE = {"headers": {}, "metadata": {"meta": pa.binary()}, "pixels": {"meta": pa.binary(), "rgba": pa.binary()}, "lines": _LINES}
_STAGING, _PENDING = "_staging", "_pending"
_BATCH = 8 << 20

_TESTS = {
    ds.EqualTo: lambda v, x: v == x,
    ds.GreaterThan: lambda v, x: v > x,
    ds.GreaterThanOrEqual: lambda v, x: v >= x,
    ds.LessThan: lambda v, x: v < x,
    ds.LessThanOrEqual: lambda v, x: v <= x,
    ds.In: lambda v, x: v in x,
    ds.StringStartsWith: lambda v, x: v.startswith(x),
    ds.StringEndsWith: lambda v, x: v.endswith(x),
    ds.StringContains: lambda v, x: x in v,
}


@dataclass(frozen=True)
class Test:
    """One pushed comparison of a field that is not null in any file that can be read."""

    column: str
    kind: type
    value: object

    def __call__(self, row: dict) -> bool:
        return _TESTS[self.kind](row[self.column], self.value)


@dataclass
class Files(ds.InputPartition):
    """Files, each with its bytes and the number of the one stream that is read of it, or None."""

    files: list[tuple[str, int, int | None]]


def _fields(read: str) -> dict[str, pa.DataType]:
    if read not in _MORE:
        raise ValueError(f"option read: {', '.join(_MORE)}")
    return _FIELDS | _MORE[read]


def _hidden(path: str, root: str) -> bool:
    return any(p[:1] in "_." for p in posixpath.relpath(path, root).split("/"))


def listing(root: str, extension: str = "") -> list[tuple[str, int]]:
    """Path and bytes of the files below a folder, hidden ones and what a write has not published left out, by path."""
    fs, top = opened(root)
    found = fs.get_file_info(pyarrow.fs.FileSelector(top, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == pyarrow.fs.FileType.File and not _hidden(f.path, top) and f.path.endswith(extension))


class TileReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.root, self.read_kind = options["path"], options.get("read", "headers")
        self.strict, self.extension = options.get("strict", "true").lower() == "true", options.get("extension", "")
        self.most_files, self.most_bytes = int(options.get("partitionfiles", 1000)), int(options.get("partitionbytes", 128 << 20))
        self.tests: list[Test] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _TESTS and column in (*_HEAD, "path", "file_size"):
                self.tests.append(Test(column, type(f), f.value))
            elif not (type(f) is ds.IsNotNull and column in ("path", "file_size")):
                yield f

    def partitions(self) -> list[Files]:
        early = [t for t in self.tests if t.column in ("path", "file_size")]
        out, room_files, room_bytes = [], 0, 0
        for path, size in listing(self.root, self.extension):
            if not all(t({"path": path, "file_size": size}) for t in early):
                continue
            cost = size if self.read_kind in ("pixels", "lines") else 0
            for stream in range(4) if self.read_kind == "lines" else (None,):
                part = cost if stream is None else cost // 4
                if room_files < 1 or room_bytes < part:
                    out.append(Files([]))
                    room_files, room_bytes = self.most_files, self.most_bytes
                out[-1].files.append((path, size, stream))
                room_files, room_bytes = room_files - 1, room_bytes - part
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.root)
        late = [t for t in self.tests if t.column in _HEAD]
        schema = pa.schema(_fields(self.read_kind).items())
        rows, held = [], 0
        for path, size, stream in partition.files:
            if stream is not None:
                for batch in self._lines(fs, path, size, stream, late):
                    yield pa.RecordBatch.from_pylist(batch, schema=schema)
                continue
            row = self._row(fs, path, size, late)
            if row is not None:
                rows.append(row)
                held += 200 + len(row.get("rgba") or b"") + len(row.get("meta") or b"")
            if held > _BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def _row(self, fs: pyarrow.fs.FileSystem, path: str, size: int, late: list[Test]) -> dict | None:
        """The row of a file; None where a filter drops it. What is wrong with a file is its error, all else then null."""
        read = [0]

        def ranges(at: int, n: int) -> bytes:
            data = f.read_at(n, at)
            read[0] += len(data)
            return data

        try:
            with fs.open_input_file(path) as f:
                head = container.walk(ranges, size, self.strict, self.read_kind != "headers", lambda h: all(t(h) for t in late))
                if head is None:
                    return None
                if self.read_kind == "pixels":
                    head["rgba"] = container.pixels(head, ranges)
            return {**head, "path": path, "file_size": size, "bytes_read": read[0], "error": None}
        except (ValueError, OSError) as e:
            return None if late else {"path": path, "file_size": size, "bytes_read": read[0], "error": str(e)}


    def _lines(self, fs: pyarrow.fs.FileSystem, path: str, size: int, stream: int, late: list[Test]) -> Iterator[list[dict]]:
        """Batches of the residual lines of one stream, decompressed as they are needed; a bad file is one row of its
        first stream."""
        try:
            with fs.open_input_file(path) as f:
                head = container.walk(lambda at, n: f.read_at(n, at), size, self.strict, False, lambda h: all(t(h) for t in late))
                if head is None or stream >= len(head["streams"]):
                    return
                s, rows, held = head["streams"][stream], [], 0
                known = {**head, "path": path, "file_size": size, "channel": s["channel"], "predictor": s["predictor"]}
                for y, line in enumerate(container.lines(f, head, s)):
                    rows.append({**known, "y": y, "row": line})
                    held += 200 + 8 * len(line)
                    if held > _BATCH:
                        yield rows
                        rows, held = [], 0
                yield rows
        except (ValueError, OSError) as e:
            if stream == 0 and not late:
                yield [{"path": path, "file_size": size, "error": str(e)}]


@dataclass
class Staged(ds.WriterCommitMessage):
    """What a task attempt has written: name, staged path and bytes of each file."""

    files: list[tuple[str, str, int]]


def _checked(name: str | None) -> str:
    clean = posixpath.normpath(name or "")
    if not name or clean.startswith(("/", "..")) or any(p[:1] in "_." for p in clean.split("/")):
        raise ValueError(f"not a name below the folder: {name!r}")
    return clean


class TileWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        names = set(schema.fieldNames())
        if "name" not in names or not ("content" in names or {"width", "height", "rgba"} <= names):
            raise ValueError("tiles need name, and content or width, height and rgba")
        self.root, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.profile, self.predictor = options.get("profile", "balance"), options.get("predictor")
        recover(self.root)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        fs, top = opened(self.root)
        task = TaskContext.get()
        mine = f"{top}/{_STAGING}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        fs.create_dir(mine, recursive=True)
        out = []
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                name, body = _checked(row["name"]), row.get("content")
                if "content" not in row:
                    body = container.pack(row["rgba"], row["width"], row["height"], row.get("channels", 4), self.profile, row.get("meta"), self.predictor)
                staged = f"{mine}/{len(out)}"
                with fs.open_output_stream(staged) as f:
                    f.write(body or b"")
                out.append((name, staged, len(body or b"")))
        return Staged(out)

    def commit(self, messages: list[Staged | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        if len({n for n, _, _ in files}) != len(files):
            self.abort(messages)
            raise ValueError("several rows have one name; nothing was written")
        fs, top = opened(self.root)
        todo = {"job": self.job, "replace": self.overwrite, "files": [[n, s] for n, s, _ in files]}
        fs.create_dir(f"{top}/{_PENDING}", recursive=True)
        draft = f"{top}/{_STAGING}/{self.job}.json"
        fs.create_dir(f"{top}/{_STAGING}", recursive=True)
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps(todo).encode())
        fs.move(draft, f"{top}/{_PENDING}/{self.job}.json")
        _publish(fs, top, todo)

    def abort(self, messages: list[Staged | None]) -> None:
        fs, top = opened(self.root)
        _drop(fs, f"{top}/{_STAGING}/{self.job}")


def _drop(fs: pyarrow.fs.FileSystem, folder: str) -> None:
    if fs.get_file_info(folder).type == pyarrow.fs.FileType.Directory:
        fs.delete_dir(folder)


def _publish(fs: pyarrow.fs.FileSystem, top: str, todo: dict) -> None:
    """Carries out a list of files to publish; what an earlier try has moved already is passed over."""

    def move(file: list[str]) -> None:
        name, staged = file
        if fs.get_file_info(staged).type == pyarrow.fs.FileType.File:
            fs.create_dir(posixpath.dirname(f"{top}/{name}"), recursive=True)
            fs.move(staged, f"{top}/{name}")

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(move, todo["files"]))
        if todo["replace"]:
            keep = {f"{top}/{name}" for name, _ in todo["files"]}
            list(pool.map(fs.delete_file, [path for path, _ in listing(top) if path not in keep]))
    _drop(fs, f"{top}/{_STAGING}/{todo['job']}")
    fs.delete_file(f"{top}/{_PENDING}/{todo['job']}.json")


def recover(root: str) -> int:
    """Publishes what writes whose driver died had committed to; returns how many writes that were."""
    fs, top = opened(root)
    pending = fs.get_file_info(pyarrow.fs.FileSelector(f"{top}/{_PENDING}", allow_not_found=True))
    for f in sorted(pending, key=lambda f: f.mtime):
        with fs.open_input_stream(f.path) as s:
            _publish(fs, top, json.loads(s.read()))
    return len(pending)


class TileSource(ds.DataSource):
    """Options: path; read: headers, metadata, pixels, or lines (a row for each line of residuals of each stream); strict; extension; partitionFiles, partitionBytes; of writes
    profile and predictor."""

    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> str:
        fields = _fields(self.options.get("read", "headers"))
        return ", ".join(_STREAMS if n == "streams" else f"{n} {_SQL[t]}" for n, t in fields.items())

    def reader(self, schema: StructType) -> TileReader:
        return TileReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> TileWriter:
        return TileWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets it push filters to Python sources."""
    spark.dataSource.register(TileSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("tiles").options(**options).load(path)


def pixel_rows(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """image_id (the path), y, row of RGBA of the containers of a folder. Streams are read by tasks of their own, line by
    line, once into the shared folder, and predictors and transforms are undone on rows, so that no task holds an image.
    Bad files are left out."""
    kept = ["path", "channel", "predictor", "y", "row", "width", "channels", "alpha", "transform"]
    lines, where = read(spark, path, read="lines", **options).where("error is null").select(*kept), folder(spark, "lines")
    lines.write.parquet(where)
    lines = spark.read.schema(lines.schema).parquet(where)
    plane = lines.withColumn("image_id", F.struct("path", "channel"))
    rows = predict.restored_lines(plane.select("image_id", "predictor", "y", "row"))
    heads = lines.where("y = 0").select(F.struct("path", "channel").alias("image_id"), "width", "channels", "alpha", "transform")
    met = rows.join(heads, "image_id").select(F.col("image_id.path").alias("path"), F.col("image_id.channel").alias("channel"), "y", "row", "width", "channels", "alpha", "transform")
    return predict.assembled(met.withColumnRenamed("path", "image_id"))


def write(tiles: DataFrame, path: str, overwrite: bool = True, **options: str) -> None:
    """Writes name and content, or name, width, height, rgba and perhaps channels and meta, as one file a row."""
    register(tiles.sparkSession)
    tiles.write.format("tiles").mode("overwrite" if overwrite else "append").options(**options).save(path)
