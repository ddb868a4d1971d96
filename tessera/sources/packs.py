"""Pack files as a data source: spark.read.format("packs"), a row for each sheet, one pack over as many tasks as it needs.

Planning reads the header of each file and nothing else. A partition is a list of sheets of about so many bytes, of which a
task reads just their ranges. Filters on a sheet's fields and on the path are applied while planning, so that sheets they
drop cost nothing. A file that is no pack is one row with its error.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from tessera.sources import packfile, tiles
from tessera.sources.shared import opened

_SHEET = ("index", "width", "height", "entries", "offset", "len")
_TYPES = {"path": pa.string(), "name": pa.string(), **{c: pa.int64() for c in _SHEET}, "content": pa.binary(), "error": pa.string()}
_SQL = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary"}


@dataclass
class Sheets(ds.InputPartition):
    rows: list[dict]


class PackReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.root, self.most_bytes = options["path"], int(options.get("partitionbytes", 128 << 20))
        magic, form = options.get("magic"), packfile.Format()
        self.form = packfile.Format(magic.encode() if magic else form.magic, options.get("kind", form.kind), int(options.get("version", form.version)))
        self.tests: list[tiles.Test] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in tiles._TESTS and column in ("path", "name", *_SHEET):
                self.tests.append(tiles.Test(column, type(f), f.value))
            else:
                yield f

    def _plan(self, file: tuple[str, int]) -> list[dict]:
        path, size = file
        fs, _ = opened(self.root)
        try:
            with fs.open_input_file(path) as f:
                head = packfile.header_of(lambda at, n: f.read_at(n, at), size, self.form)
            sheets = [{"path": path, "name": head.get("name"), **{c: a[c] for c in _SHEET}} for a in head.get("atlases") or []]
            return [s for s in sheets if all(s[t.column] is not None and t(s) for t in self.tests)]
        except (ValueError, KeyError, TypeError, OSError) as e:
            return [] if self.tests else [{"path": path, "error": str(e) or "not a pack"}]

    def partitions(self) -> list[Sheets]:
        with ThreadPoolExecutor(16) as pool:
            found = [s for of in pool.map(self._plan, tiles.listing(self.root)) for s in of]
        out, room = [], 0
        for s in found:
            if room <= 0:
                out.append(Sheets([]))
                room = self.most_bytes
            out[-1].rows.append(s)
            room -= s.get("len", 0) + 1
        return out or [Sheets([])]

    def read(self, partition: Sheets) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.root)
        for row in partition.rows:
            if "len" in row:
                with fs.open_input_file(row["path"]) as f:
                    row = row | {"content": f.read_at(row["len"], row["offset"])}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema(_TYPES.items()))


class PackSource(ds.DataSource):
    """Options: path; magic, kind and version of the format; partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "packs"

    def schema(self) -> str:
        return ", ".join(f"`{n}` {_SQL[t]}" for n, t in _TYPES.items())

    def reader(self, schema: StructType) -> PackReader:
        return PackReader(dict(self.options))


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """path, name, index, width, height, entries, offset, len, content, error of the sheets of all packs below a folder."""
    spark.dataSource.register(PackSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("packs").options(**options).load(path)
