"""TIFF structure: headers, directories, values of entries, and the JPEG images that raw files embed."""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of each field type; fixed values.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, HEIGHT, COMPRESSION, STRIPS, ORIENTATION, STRIP_BYTES, SUB_DIRECTORIES = 0x100, 0x101, 0x103, 0x111, 0x112, 0x117, 0x14A
#: Compressions that are JPEG.
JPEG = (6, 7)


def _take(data: bytes, form: str, at: int) -> tuple:
    if at < 0 or at + struct.calcsize(form) > len(data):
        raise ValueError("TIFF is cut")
    return struct.unpack_from(form, data, at)


def header(data: bytes) -> tuple[str, int]:
    """Byte order, as struct names it, and the place of the first directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or _take(data, order + "H", 2)[0] != 42:
        raise ValueError("not a TIFF")
    return order, _take(data, order + "I", 4)[0]


class Directory:
    """The entries of one directory by tag (type, count, place of the value), and the place of the next one, or 0."""

    def __init__(self, data: bytes, order: str, at: int):
        self.data, self.order = data, order
        n = _take(data, order + "H", at)[0]
        self.entries: dict[int, tuple[int, int, int]] = {}
        end = at + 2 + 12 * n
        if end > len(data):
            raise ValueError("TIFF is cut")
        for k, (tag, kind, count) in enumerate(struct.iter_unpack(order + "HHI4x", data[at + 2 : end])):
            # Of entries that repeat a tag the first counts.
            self.entries.setdefault(tag, (kind, count, at + 12 * k + 10))
        self.next = struct.unpack_from(order + "I", data, end)[0] if end + 4 <= len(data) else 0

    def numbers(self, tag: int) -> list[int] | None:
        """Values of 16 or 32 bits; None for other types and where there is no such tag."""
        if tag not in self.entries:
            return None
        kind, count, at = self.entries[tag]
        if kind not in SIZES:
            raise ValueError(f"TIFF type {kind}")
        size = SIZES[kind] * count
        if size > 4:
            at = _take(self.data, self.order + "I", at)[0]
        if at + size > len(self.data):
            raise ValueError("TIFF value is outside the file")
        form = {3: "H", 4: "I"}.get(kind)
        return list(struct.unpack_from(f"{self.order}{count}{form}", self.data, at)) if form else None

    def number(self, tag: int) -> int | None:
        return (self.numbers(tag) or [None])[0]


def directories(data: bytes) -> Iterator[tuple[int, Directory]]:
    """Every directory once, breadth first: the first, its sub-directories, the next, and so on."""
    order, first = header(data)
    todo, seen = deque([first]), set()
    while todo:
        at = todo.popleft()
        if at and at not in seen:
            seen.add(at)
            d = Directory(data, order, at)
            todo.extend([*(d.numbers(SUB_DIRECTORIES) or []), d.next])
            yield at, d


def _short(d: Directory, tag: int) -> int | None:
    try:
        v = d.number(tag)
    except ValueError:
        return None
    return v if v is not None and v < 1 << 16 else None


def embedded_jpeg(data: bytes) -> tuple[int, int, int, int]:
    """offset, bytes, pixels and orientation of the embedded JPEG with most pixels, the first of equals."""
    best, main = None, 1
    for k, (_, d) in enumerate(directories(data)):
        turn = _short(d, ORIENTATION)
        turn = max(1, main if turn is None else turn)
        main = turn if k == 0 else main
        kind = _short(d, COMPRESSION)
        w, h, at, size = d.number(WIDTH), d.number(HEIGHT), d.numbers(STRIPS), d.numbers(STRIP_BYTES)
        if None in (w, h, at, size) or kind not in JPEG:
            continue
        for a, n in zip(at, size, strict=False):
            if a + n <= len(data) and data[a : a + min(n, 2)] == b"\xff\xd8" and (best is None or w * h > best[2]):
                best = (a, n, w * h, turn)
    if best is None:
        raise ValueError("no embedded JPEG")
    return best


#: Bytes of what one batch of entries holds, about.
_BATCH = 4 << 20


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.types, strict=True)], schema=types)


_ENTRIES = "path string, directory long, tag int, type int, count long, numbers array<long>, error string"


def entries(files: DataFrame) -> DataFrame:
    """One row per entry of every directory of the files (path, content); a file that is broken has one row with its error."""
    types = pa.schema([("path", pa.string()), ("directory", pa.int64()), ("tag", pa.int32()), ("type", pa.int32()), ("count", pa.int64()), ("numbers", pa.list_(pa.int64())), ("error", pa.string())])

    def one(path: str, data: bytes | None) -> list[tuple]:
        try:
            return [(path, at, t, e[0], e[1], d.numbers(t), None) for at, d in directories(data or b"") for t, e in d.entries.items()]
        except ValueError as e:
            return [(path, None, None, None, None, None, str(e))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = one(path, data.as_py())
                rows += found
                held += sum(100 + 8 * len(r[5] or ()) for r in found)
                if held > _BATCH:
                    yield _batch(rows, types)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, types)

    return files.select("path", "content").mapInArrow(run, _ENTRIES)


def embedded(files: DataFrame) -> DataFrame:
    """path, content (the JPEG's bytes), pixels, orientation, error of the files' (path, content) largest embedded JPEG."""
    types = pa.schema([("path", pa.string()), ("content", pa.binary()), ("pixels", pa.int64()), ("orientation", pa.int32()), ("error", pa.string())])

    def one(path: str, data: bytes | None) -> dict:
        try:
            at, n, pixels, turn = embedded_jpeg(data or b"")
            return {"path": path, "content": data[at : at + n], "pixels": pixels, "orientation": turn}
        except ValueError as e:
            return {"path": path, "error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(p, d.as_py()) for p, d in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)], schema=types)

    return files.select("path", "content").mapInArrow(run, "path string, content binary, pixels long, orientation int, error string")


def magic(content: Column) -> Column:
    """png, jpeg, gif, bmp or tiff by the first bytes; null for others."""
    head = F.hex(F.substring(content, 1, 4))
    known = {"89504E47": "png", "FFD8FF": "jpeg", "47494638": "gif", "424D": "bmp", "49492A00": "tiff", "4D4D002A": "tiff"}
    out = F.lit(None).cast("string")
    for k, v in reversed(known.items()):
        out = F.when(head.startswith(k), v).otherwise(out)
    return out
