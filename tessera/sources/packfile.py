"""Pack files: one file of a header, an icon and several sheets; and the rectangle metadata that sheets carry.

Layout: magic (8 bytes), version (u16), header length (u64), header (MessagePack map), icon, sheets; little endian.
Offsets in the header count from the start of the file. Magic and kinds are parameters, so that files of other programs
with this layout can be read and written under their own names.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources import msgpack

_FRONT = struct.Struct("<8sHQ")
ATLAS = "struct<index:long,offset:long,len:long,width:long,height:long,entries:long>"


@dataclass(frozen=True)
class Format:
    magic: bytes = b"TESSPACK"
    kind: str = "tessera.pack"
    version: int = 1


def build(pack: dict, form: Format = Format()) -> bytes:  # noqa: B008
    """pack: name, description, pack_mcmeta, icon, icon_format, sidecars and atlases (index, width, height, entries, content)."""
    atlases, icon = sorted(pack.get("atlases") or [], key=lambda a: a["index"]), pack.get("icon")
    start = 0
    while True:
        # Offsets take more bytes as they grow, so the header's length is a fixed point; it only grows, and is bounded.
        at = start + len(icon) if icon is not None else start
        head = {"kind": form.kind, "version": form.version, "name": pack.get("name") or "", "description": pack.get("description") or "", "pack_mcmeta": pack.get("pack_mcmeta"), "sidecars": pack.get("sidecars") or [], "blob_section_offset": start}
        head["icon"] = None if icon is None else {"offset": start, "len": len(icon), "format": pack.get("icon_format") or "raw"}
        head["atlases"] = []
        for a in atlases:
            head["atlases"].append({"index": a["index"], "offset": at, "len": len(a["content"]), "width": a["width"], "height": a["height"], "entries": a["entries"]})
            at += len(a["content"])
        raw = msgpack.dumps(head)
        if start == _FRONT.size + len(raw):
            break
        start = _FRONT.size + len(raw)
    return b"".join([_FRONT.pack(form.magic, form.version, len(raw)), raw, icon or b"", *(a["content"] for a in atlases)])


def header_of(read: Callable[[int, int], bytes], size: int, form: Format = Format()) -> dict:  # noqa: B008
    """The checked header of a file of so many bytes, of which nothing else is read; ValueError says what is wrong."""
    front = read(0, _FRONT.size)
    if len(front) < _FRONT.size or front[: len(form.magic)] != form.magic:
        raise ValueError("not a pack")
    _, version, n = _FRONT.unpack(front)
    if version != form.version:
        raise ValueError(f"pack version {version}")
    if _FRONT.size + n > size:
        raise ValueError("pack header is cut")
    head = msgpack.loads(bytes(read(_FRONT.size, n)))
    if not isinstance(head, dict) or head.get("kind") != form.kind or head.get("version") != form.version:
        raise ValueError("pack header of another kind")
    if head.get("blob_section_offset") != _FRONT.size + n:
        raise ValueError("blobs do not follow the header")
    for blob in [*([head["icon"]] if head.get("icon") else []), *(head.get("atlases") or [])]:
        if blob["offset"] < _FRONT.size + n or blob["len"] < 0 or blob["offset"] + blob["len"] > size:
            raise ValueError("blob outside the pack")
    return head


def header(data: bytes | None, form: Format = Format()) -> dict:  # noqa: B008
    """header_of() a file that is there as a whole."""
    return header_of(lambda at, n: (data or b"")[at : at + n], len(data or b""), form)


def write(packs: DataFrame, form: Format = Format()) -> DataFrame:  # noqa: B008
    """pack_id, content: one pack file per row of pack_id, name, description, pack_mcmeta, icon, icon_format, atlases.

    atlases: array of (index, width, height, entries, content); null is none. Other columns are ignored. A pack is
    built in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.record_batch([pa.array([r["pack_id"] for r in rows], pa.int64()), pa.array([build(r, form) for r in rows], pa.binary())], names=["pack_id", "content"])

    cols = [F.col("pack_id").cast("long"), "name", "description", "pack_mcmeta", "icon", "icon_format", "atlases"]
    return packs.select(*cols).mapInArrow(run, "pack_id long, content binary")


def inspect(files: DataFrame, form: Format = Format()) -> DataFrame:  # noqa: B008
    """One row per file of pack_id, content: pack_id, name, description, pack_mcmeta, icon, atlases, error.

    icon and atlases are positions in the file. A null or broken file has its error and nulls.
    """
    schema = f"pack_id long, name string, description string, pack_mcmeta string, icon struct<offset:long,len:long,format:string>, atlases array<{ATLAS}>, error string"
    place = pa.struct([("offset", pa.int64()), ("len", pa.int64()), ("format", pa.string())])
    atlas = pa.struct([(n, pa.int64()) for n in ("index", "offset", "len", "width", "height", "entries")])
    types = pa.schema([("pack_id", pa.int64()), ("name", pa.string()), ("description", pa.string()), ("pack_mcmeta", pa.string()), ("icon", place), ("atlases", pa.list_(atlas)), ("error", pa.string())])

    def one(pack_id, content) -> dict:
        try:
            head = header(content, form)
            return {"pack_id": pack_id, **{k: head.get(k) for k in ("name", "description", "pack_mcmeta", "icon", "atlases")}}
        except (ValueError, KeyError, TypeError) as e:
            return {"pack_id": pack_id, "error": str(e) or "not a pack"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(r["pack_id"], r["content"]) for r in batch.to_pylist()], schema=types)

    return files.select(F.col("pack_id").cast("long").alias("pack_id"), "content").mapInArrow(run, schema)


def sheets(files: DataFrame, form: Format = Format()) -> DataFrame:  # noqa: B008
    """pack_id, index, width, height, entries, content of every sheet of the files that are sound. No shuffle."""
    names = ("index", "width", "height", "entries")
    types = pa.schema([("pack_id", pa.int64()), *((n, pa.int64()) for n in names), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack_id, content in zip(*batch.to_pydict().values(), strict=True):
                try:
                    found = header(content, form).get("atlases") or []
                    rows = [{"pack_id": pack_id, **{n: a[n] for n in names}, "content": content[a["offset"] : a["offset"] + a["len"]]} for a in found]
                except (ValueError, KeyError, TypeError):
                    continue
                yield pa.RecordBatch.from_pylist(rows, schema=types)

    return files.select(F.col("pack_id").cast("long").alias("pack_id"), "content").mapInArrow(run, "pack_id long, index long, width long, height long, entries long, content binary")


def rects_meta(pad: int, rects: list[tuple[int, int]]) -> bytes:
    """Positional metadata: padding, then (id, packed rectangle) of every entry."""
    return msgpack.dumps([pad, [list(r) for r in rects]])


def levels_meta(kind: str, pad: int, levels: list[tuple[int, int, int, int, int]]) -> bytes:
    return msgpack.dumps({"kind": kind, "version": 1, "pad": pad, "levels": [dict(zip(("level", "x", "y", "w", "h"), v, strict=True)) for v in levels]})


def pack_entries_meta(pad: int, entries: list[dict], kind: str = "tessera.entries", pack_mcmeta: str | None = None, sidecars: list[dict] | None = None) -> bytes:
    """Named metadata of a pack's sheet: entries (id, resource, overlay, x, y, w, h, source_width, source_height, mcmeta)
    and sidecars (resource, overlay, mcmeta) by overlay, none first, and resource."""
    order = lambda e: (e["overlay"] is not None, e["overlay"] or "", e["resource"])
    fields = ("id", "resource", "overlay", "x", "y", "w", "h", "source_width", "source_height", "mcmeta")
    side = [{k: s.get(k) for k in ("resource", "overlay", "mcmeta")} for s in sorted(sidecars or [], key=order)]
    return msgpack.dumps({"kind": kind, "version": 2, "pad": pad, "pack_mcmeta": pack_mcmeta, "sidecars": side, "entries": [{k: e.get(k) for k in fields} for e in sorted(entries, key=order)]})


def parse_meta(raw: bytes | None) -> tuple[str, dict] | None:
    """("pack", ...), ("atlas", ...) or ("mipchain", ...) with plain fields, tried in this order; None for anything else."""
    try:
        got = msgpack.loads(raw) if raw else None
        if isinstance(got, dict) and isinstance(got.get("kind"), str):
            if got.get("version") == 2 and "entries" in got:
                return "pack", {**got, "sidecars": got.get("sidecars") or []}
            if got.get("version") == 1 and got.get("levels"):
                return "mipchain", got
        if isinstance(got, list) and len(got) == 2 and isinstance(got[0], int):
            entries = [{"id": i, "x": p >> 48, "y": p >> 32 & 65535, "w": p >> 16 & 65535, "h": p & 65535} for i, p in got[1]]
            return "atlas", {"pad": got[0], "entries": entries}
    except (ValueError, KeyError, TypeError):
        pass
    return None


def read_meta(raw: bytes | None) -> list[dict]:
    """Rectangles (id or level as id, resource, overlay, x, y, w, h) of metadata; none if it isn't recognised."""
    found = parse_meta(raw)
    if found is None:
        return []
    try:
        return [{"id": e["id"] if "id" in e else e["level"], "resource": e.get("resource"), "overlay": e.get("overlay"), **{k: e[k] for k in "xywh"}} for e in found[1].get("entries", found[1].get("levels"))]
    except (KeyError, TypeError, AttributeError):
        return []


def meta_json(raw: Column) -> Column:
    """struct (kind, json): what kind of metadata it is, and its fields as JSON; null if it isn't recognised."""

    @F.arrow_udf("struct<kind:string,json:string>")
    def dump(column: pa.Array) -> pa.Array:
        found = [parse_meta(v) for v in column.to_pylist()]
        rows = [None if f is None else {"kind": f[0], "json": json.dumps(f[1], separators=(",", ":"), ensure_ascii=False)} for f in found]
        return pa.array(rows, pa.struct([("kind", pa.string()), ("json", pa.string())]))

    return dump(raw)


def rects(files: DataFrame, meta: Column) -> DataFrame:
    """The columns of files but for meta, and id, resource, overlay, x, y, w, h of every rectangle of its metadata."""

    @F.pandas_udf("array<struct<id:long,resource:string,overlay:string,x:long,y:long,w:long,h:long>>")
    def entries(raw):
        return raw.map(read_meta)

    return files.withColumn("_rect", F.explode(entries(meta))).select(*files.columns, "_rect.*")
