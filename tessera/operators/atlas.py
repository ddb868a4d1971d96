"""Sheets of images: split over sheets, order by area or by matching edges, placement, pixels, metadata and mip sheets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import compose, edges, layout, mips, packing, resample
from tessera.sources import container, packfile, shared

#: The default and the greatest side of a sheet, and the padding around each image.
SIDE, MAX_SIDE, PAD = 16_384, 22_000, 2


@dataclass
class Item:
    """px: (h, w, 4); resource: what pack metadata says of it (resource, overlay, mcmeta), if it comes from a pack."""

    id: int
    px: np.ndarray
    resource: dict | None = None
    source: tuple[int, int] = field(default=(0, 0))

    def __post_init__(self):
        self.source = (self.px.shape[1], self.px.shape[0])

    @property
    def size(self) -> tuple[int, int]:
        return self.px.shape[1], self.px.shape[0]


def by_area(items: list[Item]) -> list[int]:
    return sorted(range(len(items)), key=lambda i: (-items[i].size[0] * items[i].size[1], -max(items[i].size)))


def edge_orders(items: list[Item]) -> list[list[int]]:
    """Places of the items so that right edges meet left ones, and so that bottom edges meet top ones."""
    found, area = [edges.signature(t.px) for t in items], [t.size[0] * t.size[1] for t in items]
    out = []
    for head, tail in (("left", "right"), ("top", "bottom")):
        sides = [np.array([s[k].ravel() for s in found], dtype=np.int64) for k in (head, tail)]
        out.append(resample.greedy(*sides, [edges.bucket(s[head]) for s in found], [edges.bucket(s[tail]) for s in found], area))
    return out


def drawn(items: list[Item], corners: list[tuple[int, int]], side: int, pad: int, lines: int = 256) -> Callable[[int, int], np.ndarray]:
    """What gives the rows of a sheet from one to another: each item with its edges and corners repeated pad times."""
    by: dict[int, list[int]] = {}
    for k, (t, (_, y)) in enumerate(zip(items, corners, strict=True)):
        for b in range(max(0, y - pad) // lines, (min(side, y + t.size[1] + pad) - 1) // lines + 1):
            by.setdefault(b, []).append(k)

    def rows(begin: int, stop: int) -> np.ndarray:
        sheet = np.zeros((stop - begin, side, 4), dtype=np.uint8)
        for k in sorted({k for b in range(begin // lines, (stop - 1) // lines + 1) for k in by.get(b, ())}):
            px, (w, h), (x, y) = items[k].px, items[k].size, corners[k]
            top, end, left, right = max(begin, y - pad), min(stop, y + h + pad), max(0, x - pad), min(side, x + w + pad)
            if top < end:
                sheet[top - begin : end - begin, left:right] = px[np.clip(np.arange(top, end) - y, 0, h - 1)][:, np.clip(np.arange(left, right) - x, 0, w - 1)]
        return sheet

    return rows


def draw(items: list[Item], corners: list[tuple[int, int]], side: int, pad: int) -> np.ndarray:
    return drawn(items, corners, side, pad)(0, side)


def metadata(items: list[Item], corners: list[tuple[int, int]], pad: int, pack: dict | None = None) -> bytes:
    """Rectangles in the order of placement; for a pack (kind, pack_mcmeta, sidecars) by overlay, none first, and resource."""
    for v in (pad, *(n for t, c in zip(items, corners, strict=True) for n in (*c, *t.size))):
        if not 0 <= v < 1 << 16:
            raise ValueError(f"{v} is no 16-bit number")
    rects = [(t.id, x, y, *t.size) for t, (x, y) in zip(items, corners, strict=True)]
    if pack is None:
        return packfile.rects_meta(pad, [(i, x << 48 | y << 32 | w << 16 | h) for i, x, y, w, h in rects])
    entries = [{"id": i, "resource": t.resource["resource"], "overlay": t.resource.get("overlay"), "x": x, "y": y, "w": w, "h": h, "source_width": t.source[0], "source_height": t.source[1], "mcmeta": t.resource.get("mcmeta")} for t, (i, x, y, w, h) in zip(items, rects, strict=True)]
    return packfile.pack_entries_meta(pad, entries, **pack)


@dataclass(frozen=True)
class Options:
    """limit: longest side of a sheet; channels 3 drops alpha; pack: kind, pack_mcmeta and sidecars, for pack metadata."""

    limit: int = SIDE
    pad: int = PAD
    channels: int = 4
    profile: str = "balance"
    mips: mips.MipSpec | None = None
    pack: dict | None = None

    def __post_init__(self):
        if not 0 < self.limit <= MAX_SIDE or self.pad < 0:
            raise ValueError(f"a sheet's side is from 1 to {MAX_SIDE}, its padding from 0")
        if self.channels not in (3, 4) or self.profile not in container.LEVELS:
            raise ValueError("channels are 3 or 4, the profile one of " + ", ".join(container.LEVELS))
        if self.pack is not None and (self.channels == 3 or self.mips):
            raise ValueError("a pack keeps alpha and has no mip levels")


def _sheet(items: list[Item], order: list[int], side: int, pad: int, o: Options) -> tuple[bytes, list[tuple[int, int]]] | None:
    """The encoded sheet of the items in an order and their corners; None if one doesn't fit."""
    own = [items[i] for i in order]
    corners = layout.shelve([t.size for t in own], side, pad)
    if None in corners:
        return None
    return container.pack_rows(drawn(own, corners, side, pad), side, side, o.channels, o.profile, metadata(own, corners, pad, o.pack)), corners


def _mip_sheets(items: list[Item], side0: int, o: Options) -> Iterator[dict]:
    """The sheets below the first: all images at their next size, in area order."""
    spec = o.mips
    if not spec.heights and spec.levels is not None and (n := max(max(t.size) for t in items).bit_length() - 1) < spec.levels:
        raise ValueError(f"the sheet has {n} levels, not {spec.levels}")
    sides, last, level = spec.checked_heights(side0), side0, 1
    now = [Item(t.id, t.px) for t in items]
    while level <= len(sides) if sides else any(max(t.size) > 1 for t in now) and (spec.levels is None or level <= spec.levels):
        target, used = sides[level - 1] if sides else None, 0
        for t in now:
            w, h = t.size
            if (w, h) != (1, 1):
                size = (mips.scaled(w, last, target), mips.scaled(h, last, target)) if target else (max(1, w // 2), max(1, h // 2))
                used += resample.taps(w, h, *size)
                t.px = resample.resize_pixels(t.px, *size, resample.whole_radius(w, h))
        order, pad = by_area(now), o.pad * target // side0 if target else o.pad
        side = target or layout.search_side([now[i].size for i in order], o.limit, pad)
        made = _sheet(now, order, side, pad, o)
        if made is None:
            raise ValueError(f"level {level} does not fit a side of {side}")
        yield {"level": level, "side": side, "order": "area", "items": len(now), "content": made[0], "taps": used}
        last, level = side, level + 1


def build(items: list[Item], o: Options = Options()) -> Iterator[dict]:  # noqa: B008
    """sheet, level, side, order, items, content and taps of every sheet; items are in order of id.

    A sheet takes what fits at the limit in area order. Of the orders by area and by edges that fit the side which area
    order needs, the one whose file is smallest stays; the earlier of equals. ValueError if an image fits no sheet.
    """
    rest, n = items, 0
    while rest:
        order = by_area(rest)
        corners = layout.shelve([rest[i].size for i in order], o.limit, o.pad)
        taken = {i for i, c in zip(order, corners, strict=True) if c is not None}
        if not taken:
            raise ValueError(f"no image fits a side of {o.limit}")
        here, rest = [t for i, t in enumerate(rest) if i in taken], [t for i, t in enumerate(rest) if i not in taken]
        orders = dict(zip(("area", "left to right", "top to bottom"), [by_area(here), *edge_orders(here)], strict=True))
        side = layout.search_side([here[i].size for i in orders["area"]], o.limit, o.pad)
        best, tried = None, []
        for name, order in orders.items():
            if order not in tried:
                tried.append(order)
                made = _sheet(here, order, side, o.pad, o)
                if made and (best is None or len(made[0]) < len(best["content"])):
                    best = {"level": 0, "side": side, "order": name, "items": len(here), "content": made[0], "taps": 0}
        if best is None:
            raise ValueError("no order fits the sheet")
        for row in [best, *(_mip_sheets(here, side, o) if o.mips else ())]:
            yield {"sheet": n, **row}
        n += 1


_SHEETS = "grp string, sheet long, level long, side long, order string, items long, content binary, taps long, error string"


def sheets(images: DataFrame, o: Options = Options()) -> DataFrame:  # noqa: B008
    """The sheets of each group of images (grp, id, width, height, rgba; for packs also resource, overlay, mcmeta).

    A group's images are packed in one task, in order of id, and so must fit there; their sheets are drawn and encoded in
    strips, so a sheet's side does not matter. Groups are independent. An image
    without pixels is left out. A group that can't be packed is one row with its error.
    """
    fields = [f for f in ("resource", "overlay", "mcmeta") if f in images.columns]
    schema = pa.schema([("grp", pa.string()), ("sheet", pa.int64()), ("level", pa.int64()), ("side", pa.int64()), ("order", pa.string()), ("items", pa.int64()), ("content", pa.binary()), ("taps", pa.int64()), ("error", pa.string())])

    def run(group: pa.Table) -> pa.Table:
        rows = sorted((r for r in group.to_pylist() if r["rgba"] is not None), key=lambda r: r["id"])
        items = [Item(r["id"], np.frombuffer(r["rgba"], dtype=np.uint8).reshape(r["height"], r["width"], 4), {f: r[f] for f in fields} if o.pack is not None else None) for r in rows]
        grp = group.column("grp")[0].as_py()
        try:
            made = [{"grp": grp, **s} for s in build(items, o)]
        except ValueError as e:
            made = [{"grp": grp, "error": str(e)}]
        return pa.Table.from_pylist(made, schema=schema)

    own = images.select(F.col("grp").cast("string").alias("grp"), F.col("id").cast("long").alias("id"), "width", "height", "rgba", *fields)
    return own.groupBy("grp").applyInArrow(run, _SHEETS)


def cut_out(files: DataFrame) -> DataFrame:
    """image_id, id, width, height, rgba, error: what sheets (image_id, content) hold at the rectangles of their metadata.

    One sheet at a time, decoded in strips: of its pixels, only a strip and the begun rectangles are in memory. A bad
    file is one row with its error, perhaps after rectangles that were whole before it.
    """
    types = pa.schema([("image_id", pa.int64()), ("id", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("rgba", pa.binary()), ("error", pa.string())])

    def found(data: bytes) -> Iterator[dict]:
        head = container.parse(data)
        todo, begun = sorted(packfile.read_meta(head["meta"]), key=lambda r: -r["y"]), []
        for y, px in container.strips(head, data):
            while todo and todo[-1]["y"] < y + len(px):
                begun.append((todo.pop(), []))
            for r, parts in begun:
                parts.append(px[max(0, r["y"] - y) : r["y"] + r["h"] - y, r["x"] : r["x"] + r["w"]].tobytes())
                if r["y"] + r["h"] <= y + len(px):
                    yield {"id": r["id"], "width": r["w"], "height": r["h"], "rgba": b"".join(parts)}
            begun = [(r, parts) for r, parts in begun if r["y"] + r["h"] > y + len(px)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    for row in found(data.as_py() or b""):
                        yield pa.RecordBatch.from_pylist([{"image_id": i, **row}], schema=types)
                except ValueError as e:
                    yield pa.RecordBatch.from_pylist([{"image_id": i, "error": str(e)}], schema=types)

    return files.selectExpr("cast(image_id as bigint) image_id", "content").mapInArrow(run, "image_id long, id long, width long, height long, rgba binary, error string")


def seeds(items: DataFrame) -> DataFrame:
    """grp, id, area: of each group's items (grp, id, w, h) the largest, of equals the last."""
    best = items.groupBy("grp").agg(F.max(F.struct((F.col("w") * F.col("h")).alias("area"), "id")).alias("best"))
    return best.select("grp", "best.id", "best.area")


def area_sheets(rows: DataFrame, limit: int = SIDE, pad: int = PAD, channels: int = 4, longer: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sheets of any size, in area order: their rows (sheet, y, row), and where the images are: sheet, id, x, y, w, h.

    rows are those of the images, (grp, id, y, row); a sheet is named by its group and number. Only rectangles pass through
    one task a group, pixels go from the rows of images to the rows of sheets. sheets() also tries orders by edges and
    encodes whole sheets, each in one task.

    An image that is longer than the limit is an error, or, if longer is true, makes the sheets of its group as wide or as
    high as it needs: in that direction alone, and they end where their last image does, so they grow with the images.
    """
    sizes = rows.groupBy("grp", "id").agg(F.first(F.floor(F.size("row") / channels)).alias("w"), F.count("*").alias("h"))
    where = shared.folder(rows.sparkSession, "sheets")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{where}/{name}")
        return rows.sparkSession.read.schema(df.schema).parquet(f"{where}/{name}")

    beyond = None
    if longer:
        sizes = kept(sizes, "sizes")
        need = lambda c: F.greatest(F.lit(limit), F.max(c) + 2 * pad).alias(c)
        over = sizes.groupBy(F.col("grp").alias("_over")).agg(need("w"), need("h")).where((F.col("w") > limit) | (F.col("h") > limit))
        own = F.col("grp").eqNullSafe(F.col("_over"))
        beyond = kept(packing.split_at(sizes.join(over.select("_over"), own, "left_semi"), over.select(F.col("_over").alias("grp"), F.col("w").alias("width"), F.col("h").alias("height")), pad), "beyond")
        sizes = sizes.join(over.select("_over"), own, "left_anti")
    parts = kept(packing.split(sizes, limit, pad).select(F.struct("grp", "sheet").alias("grp"), "id", "w", "h"), "parts")
    sides = packing.least_side(parts, limit, pad)
    placed = packing.pack_at(parts, sides, pad).select(F.col("grp").alias("sheet"), F.struct(F.col("grp.grp").alias("grp"), "id").alias("id"), "x", "y", "w", "h")
    found = sides.select(F.col("grp").alias("sheet"), F.col("side").alias("width"), F.col("side").alias("height"))
    if beyond is not None:
        more = beyond.select(F.struct("grp", "sheet").alias("sheet"), F.struct("grp", "id").alias("id"), "x", "y", "w", "h")
        placed = placed.unionByName(more)
        found = found.unionByName(more.groupBy("sheet").agg((F.max(F.col("x") + F.col("w")) + pad).alias("width"), (F.max(F.col("y") + F.col("h")) + pad).alias("height")))
    keyed = rows.select(F.struct("grp", F.col("id").cast("long").alias("id")).alias("id"), "y", "row")
    return compose.sheets(keyed, placed, found, pad, channels), placed


def sheet_names(found: DataFrame, base: Column, ext: str) -> DataFrame:
    """found with path: the base alone if a group has one sheet, else numbered; levels below the first are named too."""
    many = F.max("sheet").over(Window.partitionBy("grp")) > 0
    named = found.withColumn("path", F.when(many, names.numbered(base, "_", F.col("sheet"), ext)).otherwise(base))
    return named.withColumn("path", F.when(F.col("level") > 0, names.numbered(F.col("path"), "_mip", F.col("level"), ext)).otherwise(F.col("path")))
