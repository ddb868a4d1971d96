"""Shelf packing of groups of any size: rectangles pass by in area order, and only the open shelves are in memory.

What a rectangle gets depends on all before it, so a group is one pass of one task, but never a row, a list or a window.
Searches for a side try the next 31 sides that a binary search could come to in one pass, five of its steps at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources import shared

#: Steps of a search that one pass decides.
STEPS = 5


class Shelves:
    """Shelves of one sheet, or of several sheets of different sides at once, given as an array.

    A rectangle wider or higher than the sheet changes nothing; one that opens a new shelf keeps it open even if it then
    doesn't fit.
    """

    def __init__(self, side, pad: int):
        self.side, self.pad = np.asarray(side, dtype=np.int64), pad
        self.x, self.y, self.shelf = (np.zeros_like(self.side) for _ in range(3))

    def place(self, w: int, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inner corner and whether it fits, for each side."""
        w, h = w + 2 * self.pad, h + 2 * self.pad
        may = max(w, h) <= self.side
        turn = may & (self.x + w > self.side)
        self.y = np.where(turn, self.y + self.shelf, self.y)
        self.x, self.shelf = np.where(turn, 0, self.x), np.where(turn, 0, self.shelf)
        fits = may & (self.y + h <= self.side)
        at = self.x + self.pad, self.y + self.pad, fits
        self.x, self.shelf = np.where(fits, self.x + w, self.x), np.where(fits, np.maximum(self.shelf, h), self.shelf)
        return at


class Sheet:
    """Shelves of one sheet, in plain numbers; as high as it is wide unless its height is given."""

    def __init__(self, side: int, pad: int, height: int | None = None):
        self.side, self.height, self.pad, self.x, self.y, self.shelf = side, side if height is None else height, pad, 0, 0, 0

    def place(self, w: int, h: int) -> tuple[int, int] | None:
        w, h = w + 2 * self.pad, h + 2 * self.pad
        if w > self.side or h > self.height:
            return None
        if self.x + w > self.side:
            self.x, self.y, self.shelf = 0, self.y + self.shelf, 0
        if self.y + h > self.height:
            return None
        at = self.x + self.pad, self.y + self.pad
        self.x, self.shelf = self.x + w, max(self.shelf, h)
        return at


class Sheets:
    """Sheets of one size that are filled in turn; each is open for good.

    A rectangle does nothing to a sheet where it neither needs a new shelf nor is low enough for what is left. The sheets
    that it may change are found in a tree over the least width left on the shelf and the most height left, so the others
    are not looked at. A sheet that it changes without room for it has its shelf closed, once for each shelf.
    """

    def __init__(self, side: int, pad: int, height: int | None = None):
        self.side, self.most, self.pad, self.size = side, side if height is None else height, pad, 1
        self.sheets: list[Sheet] = []
        self._grow()

    def _grow(self) -> None:
        """Twice the leaves; a leaf without a sheet is like an empty one."""
        self.size *= 2
        self.width, self.height = [self.side] * (2 * self.size), [self.most] * (2 * self.size)
        for k in range(len(self.sheets)):
            self._leaf(k)
        for k in range(self.size - 1, 0, -1):
            self._node(k)

    def _leaf(self, k: int) -> None:
        s = self.sheets[k]
        self.width[self.size + k], self.height[self.size + k] = self.side - s.x, self.most - s.y

    def _node(self, k: int) -> None:
        self.width[k], self.height[k] = min(self.width[2 * k], self.width[2 * k + 1]), max(self.height[2 * k], self.height[2 * k + 1])

    def _next(self, at: int, w: int, h: int) -> int:
        """The first leaf from at on with less width left than w or as much height as h; as many as there are if none."""
        k = at + self.size
        if at >= self.size:
            return self.size
        while not (self.width[k] < w or self.height[k] >= h):
            while k & 1:
                k >>= 1
            if k == 0:
                return self.size
            k += 1
        while k < self.size:
            k *= 2
            if not (self.width[k] < w or self.height[k] >= h):
                k += 1
        return k - self.size

    def place(self, w: int, h: int) -> tuple[int, int, int] | None:
        """Number of the sheet and inner corner; None if it fits no sheet."""
        if w + 2 * self.pad > self.side or h + 2 * self.pad > self.most:
            return None
        k = -1
        while True:
            k = self._next(k + 1, w + 2 * self.pad, h + 2 * self.pad)
            if k == self.size:
                self._grow()
            if k == len(self.sheets):
                self.sheets.append(Sheet(self.side, self.pad, self.most))
            at = self.sheets[k].place(w, h)
            self._leaf(k)
            node = (self.size + k) >> 1
            while node:
                self._node(node)
                node >>= 1
            if at is not None:
                return k, *at


def in_area_order(rects: DataFrame, *more: str) -> DataFrame:
    """grp, id, w, h and more, each group in one partition, by area, longer side (both falling) and id."""
    some = rects.select("grp", F.col("id").cast("long").alias("id"), F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h"), *more)
    return some.repartition("grp").sortWithinPartitions("grp", -(F.col("w") * F.col("h")), -F.greatest("w", "h"), "id")


def streamed(ordered: DataFrame, begin: Callable, step: Callable, end: Callable | None, schema: str) -> DataFrame:
    """Rows that a state makes of the rows of each group, which come one after the other, the group first.

    begin(row) is the state of a group, step(state, row) gives rows of it, end(state) the last ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, state, types = object(), None, None
        for batch in batches:
            types = types or batch.schema.field(0).type
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != who:
                    if end is not None and state is not None:
                        out.extend((who, *r) for r in end(state))
                    who, state = row[0], begin(row)
                out.extend((who, *r) for r in step(state, row))
            yield _batch(out, types)
        if end is not None and state is not None:
            yield _batch([(who, *r) for r in end(state)], types)

    kinds = {"long": pa.int64(), "boolean": pa.bool_()}
    columns = [c.split(" ") for c in schema.split(", ")]

    def _batch(rows: list, group: pa.DataType) -> pa.RecordBatch:
        data = list(zip(*rows, strict=True)) if rows else [()] * (len(columns) + 1)
        return pa.record_batch([pa.array(data[0], group), *(pa.array(c, kinds[k]) for c, (_, k) in zip(data[1:], columns, strict=True))], names=["grp", *(n for n, _ in columns)])

    return ordered.mapInArrow(run, f"grp {ordered.schema['grp'].dataType.simpleString()}, {schema}")


def shelf_pack(rects: DataFrame, side: int, pad: int) -> DataFrame:
    """grp, id, x, y, w, h, placed of rects (grp, id, w, h): each group on shelves of its own sheet, in area order.

    x and y are of the inner rectangle. Rectangles without a place are there with nulls.
    """

    def step(sheet: Sheet, row: tuple) -> Iterator[tuple]:
        at = sheet.place(row[2], row[3])
        yield (row[1], *(at or (None, None)), row[2], row[3], at is not None)

    return streamed(in_area_order(rects), lambda row: Sheet(side, pad), step, None, "id long, x long, y long, w long, h long, placed boolean")


def pack_at(rects: DataFrame, sides: DataFrame, pad: int) -> DataFrame:
    """As shelf_pack(), where sides (grp, side) says the side of each group's sheet."""

    def step(sheet: Sheet, row: tuple) -> Iterator[tuple]:
        at = sheet.place(row[2], row[3])
        yield (row[1], *(at or (None, None)), row[2], row[3], at is not None)

    with_side = rects.join(sides.select("grp", F.col("side").cast("long").alias("side")), "grp")
    return streamed(in_area_order(with_side, "side"), lambda row: Sheet(row[4], pad), step, None, "id long, x long, y long, w long, h long, placed boolean")


def split(rects: DataFrame, limit: int, pad: int) -> DataFrame:
    """grp, id, sheet, x, y, w, h: each sheet of a group takes what fits at the limit of what the ones before it left.

    A rectangle tries the open sheets in turn, which comes to the same as filling them one after the other; Sheets passes
    over those that it can't change. One that fits no sheet is an error.
    """

    def step(sheets: Sheets, row: tuple) -> Iterator[tuple]:
        at = sheets.place(row[2], row[3])
        if at is None:
            raise ValueError(f"{row[2]} x {row[3]} fits no sheet of {limit}")
        yield (row[1], *at, row[2], row[3])

    return streamed(in_area_order(rects), lambda row: Sheets(limit, pad), step, None, "id long, sheet long, x long, y long, w long, h long")


def split_at(rects: DataFrame, limits: DataFrame, pad: int) -> DataFrame:
    """As split(), where limits (grp, width, height) says how wide and high each group's sheets may be."""

    def step(sheets: Sheets, row: tuple) -> Iterator[tuple]:
        at = sheets.place(row[2], row[3])
        if at is None:
            raise ValueError(f"{row[2]} x {row[3]} fits no sheet of {row[4]} x {row[5]}")
        yield (row[1], *at, row[2], row[3])

    limited = rects.join(limits.select(F.col("grp").alias("_grp"), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height")), F.col("grp").eqNullSafe(F.col("_grp")))
    return streamed(in_area_order(limited, "width", "height"), lambda row: Sheets(row[4], pad, row[5]), step, None, "id long, sheet long, x long, y long, w long, h long")


def _tree(low: int, high: int, steps: int) -> list[int]:
    """The sides that the next steps of a binary search between low and high may try."""
    if steps == 0 or low >= high:
        return []
    middle = (low + high) // 2
    return [middle, *_tree(middle + 1, high, steps - 1), *_tree(low, middle, steps - 1)]


def least_side(rects: DataFrame, limit: int, pad: int) -> DataFrame:
    """grp, side: per sheet the side at which a binary search up to limit ends, packing shelves in area order.

    At limit itself nothing is tried, as all that can be said then is that no smaller side was found. Passes over the
    rectangles are the search's steps by five; what they leave to search is written to the shared folder.
    """
    spark, where, k = rects.sparkSession, shared.folder(rects.sparkSession, "sides"), 0

    def kept(df: DataFrame) -> DataFrame:
        nonlocal k
        k += 1
        df.write.parquet(f"{where}/{k}")
        return spark.read.schema(df.schema).parquet(f"{where}/{k}")

    rects = rects.select("grp", "id", "w", "h")
    longest = F.max(F.greatest("w", "h")) + 2 * pad
    bounds = kept(rects.groupBy("grp").agg(F.greatest(F.lit(1).cast("long"), longest).cast("long").alias("low")).withColumn("high", F.lit(limit).cast("long")))

    def begin(row: tuple) -> dict:
        sides = sorted(set(_tree(row[4], row[5], STEPS)))
        return {"low": row[4], "high": row[5], "shelves": Shelves(sides, pad), "fits": np.ones(len(sides), dtype=bool)}

    def step(state: dict, row: tuple) -> tuple:
        state["fits"] &= state["shelves"].place(row[2], row[3])[2]
        return ()

    def end(state: dict) -> list[tuple]:
        low, high, fits = state["low"], state["high"], dict(zip(state["shelves"].side.tolist(), state["fits"].tolist(), strict=True))
        for _ in range(STEPS):
            if low < high:
                middle = (low + high) // 2
                low, high = (low, middle) if fits[middle] else (middle + 1, high)
        return [(low, high)]

    while True:
        todo = bounds.where("low < high")
        if not todo.limit(1).count():
            return bounds.select("grp", F.col("low").alias("side"))
        on = in_area_order(rects.join(todo.withColumnRenamed("grp", "_grp"), F.col("grp").eqNullSafe(F.col("_grp"))), "low", "high")
        bounds = kept(bounds.where("low >= high").union(streamed(on, begin, step, end, "low long, high long")))
