"""Approximate nearest neighbours on shifted Hilbert curves.

1. Rows that take part are written once; of identical vectors only the smallest ids, as many as an answer can hold.
2. Each curve projects vectors to a few random directions, replaces a coordinate by its share of a sample's values below
   it, shifts all by an amount of its own, and orders them by their Hilbert key. The sample's keys turn a key into a
   place from 0 to 1, so that equal widths hold about equally many rows.
3. Some queries are answered exactly, against all rows in blocks. How far their neighbours lie from them, on the curve
   that brings them nearest, gives the window: the least width that finds the wanted share of them. So the width follows
   the data: narrow where near vectors are near on curves, wide where distances say little.
4. Rows are range-partitioned into blocks of each curve, a query goes to every block that its window meets, and a block
   ranks what lies in the windows by exact distance. The best of all curves and blocks are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._scratch import Scratch

_CHUNK = 256
#: Low bits of a key that spread rows of one cell of a curve; with the cell's bits a float64 holds them exactly.
_SPREAD = 5


@dataclass(frozen=True)
class Curves:
    """k: neighbours; every: queries are the ids that it divides; curves, dims, bits: of the orderings; sample: rows that
    fit the curves, about, and values: numbers in these rows at most; asked: queries answered exactly to set the window,
    about; recall: share of their neighbours that it must find; block: rows of a block, about; wave: curves whose rows are
    shuffled at once."""

    k: int = 10
    every: int = 100
    curves: int = 16
    dims: int = 8
    bits: int = 6
    sample: int = 16384
    values: int = 1 << 22
    asked: int = 256
    recall: float = 0.96
    block: int = 8192
    wave: int = 2
    seed: int = 12


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Key of each row of cells, (n, dims) of 0 to 2**bits - 1, on a Hilbert curve; dims * bits is 63 at most.

    From the highest bit down, the orientation of the cube that a point is in is undone (coordinates are exchanged or
    mirrored), then Gray codes over the coordinates become positions and the bits are interleaved.
    """
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i, axis in enumerate(axes):
            mirror = (axis >> level) & 1 == 1
            swap = np.where(mirror, 0, (axes[0] ^ axis) & low)
            axes[0] = np.where(mirror, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = axis ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(cells), dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    key = np.zeros(len(cells), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ turn) >> level) & 1)
    return key


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of lists of dim numbers as float64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class Ordering:
    """Curves fitted on a sample of vectors; place() is all that the search asks of one."""

    def __init__(self, sample: np.ndarray, spec: Curves):
        rng = np.random.default_rng(spec.seed)
        dim = sample.shape[1]
        dims = min(spec.dims, dim)
        self.bits = min(63, spec.dims * spec.bits) // dims if dims < spec.dims else spec.bits
        self.bits = min(self.bits, 12)
        self.shares = np.linspace(0, 1, 257)
        self.axes, self.knots, self.shifts, self.keys, self.at = [], [], [], [], []
        for _ in range(spec.curves):
            self.axes.append(np.linalg.qr(rng.standard_normal((dim, dims)))[0])
            self.knots.append(np.quantile(sample @ self.axes[-1], self.shares, axis=0))
            self.shifts.append(rng.random(dims))
            self.keys.append(np.zeros(0))
            self.at.append(np.zeros(0))
        for c in range(spec.curves):
            keys = np.sort((self.key(c, sample) << _SPREAD) + (np.arange(len(sample)) & ((1 << _SPREAD) - 1)))
            self.keys[c], first, n = np.unique(keys, return_index=True, return_counts=True)
            self.at[c] = (first + n / 2) / len(keys)

    def key(self, c: int, x: np.ndarray) -> np.ndarray:
        p = x @ self.axes[c]
        share = np.stack([np.interp(p[:, i], self.knots[c][:, i], self.shares) for i in range(p.shape[1])], axis=1)
        cells = ((share + self.shifts[c]) / 2 * (1 << self.bits)).astype(np.int64)
        return hilbert(np.minimum(cells, (1 << self.bits) - 1), self.bits)

    def place(self, c: int, x: np.ndarray, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The range of places of each vector's cell on curve c; with ids, the one place in it that a row takes."""
        key = self.key(c, x) << _SPREAD
        last = (1 << _SPREAD) - 1
        of = lambda k: np.interp(k, self.keys[c], self.at[c])
        if ids is not None:
            spread = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SPREAD)).astype(np.int64)
            return (one := of(key + spread)), one
        return of(key), of(key + last)


def _best(query: np.ndarray, query_id: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of each query's k nearest rows among x[low:high], its own id left out, ties to smaller ids.

    One matrix product ranks roughly; all rows that rounding could put among the first k are measured exactly.
    """
    square = (x * x).sum(1)
    found = []
    for at in range(0, len(query), _CHUNK):
        q = query[at : at + _CHUNK]
        a, b = (0, len(x)) if low is None else (int(low[at : at + _CHUNK].min()), int(high[at : at + _CHUNK].max()))
        if a >= b:
            continue
        own = (q * q).sum(1)[:, None]
        d = own + square[a:b] - 2 * (q @ x[a:b].T)
        out = query_id[at : at + _CHUNK, None] == ids[a:b]
        if low is not None:
            rows = np.arange(a, b)
            out |= (rows < low[at : at + _CHUNK, None]) | (rows >= high[at : at + _CHUNK, None])
        d[out | np.isnan(d)] = np.inf
        far = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if b - a > k else np.full((len(q), 1), np.inf)
        i, j = np.nonzero((d <= far + 1e-9 * (own + square[a:b].max())) & (d < np.inf))
        i, j = i + at, j + a
        exact = np.sqrt(((query[i] - x[j]) ** 2).sum(1))
        order = np.lexsort((ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, i)
        keep = np.arange(len(i)) - first < k
        found.append((i[keep], j[keep], exact[keep]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _taking_part(rows: DataFrame, spec: Curves, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Rows (id, v) that can be found, queries (id, v), and the length of v."""
    v = F.col("embedding")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    valid = rows.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & sound)
    length = valid.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = length["dim"] if length else 0
    valid = valid.where(F.size("v") == dim)
    same = Window.partitionBy("h", "v").orderBy("id")
    kept = valid.withColumn("h", F.xxhash64("v")).withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= spec.k + 1)
    queries = valid.where(F.col("id") % spec.every == 0).groupBy("id").agg(F.min("v").alias("v"))
    return scratch.keep(kept.select("id", "v")), scratch.keep(queries), dim


def _share(df: DataFrame, rows: int, n: int, seed: int) -> pa.Table:
    """About so many of n rows, the same each time."""
    cut = min(1 << 32, math.ceil(rows / max(n, 1) * (1 << 32)))
    return df.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 32)) < F.lit(cut).cast("long")).toArrow()


def _exact(rows: DataFrame, query: np.ndarray, query_id: np.ndarray, k: int) -> DataFrame:
    """asked (number of the query), id, v, score: the k nearest of all rows, each task with its own best so far."""
    dim = query.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None
        for batch in batches:
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1), dim)
            i, j, d = _best(query, query_id, x, ids, k)
            new = i, ids[j], x[j], d
            have = new if have is None else tuple(np.concatenate(c) for c in zip(have, new, strict=True))
            order = np.lexsort((have[1], have[3], have[0]))
            i = have[0][order]
            order = order[np.arange(len(i)) - np.searchsorted(i, i) < k]
            have = tuple(c[order] for c in have)
        if have is not None and len(have[0]):
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(have[0]) + 1, dtype=np.int32) * dim), pa.array(have[2].ravel()))
            yield pa.record_batch([pa.array(have[0]), pa.array(have[1]), v, pa.array(have[3])], names=["asked", "id", "v", "score"])

    best = Window.partitionBy("asked").orderBy("score", "id")
    found = rows.mapInArrow(run, "asked long, id long, v array<double>, score double")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")


def window(ordering: Ordering, query: np.ndarray, near: np.ndarray, of: np.ndarray, spec: Curves) -> float:
    """The least width to each side at which spec.recall of the rows near, neighbours of query[of], lie in a window."""
    gaps = np.full(len(near), np.inf)
    for c in range(spec.curves):
        (low, high), (a, b) = ordering.place(c, query), ordering.place(c, near)
        gaps = np.minimum(gaps, np.maximum(0, np.maximum(low[of] - a, b - high[of])))
    return float(np.quantile(gaps, spec.recall, method="higher")) if len(near) else 0.0


def _placed(df: DataFrame, ordering: Ordering, curves: range, blocks: int, tiles: int, width: float | None, dim: int, kind: str) -> DataFrame:
    """curve, block, tile, asks, low, high, id, v: rows at their place, or queries (with a width) in all blocks they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1), dim)
            for c in curves:
                if width is None:
                    low, high = ordering.place(c, x, ids)
                    n = np.full(len(ids), tiles)
                else:
                    low, high = ordering.place(c, x)
                    low, high = low - width, high + width
                first = np.clip((low * blocks).astype(np.int64), 0, blocks - 1)
                if width is not None:
                    n = np.clip((high * blocks).astype(np.int64), 0, blocks - 1) - first + 1
                row = np.repeat(np.arange(len(ids)), n)
                step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                block, tile = (first[row], step) if width is None else (first[row] + step, ids[row] // 7 % tiles)
                take = pa.array(row)
                columns = [pa.array(np.full(len(row), c), pa.int32()), pa.array(block), pa.array(tile, pa.int64()), pa.array(np.full(len(row), width is not None)), pa.array(low[row]), pa.array(high[row])]
                yield pa.record_batch([*columns, batch.column(0).take(take), batch.column(1).take(take)], names=["curve", "block", "tile", "asks", "low", "high", "id", "v"])

    return df.mapInArrow(run, f"curve int, block long, tile long, asks boolean, low double, high double, id long, v {kind}")


def _search(dim: int, k: int):
    def run(block: pa.Table) -> pa.Table:
        asks = block["asks"].to_numpy()
        low, high, ids = (block[c].to_numpy() for c in ("low", "high", "id"))
        v = matrix(block["v"], dim)
        order = np.flatnonzero(~asks)[np.argsort(low[~asks], kind="stable")]
        ask = np.flatnonzero(asks)[np.argsort(low[asks], kind="stable")]
        at = low[order]
        a, b = np.searchsorted(at, low[ask], side="left"), np.searchsorted(at, high[ask], side="right")
        i, j, d = _best(v[ask], ids[ask], v[order], ids[order], k, a, b)
        return pa.table({"query_id": ids[ask][i], "vec_id": ids[order][j], "score": d})

    return run


def neighbours(rows: DataFrame, spec: Curves = Curves(), spark: SparkSession | None = None) -> DataFrame:  # noqa: B008
    """query_id, rank, vec_id, score: of each row whose vec_id spec.every divides, the spec.k nearest found of all others.

    Null and zero vectors, those with null or non-finite components, those of another length than most have, and rows
    without an id take no part. Rows that repeat an id are one candidate, at its nearest vector, and of queries that do
    the smallest vector asks. Distances are Euclidean, in double precision, of the vectors as given; those that overflow
    are not found. A table without rows or queries gives no rows; other columns are ignored.
    """
    spark = spark or rows.sparkSession
    scratch = Scratch(spark, "curves")
    have, queries, dim = _taking_part(rows, spec, scratch)
    kind = have.schema["v"].dataType.simpleString()
    n, asking = have.count(), queries.count()
    if not n or not asking:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ordering = Ordering(matrix(_share(have, min(spec.sample, max(256, spec.values // dim)), n, spec.seed)["v"], dim), spec)
    some = _share(queries, spec.asked, asking, spec.seed + 1)
    asked, asked_id = matrix(some["v"], dim), some["id"].to_numpy()
    near = _exact(have, asked, asked_id, spec.k).toArrow()
    width = window(ordering, asked, matrix(near["v"], dim), near["asked"].to_numpy(), spec)
    # A window also holds k rows beside the query's own, on either side and twice over, so that few rows are all met.
    width = max(width, 2 * (spec.k + 1) / n)

    blocks = math.ceil(n / spec.block)
    tiles = math.ceil(asking * (2 * width + 1 / blocks) / spec.block)
    found = []
    for c in range(0, spec.curves, spec.wave):
        curves = range(c, min(c + spec.wave, spec.curves))
        both = _placed(have, ordering, curves, blocks, tiles, None, dim, kind).union(_placed(queries, ordering, curves, blocks, tiles, width, dim, kind))
        found.append(scratch.keep(both.groupBy("curve", "block", "tile").applyInArrow(_search(dim, spec.k), "query_id long, vec_id long, score double")))
    merged = found[0]
    for f in found[1:]:
        merged = merged.union(f)
    scratch.drop(have, queries)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    merged = merged.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(best))
    return merged.where(F.col("rank") <= spec.k).select("query_id", "rank", "vec_id", "score")


def op12_curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Curves(), spark)
