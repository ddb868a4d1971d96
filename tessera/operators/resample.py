"""Fixed-point Lanczos resizing and the greedy order of edges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values, 32 fraction bits: one, pi and the coefficients of the sine.
ONE, PI, C3, C5, C7 = 1 << 32, 13493037705, -715827883, 35791394, -852176


def _mul(a: int, b: int) -> int:
    return (a * b) >> 32


def _div(a: int, b: int) -> int:
    q = (abs(a) << 32) // abs(b)
    return q if (a < 0) == (b < 0) else -q


def _sinc(x: int) -> int:
    if not x:
        return ONE
    t = _mul(PI, abs(x) & (ONE - 1))
    t2 = _mul(t, t)
    s = t + _mul(_mul(t2, t), C3 + _mul(C5 + _mul(C7, t2), t2))
    if (abs(x) >> 32) % 2:
        s = -s
    return _div(s if x > 0 else -s, _mul(PI, x))


@lru_cache(maxsize=64)
def kernel(src: int, dst: int, radius: int) -> tuple[tuple[tuple[int, int], ...], ...]:
    """For each target sample its (source, weight) taps; radius has 32 fraction bits."""
    scale, out = (src << 32) // dst, []
    for i in range(dst):
        centre = _mul(i * ONE + ONE // 2, scale) - ONE // 2
        taps = []
        for s in range(max(0, (centre - radius) >> 32), min(src - 1, (centre + radius) >> 32) + 1):
            d = abs(centre - (s << 32))
            w = _mul(_sinc(d), _sinc(_div(d, radius))) if d < radius else 0
            if w:
                taps.append((s, w))
        whole = sum(w for _, w in taps)
        out.append(tuple((s, _div(w, whole)) for s, w in taps) if whole else ())
    return tuple(out)


def resample(rows: np.ndarray, dst: int, radius: int) -> np.ndarray:
    """Resizes the first axis to dst samples of 0 to 255; the same size changes nothing."""
    if len(rows) == dst:
        return rows
    out = np.zeros((dst, *rows.shape[1:]), dtype=np.uint8)
    wide = rows.astype(np.int64)
    for i, taps in enumerate(kernel(len(rows), dst, radius)):
        if taps:
            acc = sum(wide[s] * w for s, w in taps)
            out[i] = np.clip(acc >> 32, 0, 255)
    return out


def resize_pixels(px: np.ndarray, width: int, height: int, radius: int) -> np.ndarray:
    """(h, w, channels) to (height, width, channels): across, then down."""
    across = resample(px.swapaxes(0, 1), width, radius).swapaxes(0, 1)
    return resample(across, height, radius)


def whole_radius(width: int, height: int) -> int:
    """The smaller side of the image that is resized, one sample at least."""
    return max(ONE, min(width, height) * ONE)


def taps(width: int, height: int, new_width: int, new_height: int, radius: int | None = None) -> int:
    """Weights that resizing one image uses: none if its size stays, else those of each target pixel of both passes."""
    if (width, height) == (new_width, new_height):
        return 0
    radius = radius or whole_radius(width, height)
    across, down = kernel(width, new_width, radius), kernel(height, new_height, radius)
    return sum(map(len, across)) * height + sum(map(len, down)) * new_width


def resize(images: DataFrame, width: int, height: int, radius: int | None = None) -> DataFrame:
    """image_id, width, height, rgba of images resized; by default an image's radius is its own smaller side, 1 at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, w, h, rgba in zip(*batch.columns, strict=True):
                w, h = w.as_py(), h.as_py()
                px = np.frombuffer(rgba.as_py(), dtype=np.uint8).reshape(h, w, 4)
                body = np.ascontiguousarray(resize_pixels(px, width, height, radius or whole_radius(w, h))).tobytes()
                yield pa.record_batch([pa.array([i.as_py()], pa.int64()), pa.array([width], pa.int64()), pa.array([height], pa.int64()), pa.array([body], pa.binary())], names=["image_id", "width", "height", "rgba"])

    return images.selectExpr("cast(image_id as bigint) image_id", "width", "height", "rgba").mapInArrow(run, "image_id long, width long, height long, rgba binary")


def greedy(head: np.ndarray, tail: np.ndarray, head_q: list[int], tail_q: list[int], area: list[int], band: int = 3, newest: int = 64) -> list[int]:
    """Order of items in which each tail edge meets a head edge of little L1 cost.

    It starts at the last of the largest items. Buckets of head edges are searched outwards from the bucket of the
    current tail, each from its newest member, and an edge of cost 0 ends the search.
    """
    n = len(area)
    if not n:
        return []
    buckets: dict[int, list[int]] = {}
    for i, q in enumerate(head_q):
        buckets.setdefault(q, []).append(i)
    now = max(range(n), key=lambda i: (area[i], i))
    used, order, low = {now}, [now], 0
    while len(order) < n:
        best, found = None, -1
        for at in [tail_q[now], *[tail_q[now] + s * d for d in range(1, band + 1) for s in (-1, 1)]]:
            for i in reversed(buckets.get(at, [])[-newest:]):
                if best != 0 and i not in used:
                    cost = int(np.abs(tail[now] - head[i]).sum())
                    if best is None or cost < best:
                        best, found = cost, i
        if found < 0:
            while low in used:
                low += 1
            found = low
        used.add(found)
        order.append(found)
        now = found
    return order


def greedy_order(items: DataFrame) -> DataFrame:
    """grp, id, ordinal: greedy order of each group (a sheet) of items (grp, id, area, head, tail, head_q, tail_q)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("id").reset_index(drop=True)
        edges = [np.array(g[c].tolist(), dtype=np.int64) for c in ("head", "tail")]
        order = greedy(*edges, g["head_q"].tolist(), g["tail_q"].tolist(), g["area"].tolist())
        return pd.DataFrame({"grp": g["grp"].iloc[order].to_numpy(), "id": g["id"].iloc[order].to_numpy(), "ordinal": range(len(order))})

    return items.groupBy("grp").applyInPandas(run, "grp long, id long, ordinal long")
