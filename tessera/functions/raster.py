"""Samples are integers from 0 to 255 and wrap; a row of samples is an array, so row-local work needs no shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

#: Sums that pass the largest long stay there.
LARGEST = (1 << 63) - 1


def wrap(x: Column) -> Column:
    return F.pmod(x, F.lit(256))


def shifted(row: Column) -> Column:
    """The row moved right by one, 0 first."""
    return F.slice(F.concat(F.array(F.lit(0).cast("long")), row), 1, F.size(row))


def delta_row(row: Column) -> Column:
    return F.zip_with(row, shifted(row), lambda a, b: wrap(a - b))


@F.arrow_udf(ArrayType(LongType()))
def undelta_row(residual: pa.Array) -> pa.Array:
    """Running sums, one linear pass over all rows of a batch; a null row stays null."""
    flat, size = residual.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pa.compute.list_value_length(residual).fill_null(0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(flat)])
    end = np.cumsum(size)
    rows = (total[1:] - np.repeat(total[end - size], size)) % 256
    out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]), pa.int32()), pa.array(rows, pa.int64()))
    return pa.compute.if_else(residual.is_null(), pa.scalar(None, out.type), out)


def up_row(row: Column, above: Column) -> Column:
    return F.when(above.isNull(), row).otherwise(F.zip_with(row, above, lambda a, b: wrap(a - b)))


def paeth(left: Column, up: Column, corner: Column) -> Column:
    """The neighbour nearest to left + up - corner; ties go to left, then up."""
    dl, du, dc = F.abs(up - corner), F.abs(left - corner), F.abs(left + up - 2 * corner)
    return F.when((dl <= du) & (dl <= dc), left).when(du <= dc, up).otherwise(corner)


def paeth_row(row: Column, above: Column) -> Column:
    above = F.coalesce(above, F.transform(row, lambda x: F.lit(0).cast("long")))
    near = F.zip_with(above, shifted(above), lambda u, c: F.struct(u.alias("u"), c.alias("c")))
    side = F.zip_with(shifted(row), near, lambda l, n: paeth(l, n["u"], n["c"]))
    return F.zip_with(row, side, lambda x, p: wrap(x - p))


def magnitude(e: Column) -> Column:
    """A residual's distance from 0 around the circle."""
    return F.least(e, 256 - e)


def total(row: Column) -> Column:
    return F.aggregate(row, F.lit(0).cast("long"), lambda acc, x: acc + x)


def moment(row: Column) -> Column:
    """Sum of position (from 1) times sample: tells rows with the same samples in another order apart."""
    return total(F.transform(row, lambda x, i: x * (i + 1)))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright((77 * r + 150 * g + 29 * b).cast("int"), 8)


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, v: s + v)


def alpha_mode(a: str = "a") -> Column:
    """Aggregate: Opaque255, Transparent0, Mask1Bit or Normal."""
    low, high = F.min(a), F.max(a)
    return F.when(low == 255, "Opaque255").when(high == 0, "Transparent0").when(F.bool_and(F.col(a).isin(0, 255)), "Mask1Bit").otherwise("Normal")


def pack_rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Four 16-bit numbers in a long, x in the top bits."""
    part = [F.shiftleft(c.cast("long"), n) for c, n in ((x, 48), (y, 32), (w, 16), (h, 0))]
    return part[0].bitwiseOR(part[1]).bitwiseOR(part[2]).bitwiseOR(part[3])


def unpack_rect(packed: Column) -> list[Column]:
    return [F.shiftrightunsigned(packed, n).bitwiseAND(F.lit(65535)) for n in (48, 32, 16, 0)]


def saturating_add(a: Column, b: Column) -> Column:
    """For numbers from 0 on."""
    return F.coalesce(F.try_add(a, b), F.when(a.isNotNull() & b.isNotNull(), F.lit(LARGEST)))


def saturating_multiply(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_multiply(a, b), F.when(a.isNotNull() & b.isNotNull(), F.lit(LARGEST)))


def premultiplied(c: Column, a: Column) -> Column:
    """A channel over black, rounded."""
    return F.floor((c * a + 127) / 255)


def mask_bytes(alpha: Column) -> Column:
    """An array of alpha samples as bytes of eight bits each, the first in the lowest bit; set where a sample isn't 0."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(alpha) / 8).cast("int") - 1, F.lit(0)))
    byte = lambda k: F.aggregate(F.transform(F.slice(alpha, k * 8 + 1, 8), lambda v, i: F.when(v != 0, F.call_function("shiftleft", F.lit(1), i)).otherwise(0)), F.lit(0), lambda s, v: s + v)
    return F.when(F.size(alpha) > 0, F.transform(starts, byte)).otherwise(F.expr("cast(array() as array<int>)"))


def mask_samples(packed: Column, n: Column) -> Column:
    """The n alpha samples, 0 or 255, of mask bytes."""
    at = F.sequence(F.lit(0), n.cast("int") - 1)
    return F.when(n > 0, F.transform(at, lambda i: F.call_function("getbit", F.get(packed, (i / 8).cast("int")).cast("int"), (i % 8).cast("int")).cast("int") * 255)).otherwise(F.expr("cast(array() as array<int>)"))


def interleaved(planes: list[Column]) -> Column:
    """Planes of samples as one array, a sample of each plane in turn."""
    return F.flatten(F.transform(F.arrays_zip(*[p.alias(f"p{k}") for k, p in enumerate(planes)]), lambda z: F.array(*[z[f"p{k}"] for k in range(len(planes))])))


def deinterleaved(samples: Column, channels: int) -> list[Column]:
    def plane(k: int) -> Column:
        return F.filter(samples, lambda v, i: i % channels == k)

    return [plane(k) for k in range(channels)]


@F.arrow_udf(LongType())
def byte_total(data: pa.Array) -> pa.Array:
    """The sum of a binary's bytes."""
    return pa.array([None if d is None else int(np.frombuffer(d, dtype=np.uint8).sum(dtype=np.int64)) for d in data.to_pylist()], pa.int64())


@F.arrow_udf(LongType())
def byte_moment(data: pa.Array) -> pa.Array:
    """The sum of position (from 1) times byte."""
    read = lambda d: np.frombuffer(d, dtype=np.uint8).astype(np.int64)
    return pa.array([None if d is None else int(read(d) @ np.arange(1, len(d) + 1)) for d in data.to_pylist()], pa.int64())
