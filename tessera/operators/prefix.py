"""Running sums and numbers over a whole order, by a two-level scan: no task sees all rows, also not those of one group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a stretch of the order, about; stretches at most, and sampled rows for each from which their bounds are taken.
_ROWS, _MOST, _SAMPLED = 1 << 16, 1024, 64


def bounds(df: DataFrame, order: Column, rows: int = _ROWS) -> list:
    """Values that cut the order into stretches of about so many rows, from a sample of 64 rows a stretch at most.

    The sample is by a hash of the value, so it is the same each time; rows that are equal stay together.
    """
    n = df.count()
    parts = min(_MOST, max(1, -(-n // rows)))
    if parts == 1:
        return []
    cut = min(1 << 32, -(-(parts * _SAMPLED << 32) // n))
    some = df.select(order.alias("o")).where(F.col("o").isNotNull() & (F.pmod(F.xxhash64("o"), F.lit(1 << 32)) < F.lit(cut).cast("long")))
    values = [r[0] for r in some.orderBy("o").collect()]
    return sorted({values[len(values) * k // parts] for k in range(1, parts)}) if values else []


def stretch(order: Column, cuts: list) -> Column:
    """The number of cuts at or below a value, by halving; nulls are in the first stretch, where they sort."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(order >= F.lit(cuts[middle]), search(middle + 1, high)).otherwise(search(low, middle))

    return search(0, len(cuts))


def running(df: DataFrame, by: list[str], order: Column, value: Column, name: str, rows: int = _ROWS) -> DataFrame:
    """df with the sum of value over the rows before each in its group, in an order without ties; null values count as 0.

    Rows are cut into stretches of the order, the same ones in every group. Sums of a group's stretches, one row for
    each, are added up to what comes before a stretch, and only inside a stretch are rows sorted. Groups may be null.
    """
    cuts = bounds(df, order, rows)
    at = df.withColumns({"_value": F.coalesce(value, F.lit(0)), "_order": order, "_stretch": stretch(order, cuts)})
    inside = Window.partitionBy(*by, "_stretch").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    local = at.withColumn("_local", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    if not cuts:
        return local.withColumn(name, F.col("_local")).drop("_value", "_order", "_stretch", "_local")
    earlier = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = at.groupBy(*by, "_stretch").agg(F.sum("_value").alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    base = sums.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_stretch").alias("_at"), "_base")
    same = F.col("_stretch") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    out = local.join(base, same).withColumn(name, F.col("_local") + F.col("_base"))
    return out.drop(*base.columns, "_value", "_order", "_stretch", "_local")


def numbered(df: DataFrame, order: Column, name: str = "id", rows: int = _ROWS) -> DataFrame:
    """df with its rows numbered from 0 in an order without ties."""
    return running(df, [], order, F.lit(1).cast("long"), name, rows)
