"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r between 0 and `cap`. Among all rates that give every source its target of words, those of
the least bounded relative entropy to 1 are exponential tilts of the size: r = cap / (1 + (cap - 1) exp(-t x)), x the
document's size over its source's mean. The convex dual in the tilts t, one of each source's token constraint, is
solved by guarded Newton iterations; each is an aggregation over the table of sizes (source, size, rows), so neither
texts nor rows are read again. Rates are then rounded to copies with one hash number of each document, and a shift of
each source's rounding threshold, found from two cumulative histograms, brings the words taken to the target.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._scratch import Scratch

#: Up to so many sources (rows of four numbers) are broadcast; more are joined in a salted shuffle.
BROADCAST_SOURCES = 20_000
_SALTS = 32
_FINE = 1 << 12


@dataclass(frozen=True)
class Mix:
    """weights: repeating over the sources in code point order, nulls last; total: words of the mix over all words."""

    weights: tuple[int, ...] = (1, 2, 3)
    total: float = 1.0
    cap: int = 3
    newton: int = 60
    rounds: int = 4
    near: float = 1e-4
    tolerance: float = 1e-7


def n_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ runs; 0 for null."""
    gaps = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    inner = F.trim(gaps)
    return F.when(inner == "", 0).otherwise(F.length(inner) - F.length(F.translate(inner, " ", "")) + 1).cast("long")


def _attach(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """rows with the columns of their source, by code (no nulls)."""
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources), "code")
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(_SALTS)).cast("int")).join(salted, ["code", "salt"]).drop("salt")


def targets(sources: DataFrame, spec: Mix) -> DataFrame:
    """(code, source_size, rows) with weight and target: level * weight, at most cap * source_size, adding up to the total.

    Works on one row per source. The water level follows from sources in order of cap * source_size / weight: those
    before some place are capped, and the rest share what is left by weight.
    """
    order = Window.orderBy(F.col("code"))
    weights = F.array(*[F.lit(float(w)) for w in spec.weights])
    s = sources.withColumn("weight", F.element_at(weights, ((F.row_number().over(order) - 1) % len(spec.weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * float(spec.cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    every = Window.partitionBy(F.lit(1))
    upto = Window.orderBy("ratio", "code").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("all", F.least(F.sum("source_size").over(every) * spec.total, F.sum("most").over(every)))
    s = s.withColumn("capped", F.coalesce(F.sum("most").over(upto), F.lit(0.0)))
    s = s.withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    s = s.withColumn("level", (F.col("all") - F.col("capped")) / F.col("left"))
    # The level is that of the first source which it doesn't cap; if it caps all, the last one's.
    s = s.withColumn("here", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "code", "level")))
    s = s.withColumn("level", F.coalesce(F.min("here").over(every)["level"], F.max("ratio").over(every)))
    return s.select("code", "source_size", "rows", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def _rate(cap: int, tilt: Column, x: Column) -> Column:
    return F.lit(float(cap)) / (1.0 + (cap - 1.0) * F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), tilt * x))))


def _solve(sizes: DataFrame, sources: DataFrame, n_sources: int, spec: Mix, scratch: Scratch) -> DataFrame:
    """sources with their tilt: Newton on the dual's gradient, held in a bracket that bisection or doubling moves."""
    state = scratch.keep(sources.withColumn("x0", F.col("source_size") / F.col("rows")).withColumn("tilt", F.lit(0.0)).withColumn("low", F.lit(float("-inf"))).withColumn("high", F.lit(float("inf"))))
    free = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * float(spec.cap) * (1 - 1e-12))
    for _ in range(spec.newton):
        rows = _attach(sizes, state.where(free).select("code", "tilt", "x0"), n_sources)
        x = F.col("size") / F.col("x0")
        rate = _rate(spec.cap, F.col("tilt"), x)
        mass = F.col("size") * F.col("n")
        sums = rows.groupBy("code").agg(F.sum(rate * mass).alias("got"), F.sum(mass * x * rate * (1 - rate / spec.cap)).alias("slope"))
        new = state.join(sums, "code", "left")
        miss = F.col("got") - F.col("target")
        new = new.withColumn("low", F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(miss > 0, F.col("tilt")).otherwise(F.col("high")))
        newton = F.col("tilt") - miss / F.greatest(F.col("slope"), F.lit(1e-300))
        inf = F.lit(float("inf"))
        fallback = F.when(F.col("high") == inf, F.greatest(F.col("low") * 2, F.col("low") + 1)).when(F.col("low") == -inf, F.least(F.col("high") * 2, F.col("high") - 1)).otherwise((F.col("low") + F.col("high")) / 2)
        inside = (newton > F.col("low")) & (newton < F.col("high")) & (F.abs(newton - F.col("tilt")) <= 4 + F.abs(F.col("tilt")))
        off = F.coalesce(F.abs(miss) / F.col("target"), F.lit(0.0))
        done = off <= spec.tolerance
        new = new.withColumn("off", off).withColumn("tilt", F.when(done, F.col("tilt")).when(inside, newton).otherwise(fallback)).drop("got", "slope")
        new = scratch.keep(new)
        worst = new.agg(F.max("off")).first()[0]
        scratch.drop(state)
        state = new.drop("off")
        state._scratch_path = new._scratch_path
        if worst is None or worst <= spec.tolerance:
            break
    return state


def balance(docs: DataFrame, spec: Mix = Mix(), spark: SparkSession | None = None) -> DataFrame:  # noqa: B008
    """One row per document: doc_id, size, source_size, target, taken, copies, rate.

    Null texts have no words; a null source is a source of its own, the last. Documents without words take none. A
    source whose target is its cap takes every document cap times. Rows that repeat a doc_id round alike; a null doc_id
    rounds by one fixed number. An empty table gives an empty result; other columns are ignored.
    """
    spark = spark or docs.sparkSession
    scratch = Scratch(spark, "mix")
    code = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    rows = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), code.alias("code"), n_words(F.col("text")).alias("size")))
    sizes = scratch.keep(rows.groupBy("code", "size").agg(F.count("*").alias("n")))
    sources = sizes.groupBy("code").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
    sources = scratch.keep(targets(sources, spec))
    n = sources.count()
    state = _solve(sizes.where("size > 0"), sources, n, spec, scratch)

    cap = spec.cap
    state = state.withColumn("full", F.col("target") >= F.col("source_size") * float(cap) * (1 - 1e-12)).withColumn("none", F.col("target") <= 0)
    out = _attach(rows, state.select("code", "source_size", "target", "tilt", "x0", "full", "none"), n)
    rate = F.when(F.col("none") | (F.col("size") == 0), 0.0).when(F.col("full"), float(cap)).otherwise(_rate(cap, F.col("tilt"), F.col("size") / F.col("x0")))
    unit = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(17)), F.lit(1 << 40)) / float(1 << 40)
    # A whole rate never rounds.
    out = out.withColumn("rate", rate).withColumn("at", F.when((F.col("rate") == 0) | (F.col("rate") == cap), F.col("rate")).otherwise(F.col("rate") + unit))
    out = out.withColumn("copies", F.least(F.floor("at"), F.lit(cap))).withColumn("frac", F.col("at") - F.floor("at")).drop("at", "tilt", "x0", "full", "none")

    # What is missing comes from documents whose next copy is nearest, what is too much from those whose last was. A
    # document larger than the gap is passed over, so a few rounds close it to less than any document that may move.
    out = scratch.keep(out.withColumn("copies", F.col("copies").cast("long")))
    for _ in range(spec.rounds):
        totals = out.groupBy("code").agg(F.first("target").alias("goal"), F.sum(F.col("copies") * F.col("size")).alias("got"))
        gap = totals.select("code", F.signum(F.col("goal") - F.col("got")).cast("int").alias("step"), F.abs(F.col("goal") - F.col("got")).alias("miss"), (F.abs(F.col("goal") - F.col("got")) / F.greatest("goal", F.lit(1.0))).alias("off"))
        gap = scratch.keep(gap)
        if (gap.agg(F.max("off")).first()[0] or 0.0) <= spec.near:
            break
        shifted = _attach(out, gap.drop("off"), n)
        room = F.when(F.col("step") > 0, (F.col("copies") < cap) & (F.col("rate") > 0)).otherwise(F.col("copies") > 0)
        may = room & (F.col("size") > 0) & (F.col("size") <= F.col("miss")) & (F.col("rate") < cap) & (F.col("step") != 0)
        away = F.when(F.col("step") > 0, 1 - F.col("frac")).otherwise(F.col("frac"))
        cell = F.least(F.floor(away * (_FINE * _FINE)), F.lit(_FINE * _FINE - 1)).cast("long")
        shifted = shifted.withColumn("cell", F.when(may, cell))
        shifted = _attach(shifted, _threshold(shifted, n, scratch), n)
        copies = F.when(F.col("cell") < F.col("until"), F.col("copies") + F.col("step")).otherwise(F.col("copies")).cast("long")
        new = scratch.keep(shifted.withColumn("copies", copies).drop("cell", "until", "step", "miss"))
        scratch.drop(out)
        out = new
    scratch.drop_all_but(out)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def _threshold(out: DataFrame, n_sources: int, scratch: Scratch) -> DataFrame:
    """(code, until): cells below it hold as many words as are missing, at most; two histograms of 4096 bins a source."""
    counted = out.where("cell is not null").select("code", "miss", "size", "cell")

    def passed(bins: DataFrame, room: str) -> DataFrame:
        before = Window.partitionBy("code").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        fits = bins.withColumn("sum", F.sum("words").over(before)).withColumn("fits", F.col("sum") <= F.col(room))
        return fits.groupBy("code").agg(F.max(F.when(F.col("fits"), F.col("bin"))).alias("last"), F.max(F.when(F.col("fits"), F.col("sum"))).alias("used"), F.first(room).alias("room"))

    coarse = counted.groupBy("code", F.floor(F.col("cell") / _FINE).alias("bin")).agg(F.sum("size").alias("words"), F.first("miss").alias("miss"))
    first = passed(coarse, "miss").select("code", (F.coalesce("last", F.lit(-1)) + 1).alias("bin0"), (F.col("room") - F.coalesce("used", F.lit(0))).alias("room"))
    # The next bin that holds anything may be further on.
    first = coarse.join(first, "code").where("bin >= bin0").groupBy("code").agg(F.min("bin").alias("edge"), F.first("room").alias("room"))
    first = scratch.keep(first)
    fine = _attach(counted.drop("miss"), first, n_sources).where(F.floor(F.col("cell") / _FINE) == F.col("edge"))
    fine = fine.groupBy("code", F.col("cell").alias("bin")).agg(F.sum("size").alias("words"), F.first("room").alias("room"), F.first("edge").alias("edge"))
    second = passed(fine, "room").select("code", (F.col("last") + 1).alias("inner"))
    every = out.select("code").distinct()
    found = every.join(first, "code", "left").join(second, "code", "left")
    until = F.coalesce("inner", F.col("edge") * _FINE, F.lit(_FINE * _FINE))
    return scratch.keep(found.select("code", until.alias("until")))


def op10_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance(spark.read.parquet(f"{sf_dir}/documents.parquet"), Mix(), spark)
