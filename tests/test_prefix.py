"""Two-level running sums and numbers against plain ones."""

import itertools
import random

from pyspark.sql import functions as F

from tessera.operators import layout, prefix


def test_running_sums_in_stretches(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([1, 5, None, 1 << 40])) for i in rng.sample(range(-3000, 3000), 2000)]
    df = spark.createDataFrame(rows, "k long, g string, v long").repartition(7)
    got = {(r["k"], r["g"]): r["offset"] for r in layout.offsets(df, "g", "k", "v").collect()}
    small = {(r["k"], r["g"]): r["o"] for r in prefix.running(df, ["g"], F.col("k"), F.col("v"), "o", rows=50).collect()}
    want, sums = {}, {}
    for k, g, v in sorted(rows, key=lambda r: r[0]):
        want[k, g] = sums.get(g, 0)
        sums[g] = sums.get(g, 0) + (v or 0)
    assert got == want and small == want


def test_no_task_sees_a_whole_group(spark):
    df = spark.range(20000).select("id", F.lit("one").alias("g"), F.lit(2).cast("long").alias("v"))
    cuts = prefix.bounds(df, F.col("id"), 1000)
    sizes = [r["count"] for r in df.groupBy(prefix.stretch(F.col("id"), cuts)).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2500
    assert prefix.running(df, ["g"], F.col("id"), F.col("v"), "o", rows=1000).where("o <> 2 * id").count() == 0


def test_numbers_by_text(spark):
    names = sorted("".join(t) for t in itertools.product("ab/-.", repeat=4))
    df = spark.createDataFrame([(n,) for n in random.Random(1).sample(names, len(names))], "path string")
    got = prefix.numbered(df, F.translate("path", "/", "\x01"), rows=40).orderBy("id").collect()
    assert [r["path"] for r in got] == sorted(names, key=lambda n: n.split("/")) and [r["id"] for r in got] == list(range(len(names)))


def test_empty_and_one_row(spark):
    df = spark.createDataFrame([], "k long, g string, v long")
    assert layout.offsets(df, "g", "k", "v").count() == 0
    one = spark.createDataFrame([(1, None, None)], "k long, g string, v long")
    assert [r["offset"] for r in layout.offsets(one, "g", "k", "v").collect()] == [0]
