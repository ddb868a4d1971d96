"""Near-duplicate groups by banded MinHash, odd sketches and a confirmation on full shingle sets.

1. One pass over the texts gives each document its number of distinct shingles, a 128-bit fingerprint of the set, its
   band keys and its odd sketch: MinHash samples folded into a parity bitmap.
2. Documents with the same set form a class of which the smallest id goes on; copies never meet in a bucket.
3. In each bucket of a band, every class is proposed with the bucket's smallest id only. For each class the proposal
   whose sketches differ in the fewest bits is confirmed on full sets, and the links give components.
4. Buckets that still hold several components are compared in cells of bounded size, where only pairs of different
   components whose sketches agree closely enough are proposed: first each class's best partner, then, between the
   components that are left, all. These are confirmed too, and components are joined.
Links inside a component need no confirmation, so a bucket of near copies costs rows in proportion to its members.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._graph import components
from ._scratch import Scratch
from ._text import U


@dataclass(frozen=True)
class NearDedup:
    """words: shingle length; percent: least similarity of a link, 100 * intersection >= percent * union.

    With 28 bands of 4 rows a pair at 0.8 shares no band with a probability of 4e-7. The odd sketch folds up to `bins`
    samples of one more permutation (the least hash of each bin) into `sketch_bits`, and drops a candidate only if it
    is well below percent: 4.6 standard deviations or more, as simulated at 0.8 for 20 to 10,000 shingles.
    """

    words: int = 5
    percent: int = 80
    bands: int = 28
    rows: int = 4
    bins: int = 2048
    sketch_bits: int = 2048
    cell: int = 512

    def most_apart(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Sketch bits in which two sets of n and m shingles differ at most, if they are as similar as percent."""
        j, k, bits = self.percent / 100, self.bins, self.sketch_bits

        def filled(x):
            return k * -np.expm1(-x / k)

        union = (n + m) / (1 + j)
        both = filled(union)
        # Samples that differ: each bin of the union is equal with probability j, less the variance that full bins save.
        apart = filled(n) + filled(m) - 2 * j * both
        spread = 2 * np.sqrt(both * j * (1 - j) * (1 - both / (union + 1e-9)) + 0.02 * union * union / k + 1)
        apart = np.maximum(apart, 0) + 3 * spread
        # Flips of the same bit cancel.
        odd = bits / 2 * -np.expm1(-2 * apart / bits)
        return np.minimum(bits, odd + 3 * np.sqrt(apart * apart / bits / 2 + 0.25))


def _seeds(k: int) -> np.ndarray:
    return _text.mix(np.arange(1, k + 1, dtype=U), 0xC0FFEE) | U(1)


def _signature(sets: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    best = np.full(len(seeds), np.iinfo(U).max, dtype=U)
    for i in range(0, len(sets), 1024):
        np.minimum(best, (sets[i : i + 1024, None] * seeds[None, :]).min(0), out=best)
    return best


def _band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    parts = sig.reshape(-1, rows)
    key = np.arange(1, len(parts) + 1, dtype=U)
    for r in range(rows):
        key = _text.mix(key * U(0x9E3779B97F4A7C15) + parts[:, r])
    return key


def _odd_sketch(sets: np.ndarray, spec: NearDedup) -> bytes:
    """Each sample flips one of the bits, so samples that two sets share cancel in the XOR of their sketches."""
    v = np.sort(_text.mix(sets, 41))
    bins = v // U((1 << 64) // spec.bins)
    first = np.ones(len(v), dtype=bool)
    first[1:] = bins[1:] != bins[:-1]
    at = _text.mix(v[first], 43) % U(spec.sketch_bits)
    odd = np.bincount(at.astype(np.int64), minlength=spec.sketch_bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64)


def _bitmaps(column) -> np.ndarray:
    got = column.to_pylist()
    return np.frombuffer(b"".join(got), dtype=U).reshape(len(got), -1)


_FEATURES = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch binary"


def _features(spec: NearDedup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds(spec.bands * spec.rows)
        for batch in batches:
            ids, text = batch.column(0), _text.plain(batch.column(1))
            for lo, hi in _text.chunks(text):
                g, ptr = _text.grams(*_text.words(text.slice(lo, hi - lo), lower=True), spec.words, short=True)
                n, s1, s2, keys, sketch = [], [], [], [], []
                for i in range(hi - lo):
                    x = np.unique(g[ptr[i] : ptr[i + 1]])
                    n.append(len(x))
                    s1.append(int(_text.mix(x, 11).sum(dtype=U).view(np.int64)) if len(x) else 0)
                    s2.append(int(_text.mix(x, 29).sum(dtype=U).view(np.int64)) if len(x) else 0)
                    if len(x):
                        sig = _signature(x, seeds)
                        keys.append(_band_keys(sig, spec.rows).view(np.int64))
                        sketch.append(_odd_sketch(x, spec))
                    else:
                        keys.append(None)
                        sketch.append(None)
                yield pa.record_batch([ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["doc_id", "n_shingles", "s1", "s2", "bands", "sketch"])

    return run


def _sets(spec: NearDedup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0), _text.plain(batch.column(1))
            for lo, hi in _text.chunks(text):
                g, ptr = _text.grams(*_text.words(text.slice(lo, hi - lo), lower=True), spec.words, short=True)
                sets = [np.unique(g[ptr[i] : ptr[i + 1]]).tobytes() for i in range(hi - lo)]
                yield pa.record_batch([ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=U), np.frombuffer(y.as_buffer(), dtype=U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            got = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.record_batch([got.column(0), got.column(1)], names=["a", "b"])

    return run


def _proposals(spec: NearDedup):
    """a, b, their sketches and sizes: the pairs that may be similar enough, and in how many bits they differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = _differ(_bitmaps(batch.column(2)), _bitmaps(batch.column(3)))
            ok = apart <= spec.most_apart(*(batch.column(i).to_numpy().astype(float) for i in (4, 5)))
            got = batch.filter(pa.array(ok))
            yield pa.record_batch([got.column(0), got.column(1), pa.array(apart[ok])], names=["a", "b", "apart"])

    return run


def _within_cells(spec: NearDedup, best_only: bool):
    """Rows sorted by (key, cell): pairs of different components that may be similar enough.

    In a cell of two blocks only pairs across the blocks count. A cell has a bounded number of rows, and one that
    spans Arrow batches is carried over. best_only: of each row only the pair whose sketches differ least.
    """

    def pairs(cell, key, comp, side, size, sketch, bands):
        for lag in range(1, len(cell)):
            i = np.flatnonzero(cell[lag:] == cell[:-lag])
            if not len(i):
                return
            j = i + lag
            ok = (comp[i] != comp[j]) & ((side[i] < 0) | (side[i] != side[j]))
            i, j = i[ok], j[ok]
            if len(i):
                apart = _differ(sketch[i], sketch[j])
                near = apart <= spec.most_apart(size[i], size[j])
                i, j, apart = i[near], j[near], apart[near]
                # A pair that meets in several bands counts in the first of them.
                first = (bands[i] == bands[j]).argmax(1) == (bands[i] == key[i][:, None]).argmax(1)
                yield i[first], j[first], apart[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if not table.num_rows:
                return
            cols = {n: table.column(n).to_numpy() for n in ("key", "cell", "rep", "comp", "side", "n_shingles")}
            new = np.ones(table.num_rows, dtype=bool)
            new[1:] = (cols["key"][1:] != cols["key"][:-1]) | (cols["cell"][1:] != cols["cell"][:-1])
            bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
            got = list(pairs(np.cumsum(new), cols["key"], cols["comp"], cols["side"], cols["n_shingles"].astype(float), _bitmaps(table.column("sketch")), bands))
            if not got:
                return
            i, j, apart = (np.concatenate([g[k] for g in got]) for k in range(3))
            if best_only:
                own = np.concatenate([i, j])
                order = np.lexsort((np.concatenate([j, i]), np.concatenate([apart, apart]), own))
                first = np.ones(len(order), dtype=bool)
                first[1:] = own[order][1:] != own[order][:-1]
                pick = np.unique(order[first] % max(1, len(i)))
                i, j = i[pick], j[pick]
            a, b = np.minimum(cols["rep"][i], cols["rep"][j]), np.maximum(cols["rep"][i], cols["rep"][j])
            one = np.unique(np.stack([a, b], 1), axis=0)
            yield pa.record_batch([pa.array(one[:, 0]), pa.array(one[:, 1])], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            if not table.num_rows:
                continue
            key, cell = table.column("key").to_numpy(), table.column("cell").to_numpy()
            other = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
            last = int(other[-1]) + 1 if len(other) else 0
            yield from emit(table.slice(0, last))
            rest = table.slice(last)
        if rest is not None:
            yield from emit(rest)

    return run


def near_groups(docs: DataFrame, spec: NearDedup = NearDedup(), spark: SparkSession | None = None) -> DataFrame:  # noqa: B008
    """One row per document: doc_id, n_shingles, component_id, kept, class_id.

    Words are lower-cased (A-Z). Documents without words have no shingles and link with nothing; one with fewer words
    than a shingle has its whole sequence as the only one. class_id is the smallest id with the same set. A null doc_id
    links with nothing and has a null component, kept. Rows that repeat a doc_id share its component. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = spark or docs.sparkSession
    scratch = Scratch(spark, "near")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    feats = scratch.keep(text.mapInArrow(_features(spec), _FEATURES))
    live = feats.where("doc_id is not null and n_shingles > 0")

    classes = live.groupBy("s1", "s2").agg(F.min("doc_id").alias("class_id"))
    classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    slim = live.select("doc_id", "n_shingles", "s1", "s2", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int").alias("salt"))
    members = scratch.keep(slim.join(classes, ["s1", "s2", "salt"]).select("doc_id", "n_shingles", "class_id"))
    reps = members.where("doc_id = class_id").select("doc_id").distinct()
    reps = live.join(reps, "doc_id").groupBy("doc_id").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"))
    reps = scratch.keep(reps.withColumnRenamed("doc_id", "rep"))

    # A bucket of one class is of no use; the count and the minimum combine before the shuffle.
    bands = reps.select(F.explode("bands").alias("key"), "rep")
    heads = bands.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("head")).where("size > 1")
    buckets = scratch.keep(bands.join(heads, "key").select("key", "rep", "head"))
    shared = scratch.keep(buckets.select("rep").distinct())
    sets = text.join(shared.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").mapInArrow(_sets(spec), "doc_id long, shingles binary")
    sets = scratch.keep(sets.groupBy("doc_id").agg(F.first("shingles").alias("shingles")))
    sketches = scratch.keep(reps.join(shared, "rep", "left_semi").select("rep", "sketch", "n_shingles", "bands"))

    proposed = buckets.where("rep != head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    of = sketches.select("rep", "sketch", "n_shingles")
    proposed = proposed.join(of.toDF("a", "x", "n"), "a").join(of.toDF("b", "y", "m"), "b")
    proposed = proposed.select("a", "b", "x", "y", "n", "m").mapInArrow(_proposals(spec), "a long, b long, apart long")
    best = proposed.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("best"))
    tested = scratch.keep(best.select(F.col("best.a").alias("a"), "b"))
    links = scratch.keep(_confirmed(tested, sets, spec))
    comp = scratch.keep(components(links, scratch))

    # Buckets that still hold several components: first each class's best partner there, then all that remains.
    for best_only in (True, False):
        cells = _cells(buckets.select("key", "rep"), comp, sketches, spec)
        found = cells.mapInArrow(_within_cells(spec, best_only), "a long, b long").distinct()
        new = scratch.keep(found.join(tested, ["a", "b"], "left_anti"))
        links = scratch.keep(links.union(_confirmed(new, sets, spec)))
        tested = tested.union(new)
        comp = scratch.keep(components(links, scratch))

    scratch.drop_all_but(feats, members, comp)
    found = members.join(comp.withColumnRenamed("node", "class_id"), "class_id", "left")
    found = found.select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"), "class_id")
    none = feats.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    out = found.unionByName(none)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id")


def _cells(buckets: DataFrame, comp: DataFrame, sketches: DataFrame, spec: NearDedup) -> DataFrame:
    """The rows of buckets with several components, in cells of two blocks of rows each, sorted by cell."""
    state = buckets.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = state.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size")).where("c0 != c1").select("key", "size")
    rows = state.join(mixed, "key").join(sketches, "rep")
    rows = rows.withColumn("blocks", F.ceil(F.col("size") / spec.cell).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    rows = rows.select("key", (low * F.col("blocks") + high).cast("long").alias("cell"), "rep", "comp", F.when(low == high, -1).otherwise(F.col("block")).cast("int").alias("side"), "n_shingles", "sketch", "bands")
    return rows.repartition("key", "cell").sortWithinPartitions("key", "cell")


def _confirmed(pairs: DataFrame, sets: DataFrame, spec: NearDedup) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_confirm(spec.percent), "a long, b long")


def keep_one(docs: DataFrame, spec: NearDedup = NearDedup(), spark: SparkSession | None = None) -> DataFrame:  # noqa: B008
    """The documents of which no near duplicate with a smaller id exists, with all their columns."""
    spark = spark or docs.sparkSession
    gone = near_groups(docs, spec, spark).where("not kept").select("doc_id").distinct()
    return docs.join(Scratch(spark, "near-drop").keep(gone), "doc_id", "left_anti").select(*docs.columns)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), NearDedup(words=4), spark).select("doc_id", "n_shingles", "component_id", "kept")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(a[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, a, unnest(range(1, greatest(2, len(a) - 2))) AS i FROM w WHERE len(a) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""
