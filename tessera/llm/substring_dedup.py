"""Removal of long repeats between documents by seed and extend.

Seeds: of the hashes of all runs of `seed` words, each window of `length` words picks the smallest (the rightmost of
equals). The pick depends on the window's words alone, so two equal windows, wherever they stand, share a seed, and
all windows of a document that pick the same occurrence are neighbours. A seed travels with the fingerprints of these
windows: they are its extensions to the left and right up to the length threshold.
Join: occurrences meet by seed hash. A window is removed if the same one is there from a smaller doc_id. Runs of
removed windows are the maximal repeats; their words go in one last pass over the texts.

Pre-aggregation: among the rows of one slice of text, only the smallest doc_id of equal extensions travels; the others
are removed already. A seed inside a passage that a third of all documents hold so sends at most a few rows a slice.
At the passage's ends its seeds meet different extensions in each document. Seeds with more such rows than a task should
have are counted in a pass of their own; their windows travel one by one, each to where its own fingerprint belongs, so
equal windows still meet and the others spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._scratch import Scratch
from ._text import U

#: Bytes of a window's fingerprint. All windows that meet have the same seed, so its 64 bits don't tell them apart.
_MARK = 8


@dataclass(frozen=True)
class Repeats:
    """length: words of a repeat at least; seed: words of an anchor. Each slice holds slice_bytes of text.

    hot: a seed with so many rows is split by window, so a task carries no more marks of one seed; below that, one with
    a share of 1 / hot_share of all rows is, if it has hot_least. There are at most rows / hot, or hot_share, such seeds.
    """

    length: int = 13
    seed: int = 5
    slice_bytes: int = 8 << 20
    hot: int = 500_000
    hot_share: int = 5_000
    hot_least: int = 2_000


def _segments(h: np.ndarray, ptr: np.ndarray, spec: Repeats):
    """Per run of windows with the same seed occurrence: document row, first window, number of windows, seed hash; and all windows' fingerprints."""
    k, n, span = spec.seed, spec.length, spec.length - spec.seed + 1
    if len(h) < n:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, np.zeros(0, dtype=U), np.zeros(0, dtype=U), z
    m = len(h) - n + 1
    seeds = h[: len(h) - k + 1].copy()
    window = h[:m].copy()
    for j in range(1, n):
        if j < k:
            seeds = seeds * U(0xD6E8FEB86659FD93) + h[j : j + len(seeds)]
        window = window * U(0xA0761D6478BD642F) + h[j : j + m]
    seeds, window = _text.mix(seeds, 5), _text.mix(window, 13)
    at = np.arange(m) + (span - 1 - sliding_window_view(seeds[::-1], span).argmin(1)[::-1])
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    inside = row[:m] == row[n - 1 :]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    count = np.add.reduceat(inside.astype(np.int64), first) if len(first) else first
    return row[first], first - ptr[row[first]], count, seeds[at[first]], window, first


def _anchored(text: pa.Array, spec: Repeats):
    """Document row, start, windows, seed, a hash of the extensions, first window and all windows' fingerprints of a slice."""
    out, rows, n = [], 0, 0
    for a, b in _text.chunks(text):
        row, start, count, seed, window, first = _segments(*_text.words(text.slice(a, b - a)), spec)
        whole = window[:0]
        if len(first):
            total = np.zeros(len(window) + 1, dtype=U)
            np.cumsum(_text.mix(window, 3) * (np.arange(len(window), dtype=U) * U(2) + U(1)), out=total[1:])
            flat = np.zeros(len(window) + 1, dtype=U)
            np.cumsum(_text.mix(window, 3), out=flat[1:])
            end = first + count
            whole = (total[end] - total[first]) - (flat[end] - flat[first]) * (first.astype(U) * U(2))
        out.append((row + rows, start, count, seed, _text.mix(whole ^ seed, 1) + count.astype(U), first + n, window))
        rows, n = rows + b - a, n + len(window)
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _least_of_equals(doc: np.ndarray, whole: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by seed and extensions, and the rows of which a smaller doc_id has the same."""
    order = np.lexsort((doc, whole, seed))
    s, w, d = seed[order], whole[order], doc[order]
    head = np.ones(len(order), dtype=bool)
    head[1:] = (s[1:] != s[:-1]) | (w[1:] != w[:-1])
    least = d[np.maximum.accumulate(np.where(head, np.arange(len(d)), 0))] if len(d) else d
    return order, order[d > least]


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def _busy_seeds(spec: Repeats):
    """seed, n: how many rows of a slice a seed would send, where it is more than a few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = _ids(batch.column(0)), _text.plain(batch.column(1))
            for lo, hi in _text.chunks(text, spec.slice_bytes):
                row, _, _, seed, whole, _, _ = _anchored(text.slice(lo, hi - lo), spec)
                order, again = _least_of_equals(ids[lo + row], whole, seed)
                travels = np.ones(len(order), dtype=bool)
                travels[again] = False
                busy, n = np.unique(seed[travels], return_counts=True)
                busy, n = busy[n > 3], n[n > 3]
                # The null seed has the number of rows in all.
                seeds, n = pa.array([None, *busy.view(np.int64).tolist()], pa.int64()), pa.array([int(travels.sum()), *n.tolist()], pa.int64())
                yield pa.record_batch([seeds, n], names=["seed", "n"])

    return run


def _seed_rows(spec: Repeats, hot: np.ndarray):
    """doc_id, start, windows, seed, marks; rows without marks are removals that are certain already. hot: sorted seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = _ids(batch.column(0)), _text.plain(batch.column(1))
            for lo, hi in _text.chunks(text, spec.slice_bytes):
                row, start, count, seed, whole, first, window = _anchored(text.slice(lo, hi - lo), spec)
                if len(hot) and len(seed):
                    split = hot[np.minimum(np.searchsorted(hot, seed), len(hot) - 1)] == seed
                    n = np.where(split, count, 1)
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    row, start, first, of = np.repeat(row, n), np.repeat(start, n) + nth, np.repeat(first, n) + nth, np.repeat(split, n)
                    own = _text.mix(window[first], 21)
                    count, seed, whole = np.where(of, 1, np.repeat(count, n)), np.where(of, own, np.repeat(seed, n)), np.where(of, own, np.repeat(whole, n))
                doc = ids[lo + row]
                offset = np.zeros(len(first) + 1, dtype=np.int64)
                np.cumsum(count * _MARK, out=offset[1:])
                pick = np.repeat(first - offset[:-1] // _MARK, count) + np.arange(offset[-1] // _MARK)
                marks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offset), pa.py_buffer(window[pick].astype("<u8").tobytes())])
                order, again = _least_of_equals(doc, whole, seed)
                sure = np.zeros(len(order), dtype=bool)
                sure[again] = True
                marks = pa.compute.if_else(pa.array(sure), pa.scalar(None, pa.large_binary()), marks).cast(pa.binary())
                # Removals spread over all partitions; only what travels must meet by seed.
                key = np.where(sure, _text.mix(doc.view(U), 9), seed)
                for i in range(0, len(order), 200_000):
                    yield pa.record_batch([pa.array(doc[i : i + 200_000]), pa.array(start[i : i + 200_000].astype(np.int32)), pa.array(count[i : i + 200_000].astype(np.int32)), _text.signed(key[i : i + 200_000]), marks.slice(i, 200_000)], names=["doc_id", "start", "windows", "seed", "marks"])

    return run


def _hot_seeds(text: DataFrame, spec: Repeats, scratch: Scratch) -> np.ndarray:
    """The seeds that are split by window, sorted; a set of bounded size."""
    counts = scratch.keep(text.mapInArrow(_busy_seeds(spec), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")))
    total = counts.where("seed is null").agg(F.sum("n")).first()[0] or 0
    limit = min(spec.hot, max(spec.hot_least, total // spec.hot_share))
    rows = counts.where("seed is not null").where(F.col("n") >= limit).select("seed").toPandas()
    return np.sort(rows["seed"].to_numpy(dtype=np.int64).view(U))


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by seed and doc_id; out: doc_id, start and a bit for each removed window of an occurrence.

    For a seed that spans batches, the marks seen so far are carried with their smallest doc_id.
    """
    open_seed, open_marks, open_least = None, np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    for batch in batches:
        doc, start, count, seed = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        sure = np.asarray(batch.column(4).is_null())
        bits = np.where(sure, (1 << count.astype(np.int64)) - 1, 0)
        live = np.flatnonzero(~sure)
        if len(live):
            data = batch.column(4).drop_null()
            mark = np.frombuffer(b"".join(data.to_pylist()), dtype="<u8").astype(U)
            own = np.repeat(live, count[live])
            nth = np.arange(len(own)) - np.repeat(np.cumsum(count[live]) - count[live], count[live])
            s, d = seed[own], doc[own]
            if open_seed is not None and s[0] == open_seed and len(open_marks):
                s, d, mark = np.concatenate([np.full(len(open_marks), open_seed), s]), np.concatenate([open_least, d]), np.concatenate([open_marks, mark])
                own, nth = np.concatenate([np.full(len(open_marks), -1), own]), np.concatenate([np.zeros(len(open_marks), dtype=np.int64), nth])
            order = np.lexsort((d, mark, s))
            ss, mm, dd = s[order], mark[order], d[order]
            head = np.ones(len(order), dtype=bool)
            head[1:] = (ss[1:] != ss[:-1]) | (mm[1:] != mm[:-1])
            at = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
            hit = order[dd > dd[at]]
            hit = hit[own[hit] >= 0]
            np.bitwise_or.at(bits, own[hit], 1 << nth[hit])
            last = head & (ss == s[-1])
            open_seed, open_marks, open_least = s[-1], mm[last], dd[last]
        out = np.flatnonzero(bits)
        yield pa.record_batch([pa.array(doc[out]), pa.array(start[out]), pa.array(bits[out])], names=["doc_id", "start", "bits"])


def _cut(spec: Repeats, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0), _text.plain(batch.column(1))
            n_words, n_removed, digest, kept = [], [], [], []
            for i in range(len(text)):
                w = text[i].as_buffer().to_pybytes().split()
                hits = batch.column(2)[i]
                gone = 0
                if hits.is_valid and len(w):
                    delta = np.zeros(len(w) + 1, dtype=np.int32)
                    at = hits.values.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    bits = hits.values.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
                    for j in range(spec.length - spec.seed + 1):
                        x = at[(bits >> j) & 1 == 1] + j
                        np.add.at(delta, x, 1)
                        np.add.at(delta, x + spec.length, -1)
                    keep = np.cumsum(delta[:-1]) == 0
                    gone = int((~keep).sum())
                    total = len(w)
                    w = [x for x, k in zip(w, keep, strict=True) if k]
                else:
                    total = len(w)
                joined = b" ".join(w)
                n_words.append(total)
                n_removed.append(gone)
                digest.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode() if texts else None)
            cols = [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.record_batch([*cols, pa.array(kept, pa.string())] if texts else cols, names=[*names, "kept_text"] if texts else names)

    return run


def remove_repeats(docs: DataFrame, spec: Repeats = Repeats(), spark: SparkSession | None = None, *, texts: bool = False) -> DataFrame:  # noqa: B008
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and with texts also kept_text.

    A repeat inside one document alone stays. Null and empty texts have no words. A null doc_id takes no part: its text
    is returned whole. Rows that repeat a doc_id count as one document and lose the same windows' words by position.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = spark or docs.sparkSession
    scratch = Scratch(spark, "repeats")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = text.where("doc_id is not null")
    rows = known.mapInArrow(_seed_rows(spec, _hot_seeds(known, spec, scratch)), "doc_id long, start int, windows int, seed long, marks binary")
    met = rows.repartition("seed").sortWithinPartitions("seed", "doc_id")
    hits = scratch.keep(met.mapInArrow(_extend, "doc_id long, start int, bits long"))
    by_doc = hits.groupBy("doc_id").agg(F.collect_list(F.struct("start", "bits")).alias("hits"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return text.join(by_doc, "doc_id", "left").select("doc_id", "text", "hits").mapInArrow(_cut(spec, texts), schema)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), Repeats(), spark)


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
s AS (SELECT doc_id, i, array_to_string(a[i:i + 12], ' ') AS g FROM (SELECT doc_id, a, unnest(range(1, len(a) - 11)) AS i FROM w WHERE len(a) >= 13)),
m AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g),
c AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS gone FROM s JOIN m USING (g) WHERE doc_id > first GROUP BY doc_id),
k AS (SELECT w.doc_id, len(a) AS n, coalesce(len(gone), 0) AS r, CASE WHEN gone IS NULL THEN a ELSE list_filter(a, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, n AS n_words, r AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
