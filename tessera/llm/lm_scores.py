"""Stupid-backoff scores of documents under the corpus's own n-gram counts, without the document itself.

1. Documents are packed into blocks of a few MB of text, a table of its own, so that every later pass sees the same ones.
2. Each block's n-grams of all orders are exploded and counted; they go, partitioned by hash, to the count tables. A row
   of that exchange holds one block's share of one part of the hash space as packed arrays, so a word that every
   document has costs an entry for each block, not one for each document, and no key can fill a task.
3. In each part the count table is the sum over all blocks. It is joined to the blocks' n-grams of that part, and the
   counts go back to their block. The parts are taken in slices of the hash space, one after the other, so the exchange
   on disk is a fraction of what all n-grams need.
4. Each block meets its texts again in a merge join by block; documents take themselves off the counts, back off where
   no other document has the n-gram, and sum up.
The number of parts follows the number of words, so a task's share stays the same at any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._scratch import Scratch
from ._text import U

#: Hash of the places before a text's first word.
START = 1


@dataclass(frozen=True)
class Backoff:
    """alpha: factor of a back-off; order: words of the longest n-gram; block_bytes: text of a block, unless one document
    has more; part_words: words for each part of the hash space; slices: that the parts are taken in."""

    alpha: float = 0.4
    order: int = 2
    block_bytes: int = 2 << 20
    part_words: int = 500_000
    slices: int = 2


_BLOCK = "block long, n_words long, doc_ids array<long>, texts array<string>"


def _blocks(spec: Backoff):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, texts, size = TaskContext.get().partitionId() << 33, [], [], 0

        def row() -> pa.RecordBatch:
            text = pa.concat_arrays(texts)
            n = len(_text.words(text)[0])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(text)], pa.int32()), v) for v in (pa.concat_arrays(ids), text.cast(pa.string()))]
            return pa.record_batch([pa.array([block]), pa.array([n]), *lists], names=["block", "n_words", "doc_ids", "texts"])

        for batch in batches:
            every, text = batch.column(0).cast(pa.int64()), _text.plain(batch.column(1))
            for lo, hi in _text.chunks(text, spec.block_bytes // 8):
                ids.append(every.slice(lo, hi - lo))
                texts.append(text.slice(lo, hi - lo))
                size += int(np.diff(_text.raw(texts[-1])[1]).sum())
                if size >= spec.block_bytes:
                    yield row()
                    block, ids, texts, size = block + 1, [], [], 0
        if ids:
            yield row()

    return run


def _grams(text: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the 1-grams to order-grams that end at each place, the places of words, and the range of each row's words.

    Before the words of a row stand order - 1 places of START.
    """
    w, ptr = _text.words(text, lower=True)
    size, pad = np.diff(ptr), order - 1
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(w)) + pad * (row + 1)
    seq = np.full(len(w) + pad * len(size), START, dtype=U)
    seq[at] = w
    levels = [_text.mix(seq, 1)]
    for k in range(2, order + 1):
        level = np.zeros_like(seq)
        level[1:] = _text.mix(_text.mix(levels[-1][:-1], 7) * U(3) + seq[1:], k)
        levels.append(level)
    return levels, at, ptr


def _counted(levels: list[np.ndarray], at: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct n-grams in order of hash, with their counts. The lower orders also count once before each text."""
    first = at[ptr[:-1][np.diff(ptr) > 0]] - 1
    every = [level[at] for level in levels] + [level[first] for level in levels[:-1]]
    return np.unique(np.concatenate(every), return_counts=True)


def _bounds(grams: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins in sorted hashes: part p holds those from p / parts of the hash space on."""
    edge = np.array([(p << 64) // parts for p in range(parts)], dtype=U)
    return np.append(np.searchsorted(grams, edge), len(grams))


def _shares(spec: Backoff, parts: int, mine: range):
    """part, block, grams, n: a block's sorted distinct n-grams in one part, as arrays of 8 bytes, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch.column(0).to_pylist()):
                grams, n = _counted(*_grams(_text.plain(batch.column(1).slice(i, 1).flatten()), spec.order))
                cut, n = _bounds(grams, parts), n.astype("<u4")
                some = [p for p in mine if cut[p] < cut[p + 1]]
                packed = [[x[cut[p] : cut[p + 1]].tobytes() for p in some] for x in (grams, n)]
                yield pa.record_batch([pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), *(pa.array(x, pa.binary()) for x in packed)], names=["part", "block", "grams", "n"])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part: the part's count table, joined to each block's n-grams: part, block, counts in their order."""
    now, blocks, grams, counts = None, [], [], []

    def table() -> Iterator[pa.RecordBatch]:
        if not blocks:
            return
        every = np.concatenate(grams)
        distinct, where = np.unique(every, return_inverse=True)
        total = np.bincount(where, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
        wide = bool(total.max() >> 32)
        edge = np.cumsum([0, *map(len, grams)])
        out = [total[where[a:b]].astype("<i8" if wide else "<u4").tobytes() for a, b in zip(edge, edge[1:], strict=False)]
        yield pa.record_batch([pa.array([now] * len(out), pa.int32()), pa.array(blocks, pa.int64()), pa.array(out, pa.binary()), pa.array([wide] * len(out))], names=["part", "block", "counts", "wide"])

    for batch in batches:
        for part, block, g, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if part != now:
                yield from table()
                now, blocks, grams, counts = part, [], [], []
            blocks.append(block)
            grams.append(np.frombuffer(g.as_buffer().to_pybytes(), dtype="<u8"))
            counts.append(np.frombuffer(n.as_buffer().to_pybytes(), dtype="<u4"))
    yield from table()


def _own(grams: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each place's n-gram stands in its own document."""
    _, back, n = np.unique(_text.mix(grams ^ _text.mix(doc, 3)), return_inverse=True, return_counts=True)
    return n[back]


def _logs(text: pa.Array, counts: np.ndarray, total: int, spec: Backoff) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: words, words whose longest n-gram other documents have, and the sum of log scores."""
    levels, at, ptr = _grams(text, spec.order)
    size = np.diff(ptr)
    if not len(at):
        return size, size, np.zeros(len(size))
    grams, _ = _counted(levels, at, ptr)
    row = np.repeat(np.arange(len(size)), size)
    doc = row.astype(U)
    logp, open_, seen = np.zeros(len(at)), np.ones(len(at), dtype=bool), np.zeros(len(at), dtype=bool)
    for k in range(spec.order, 0, -1):
        factor = spec.alpha ** (spec.order - k)
        here = levels[k - 1][at]
        others = counts[np.searchsorted(grams, here)] - _own(here, doc)
        if k == 1:
            value = np.log(factor * np.maximum(others, 1) / total)
            logp[open_] = value[open_]
            break
        context = levels[k - 2][at - 1]
        left = counts[np.searchsorted(grams, context)] - _own(context, doc)
        hit = open_ & (others > 0)
        logp[hit] = np.log(factor * others[hit] / np.maximum(left, others)[hit])
        if k == spec.order:
            seen = hit
        open_ &= ~hit
    return size, np.bincount(row, weights=seen, minlength=len(size)).astype(np.int64), np.bincount(row, weights=logp, minlength=len(size))


_SCORES = "doc_id long, n_words long, n_seen long, log_score double"


def _score(spec: Backoff, total: int):
    """Rows sorted by block and part, the texts first: each block's counts in order of hash are the parts' one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = None, []

        def scored() -> Iterator[pa.RecordBatch]:
            if held is not None:
                every = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
                size, seen, logs = _logs(held[1], every, total, spec)
                yield pa.record_batch([held[0], pa.array(size, pa.int64()), pa.array(seen, pa.int64()), pa.array(logs, pa.float64())], names=["doc_id", "n_words", "n_seen", "log_score"])

        for batch in batches:
            for i, part in enumerate(batch.column(1).to_pylist()):
                if part < 0:
                    yield from scored()
                    held, counts = (batch.column(2).slice(i, 1).flatten(), _text.plain(batch.column(3).slice(i, 1).flatten())), []
                else:
                    counts.append(np.frombuffer(batch.column(4)[i].as_buffer().to_pybytes(), dtype="<i8" if batch.column(5)[i].as_py() else "<u4").astype(np.int64))
        yield from scored()

    return run


def scores(docs: DataFrame, spec: Backoff = Backoff(), spark: SparkSession | None = None) -> DataFrame:  # noqa: B008
    """One row per row of docs: doc_id, n_words, n_seen, log_score, mean_log.

    n_seen: words whose longest n-gram other rows hold. A word that no other row holds counts as occurring once. Null and
    empty texts have no words, a log_score of 0 and a null mean. Each row is a document of its own: rows that repeat a
    doc_id or have none are scored each, and count for one another. An empty table gives an empty result; other columns
    are ignored.
    """
    spark = spark or docs.sparkSession
    scratch = Scratch(spark, "lm", long_rows=True)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = scratch.keep(text.mapInArrow(_blocks(spec), _BLOCK))
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    parts = max(spec.slices, -(-total // spec.part_words))
    counted = []
    for s in range(spec.slices):
        mine = range(parts * s // spec.slices, parts * (s + 1) // spec.slices)
        shares = blocks.select("block", "texts").mapInArrow(_shares(spec, parts, mine), "part int, block long, grams binary, n binary")
        met = shares.repartition("part").sortWithinPartitions("part")
        counted.append(scratch.keep(met.mapInArrow(_joined, "part int, block long, counts binary, wide boolean")))
    rows = blocks.select("block", F.lit(-1).alias("part"), "doc_ids", "texts", F.lit(None).cast("binary").alias("counts"), F.lit(False).alias("wide"))
    for c in counted:
        rows = rows.unionByName(c, allowMissingColumns=True)
    rows = rows.repartition("block").sortWithinPartitions("block", "part")
    out = scratch.keep(rows.mapInArrow(_score(spec, max(1, total)), _SCORES))
    scratch.drop(blocks, *counted)
    return out.withColumn("mean_log", F.col("log_score") / F.nullif(F.col("n_words"), F.lit(0)))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), Backoff(), spark)
    return out.select("doc_id", "n_words", "n_seen", F.round("mean_log", 4).alias("mean_log"))


SQL = r"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
p AS (SELECT doc_id, unnest(a) AS w, unnest(list_concat([NULL], a[:-2])) AS u FROM t WHERE len(a) > 0),
d AS (SELECT doc_id, u, w, count(*) AS n FROM p GROUP BY ALL),
b AS (SELECT u, w, count(*) AS c FROM p GROUP BY ALL),
uni AS (SELECT w, count(*) AS c FROM p GROUP BY w UNION ALL SELECT NULL, count(DISTINCT doc_id) FROM p),
du AS (SELECT doc_id, u, count(*) AS n FROM p GROUP BY ALL),
dw AS (SELECT doc_id, w, count(*) AS n FROM p GROUP BY ALL),
s AS (
  SELECT d.doc_id, d.n, b.c > d.n AS seen,
    CASE WHEN b.c > d.n THEN ln((b.c - d.n) / greatest(cu.c - du.n, b.c - d.n)) ELSE ln(0.4 * greatest(cw.c - dw.n, 1) / (SELECT count(*) FROM p)) END AS lp
  FROM d JOIN b ON b.u IS NOT DISTINCT FROM d.u AND b.w = d.w
  JOIN uni cu ON cu.w IS NOT DISTINCT FROM d.u JOIN uni cw ON cw.w = d.w
  JOIN du ON du.doc_id = d.doc_id AND du.u IS NOT DISTINCT FROM d.u JOIN dw ON dw.doc_id = d.doc_id AND dw.w = d.w)
SELECT o.doc_id, coalesce(sum(s.n), 0)::BIGINT AS n_words, coalesce(sum(CASE WHEN seen THEN s.n ELSE 0 END), 0)::BIGINT AS n_seen, round(sum(lp * s.n) / sum(s.n), 4) AS mean_log
FROM documents o LEFT JOIN s USING (doc_id) GROUP BY o.doc_id
"""
