"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ in e = m * percent / 100 edits. Of its e + 1 pieces at least one then stands
unchanged in a text that holds it, so all pieces go into one Aho-Corasick automaton, and around each piece hit Myers'
bit-parallel algorithm computes the least edit distance of the whole item within the stretch it must lie in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._scratch import Scratch, small_batches


@dataclass(frozen=True)
class Matching:
    """percent: edits allowed for each hundred characters; shortest: items of fewer characters match as whole words, unchanged.

    Items are taken in blocks of at most block_chars characters, each matched against all rows, so what a task holds
    of the items has a fixed bound.
    """

    percent: int = 5
    shortest: int = 20
    block_chars: int = 8_000_000


def fold(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of near equal length, with their offsets."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers(pattern: str, text: str, most: int) -> int:
    """Least edit distance of pattern to any part of text, or most + 1 if it is above most."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best = score
            if not best:
                break
    return min(best, most + 1)


class Items:
    """The pieces of a block of items, ready to match; pickles as plain lists."""

    def __init__(self, items: list[tuple[int, str]], spec: Matching):
        self.spec = spec
        self.items = [(i, fold(t)) for i, t in items]
        self._automaton = self._short = None

    def __getstate__(self):
        return {"spec": self.spec, "items": self.items, "_automaton": None, "_short": None}

    def budget(self, item: str) -> int:
        return len(item) * self.spec.percent // 100

    def automaton(self):
        if self._automaton is None:
            where: dict[str, list[tuple[int, int]]] = {}
            for k, (_, item) in enumerate(self.items):
                if len(item) >= self.spec.shortest:
                    for at, piece in pieces(item, self.budget(item)):
                        where.setdefault(piece, []).append((k, at))
            self._automaton = ahocorasick.Automaton()
            for piece, places in where.items():
                self._automaton.add_word(piece, (len(piece), places))
            if where:
                self._automaton.make_automaton()
        return self._automaton

    def short(self):
        """An automaton of the items too short for edits, with their ids."""
        if self._short is None:
            ids: dict[str, list[int]] = {}
            for item_id, item in self.items:
                if 0 < len(item) < self.spec.shortest:
                    ids.setdefault(item, []).append(item_id)
            self._short = ahocorasick.Automaton()
            for item, of in ids.items():
                self._short.add_word(item, (len(item), of))
            if ids:
                self._short.make_automaton()
        return self._short

    def find(self, text: str) -> dict[int, int]:
        """item_id -> least distance, of the items within their budget."""
        a, short, found, tried = self.automaton(), self.short(), {}, {}
        if not len(a) and not len(short):
            return found
        text = fold(text)
        for end, (n, of) in short.iter(text) if len(short) else ():
            # No letter or digit goes on across either end.
            if not (text[end].isalnum() and text[end + 1 : end + 2].isalnum()) and not (text[end + 1 - n].isalnum() and end >= n and text[end - n].isalnum()):
                found.update(dict.fromkeys(of, 0))
        if not len(a):
            return found
        for end, (n, places) in a.iter(text):
            for k, at in places:
                item_id, item = self.items[k]
                if found.get(item_id) == 0:
                    continue
                e = self.budget(item)
                start = end + 1 - n - at
                # Hits of one alignment lie within e of each other; a stretch is verified once.
                if start in tried.setdefault(k, set()):
                    continue
                tried[k].add(start)
                lo, hi = max(0, start - e), start + len(item) + e
                d = 0 if text.startswith(item, max(0, start)) and start >= 0 else myers(item, text[lo:hi], e)
                if d <= e and d < found.get(item_id, e + 1):
                    found[item_id] = d
        return found


def _match(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sorted(items.find(t.as_py()).items()) for t in _text.plain(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array([[i for i, _ in g] for g in got], pa.list_(pa.int64())), pa.array([[d for _, d in g] for g in got], pa.list_(pa.int32()))], names=["doc_id", "item_ids", "distances"])

    return run


def _blocks(benchmark: DataFrame, spec: Matching) -> Iterator[Items]:
    """The items in blocks; a block has a bounded number of characters beside its last item."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    block, size = [], 0
    for r in rows.distinct().orderBy("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size >= spec.block_chars:
            yield Items(block, spec)
            block, size = [], 0
    if block:
        yield Items(block, spec)


def contamination(docs: DataFrame, benchmark: DataFrame, spec: Matching = Matching()) -> DataFrame:  # noqa: B008
    """One row per document: doc_id, contaminated, item_ids (sorted), distances.

    Case and white space don't count. Items with nulls match nothing, and those shorter than spec.shortest only as
    whole words. Null and empty texts hold nothing; rows that repeat are matched each, however many blocks the items
    take; an empty table gives an empty result, and an empty benchmark finds every document clean. Other columns are
    ignored.
    """
    small_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = _blocks(benchmark, spec)
    first, second = next(blocks, None), next(blocks, None)
    schema = "item_ids array<long>, distances array<int>"
    if first is None:
        out = text.select("doc_id", F.expr("cast(array() as array<long>) item_ids"), F.expr("cast(array() as array<int>) distances"))
    elif second is None:
        out = text.mapInArrow(_match(first), f"doc_id long, {schema}")
    else:
        # Rows have keys of their own, written once, so that all blocks see the same ones.
        scratch = Scratch(docs.sparkSession, "leaks")
        keyed = scratch.keep(text.withColumn("row", F.monotonically_increasing_id()))
        hits = None
        for items in chain((first, second), blocks):
            # One block at a time: neither the driver nor a plan ever holds several.
            part = scratch.keep(keyed.select(F.col("row").alias("doc_id"), "text").mapInArrow(_match(items), f"doc_id long, {schema}").where("size(item_ids) > 0"))
            hits = part if hits is None else hits.union(part)
        z = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("item_ids", "distances"))))
        hits = hits.groupBy(F.col("doc_id").alias("row")).agg(z.alias("z"))
        # An id whose texts are in several blocks stands once, with its least distance.
        once = F.filter("z", lambda x, i: (i == 0) | (F.get("z", i - 1)["item_ids"] != x["item_ids"]))
        hits = hits.select("row", once.alias("z"))
        none = "cast(array() as array<struct<item_ids:long,distances:int>>)"
        out = keyed.select("row", "doc_id").join(hits, "row", "left").select("doc_id", F.coalesce("z", F.expr(none)).alias("z"))
        out = out.select("doc_id", F.col("z.item_ids").alias("item_ids"), F.col("z.distances").alias("distances"))
    return out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "distances")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, spec: Matching = Matching()) -> DataFrame:  # noqa: B008
    """The documents that hold no item, with all their columns."""
    small_batches(docs.sparkSession)
    blocks = _blocks(benchmark, spec)
    first, second = next(blocks, None), next(blocks, None)
    text = F.col("text").cast("string")
    if first is None:
        return docs
    if second is None:
        return docs.where(~_holds(first)(text))
    scratch = Scratch(docs.sparkSession, "leaks-drop")
    keyed = scratch.keep(docs.select(F.struct("*").alias("row"), text.alias("text"), F.monotonically_increasing_id().alias("key")))
    hits = None
    for items in chain((first, second), blocks):
        part = scratch.keep(keyed.where(_holds(items)(F.col("text"))).select("key"))
        hits = part if hits is None else hits.union(part)
    return keyed.join(hits.distinct(), "key", "left_anti").select("row.*")


def _holds(items: Items):
    @F.pandas_udf("boolean")
    def holds(text: pd.Series) -> pd.Series:
        return pd.Series([bool(items.find(t or "")) for t in text], dtype=bool)

    return holds


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, benchmark)
