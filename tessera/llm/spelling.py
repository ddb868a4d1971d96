"""Spelling variants: words that differ by one code point, by rolling-hash deletions.

1. Words of whole texts are counted, batch by batch and then over all documents.
2. Each word gets a 64-bit key of what is left without its i-th code point, for every i, and one of itself. A polynomial
   hash of the part before i and one of the part after i, both from running sums over all words of a batch, make the
   keys in a few NumPy operations. Two words are one replacement apart if they leave the same rest at the same place, and
   one insertion apart if one is what the other leaves.
3. Keys are dealt by their leading bits, sorted in NumPy, and rows whose key no other word shares with them go.
4. What stays is grouped by the rest itself, a string, so that keys that merely collide link nothing. A group is one
   place of a rest, with a word for each letter of the alphabet at most, or a rest that is a word and the words that hold
   one letter more. Its words learn of each other from its size and its first two, so no pairs are made.
5. Each word follows its most frequent near word if that is frequent enough, and these links lead to its root.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._scratch import Scratch
from ._text import U

_BATCH = 4 << 20
_POINTS = 1 << 18
_BASE = 0xC2B2AE3D27D4EB4F
#: Runs of more bytes are hashed one by one.
_LONG = 64
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32


@dataclass(frozen=True)
class Spelling:
    """every: occurrences whose hash it divides are read with one code point missing, 0 for none; shortest, least: code
    points and occurrences of a word; ratio: how many times a word's own count its form needs; keys: about so many a task."""

    every: int = 97
    shortest: int = 5
    least: int = 3
    ratio: int = 2
    keys: int = 1_000_000


def _zero_byte() -> np.ndarray:
    """What one zero byte makes of each state of a CRC-32 below 256."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(0xEDB88320), state >> 1)
    return state


_ZERO = _zero_byte()


def runs(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs [A-Za-z\\u00C0-\\u00FF]+ of a large_string array, A-Z lower-cased, and the row of each."""
    data, off = _text.raw(text)
    n = len(data)
    if not n:
        return pa.array([], pa.large_string()), np.zeros(0, dtype=np.int64)
    # U+00C0 to U+00FF are the two-byte sequences that begin with C3.
    wide = data == 0xC3
    member = _LETTER[data] | wide
    member[1:] |= wide[:-1]
    first, last = member.copy(), member.copy()
    joined = member[1:] & member[:-1]
    first[1:] &= ~joined
    last[:-1] &= ~joined
    cut = off[(off > 0) & (off < n)]
    first[cut], last[cut - 1] = member[cut], member[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    ptr = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(end - start, out=ptr[1:])
    body = np.ascontiguousarray(_FOLDED[data[member]])
    found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ptr), pa.py_buffer(body))
    return found, np.searchsorted(off, start, side="right") - 1


def _crc(names: list[bytes], row: np.ndarray, code: np.ndarray, size: np.ndarray, words: list[bytes]) -> np.ndarray:
    """crc32 of names[row] + words[code] for every occurrence.

    The CRC of a joined text is that of its first part, carried over as many zero bytes as the second has, and that of
    the second, added without carry. So each name is hashed once and each word once; size is of the occurrence's word.
    """
    own = np.array([zlib.crc32(w) if len(w) <= _LONG else 0 for w in words], dtype=np.uint32)
    state = np.array([zlib.crc32(x) for x in names], dtype=np.uint32)
    order = np.argsort(size, kind="stable")
    most = min(_LONG, int(size.max(initial=0)))
    cut = np.searchsorted(size[order], np.arange(1, most + 2))
    out = np.zeros(len(row), dtype=np.uint32)
    for n in range(most):
        state = _ZERO[state & 255] ^ (state >> 8)
        at = order[cut[n] : cut[n + 1]]
        out[at] = state[row[at]] ^ own[code[at]]
    for i in order[cut[-1] :]:
        out[i] = zlib.crc32(names[row[i]] + words[code[i]])
    return out


def _count(ids: list, text: pa.Array, spec: Spelling) -> Counter:
    """Occurrences of the words of some rows, after the change of those whose hash spec.every divides."""
    found, row = runs(text)
    coded = found.dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy()
    points = pc.utf8_length(words).to_numpy()
    # A word that is too short stays so with a code point less.
    long = points[code] >= spec.shortest
    code, row = code[long], row[long]
    changed = np.zeros(len(code), dtype=bool)
    out: Counter = Counter()
    if spec.every:
        names = [b":" if i is None else b"%d:" % i for i in ids]
        h = _crc(names, row, code, pc.binary_length(words).to_numpy()[code], [w.encode() for w in words.to_pylist()])
        changed = h % spec.every == 0
        for i in np.flatnonzero(changed):
            w = words[code[i]].as_py()
            at = int(h[i]) % len(w)
            if len(w) > spec.shortest:
                out[w[:at] + w[at + 1 :]] += 1
    n = np.bincount(code[~changed], minlength=len(words))
    there = np.flatnonzero(n)
    for w, k in zip(words.take(pa.array(there)).to_pylist(), n[there].tolist(), strict=True):
        out[w] += k
    return out


def vocabulary(docs: DataFrame, spec: Spelling = Spelling()) -> DataFrame:  # noqa: B008
    """word, n: words of at least spec.shortest code points that occur spec.least times in all texts, changes made.

    A null text has no words, a row that repeats counts again, a null doc_id stands as nothing before the colon.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0).to_pylist(), _text.plain(batch.column(1))
            for lo, hi in _text.chunks(text, _BATCH):
                n = _count(ids[lo:hi], text.slice(lo, hi - lo), spec)
                yield pa.record_batch([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["word", "n"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= spec.least)


def deletions(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every word and code point the key of the word without it, then the keys of whole words with place -1.

    Returns key, word (its number), place, and whether the code point begins a run of equal ones: the others of a run
    leave the same rest.
    """
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    size = np.array([len(w) for w in words], dtype=np.int64)
    start = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(size, out=start[1:])
    n = len(flat)
    up, down = _text.powers(_BASE, n + 1), _text.powers(pow(_BASE, -1, 1 << 64), n + 2)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum(_text.mix(flat.astype(U), 0x5EED) * up[:n], out=total[1:])
    word, at = np.repeat(np.arange(len(words)), size), np.arange(n)
    begin, end = start[word], start[word + 1]
    rest = ((total[at] - total[begin]) + (total[end] - total[at + 1]) * down[1]) * down[begin]
    whole = (total[start[1:]] - total[start[:-1]]) * down[start[:-1]]
    head = np.ones(n, dtype=bool)
    head[1:] = (flat[1:] != flat[:-1]) | (begin[1:] == at[1:])
    key = _text.mix(np.concatenate([rest, whole]))
    place = np.concatenate([at - begin, np.full(len(words), -1)])
    return key, np.concatenate([word, np.arange(len(words))]), place, np.concatenate([head, np.zeros(len(words), dtype=bool)])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, words = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        upto = np.cumsum([len(w) + 1 for w in words])
        for part in np.split(np.arange(len(words)), np.flatnonzero(np.diff(upto // _POINTS)) + 1):
            if len(part):
                key, word, place, head = deletions([words[i] for i in part])
                yield pa.record_batch([_text.signed(key), pa.array(ids[part][word]), pa.array(place, pa.int32()), pa.array(head)], names=["key", "id", "place", "head"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and place of keys that several words share in a way that may make them near; slot: the place that words share,
    or -1 between a word and those with one letter more."""
    parts = list(batches)
    if not sum(b.num_rows for b in parts):
        return
    t = pa.Table.from_batches(parts)
    key, ids, place, head = (t.column(c).to_numpy() for c in ("key", "id", "place", "head"))
    order = np.lexsort((place, key))
    key, ids, place, head = key[order], ids[order], place[order], head[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    cell = first.copy()
    cell[1:] |= place[1:] != place[:-1]
    group, spot = np.cumsum(first) - 1, np.cumsum(cell) - 1
    replaced = (place >= 0) & (np.bincount(spot)[spot] > 1)
    whole, longer = np.bincount(group, place < 0) > 0, np.bincount(group, head) > 0
    shifted = (head | (place < 0)) & (whole & longer)[group]
    for some, slot in ((replaced, place), (shifted, np.full(len(place), -1, dtype=np.int32))):
        yield pa.record_batch([pa.array(ids[some]), pa.array(place[some], pa.int32()), pa.array(slot[some], pa.int32())], names=["id", "place", "slot"])


def near_words(words: DataFrame, spec: Spelling = Spelling()) -> DataFrame:  # noqa: B008
    """id, n_near, best: of every word (id, word, n) with near words their number and the most frequent, (-n, word, id).

    The rows of an alphabet of 90 letters bound a group: 90 words at a place, or 90 for each place of a longer word.
    """
    total = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    keys = words.select("id", "word").mapInArrow(_keyed, "key long, id long, place int, head boolean")
    keys = keys.repartition(math.ceil(total / spec.keys) or 1, F.shiftrightunsigned("key", 48))
    shared = keys.mapInArrow(_shared, "id long, place int, slot int").join(words, "id")
    rest = F.expr("if(place < 0, word, concat(substring(word, 1, place), substring(word, place + 2)))")
    word = F.struct((-F.col("n")).alias("n"), "word", "id")
    cells = shared.groupBy(rest.alias("rest"), "slot").agg(F.array_sort(F.collect_list(F.when(F.col("place") >= 0, word))).alias("all"), F.min(F.when(F.col("place") < 0, word)).alias("whole"))
    said = lambda m, n, best: F.struct(m["id"].alias("id"), n.cast("long").alias("n_near"), best.alias("best"))
    replaced = F.transform("all", lambda m, i: said(m, F.size("all") - 1, F.when(i == 0, F.get("all", F.lit(1))).otherwise(F.get("all", F.lit(0)))))
    shifted = F.concat(F.transform("all", lambda m: said(m, F.lit(1), F.col("whole"))), F.array(said(F.col("whole"), F.size("all"), F.get("all", F.lit(0)))))
    own = cells.where("if(slot < 0, whole is not null and size(all) > 0, size(all) > 1)").select(F.inline(F.when(F.col("slot") < 0, shifted).otherwise(replaced)))
    return own.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, root: where the links (id, to, word) of a forest end, as (id, word); each round doubles the way that a link goes.

    A form is at least twice as frequent as its word where ratio is 2, so a way has at most the logarithm of the largest
    count of links, and rounds are the logarithm of that.
    """
    now = scratch.keep(links)
    while True:
        ahead = now.select(F.col("id").alias("to"), F.struct(F.col("to").alias("id"), "word").alias("next"))
        new = now.join(ahead, "to", "left").select("id", F.coalesce("next.id", "to").alias("to"), F.coalesce("next.word", "word").alias("word"), F.col("next").isNotNull().alias("moved"))
        new = scratch.keep(new)
        scratch.drop(now)
        if not new.where("moved").limit(1).count():
            return new.select("id", F.col("word").alias("root"))
        path = new._scratch_path
        now = new.drop("moved")
        now._scratch_path = path


def variants(docs: DataFrame, spec: Spelling = Spelling(), spark: SparkSession | None = None) -> DataFrame:  # noqa: B008
    """word, form, root, n, n_near, form_n of every word of vocabulary().

    form is the near word of largest n, ties to the first in code point order, if its n is at least ratio times the
    word's own, else null as form_n is; root is where forms lead from the word, or the word itself. A ratio of 1 or less
    could lead in circles and is an error. Tables without words give no rows; other columns are ignored.
    """
    if spec.ratio < 2:
        raise ValueError("ratio must be 2 or more")
    spark = spark or docs.sparkSession
    scratch = Scratch(spark, "spelling")
    words = scratch.keep(vocabulary(docs, spec).withColumn("id", F.monotonically_increasing_id()))
    near = scratch.keep(near_words(words, spec))
    told = words.join(near, "id", "left").withColumn("better", F.when(-F.col("best.n") >= F.col("n") * spec.ratio, F.col("best")))
    told = scratch.keep(told.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "better"))
    scratch.drop(words, near)
    ends = roots(told.where("better is not null").select("id", F.col("better.id").alias("to"), F.col("better.word").alias("word")), scratch)
    out = told.join(ends, "id", "left")
    return out.select("word", F.col("better.word").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("better.n")).alias("form_n"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), Spelling(), spark)
