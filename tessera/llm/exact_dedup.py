"""Exact deduplication in two passes, with DataFrame operations only.

Pass one reads the texts once and keeps (doc_id, digest), in slices of the digests' hash space. For each slice a
two-probe Bloom filter, whose cells count to two, tells which of its digests may be repeated. The filter has so many bits
for each row of the slice, and the number of slices follows the number of rows, so that a filter never fills up and its
bitmaps, which are broadcast, keep within a fixed bound at any size of the input.
Pass two shuffles only the slim rows that the filters let through; the others are groups of one and pass straight on.
A false positive costs a shuffled row, never a wrong result. Texts never move.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import Scratch

_PAGE = 32768
_SALTS = 16


@dataclass(frozen=True)
class Bloom:
    """bits_per_row: with 16, about one unique row in 70 passes the filter; max_bits: of one slice's filter, 2**28 bits are
    32 MB to broadcast."""

    bits_per_row: int = 16
    max_bits: int = 1 << 28


def normalized(text: Column) -> Column:
    """Each run of [\\x20\\x09-\\x0D] becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _bit(page: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(page, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def _probes(bits: int, digest: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(bits)) for k in (1, 2)]


def _pages(cells: DataFrame) -> DataFrame:
    """(page, bitmap) of the cells; at most bits / 32768 pages of 4 KB."""
    page = F.floor(F.col("cell") / _PAGE).cast("long").alias("page")
    return cells.groupBy(page).agg(F.bitmap_construct_agg(F.col("cell") % _PAGE).alias("bitmap"))


def _cells(keys: DataFrame, bits: int) -> DataFrame:
    return keys.select(F.explode(F.array(*_probes(bits, F.col("digest")))).alias("cell"))


def repeated_filter(keys: DataFrame, bits: int) -> DataFrame:
    """Pages of the cells that two rows or more hit."""
    return _pages(_cells(keys, bits).groupBy("cell").agg(F.count("*").alias("n")).where("n >= 2"))


def _bits(rows: int, bloom: Bloom) -> int:
    bits = _PAGE
    while bits < min(bloom.max_bits, bloom.bits_per_row * rows):
        bits *= 2
    return bits


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(normalized(text.cast("string")), "UTF-8"), 256))


def _slice(digest: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(3)), F.lit(slices)).cast("int")


def _may_repeat(rows: DataFrame, pages: DataFrame, bits: int) -> DataFrame:
    """rows with hit: both cells of the digest are hit twice or more. No shuffle: the pages are broadcast."""
    kept = rows.columns
    for k, probe in enumerate(_probes(bits, F.col("digest"))):
        side = pages.select(F.col("page").alias(f"page{k}"), F.col("bitmap").alias(f"bitmap{k}"))
        rows = rows.withColumn(f"cell{k}", probe).withColumn(f"page{k}", F.floor(F.col(f"cell{k}") / _PAGE).cast("long"))
        rows = rows.join(F.broadcast(side), f"page{k}", "left").withColumn(f"hit{k}", _bit(F.col(f"bitmap{k}"), F.col(f"cell{k}") % _PAGE))
    return rows.select(*kept, (F.col("hit0") & F.col("hit1")).alias("hit"))


def _first_pass(docs: DataFrame, scratch: Scratch, bloom: Bloom) -> DataFrame:
    """doc_id, digest and hit: whether the filter says that the digest may be repeated."""
    keys = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(F.col("text")).alias("digest")))
    rows = keys.count()
    slices = max(1, -(-rows * bloom.bits_per_row // bloom.max_bits))
    bits = _bits(-(-rows // slices), bloom)
    if slices == 1:
        return _may_repeat(keys, scratch.keep(repeated_filter(keys, bits)), bits)
    # Each slice is a folder of its own, so a slice's passes read its rows alone.
    sliced = scratch.keep(keys.withColumn("slice", _slice(F.col("digest"), slices)), by="slice")
    out = None
    for s in range(slices):
        own = sliced.where(F.col("slice") == s).select("doc_id", "digest")
        part = scratch.keep(_may_repeat(own, scratch.keep(repeated_filter(own, bits)), bits))
        out = part if out is None else out.unionByName(part)
    return out


def exact_groups(docs: DataFrame, spark: SparkSession | None = None, bloom: Bloom = Bloom()) -> DataFrame:  # noqa: B008
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal after normalized(). Null texts count as empty and form one group with the empty ones. Null doc_id:
    such a row is kept only if its whole group has none; keep_id is then null. Rows that repeat a doc_id and text all
    carry the same keep_id and count in group_size. An empty table gives an empty result; other columns are ignored.
    """
    rows = _first_pass(docs, Scratch(spark or docs.sparkSession, "exact"), bloom)
    alone = rows.where(~F.col("hit")).select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    some = rows.where("hit").select("doc_id", "digest")
    groups = some.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    some = some.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)), F.lit(0)).cast("int"))
    found = alone.unionByName(some.join(groups, ["digest", "salt"]).select("doc_id", "digest", "keep_id", "group_size"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, spark: SparkSession | None = None, bloom: Bloom = Bloom()) -> DataFrame:  # noqa: B008
    """The documents that stay, with all their columns, whatever their names. Of rows that repeat a doc_id and text, one stays.

    The digests that do repeat fill one more filter, of a bounded size. Documents that it rules out pass straight on; the
    others move with their texts, by digest and doc_id together, so a large group of copies spreads over the tasks.
    """
    scratch = Scratch(spark or docs.sparkSession, "exact-drop")
    some = _first_pass(docs, scratch, bloom).where("hit")
    repeated = some.groupBy("digest").agg(F.min("doc_id").alias("keep"), F.count("*").alias("n")).where("n > 1")
    repeated = scratch.keep(repeated.select("digest", "keep", F.lit(True).alias("found")))
    bits = _bits(repeated.count(), bloom)
    pages = scratch.keep(_pages(_cells(repeated, bits)))
    # The row travels as one column, so its columns' names clash with nothing.
    rows = docs.select(F.struct("*").alias("row"), _digest(F.col("text")).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = _may_repeat(rows, pages, bits)
    salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)), F.lit(0)).cast("int")
    met = rows.where("hit").withColumn("salt", salt).join(salted, ["digest", "salt"], "left")
    first = met.where(F.col("found") & F.col("doc_id").eqNullSafe(F.col("keep"))).dropDuplicates(["doc_id", "digest"])
    out = rows.where(~F.col("hit")).select("row").union(met.where("found is null").select("row")).union(first.select("row"))
    return out.select("row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark)


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
