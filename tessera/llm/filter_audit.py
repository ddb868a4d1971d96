"""Filter interaction audit: what every order of a set of filters keeps and removes, by a subset-zeta transform.

Each document gets one mask of the filters that it fails. Its part's counts by mask, 2 ** filters numbers, are all that
is kept of the texts. A zeta transform over the bits turns them into survivors: of each subset of filters, the documents
that fail none of it. A step of any order is then the difference between two neighbouring subsets, and what holds for
counts holds for the counts of labelled documents, so no order is ever run.
"""

from __future__ import annotations

import itertools
import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SPACE = r"[\x20\x09-\x0D]+"
#: Columns of labels that are audited, and the measures of them that a step reports.
_LABELS = {"quality": "good_lost", "toxic": "toxic_lost"}


@dataclass(frozen=True)
class Audit:
    """filters: name to the condition, over text, words and n_words, on which a text fails; copies: the filter of copies.

    Up to seven filters: a report has filters! * filters rows a part.
    """

    filters: tuple[tuple[str, str], ...] = (
        ("A", "n_words < 200"),
        ("B", "100L * size(array_distinct(words)) < 50L * n_words"),
        ("C", "100L * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3L * length(text)"),
        ("D", "text rlike '[#$%&*|]'"),
    )
    copies: str = "E"

    def names(self) -> list[str]:
        return [*(n for n, _ in self.filters), self.copies]


def failures(docs: DataFrame, spec: Audit = Audit()) -> DataFrame:  # noqa: B008
    """doc_id, part, digest and mask of every row: bit i is set if the text fails filter i. No shuffle.

    A null text is empty, a null lang is the part ''. The bit of copies needs other rows and is not set here.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.withColumn("words", F.filter(F.split("text", _SPACE), lambda w: w != "")).withColumn("n_words", F.size("words").cast("long"))
    mask = F.lit(0)
    for i, (_, fails) in enumerate(spec.filters):
        mask = mask + F.expr(f"if({fails}, {1 << i}, 0)")
    return d.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def mask_counts(failed: DataFrame, labels: DataFrame, spec: Audit = Audit()) -> DataFrame:  # noqa: B008
    """part, mask, n, quality, toxic: documents by part and mask of failed filters, and those of them with each label.

    A copy fails if a row with the same text has a smaller doc_id; rows that repeat a doc_id are documents of their own
    and don't make each other copies, and a null doc_id neither is a copy nor makes one. A label counts if any of the
    document's rows in labels has it. Rows of one text differ in part and labels only, so each text is a few rows once
    they are summed; before that rows are spread by doc_id, null ones by their digest.
    """
    bit = 1 << len(spec.filters)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("long").alias(c) for c in _LABELS]).where("doc_id is not null")
    marks = marks.groupBy("doc_id").agg(*[F.max((F.coalesce(c, F.lit(0)) == 1).cast("int")).alias(c) for c in _LABELS]).withColumn("spread", F.lit(0))
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(4096)).cast("int")).otherwise(0)
    rows = failed.withColumn("spread", spread).join(marks, ["doc_id", "spread"], "left")
    key = ["digest", "part", "mask", *_LABELS]
    rows = rows.select("doc_id", "spread", "digest", "part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in _LABELS])
    same = rows.groupBy("doc_id", "spread", *key).agg(F.count("*").alias("n"))
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    texts = same.groupBy(*key).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), F.min(named).alias("first"))
    # A text's rows are now one for each part and pair of labels.
    texts = texts.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("digest")))
    kept = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("mask"), kept.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - kept).alias("n")))
    split = texts.select("part", *_LABELS, F.explode(both).alias("m")).select("part", *_LABELS, "m.mask", "m.n")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.col(c) * F.col("n")).alias(c) for c in _LABELS])


def survivors(counts: DataFrame, spec: Audit = Audit()) -> DataFrame:  # noqa: B008
    """part and, for n and each label, an array by subset of filters: the documents that fail no filter of it.

    One row a part. Counts are laid out by what their documents pass, and one round for each bit adds those that pass
    that filter too.
    """
    size, measures = 1 << len(spec.names()), ["n", *_LABELS]
    cells = F.sequence(F.lit(0), F.lit(size - 1))
    whole = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*measures)))).alias("by_mask"))

    def zeta(measure: str) -> Column:
        # Entry s holds the documents whose passed filters are s; after the sums, those whose passed filters include s.
        passed = F.transform(cells, lambda s: F.coalesce(F.col("by_mask")[F.lit(size - 1) - s][measure], F.lit(0).cast("long")))
        bits = F.array(*[F.lit(1 << i) for i in range(len(spec.names()))])
        return F.aggregate(bits, passed, lambda a, b: F.transform(a, lambda v, s: F.when(s.bitwiseAND(b) == 0, v + F.get(a, s + b)).otherwise(v)))

    return whole.select("part", *[zeta(m).alias(m) for m in measures])


def orders(spec: Audit = Audit()) -> Column:  # noqa: B008
    """An array of (filter_order, step, bit, before), one for each order and place in it; before: what is applied earlier."""
    names, rows = spec.names(), []
    for order in itertools.permutations(range(len(names))):
        for step, i in enumerate(order):
            rows.append({"filter_order": "".join(names[j] for j in order), "step": step + 1, "bit": 1 << i, "before": sum(1 << j for j in order[:step])})
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order string, step int, bit int, before int>>")


def report(parts: DataFrame, spec: Audit = Audit()) -> DataFrame:  # noqa: B008
    """A row for each part, order and step, from the survivors of the subsets before and after it."""
    n_filters = len(spec.names())
    every = (1 << n_filters) - 1
    at = lambda c, s: F.get(F.col(c), s)
    before, after, bit = F.col("before"), F.col("before") + F.col("bit"), F.col("bit")
    fails = at("n", F.lit(0)) - at("n", bit)
    removed = at("n", before) - at("n", after)
    # Of all orders, as many come to a filter by one subset as there are orders of what is in it and of what is not.
    weights = F.array(*[F.lit(math.factorial(s.bit_count()) * math.factorial(n_filters - 1 - s.bit_count()) if s != every else 0) for s in range(every + 1)])
    share = F.aggregate(F.sequence(F.lit(0), F.lit(every)), F.lit(0).cast("long"), lambda a, s: a + F.when(s.bitwiseAND(bit) == 0, F.get(weights, s) * (at("n", s) - at("n", s + bit))).otherwise(0))
    names = [F.lit(x) for x in spec.names()]
    steps = parts.withColumn("at", F.explode(orders(spec))).select(*parts.columns, "at.*")
    return steps.select(
        "part", "filter_order", "step", F.get(F.array(*names), F.log2(bit).cast("int")).alias("filter"),
        at("n", after).alias("kept"), removed.alias("removed"), (fails - removed).alias("redundant"),
        (at("n", F.lit(every) - bit) - at("n", F.lit(every))).alias("unique_fails"),
        *[(at(c, before) - at(c, after)).alias(name) for c, name in _LABELS.items()], share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, spec: Audit = Audit(), spark: SparkSession | None = None) -> DataFrame:  # noqa: B008
    """part, filter_order, step, filter and the step's counts, for every part, order of the filters and step.

    An empty table gives no rows, a label without its document counts nowhere, other columns are ignored. How rows with
    nulls, repeated ids and copies count is said at failures() and mask_counts().
    """
    return report(survivors(mask_counts(failures(docs, spec), labels, spec), spec), spec)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents),
l AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT part, len(words) < 200 AS fa, 100 * len(list_distinct(words)) < 50 * len(words) AS fb,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS fc,
         regexp_matches(text, '[#$%&*|]') AS fd, coalesce(d.doc_id > least, false) AS fe,
         coalesce(good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM d LEFT JOIN l USING (doc_id)),
m AS (
  SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN fa WHEN 'B' THEN fb WHEN 'C' THEN fc WHEN 'D' THEN fd ELSE fe END) AS fails,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f GROUP BY ALL),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM c a, c b, c, c d, c e
  WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS filter, string_split(substr(filter_order, 1, step - 1), '') AS earlier
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, step, filter,
         coalesce(sum(n) FILTER (NOT list_has_any(fails, earlier) AND NOT list_contains(fails, filter)), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT list_has_any(fails, earlier) AND list_contains(fails, filter)), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (list_has_any(fails, earlier) AND list_contains(fails, filter)), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = [filter]), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (NOT list_has_any(fails, earlier) AND list_contains(fails, filter)), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (NOT list_has_any(fails, earlier) AND list_contains(fails, filter)), 0)::BIGINT AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley
FROM r
"""
