"""Licence scans: a trained paragraph classifier with DataFrame operations only on the main path.

Training, on the driver: a multinomial logistic regression over word one- and two-grams of the sentences below, with
random cuts and fillers of them as further rows, and paragraphs of other text as the class `unknown`; a temperature
fitted on cuts that training didn't use calibrates it, and quality() measures it on rows of other random numbers. The
model is a table of some thousand features.
Scanning: blank lines part paragraphs. Units are a paragraph's lines and, if it has several, windows of its words
that overlap by half, so that a notice wrapped over lines stands whole in one. Their distinct n-grams are exploded and
joined to the broadcast features. A family is reported if its calibrated probability is high enough and the unit holds
most of one of the family's notices (template comparison); other units with licence words are unknown. A window claims
its lines that have part in the notice, unless one of them holds the notice alone.
Each notice has words without which less than the share for unknown is left of it; paragraphs without any of these
can't give a row and leave the scan first.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import Scratch

# Sentences of public licences and of the notices that name them, by family.
NOTICES = {
    "AGPL": ["licensed under the GNU Affero General Public License version 3", "this program is free software under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "you should have received a copy of the GNU Affero General Public License along with this program"],
    "Apache-2.0": ["licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License", "unless required by applicable law or agreed to in writing software distributed under the License is distributed on an as is basis", "released under the Apache 2.0 license", "you may obtain a copy of the License at apache.org licenses LICENSE-2.0", "see the License for the specific language governing permissions and limitations under the License"],
    "BSD": ["redistribution and use in source and binary forms with or without modification are permitted", "released under the BSD 3-Clause License", "licensed under the 2-clause BSD license", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "may be used to endorse or promote products derived from this software without specific prior written permission"],
    "CC-BY": ["licensed under CC BY 4.0", "this work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC": ["licensed under CC BY-NC 4.0", "this work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA": ["licensed under CC BY-SA 4.0", "this work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0": ["to the extent possible under law the author has waived all copyright and related rights to this work", "released under CC0 1.0 Universal public domain dedication"],
    "GPL": ["this work is licensed under the GNU General Public License, version 3", "this program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "licensed under the GPL version 2", "released under the GNU GPL v3", "you should have received a copy of the GNU General Public License along with this program"],
    "ISC": ["licensed under the ISC License", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "provided that the above copyright notice and this permission notice appear in all copies"],
    "LGPL": ["licensed under the GNU Lesser General Public License version 2.1", "this library is free software under the terms of the GNU Lesser General Public License", "you should have received a copy of the GNU Lesser General Public License along with this library"],
    "MIT": ["released under the MIT License", "licensed under the MIT license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "the software is provided as is without warranty of any kind express or implied", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "MPL-2.0": ["this source code form is subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License 2.0", "if a copy of the MPL was not distributed with this file you can obtain one at mozilla.org"],
    "Proprietary": ["all rights reserved", "copyright all rights reserved no part of this publication may be reproduced without prior written permission"],
    "Unlicense": ["this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software"],
}
# Words that carry nothing alone, and lines of other text.
STOP = "a an and any as by for from in is it may of on or that the this to with you your at be are not".split()
OTHER = ["the driver must show a license and a copy of the form at the desk", "free tickets are available to any person with a card", "this work is about the history of public law in the city", "the software team released a new version of the product", "permission to enter is granted by the office", "source of the river and the general state of the water", "version of the story as told by the author", "the work of the foundation is under review", "use of the room is free of charge on sunday", "a commons in the old town", "general terms and conditions of the shop apply", "copy the file to the folder and open it", "the public library is open to any person", "it is provided with a warranty of two years", "distributed by the office in the city", "rights of the person and the state"]


@dataclass(frozen=True)
class Scan:
    """least: calibrated probability of a family; cover: share of a notice's n-grams that a unit must hold;
    part: share of one at which a unit is unknown at least."""

    least: float = 0.6
    cover: float = 0.7
    part: float = 0.4
    seed: int = 20


def _words(text: str) -> list[str]:
    return [x for w in re.sub(r"[^a-z0-9.\-]+", " ", text.lower()).split() if (x := w.strip(".-"))]


def _grams(words: list[str]) -> set[str]:
    return {w for w in words if w not in STOP} | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


@lru_cache(maxsize=4)
def train(spec: Scan = Scan()):  # noqa: B008
    """(classes, features, weights, bias, temperature, templates); class 0 is unknown."""
    rng = random.Random(spec.seed)
    classes = ["unknown", *NOTICES]
    features = sorted({g for v in NOTICES.values() for t in v for g in _grams(_words(t))})
    index = {g: i for i, g in enumerate(features)}
    filler = [w for t in OTHER for w in t.split()]
    rows, labels = [], []

    def add(words: list[str], label: int) -> None:
        rows.append([index[g] for g in _grams(words) if g in index])
        labels.append(label)

    for k, name in enumerate(classes[1:], 1):
        for notice in NOTICES[name]:
            w = _words(notice)
            for _ in range(12):
                add([x for x in w if rng.random() > 0.08], k)
                at = rng.randrange(len(w) + 1)
                add([*rng.choices(filler, k=rng.randrange(6)), *w[:at], *w[at:], *rng.choices(filler, k=rng.randrange(6))], k)
    bag = [x for v in NOTICES.values() for t in v for x in _words(t)]
    for t in OTHER:
        add(_words(t), 0)
    for _ in range(400):
        add(rng.choices(filler, k=12) + rng.choices(bag, k=rng.randrange(4)), 0)
        add(rng.choices(bag, k=rng.randrange(1, 5)), 0)
    x = np.zeros((len(rows), len(features)))
    for i, r in enumerate(rows):
        x[i, r] = 1
    y = np.eye(len(classes))[labels]
    fit = np.arange(len(rows)) % 5 != 0
    w, b = np.zeros((len(features), len(classes))), np.zeros(len(classes))
    for _ in range(400):
        z = x[fit] @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= 0.5 * (x[fit].T @ (p - y[fit]) / fit.sum() * 10 + 2e-3 * w)
        b -= 0.5 * (p - y[fit]).mean(0)

    def loss(t: float) -> float:
        z = (x[~fit] @ w + b) / t
        z -= z.max(1, keepdims=True)
        return -float((y[~fit] * (z - np.log(np.exp(z).sum(1, keepdims=True)))).sum())

    temperature = min((0.5 + 0.1 * i for i in range(30)), key=loss)
    templates = [(k, sorted(index[g] for g in _grams(_words(t)))) for k, name in enumerate(classes[1:], 1) for t in NOTICES[name]]
    return classes, features, w, b, temperature, templates


def judge(text: str, spec: Scan = Scan()) -> tuple[str, float]:  # noqa: B008
    """The class of one unit of text and its calibrated probability, as the scan has them before template comparison."""
    classes, features, w, b, temperature, _ = train(spec)
    index = {g: i for i, g in enumerate(features)}
    z = (w[[index[g] for g in _grams(_words(text)) if g in index]].sum(0) + b) / temperature
    p = np.exp(z - z.max())
    p /= p.sum()
    return classes[int(p.argmax())], float(p.max())


def quality(spec: Scan = Scan(), seed: int = 99, rounds: int = 6) -> dict[str, float]:  # noqa: B008
    """How the classifier does on rows that training never had: cuts of notices in other text with other random numbers,
    and paragraphs of other text and of licence words in no order. accuracy; recall of families; error of calibration, the
    mean gap between probability and accuracy over ten bins."""
    rng, rows = random.Random(seed), []
    filler, bag = [w for t in OTHER for w in t.split()], [x for v in NOTICES.values() for t in v for x in _words(t)]
    for name, notices in NOTICES.items():
        for notice in notices:
            w = _words(notice)
            for _ in range(rounds):
                kept = [x for x in w if rng.random() > 0.12]
                rows.append((name, " ".join([*rng.choices(filler, k=rng.randrange(10)), *kept, *rng.choices(filler, k=rng.randrange(10))])))
    for _ in range(30 * rounds):
        rows.append(("unknown", " ".join(rng.choices(filler, k=rng.randrange(5, 40)) + rng.choices(bag, k=rng.randrange(4)))))
    got = [(label, *judge(text, spec)) for label, text in rows]
    bins: dict[int, list] = {}
    for label, found, p in got:
        bins.setdefault(min(9, int(p * 10)), []).append((label == found, p))
    gap = sum(abs(sum(ok for ok, _ in b) - sum(p for _, p in b)) for b in bins.values()) / len(got)
    named = [label == found for label, found, _ in got if label != "unknown"]
    return {"accuracy": sum(label == found for label, found, _ in got) / len(got), "recall": sum(named) / len(named), "calibration_error": gap}


def _vocabulary() -> list[str]:
    return sorted({w for v in NOTICES.values() for t in v for w in _words(t)})


def _stride() -> int:
    """Half a window: half as many words again as the longest notice has, for what stands between its words."""
    return max(len(_words(t)) for v in NOTICES.values() for t in v) * 3 // 2


@lru_cache(maxsize=4)
def _needed(part: float) -> tuple[str, ...]:
    """Words of which any unit that holds the share `part` of a notice has one at least."""
    plain, needed = {w for t in OTHER for w in _words(t)}, set()
    for notice in (_words(t) for v in NOTICES.values() for t in v):
        grams = _grams(notice)
        left = {g for g in grams if not needed & set(g.split())}
        words = sorted(set(notice), key=lambda w: (w in STOP, w in plain, -sum(w in g.split() for g in grams), w))
        while len(left) >= part * len(grams):
            w = words.pop(0)
            needed.add(w)
            left = {g for g in left if w not in g.split()}
    return tuple(sorted(needed))


def _tokens(line: Column) -> Column:
    """The words of a line in order, as _words cuts them, and empty strings at the ends.

    Dots and hyphens at a word's ends belong to the separator, which a look-behind lets start only at its first one.
    """
    return F.split(F.concat(F.lit(" "), F.lower(line), F.lit(" ")), r"(?<![.\-])[.\-]*+[^a-z0-9.\-][^a-z0-9]*+")


def _known(words: Column) -> Column:
    """Null where no notice has the word, so it is in no feature."""
    return F.transform(words, lambda w: F.when(w.isin(_vocabulary()), w))


def _line_words(line: Column) -> Column:
    return _known(_tokens(line))


def _units(lines: Column) -> Column:
    """unit, first and last line, words: each line from unit 0 on, and windows of several lines' words from -1 down."""
    n = _stride()
    own = F.filter(F.transform(lines, lambda w, i: F.struct(i.alias("unit"), i.alias("lo"), i.alias("hi"), w.alias("words"))), lambda u: F.size(u["words"]) > 0)
    run = F.flatten(F.transform(lines, lambda ws, i: F.transform(ws, lambda w: F.struct(w.alias("w"), i.alias("line")))))

    def window(part: Column, k: Column) -> Column:
        return F.struct((-k - 1).alias("unit"), part[0]["line"].alias("lo"), F.element_at(part, -1)["line"].alias("hi"), F.transform(part, lambda x: x["w"]).alias("words"))

    # One lambda binds the run, so that it is built once.
    windows = F.transform(F.array(run), lambda r: F.transform(F.transform(F.sequence(F.lit(0), F.greatest((F.size(r) - n - 1), F.lit(0)), F.lit(n)), lambda at: F.slice(r, at + 1, 2 * n)), window))[0]
    several = F.size(F.filter(lines, lambda w: F.size(w) > 0)) > 1
    return F.when(several, F.concat(own, windows)).otherwise(own)


def _pairs(words: Column) -> Column:
    """Neighbours joined by a space; null where one of them is."""
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))


def license_lines(docs: DataFrame, spec: Scan = Scan(), spark: SparkSession | None = None) -> DataFrame:  # noqa: B008
    """doc_id, text_hash, paragraph and line (from 0, in the paragraph), family: a row per line and family, or the
    unknown class with licence words, that claims the line alone or in a window; a line can be claimed as both."""
    spark = spark or docs.sparkSession
    scratch = Scratch(spark, "licences")
    classes, features, w, b, temperature, templates = train(spec)
    model = spark.createDataFrame([(f, i, *map(float, w[i])) for i, f in enumerate(features)], ["gram", "id", *[f"w{k}" for k in range(len(classes))]])
    paragraphs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"(?>\r\n|[\n\r])[^\S\n\r]*+[\n\r]\s*+")).alias("paragraph", "body"))
    paragraphs = paragraphs.where(F.lower("body").rlike("(?<![a-z0-9])(?:" + "|".join(map(re.escape, _needed(spec.part))) + ")(?![a-z0-9])"))
    # One select per step: an array that an expression names several times is computed as often. An
    # inner explode would name them again, in a filter pushed below all steps; the join drops the outer one's nulls.
    key = ["doc_id", "text_hash", "paragraph"]
    lines = paragraphs.select(*key, F.transform(F.split("body", r"[\n\r]+"), lambda x: _known(F.filter(_tokens(x), lambda t: t != ""))).alias("lines"))
    units = lines.select(*key, F.explode_outer(_units(F.col("lines"))).alias("u")).select(*key, "u.*")
    unit = [*key, "unit", "lo", "hi"]
    grams = units.select(*unit, F.array_distinct(F.array_compact(F.concat("words", _pairs(F.col("words"))))).alias("grams"))
    grams = grams.select(*unit, F.explode_outer("grams").alias("gram"))
    # The model has a fixed number of rows, whatever the input.
    hits = grams.join(F.broadcast(model), "gram")
    per = hits.groupBy(*unit).agg(*[F.sum(f"w{k}").alias(f"z{k}") for k in range(len(classes))], F.collect_set("id").alias("ids"), F.count("*").alias("n"))
    # A text that stands in several rows of one doc_id counts once.
    z = [(F.col(f"z{k}") * F.size("ids") / F.col("n") + float(b[k])) / float(temperature) for k in range(len(classes))]
    top = F.greatest(*z)
    total = sum((F.exp(x - top) for x in z), F.lit(0.0))
    best = F.array_max(F.array(*[F.struct(x.alias("z"), F.lit(k).alias("k")) for k, x in enumerate(z)]))
    per = per.select(*unit, "ids", best.alias("best"), total.alias("total"), top.alias("top"))
    # Shares below the least that counts are never used, so a unit meets only templates short enough for its n-grams.
    some = min(spec.part, spec.cover)
    cover = lambda t: F.size(F.array_intersect(F.col("ids"), F.array(*map(F.lit, t)))) / F.lit(float(len(t)))
    held = F.array(*[F.when(F.size("ids") >= some * len(t), F.struct(F.lit(k).alias("k"), F.lit(i).alias("t"), cover(t).alias("cover"))) for i, (k, t) in enumerate(templates)])
    per = per.withColumn("held", F.filter(held, lambda h: h["cover"] >= some)).withColumn("probability", F.exp(F.col("best")["z"] - F.col("top")) / F.col("total"))
    full = F.filter("held", lambda h: (h["k"] == F.col("best")["k"]) & (h["cover"] >= spec.cover))
    part = F.filter("held", lambda h: h["cover"] >= spec.part)
    sure = (F.col("best")["k"] > 0) & (F.col("probability") >= spec.least) & (F.size(full) > 0)
    names = F.array(*map(F.lit, classes))
    per = per.withColumn("family", F.when(sure, F.element_at(names, F.col("best")["k"] + 1)).when(F.size(part) > 0, F.lit("unknown"))).withColumn("of", F.when(sure, F.transform(full, lambda h: h["t"])).otherwise(F.transform(part, lambda h: h["t"])))
    per = scratch.keep(per.select(*unit, "ids", "held", "family", "of"))
    alone = per.where("unit >= 0 and family is not null").select(*key, "lo", "family")
    windows = per.where("unit < 0 and family is not null").select(*[F.col(c).alias(f"_{c}") for c in key], F.col("lo").alias("a"), F.col("hi").alias("b"), "family", "of")
    own = per.where("unit >= 0").groupBy(*key).agg(F.collect_list(F.struct("lo", "ids", "held")).alias("own"))
    met = own.join(windows, F.expr("doc_id <=> _doc_id and text_hash = _text_hash and paragraph = _paragraph"))
    within = met.select(*key, "family", "of", F.filter("own", lambda x: (x["lo"] >= F.col("a")) & (x["lo"] <= F.col("b"))).alias("own"))
    least = F.when(F.col("family") == "unknown", F.lit(spec.part)).otherwise(F.lit(spec.cover))
    wrapped = F.filter("of", lambda t: ~F.exists("own", lambda x: F.exists(x["held"], lambda h: (h["t"] == t) & (h["cover"] >= least))))
    table = F.array(*[F.array(*map(F.lit, t)) for _, t in templates])
    of = F.flatten(F.transform("of", lambda t: F.get(table, t)))
    within = within.withColumn("of", wrapped).where(F.size("of") > 0).withColumn("of", of)
    claimed = F.filter("own", lambda x: F.size(F.array_intersect(x["ids"], F.col("of"))) * 2 >= F.size(x["ids"]))
    joined = within.select(*key, F.explode(F.transform(claimed, lambda x: x["lo"])).alias("lo"), "family")
    return alone.unionByName(joined).withColumnRenamed("lo", "line").distinct()


def scan(docs: DataFrame, spec: Scan = Scan(), spark: SparkSession | None = None) -> DataFrame:  # noqa: B008
    """One row per document: doc_id, n_lines (claimed by a family), n_unknown, families (sorted, comma-joined).

    Null and empty texts have no lines claimed. A null doc_id stays null; repeated rows of one doc_id and text are one
    document's and each gets the result of that text. An empty table gives an empty result; other columns are ignored.
    """
    spark = spark or docs.sparkSession
    found = license_lines(docs, spec, spark)
    # Equal rows share their lines, so a set of lines counts them once. A line with a family isn't unknown.
    sure, unknown = (F.collect_set(F.when(c, F.struct("paragraph", "line"))) for c in (F.col("family") != "unknown", F.col("family") == "unknown"))
    by = found.groupBy("doc_id", "text_hash").agg(
        F.size(sure).cast("long").alias("n_lines"),
        F.size(F.array_except(unknown, sure)).cast("long").alias("n_unknown"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("family") != "unknown", F.col("family")))), ",").alias("families"),
    ).withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_hash")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    out = rows.join(by, rows["doc_id"].eqNullSafe(by["_id"]) & (rows["text_hash"] == by["_hash"]), "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce("n_unknown", zero).alias("n_unknown"), F.coalesce("families", F.lit("")).alias("families"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scan(), spark)
