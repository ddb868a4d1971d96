"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: compatibility forms, accents, homoglyphs of other scripts and digits or signs inside words
become plain letters, all else becomes single spaces. The lexicon, whole words and word beginnings, is learned from a
bounded sample of labelled rows: terms that all but never occur in clean texts, or all but never as often for the text's
length as in toxic ones, chosen greedily while each explains toxic texts that no other term does, so words that merely come along in copies of one toxic text stay out. Phrases
around a term that clean texts use as well become exceptions and excuse it. The summed weight and its share of the
text's length go through a logistic calibration fitted on the same sample.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._scratch import Scratch, small_batches

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters inside words.
_LOOKALIKES = dict(zip("абсԁеһіјкӏмпорԛѕтуѵԝхьαβεηικνορτυχωⅼɡıʟ", "abcdehijklmnopqstuvwxbabenikvoptuxwlgil", strict=True))
_LEET = str.maketrans("013457@$!|", "oieastasil")
_LEET_RUN = re.compile(r"[013457@$!|]+(?=[a-z])")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_TABLE = {ord(k): v for k, v in _LOOKALIKES.items()}


def fold(text: str) -> str:
    """Lower-case letters of one form, in words parted by single spaces, with a space at both ends."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_TABLE)
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
    if _LEET_RUN.search(text):
        # A sign stands for a letter only directly before another letter.
        text = _LEET_RUN.sub(lambda m: m[0].translate(_LEET), text)
    return f" {_NOT_LETTER.sub(' ', text).strip()} "


@dataclass(frozen=True)
class Learning:
    """sample: most labelled rows that are read to learn; dense: occurrences in a thousand words from which a term is dense
    in a text; the rest are the support, purity and gain that a term needs, and the letters of word beginnings."""

    sample: int = 20_000
    support: float = 0.004
    least_support: int = 3
    most_clean: float = 0.04
    gain: float = 0.002
    least_gain: int = 2
    shortest: int = 4
    longest: int = 7
    dense: float = 10.0


@dataclass
class Lexicon:
    """weights: folded term with a leading space, and a trailing one if it is a whole word; exceptions: folded phrases."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = -3.0
    slope: tuple[float, float] = (3.0, 0.5)
    _automaton: object = field(default=None, compare=False, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None and (self.weights or self.exceptions):
            self._automaton = ahocorasick.Automaton()
            for phrase in self.exceptions:
                self._automaton.add_word(f" {fold(phrase).strip()} ", (None, len(fold(phrase))))
            for term, w in self.weights.items():
                self._automaton.add_word(term, (w, len(term)))
            self._automaton.make_automaton()
        return self._automaton

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of all terms outside exceptions; of terms at one place the heaviest."""
        a = self.automaton()
        if a is None:
            return []
        found, excused = {}, []
        for end, (w, n) in a.iter(folded):
            start = end + 1 - n
            if w is None:
                excused.append((start, end))
            elif start not in found or found[start][1] < w:
                found[start] = (end, w)
        return [(s, e, w) for s, (e, w) in sorted(found.items()) if not any(x <= s and e <= y for x, y in excused)]

    def features(self, text: str) -> tuple[float, float]:
        folded = fold(text)
        total = sum(w for _, _, w in self.hits(folded))
        return math.log1p(total), math.log1p(1000.0 * total / (len(folded) + 100.0))

    def score(self, text: str) -> float:
        x = self.features(text)
        z = self.bias + self.slope[0] * x[0] + self.slope[1] * x[1]
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _occurrences(folded: str, spec: Learning) -> tuple[Counter, int]:
    """Counts of a text's words and word beginnings, and its number of words."""
    words = Counter(folded.split())
    count: Counter = Counter()
    for w, n in words.items():
        if len(w) >= spec.shortest - 1:
            count[f" {w} "] += n
        for k in range(spec.shortest, min(spec.longest, len(w)) + 1):
            count[f" {w[:k]}"] += n
    return count, words.total()


def _terms(spec: Learning):
    """Terms over a batch: toxic and clean texts that have it, the same where it is dense, and for either a sum of the
    toxic texts' hashes, by which terms of the same toxic texts are known."""
    names = ["pos", "neg", "texts", "dense_pos", "dense_neg", "dense_texts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = {n: Counter() for n in names}
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                count, n = _occurrences(fold(text or ""), spec)
                # 44 bits, so that the sum over the sample stays a long.
                known = int.from_bytes(hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=6).digest()) >> 4
                for terms, prefix in ((list(count), ""), ([t for t, c in count.items() if 1000 * c >= spec.dense * n], "dense_")):
                    sums[prefix + ("pos" if label else "neg")].update(terms)
                    if label:
                        sums[f"{prefix}texts"].update(dict.fromkeys(terms, known))
            every = list(sums["pos"].keys() | sums["neg"].keys())
            yield pa.record_batch([pa.array(every, pa.string()), *(pa.array([x[t] for t in every], pa.int64()) for x in sums.values())], names=["term", *names])

    return run


def _which(terms: list[tuple[str, bool]], spec: Learning):
    """The numbers of the terms that each text has; of those marked dense, where they are dense."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, (t, _) in enumerate(terms)}
        for batch in batches:
            got = []
            for text in batch.column(1).to_pylist():
                count, n = _occurrences(fold(text or ""), spec)
                got.append([i for t, c in count.items() if (i := number.get(t)) is not None and (not terms[i][1] or 1000 * c >= spec.dense * n)])
            yield pa.record_batch([pa.array(got, pa.list_(pa.int32()))], names=["terms"])

    return run


def _phrases(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = ahocorasick.Automaton()
        for t in terms:
            a.add_word(t, len(t))
        a.make_automaton()
        for batch in batches:
            count: Counter = Counter()
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                f, seen = fold(text or ""), set()
                for end, n in a.iter(f):
                    s = end + 1 - n
                    right = f.find(" ", end if f[end] == " " and n > 1 and f[end - 1] != " " else end + 1)
                    left = f.rfind(" ", 0, s)
                    after = f.find(" ", right + 1)
                    if left >= 0:
                        seen.add(f[left : right + 1])
                    if after > 0:
                        seen.add(f[s : after + 1])
                count.update((p, label) for p in seen)
            keys = list(count)
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([count[k] for k in keys], pa.int64())], names=["phrase", "label", "n"])

    return run


def _features_of(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [lexicon.features(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(2).cast(pa.int32()), pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64())], names=["label", "x0", "x1"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Intercept and weights of a ridge logistic regression by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-3, *[ridge * 0.05] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, spec: Learning = Learning(), spark: SparkSession | None = None) -> Lexicon:  # noqa: B008
    """A lexicon from the labelled rows outside the held-out fifth.

    Rows of labels with nulls, and labels without a document, teach nothing. Without toxic rows the lexicon is empty
    and scores all texts alike, below 0.5. At most spec.sample labels are read, those with the smallest hash. Of rows that
    repeat a doc_id the least text teaches; a doc_id or text labelled both ways counts as toxic.
    """
    spark = spark or docs.sparkSession
    scratch = Scratch(spark, "toxic")
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    sample = usable.select("doc_id", F.col("toxic").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(spec.sample)
    # At most spec.sample rows of twelve bytes are broadcast.
    text = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = text.join(F.broadcast(scratch.keep(sample)), "doc_id")
    # One text for each doc_id, so that the sample bounds them, and of copies one: they teach no more.
    train = train.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    train = train.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("doc_id")).agg(F.min("text").alias("text"), F.max("label").alias("label"))
    train = scratch.keep(train)
    n_pos, n_neg = (train.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()[i] or 0 for i in range(2))
    if not n_pos or not n_neg:
        scratch.drop_all_but()
        return Lexicon()
    support = max(spec.least_support, int(spec.support * n_pos))
    names = ("pos", "neg", "texts", "dense_pos", "dense_neg", "dense_texts")
    counts = train.mapInArrow(_terms(spec), "term string, " + ", ".join(f"{c} long" for c in names)).groupBy("term").agg(*[F.sum(c).alias(c) for c in names])

    def pure(pos: str, neg: str) -> Column:
        return (F.col(pos) >= support) & (F.col(neg) * n_pos <= F.col(pos) * n_neg * spec.most_clean)

    # A term counts where it is dense only if its mere presence says too little.
    dense = ~pure("pos", "neg")
    own = [F.when(dense, F.col(f"dense_{c}")).otherwise(F.col(c)).alias(c) for c in names[:3]]
    found = counts.where(pure("pos", "neg") | pure("dense_pos", "dense_neg")).select("term", dense.alias("dense"), *own)
    # Of terms that the same toxic texts have, one goes on: a text's near copies share all their rare words.
    better = F.struct("neg", "dense", (~F.col("term").endswith(" ")).alias("part"), (-F.length("term")).alias("short"), "term", "pos")
    rows = found.groupBy("texts").agg(F.min(better).alias("best")).select("best.*").orderBy(F.col("pos").desc(), "term").collect()
    terms = [r["term"] for r in rows]
    stats = {r["term"]: (r["pos"], r["neg"]) for r in rows}
    lexicon = Lexicon()
    if terms:
        got = train.where("label = 1").mapInArrow(_which([(r["term"], r["dense"]) for r in rows], spec), "terms array<int>").collect()
        posting: dict[int, set[int]] = {}
        for d, r in enumerate(got):
            for t in r["terms"]:
                posting.setdefault(t, set()).add(d)
        least, covered = max(spec.least_gain, int(spec.gain * n_pos)), set()
        order = sorted(posting, key=lambda t: (-len(posting[t]), not terms[t].endswith(" "), -len(terms[t]), terms[t]))
        while order:
            best = max(order, key=lambda t: (len(posting[t] - covered), -stats[terms[t]][1], terms[t].endswith(" "), len(terms[t])))
            if len(posting[best] - covered) < least:
                break
            pos, neg = stats[terms[best]]
            lexicon.weights[terms[best]] = math.log((pos + 0.5) / (n_pos + 1.0)) - math.log((neg + 0.5) / (n_neg + 1.0))
            covered |= posting[best]
            order = [t for t in order if t != best and len(posting[t] - covered) >= least]
        phrases = train.mapInArrow(_phrases(list(lexicon.weights)), "phrase string, label int, n long").groupBy("phrase").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("neg"))
        excused = phrases.where((F.col("neg") >= spec.least_support) & (F.col("neg") * n_pos >= F.col("pos") * n_neg)).orderBy(F.col("neg").desc(), "phrase")
        lexicon.exceptions = [r["phrase"].strip() for r in excused.collect()]
    fit = train.mapInArrow(_features_of(lexicon), "label int, x0 double, x1 double").toPandas().sort_values(["label", "x0", "x1"], ignore_index=True)
    w = _logistic(fit[["x0", "x1"]].to_numpy(), fit["label"].to_numpy().astype(float))
    if min(w[1:]) < 0:  # a longer clean text around the same words must not raise a score
        w = np.append(_logistic(fit[["x0"]].to_numpy(), fit["label"].to_numpy().astype(float)), 0.0)
    lexicon.bias, lexicon.slope = float(w[0]), (float(max(w[1], 0.0)), float(w[2]))
    scratch.drop_all_but()
    return lexicon


def _scores(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = _text.plain(batch.column(1))
            scores = [lexicon.score(t.as_py()) for t in text]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without hits. A null doc_id isn't held out. Repeated rows are scored
    each; an empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = text.mapInArrow(_scores(lexicon), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _flags(lexicon: Lexicon):
    @F.pandas_udf("boolean")
    def flag(text: pd.Series) -> pd.Series:
        return pd.Series([lexicon.score(t or "") >= 0.5 for t in text], dtype=bool)

    return flag


def drop_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The documents that score below 0.5, with all their columns."""
    small_batches(docs.sparkSession)
    return docs.where(~_flags(lexicon)(F.col("text").cast("string")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs, learn(docs, labels, spark=spark))
