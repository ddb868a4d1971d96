"""The filter audit against every order run filter by filter, and against its SQL."""

import itertools
import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tessera.llm import filter_audit as fa

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, words string, digest string, spread int, n long"
LABELS = "doc_id long, quality int, toxic int, mask int, part string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None, "x", 9, "w", "d", 7, 5) for i, t, lang in rows], DOCS)


def _labels(spark, rows):
    return spark.createDataFrame([(i, q, t, 3, "y") for i, q, t in rows], LABELS)


def _slow(rows, labels):
    """Every order applied document by document."""
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        mine = [x for x in labels if i is not None and x[0] == i]
        docs.append((lang or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, total = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in itertools.permutations("ABCDE"):
            left, name = [d for d in docs if d[0] == part], "".join(order)
            before = list(left)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                failing = sum(d[1][f] for d in before)
                alone = sum(d[1][f] and sum(d[1].values()) == 1 for d in before)
                out[part, name, step] = [f, len(left), len(gone), failing - len(gone), alone, sum(d[2] for d in gone), sum(d[3] for d in gone)]
                total[part, f] += len(gone)
    return {k: (*v, total[k[0], v[0]]) for k, v in out.items()}


def _got(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["filter"], r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


def _rows():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["Ab", "X", "a#b", "é"]
    rows = []
    for i in range(120):
        n = rng.choice([0, 3, 150, 199, 200, 201, 400])
        t = rng.choice([" ", "\t\n ", "\x0b"]).join(rng.choices(vocab[: rng.choice([5, 150, 304])], k=n))
        rows.append((i, t + rng.choice(["", "", " $", " ABC" * 9]), rng.choice(["en", "de", None, ""])))
    rows += [(200 + i, rng.choice(rows)[1], rng.choice(["en", "fr"])) for i in range(60)]
    rows += [(300, None, None), (301, "", "en"), (301, "", "en"), (301, "other", "en"), (None, rows[0][1], "en"), (None, None, None), (302, "word " * 60000, "en"), (5, rows[5][1], "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)]
    return rows, labels + [(4, 1, 0), (4, 0, 1), (301, 1, 1), (None, 1, 1), (9999, 1, 1)]


def test_every_order_as_if_run(spark):
    rows, labels = _rows()
    assert _got(fa.audit(_docs(spark, rows), _labels(spark, labels))) == _slow(rows, labels)


def test_sql_says_the_same(spark):
    rows, labels = _rows()
    c = duckdb.connect()
    d, m = _docs(spark, rows).toPandas(), _labels(spark, labels).toPandas()  # noqa: F841
    c.execute("create table documents as select cast(doc_id as bigint) doc_id, text, lang from d")
    c.execute("create table labels as select cast(doc_id as bigint) doc_id, quality, toxic from m")
    got = fa.audit(_docs(spark, rows), _labels(spark, labels))
    assert sorted(map(tuple, got.collect())) == sorted(c.execute(fa.SQL).fetchall())


def test_empty_tables(spark):
    rows, labels = _rows()
    docs, marks = _docs(spark, rows), _labels(spark, labels)
    assert fa.audit(docs.limit(0), marks).count() == 0
    assert {(r["good_lost"], r["toxic_lost"]) for r in fa.audit(docs, marks.limit(0)).collect()} == {(0, 0)}


def test_other_filters(spark):
    spec = fa.Audit(filters=(("short", "n_words < 3"), ("long", "n_words > 5")), copies="copy")
    docs = _docs(spark, [(1, "a", "en"), (2, "a", "en"), (3, "a b c d", "en"), (4, "a b c d e f", "en")])
    parts = fa.survivors(fa.mask_counts(fa.failures(docs, spec), _labels(spark, [(1, 1, 0)]), spec), spec).first()
    assert list(parts["n"]) == [4, 2, 3, 1, 3, 2, 2, 1] and list(parts["quality"]) == [1, 0, 1, 0, 1, 0, 1, 0]
    last = fa.audit(docs, _labels(spark, []), spec).where(F.col("step") == 3)
    assert {r["kept"] for r in last.collect()} == {1} and last.count() == 6


def test_a_text_with_a_third_of_all_rows(spark):
    docs = spark.range(50000, numPartitions=8).selectExpr("id doc_id", "if(id % 3 = 0, 'same text', concat('t ', id)) text", "'en' lang")
    got = _got(fa.audit(docs, _labels(spark, [])))
    assert got["en", "EABCD", 1][2] == len(range(0, 50000, 3)) - 1
