"""The pipeline and each of its stages against a slow version, on small tables with every kind of planted document."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontamination as dec
from tessera.llm import near_dedup, toxicity

VOCAB = [f"v{i}" for i in range(500)]
ITEMS = [(1, "seven old sailors counted the silver bells on the northern pier at dawn"), (2, "a quiet engine hums below the library while the readers sleep")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = []
    for i in range(160):
        words = rng.choices(VOCAB, k=rng.randrange(20, 120))
        if i % 8 == 0:
            words[rng.randrange(len(words))] = "scoundrel"
        rows.append(" ".join(words))
    rows += [rows[3], rows[3].replace(" ", "  \n"), rows[5], None, None, "", "one two"]
    for i in (9, 17, 25):
        w = rows[i].split()
        rows.append(" ".join([*w, "tail"]))
    rows += [f"{rows[11]} {ITEMS[0][1].upper()} end", f"x {ITEMS[1][1].replace('quiet', 'quite')} y", f"{rows[13]} {ITEMS[0][1][:30]}"]
    docs = spark.createDataFrame([(i, t, "en", [None, "a", "b", "c"][i % 4], None, "kept") for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, digest string")
    labels = spark.createDataFrame([(i, 0, int(i % 8 == 0)) for i in range(160)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    folder = str(tmp_path_factory.mktemp("tables"))
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{folder}/{name}.parquet")
    return folder, dict(enumerate(rows)), docs, labels


def words(t):
    return (t or "").split()


def slow_stages(docs, lexicon):
    """The doc_ids that each stage keeps of what the stage before kept."""
    now = {i: t for i, t in docs.items() if lexicon.score(t or "") < 0.5}
    yield sorted(now)
    first: dict = {}
    for i, t in sorted(now.items()):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", t or ""), i)
    now = {i: now[i] for i in first.values()}
    yield sorted(now)
    shingles = {}
    for i, t in now.items():
        w = [x.lower() for x in words(t)]
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in now}
    for i in now:
        for j in now:
            a, b = shingles[i], shingles[j]
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((group[i], group[j]))
                group = {k: low if v == high else v for k, v in group.items()}
    now = {i: t for i, t in now.items() if group[i] == i}
    yield sorted(now)
    spec = dec.Matching()

    def holds(t):
        for _, item in ITEMS:
            p, x = dec.fold(item), dec.fold(t or "")
            row = [0] * (len(x) + 1)
            for a, c in enumerate(p, 1):
                new = [a]
                for b, d in enumerate(x, 1):
                    new.append(min(row[b] + 1, new[-1] + 1, row[b - 1] + (c != d)))
                row = new
            if min(row) <= len(p) * spec.percent // 100:
                return True
        return False

    yield sorted(i for i, t in now.items() if not holds(t))


def test_stages_and_run(spark, tables):
    folder, rows, docs, labels = tables
    lexicon = toxicity.learn(docs, labels, spark=spark)
    assert set(lexicon.weights) & {" scoundrel ", " scoun", " scou", " scound"}
    now = spark.read.parquet(f"{folder}/documents.parquet")
    want = list(slow_stages(rows, lexicon))
    assert [len(w) for w in want] == sorted((len(w) for w in want), reverse=True) and len({len(w) for w in want}) == 4
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        now = stage(spark, now, folder)
        assert now.columns == docs.columns, name
        assert sorted(r["doc_id"] for r in now.collect()) == ids, name
    left = want[-1]
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert sorted(out) == left
    size = {i: len(words(rows[i])) for i in left}
    source = {i: [None, "a", "b", "c"][i % 4] for i in left}
    total = {s: sum(size[i] for i in left if source[i] == s) for s in ("a", "b", "c", None)}
    weight, capped = dict(zip(("a", "b", "c", None), (1, 2, 3, 1), strict=True)), set()
    while True:
        free = sum(w for s, w in weight.items() if s not in capped)
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        target = {s: 3 * total[s] if s in capped else rest * w / free for s, w in weight.items()}
        new = {s for s in weight if s not in capped and target[s] > 3 * total[s]}
        if not new:
            break
        capped |= new
    for s in weight:
        own = [out[i] for i in left if source[i] == s]
        assert all(r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"] and abs(r["target"] - target[s]) < 1e-6 * target[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 120
    assert sorted(map(str, out.values())) == sorted(map(str, corpus_pipeline.run(spark, folder).collect()))


def test_empty_tables(spark, tables, tmp_path):
    folder, _, docs, labels = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_keep_one_of_repeated_rows(spark, tables):
    _, rows, docs, _ = tables
    twice = docs.where("doc_id in (9, 17, 25)").union(docs.where("doc_id = 9")).withColumn("component_id", F.lit("mine")).withColumn("kept", F.lit("mine"))
    out = near_dedup.keep_one(twice, near_dedup.NearDedup(), spark)
    assert out.columns == twice.columns and sorted(r["doc_id"] for r in out.collect()) == [9, 9, 17, 25]
