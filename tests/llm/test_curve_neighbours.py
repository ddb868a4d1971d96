"""Neighbours on curves against brute force."""

import os

import numpy as np
import pytest

from tessera.llm import curve_neighbours as cn

SF = "/root/testdata/sf0.1"
ROWS = "vec_id long, embedding array<float>, label int, id long, v int, block string, score double"


def _rows(spark, rows, partitions=4):
    return spark.createDataFrame([(i, v, 1, 2, 3, "b", 0.5) for i, v in rows], ROWS).repartition(partitions)


def _got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def _slow(rows, k, every):
    """All pairs; the rows that take part, by the docstring."""
    ok = [(i, np.float64(np.float32(v))) for i, v in rows if i is not None and v is not None and all(x is not None for x in v) and np.isfinite(np.float32(v)).all() and any(v)]
    sizes = [len(v) for _, v in ok]
    dim = max(set(sizes), key=lambda s: (sizes.count(s), s)) if ok else 0
    ok = [(i, v) for i, v in ok if len(v) == dim]
    out = {}
    for q in {i for i, _ in ok if i % every == 0}:
        own = min((tuple(v) for i, v in ok if i == q))
        near = {}
        for i, v in ok:
            if i != q:
                near[i] = min(near.get(i, np.inf), float(np.sqrt(((own - v) ** 2).sum())))
        if near:
            out[q] = sorted(near.items(), key=lambda t: (t[1], t[0]))[:k]
    return out


def _recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in near}) for q, near in want.items()) / sum(map(len, want.values()))


def test_hilbert_keys_walk_from_cell_to_cell():
    for dims, bits in ((1, 5), (2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = cn.hilbert(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(400, 440)] + [(500, rows[7][1]), (500, rows[8][1]), (-100, rows[9][1]), (100, rows[100][1])]
    rows += [(600, None), (700, [0.0] * 6), (800, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (900, [float("nan")] + [1.0] * 5), (1000, [float("inf")] + [1.0] * 5)]
    rows += [(1100, []), (1200, [1.0, 2.0]), (None, rows[3][1]), (1300, [1e30] + [1.0] * 5), (1301, [-1e-30] * 6)]
    spec = cn.Curves(block=64, recall=1.0, sample=500)
    assert _got(cn.neighbours(_rows(spark, rows), spec, spark)) == _slow(rows, spec.k, spec.every)


def test_few_rows_and_none(spark):
    spec = cn.Curves(curves=3)
    one = [(0, [1.0, 2.0])]
    assert _got(cn.neighbours(_rows(spark, one), spec, spark)) == {}
    assert _got(cn.neighbours(_rows(spark, []), spec, spark)) == {}
    assert _got(cn.neighbours(_rows(spark, [(1, [1.0]), (2, [2.0])]), spec, spark)) == {}
    two = [(0, [1.0, 2.0]), (1, [1.0, 3.0]), (100, [4.0, 6.0])]
    assert _got(cn.neighbours(_rows(spark, two), spec, spark)) == _slow(two, 10, 100)


@pytest.mark.parametrize("n", [5, 11, 12, 40])
def test_all_candidates_if_they_are_few(spark, n):
    rng = np.random.default_rng(n)
    rows = [(100 * i if i < n // 2 + 1 else i, rng.standard_normal(12).tolist()) for i in range(n)]
    got, want = _got(cn.neighbours(_rows(spark, rows), cn.Curves(recall=0.5), spark)), _slow(rows, 10, 100)
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items()}
    assert n > 12 or got == want


@pytest.mark.parametrize("noise", [0.02, 0.3])
def test_recall_and_narrow_windows_where_data_allow(spark, noise):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((150, 16))
    which = np.where(rng.random(6000) < 1 / 3, 0, rng.integers(0, 150, 6000))
    rows = list(enumerate((centres[which] + noise * rng.standard_normal((6000, 16))).tolist()))
    spec = cn.Curves(block=512, sample=2000, every=50)
    assert _recall(_got(cn.neighbours(_rows(spark, rows), spec, spark)), _slow(rows, spec.k, spec.every)) >= 0.93


def test_the_window_follows_the_data():
    rng = np.random.default_rng(2)
    flat, near = rng.standard_normal((4000, 2)) @ rng.standard_normal((2, 32)), rng.standard_normal((4000, 32))
    spec, widths = cn.Curves(), []
    for x in (flat, near):
        ids = np.arange(len(x))
        i, j, _ = cn._best(x[:100], ids[:100], x, ids, 10)
        widths.append(cn.window(cn.Ordering(x, spec), x[:100], x[j], i, spec))
    assert widths[0] < 0.002 and widths[0] < widths[1] / 5


def test_identical_vectors_in_one_third_of_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [0.5] * 8 if i % 3 == 0 else rng.standard_normal(8).tolist()) for i in range(5000)]
    got = _got(cn.neighbours(_rows(spark, rows), cn.Curves(block=256, sample=1000), spark))
    assert got[300] == [(i, 0.0) for i in range(0, 30, 3)] and got[0] == [(i, 0.0) for i in range(3, 33, 3)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_against_brute_force(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    want = _slow([(int(i), list(v)) for i, v in zip(t["vec_id"], t["embedding"], strict=True)], 10, 100)
    got = _got(cn.op12_curve_neighbours(spark, SF))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert _recall(got, want) >= 0.93
    for q, near in got.items():
        exact = dict(want[q])
        assert all(abs(exact[i] - s) < 1e-12 for i, s in near if i in exact)
