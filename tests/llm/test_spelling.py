"""Spelling variants against a slow version over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import spelling as sp

DOCS = "doc_id long, text string, lang string, word string, n long, id long, key long, place int, root string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "w", 1, 2, 3, 4, "r") for i, t in rows], DOCS)


def _slow_words(rows, spec):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if spec.every and h % spec.every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= spec.shortest and k >= spec.least}


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _slow(rows, spec):
    n, out = _slow_words(rows, spec), {}
    form = {}
    for w in n:
        near = [v for v in n if _near(v, w)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= spec.ratio * n[w] else None
        out[w] = len(near)
    rows = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows[w] = (form[w], root, n[w], out[w], n.get(form[w]))
    return rows


def _got(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def _texts(letters, n, seed):
    """Texts of words that come from few stems by some changes of one letter."""
    rng = random.Random(seed)
    stems = ["".join(rng.choices(letters, k=rng.randrange(4, 9))) for _ in range(12)]
    out = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(40)):
            w = rng.choice(stems[: rng.choice([2, 12])])
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + rng.choice(letters) + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at + 1 :]])
            words.append(rng.choice([w, w, w.capitalize(), w.upper() if w.isascii() else w]))
        out.append((i, rng.choice([" ", ", ", "1", "\n", "Ł", "一", "-"]).join(words)))
    return out


@pytest.mark.parametrize(("letters", "every"), [("ab", 97), ("abcéßÿÉ", 5), ("aaab", 0)])
def test_like_all_pairs(spark, letters, every):
    rows = _texts(letters, 250, every)
    rows += [(None, rows[3][1]), (None, None), (7, ""), (8, rows[9][1]), (8, rows[9][1]), (900, "x×y÷z " * 4), (901, "1 2 -- \n")]
    spec = sp.Spelling(every=every, keys=500)
    want = _slow(rows, spec)
    assert len(want) > 20 and any(r[0] and r[1] != r[0] for r in want.values())
    assert _got(sp.variants(_docs(spark, rows), spec, spark)) == want


def test_very_long_texts_and_words(spark):
    rng = random.Random(1)
    long = "".join(rng.choices("abcdefg", k=3000))
    more = long[:1500] + "x" + long[1500:]
    rows = [(1, " ".join([long] * 6 + [more] * 3 + ["a" * 500] * 3 + ["a" * 501] * 7)), (2, "spelling speling " * 60000 + "spelling " * 90000)]
    spec = sp.Spelling()
    assert _got(sp.variants(_docs(spark, rows), spec, spark)) == _slow(rows, spec)


def test_a_word_with_a_third_of_all_occurrences(spark):
    docs = spark.range(20000, numPartitions=8).selectExpr("id doc_id", "concat('hottest w', repeat('a', 4 + int(id % 3)), ' ', 'hotest') text")
    got = _got(sp.variants(docs, sp.Spelling(every=0), spark))
    assert got["hotest"][:2] == (None, "hotest") and got["hottest"][2] == 20000 and got["waaaaa"][3] == 2


def test_empty_tables_and_bad_ratio(spark):
    assert sp.variants(_docs(spark, []), sp.Spelling(), spark).count() == 0
    assert sp.variants(_docs(spark, [(1, None), (2, "no five")]), sp.Spelling(), spark).count() == 0
    with pytest.raises(ValueError):
        sp.variants(_docs(spark, []), sp.Spelling(ratio=1), spark)


def test_keys_are_of_what_is_left():
    words = ["abcde", "abde", "xbcde", "aab", "ab", "éè", "é", "aaaa" * 50]
    key, word, place, head = sp.deletions(words)
    left = {}
    for k, w, p in zip(key.tolist(), word.tolist(), place.tolist(), strict=True):
        rest = words[w] if p < 0 else words[w][:p] + words[w][p + 1 :]
        assert left.setdefault(rest, k) == k
    assert len(set(left.values())) == len(left)
    assert sorted(place[head & (word == 3)].tolist()) == [0, 2]


def test_crc_of_joined_texts():
    rng = random.Random(2)
    names = [f"{rng.randrange(10**k)}:".encode() for k in range(1, 9)]
    words = [bytes(rng.choices(range(97, 123), k=k)) for k in (1, 2, 5, 63, 64, 65, 200)]
    row, code = np.array([(r, c) for r in range(len(names)) for c in range(len(words))]).T
    size = np.array([len(w) for w in words])[code]
    got = sp._crc(names, row, code, size, words)
    assert got.tolist() == [zlib.crc32(names[r] + words[c]) for r, c in zip(row, code, strict=True)]


def test_runs_end_with_their_row():
    found, row = sp.runs(pa.array(["AbÉ", "cd", "", "é Łx"], pa.large_string()))
    assert found.to_pylist() == ["abÉ", "cd", "é", "x"] and row.tolist() == [0, 1, 3, 3]
