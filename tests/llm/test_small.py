"""Small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination as dec
from tessera.llm import exact_dedup, html_text, license_scan, lm_scores, mixing, near_dedup, secrets, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, salt int, digest string, code string, page long, hits string"


def _docs(spark, texts, source=lambda i: f"s{i % 3}"):
    return spark.createDataFrame([(i, t, "en", source(i), None, 1, 2, "d", "c", 3, "h") for i, t in texts], SCHEMA)


def _words(t):
    return (t or "").encode().split()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(vocab, k=rng.randrange(5, 120))) for _ in range(60)]
    out = []
    for i, t in enumerate(base):
        out.append(t)
        if i % 3 == 0:
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        if i % 5 == 0:
            out.append(t.replace(" ", "  \n", 3))
        if i % 7 == 0 and i:
            out.append(base[i - 1] + " " + t)
    out += [None, "", "   ", "one", "one", "one two", " ".join(vocab * 20)]
    return list(enumerate(out))


def test_exact_groups(spark, texts):
    docs = _docs(spark, texts)
    norm = {i: re.sub(r"[ \t-\r]+", " ", t or "") for i, t in texts}
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs, spark).collect()}
    assert len(got) == len(texts)
    for i, t in norm.items():
        same = [j for j, u in norm.items() if u == t]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(same), len(same), i == min(same))
        assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    kept = exact_dedup.drop_copies(docs, spark)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in got if got[i]["kept"])
    twice = docs.union(docs.limit(1))
    assert exact_dedup.drop_copies(twice, spark).where("doc_id = 0").count() == 1


def test_near_groups(spark, texts):
    spec = near_dedup.NearDedup(words=4)

    def shingles(t):
        w = [x.lower() for x in _words(t)]
        return {b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    sets = {i: shingles(t) for i, t in texts}
    comp = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = {k: min(a, b) if v in (a, b) else v for k, v in comp.items()}
    got = {r["doc_id"]: r for r in near_dedup.near_groups(_docs(spark, texts), spec, spark).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == comp
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_repeats(spark, texts):
    first = {}
    for i, t in texts:
        w = _words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for r in substring_dedup.remove_repeats(_docs(spark, texts), spark=spark, texts=True).collect():
        w = _words(dict(texts)[r["doc_id"]])
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < r["doc_id"] for j in range(13)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (len(w), len(gone), kept.decode())


def test_repeats_of_one_seed_stay_apart(spark):
    # These windows share their seed and the lowest 40 bits of their hashes.
    tail = " of the long passage that all documents in this set share here"
    pairs = [(1061112, 2954135), (2137894, 2600184), (343789, 1069602)]
    docs = _docs(spark, [(i, f"n{n}{tail}") for i, n in enumerate(x for p in pairs for x in p)])
    assert all(r["n_removed"] == 0 for r in substring_dedup.remove_repeats(docs, spark=spark).collect())


def test_distance_and_contamination(spark):
    def slow(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        return min(row)

    rng = random.Random(5)
    for _ in range(200):
        p, t = ("".join(rng.choices("abc", k=rng.randrange(1, n))) for n in (70, 90))
        assert dec.myers(p, t, 1000) == slow(p, t)
    item = "the quick brown fox jumps over the lazy dog while seven wizards boil a strange green soup"
    changed = item.replace("quick", "quack").replace("lazy", "lzy")
    docs = _docs(spark, [(1, f"x {item.upper()} y"), (2, f"a\n{changed} b"), (3, item[:40]), (4, None), (5, "")])
    bench = spark.createDataFrame([(7, item, 1), (8, None, 2), (None, "z" * 50, 3), (9, "short", 4)], "item_id long, text string, doc_id int")
    got = {r["doc_id"]: (r["contaminated"], r["item_ids"], r["distances"]) for r in dec.contamination(docs, bench).collect()}
    assert got == {1: (True, [7], [0]), 2: (True, [7], [2]), 3: (False, [], []), 4: (False, [], []), 5: (False, [], [])}
    blocks = dec.contamination(docs, bench, dec.Matching(block_chars=1))
    assert {r["doc_id"]: r["contaminated"] for r in blocks.collect()} == {k: v[0] for k, v in got.items()}
    assert sorted(r["doc_id"] for r in dec.drop_contaminated(docs, bench).collect()) == [3, 4, 5]


def test_blocks_change_nothing_and_short_items_match(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over"), (2, "pack my box with five dozen jugs"), (3, "Short one"), (2, "sphinx of black quartz judge my vow")], "item_id long, text string")
    texts = ["x the quick brown fox jumps over y", "pack my box with five dozen jugs", "a short  one.", "a short ones"]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[2]), (8, texts[3]), (9, f"{texts[1]} sphinx of black quartz judge my vow"), (10, None)]
    docs = _docs(spark, rows, lambda i: "s")
    got = [sorted(map(str, dec.contamination(docs, bench, dec.Matching(block_chars=n)).collect())) for n in (8_000_000, 1, 60)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)
    assert [r["item_ids"] for r in dec.contamination(docs, bench).collect()] == [[1], [2], [3], [3], [], [2], []]


def test_toxicity(spark):
    assert toxicity.fold("You 1D10T, lоsér!") == " you idiot loser "
    lex = toxicity.Lexicon({" idiot ": 4.0, " vequ": 4.0}, ["idiot proof"])
    assert lex.score("an id1ot here") >= 0.5 and lex.score("la vequmo en") >= 0.5
    assert lex.score("it is idiot proof") < 0.5 and lex.score("idiots") < 0.5 and lex.score("") < 0.5
    rng = random.Random(1)
    plain = [" ".join(rng.choices([f"word{i}" for i in range(300)], k=60)) for _ in range(200)]
    texts = [(i, t + (" scum here" if i % 8 == 0 else "")) for i, t in enumerate(plain)] + [(900, None)]
    docs, labels = _docs(spark, texts), spark.createDataFrame([(i, None, int(i % 8 == 0)) for i in range(200)] + [(None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    lex = toxicity.learn(docs, labels, spark=spark)
    assert {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, lex).collect()} == {i: int(i % 8 == 0 and i < 200) for i, _ in texts}
    assert toxicity.learn(docs, labels.limit(0), spark=spark).weights == {}


def test_mixing(spark):
    rng = random.Random(2)
    texts = [(i, "a " * rng.randrange(1, 80)) for i in range(600)] + [(700, None), (701, " ")]
    docs = _docs(spark, texts, lambda i: None if i % 10 == 0 else f"s{i % 3}")
    rows = mixing.balance(docs, spark=spark).collect()
    names = sorted({f"s{i % 3}" for i in range(3)}) + [None]
    source = {i: None if i % 10 == 0 else f"s{i % 3}" for i, _ in texts}
    size = {i: len(_words(t)) for i, t in texts}
    total = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    weight = dict(zip(names, (1, 2, 3, 1), strict=True))
    target, capped = {}, set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * total[s] if s in capped else rest * weight[s] / free for s in names}
        new = {s for s in names if s not in capped and target[s] > 3 * total[s]}
        if not new:
            break
        capped |= new
    assert len(rows) == len(texts)
    for s in names:
        own = [r for r in rows if source[r["doc_id"]] == s]
        assert all(r["size"] == size[r["doc_id"]] and r["source_size"] == total[s] and 0 <= r["taken"] <= 3 * r["size"] for r in own)
        assert all(abs(r["target"] - target[s]) < 1e-6 * target[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 80
    assert sorted(map(str, rows)) == sorted(map(str, mixing.balance(docs, spark=spark).collect()))


def test_secrets(spark):
    token = "wJalrXUtnFEMI7K7MDENGbPxRfiCYz9q2Lk8Vd0T"
    t = f"é password = 'hunter2x' TOKEN:abc {'ab12' * 8} AKIA{'A1' * 8} {token} thblebleinginnnnnnnnn"
    got = secrets.scan(_docs(spark, [(1, t), (2, None), (3, "﷐ secret=abcdefgh")]), secrets.Battery(rate=0.5), spark).orderBy("doc_id").collect()
    spans = got[0]["spans"].split(",")
    assert (got[0]["n_assign"], got[0]["n_access"], got[0]["n_hex"]) == (1, 1, 1)
    assert spans[0] == f"assign:2:{t.index('hunter2x') + 8}" and f"random:{t.index(token)}:{t.index(token) + 40}" in spans
    assert got[1]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[2]["spans"] == "assign:2:17"


def test_secrets_of_every_alphabet(spark):
    rng = random.Random(8)
    lower, b32, b64 = "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    tokens = ["".join(rng.choices(a, k=n)) for a, n in ((lower, 32), (b32, 64), (b64, 32)) for _ in range(20)]
    words = ["internationalization", "AbstractUserFactoryBean", "CONSTANTNAMESINCAPITALS", "chapter2section14page", "getElementsByTagNameList"]
    got = secrets.scan(_docs(spark, list(enumerate(tokens + words))), secrets.Battery(), spark).collect()
    found = {r["doc_id"] for r in got if r["n_random"]}
    # Some have too few changes of class to be told from names.
    assert min(sum(i in found for i in range(k, k + 20)) for k in (0, 20, 40)) >= 12
    assert not found & set(range(60, 65))


def test_html_attributes_are_whole_names():
    """Names inside other attributes' names and values, and values that only begin like others, say nothing."""
    kept = ['p title="hidden gems"', 'p data-hidden="false"', 'span data-role="dialog"', 'p aria-hidden="true-ish"', 'p title="role=dialog"', "p data-x='a class=menu b'", 'p alt=hidden', 'p data-class="cookie" id=one', 'p class="a" title="x > y hidden"', "p role=note", 'p data-aria-hidden=true']
    for tag in kept:
        assert html_text.extract(f"<article><p>One</p><{tag}>two</{tag.split()[0]}></article>").split() == ["One", "two"], tag
    for tag in ("p hidden", 'p hidden=""', "p HIDDEN class=x", 'p aria-hidden="true"', "div role='dialog'", 'div class="cookie-notice"', "div id=menu", "p\nhidden\n", "div class = 'menu'"):
        assert html_text.extract(f"<article><p>One</p><{tag}>two</{tag.split()[0]}></article>") == "One", tag


def test_html_in_a_form_around_the_page():
    inner = "<nav>Menu</nav><article><p>First part of it.</p><form class=search><label>Find</label><input><p>Go</p></form><p>Second part.</p></article>"
    assert html_text.extract(f"<body><form action='/x' method=post>{inner}</form></body>") == "First part of it.\nSecond part."
    plain = "<div><p>A long text of the page without any marks, in two parts.</p><p>This is the second of them.</p></div>"
    assert html_text.extract(f"<body><nav>Menu</nav><form id=aspnetForm>{plain}<select><option>x</select></form></body>").split("\n")[-1] == "This is the second of them."
    small = "<body><div><p>All that the page has to say stands here.</p></div><form><p>Write to us</p><input></form></body>"
    assert html_text.extract(small) == "All that the page has to say stands here."


def test_html():
    page = "<html><head><title>t</title></head><body><nav>Menu</nav><div class='cookie-notice'>ok</div><article><header><h1>A &amp; B</h1></header><p>One  two<p>three <b>x</b>y<br>z<div class=ad>buy</div><form>f</form></p></article><div id=comments>no</div><footer>c</footer>"
    assert html_text.extract(page) == "A & B\nOne two\nthree xy z"
    assert html_text.extract("") == "" and html_text.extract("plain < text") == "plain < text"
    assert html_text.extract("<script>a</p>") == ""


def test_pages(spark):
    page = "<body><div class=top>Site</div><div><p>{}</p></div><div class=bottom>Made here</div></body>"
    rows = [(i, f"http://h.org/{i}", page.format(f"Text number {i} " * 9)) for i in range(12)] + [(50, None, None), (51, "nohost", "")]
    got = {r["page_id"]: r for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string"), spark=spark).collect()}
    assert got[3]["text"] == ("Text number 3 " * 9).strip() and got[50]["text"] == "" == got[51]["text"]


def test_whole_articles():
    page = "<body><article><p>One</p><section class='related-work'>two</section><div class=legal-analysis>three</div><label>four</label><math><mi>x</mi></math><div class=social-share>no</div></article><div class=related>no</div><article>five</article><div class=entry-content>six</div></body>"
    assert html_text.extract(page) == "One\ntwo\nthree\nfourx\nfive\nsix"


def test_template_inside_articles(spark):
    page = "<body><article><h1>Title {0}</h1><p>Text number {0}</p><div class=x>Read our other stories</div><div class=y>Printed daily</div></article></body>"
    rows = [(i, f"http://h.org/{i}", page.format(i)) for i in range(12)] + [(i, f"http://same.org/{i}", page.format("s")) for i in range(20, 30)]
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string"), spark=spark).collect()}
    assert got[3] == "Title 3\nText number 3"
    assert got[20] == "Title s\nText number s\nRead our other stories\nPrinted daily"
    one = html_text.main_texts(spark.createDataFrame(rows[:1], "page_id long, url string, html string"), spark=spark).first()
    assert one["text"] == "Title 0\nText number 0\nRead our other stories\nPrinted daily"


def test_license_lines(spark):
    docs = _docs(spark, [(1, "Hello.\nReleased under the MIT License.\nbye"), (2, None), (3, "the free version of the water"), (4, "Licensed under the Apache License, Version 2.0.")])
    got = {r["doc_id"]: (r["n_lines"], r["families"]) for r in license_scan.scan(docs, spark=spark).collect()}
    assert got == {1: (1, "MIT"), 2: (0, ""), 3: (0, ""), 4: (1, "Apache-2.0")}


def test_wrapped_licenses(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal"
    prose = "\n".join(f"line {i} of the story as told by the author in the old town" for i in range(30))
    narrow = mit.replace("\n", " ").replace(" ", "\r\n * ")
    texts = [gpl, mit, f"{prose}\n{gpl}\n{prose}", narrow, prose, "--\nHello.\nReleased under the MIT License.\n*\nbye", mit.replace("a copy\n", "a copy\n \n")]
    docs = _docs(spark, list(enumerate(texts)))
    got = {r["doc_id"]: (r["families"], r["n_lines"], r["n_unknown"]) for r in license_scan.scan(docs.union(docs.where("doc_id = 4")), spark=spark).collect()}
    assert [got[i][0] for i in range(7)] == ["GPL", "MIT", "GPL", "MIT", "", "MIT", ""]
    assert got[0][1] >= 2 and got[1][1] == 2 and got[2][1] >= 2 and got[3][1] > 10 and got[5][1] == 1


def test_needed_words():
    for notice in (set(license_scan._grams(license_scan._words(t))) for v in license_scan.NOTICES.values() for t in v):
        assert len([g for g in notice if not set(g.split()) & set(license_scan._needed(0.4))]) < 0.4 * len(notice)


def test_license_words_are_the_trained_ones(spark):
    lines = ["", " ", "..", "-MIT- License.", "the BSD..license - and - GPL v2.0.", "Licensed under the...Apache\u00e9License, Version 2.0", "a.-.b CC-BY--SA 4.0-", "\u0130 license", "x" * 50 + "." * 3000 + " license"]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", license_scan._line_words(F.col("line")).alias("w")).select("i", "w", license_scan._pairs(F.col("w")).alias("p"))
    vocabulary = set(license_scan._vocabulary())
    for i, words, pairs in df.collect():
        want = license_scan._words(lines[i])
        assert [w for w in words if w] == [w for w in want if w in vocabulary]
        assert [p for p in pairs if p] == [f"{a} {b}" for a, b in zip(want, want[1:]) if {a, b} <= vocabulary]


def test_lm_scores(spark):
    docs = _docs(spark, [(1, "a b c"), (2, "a b d"), (3, None), (4, "Z")])
    got = {r["doc_id"]: (r["n_words"], r["n_seen"]) for r in lm_scores.scores(docs, spark=spark).collect()}
    assert got == {1: (3, 2), 2: (3, 2), 3: (0, 0), 4: (1, 0)}


def test_empty_tables(spark):
    docs = _docs(spark, [(1, "x")]).limit(0)
    lex = toxicity.Lexicon({" x ": 1.0})
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (exact_dedup.exact_groups(docs, spark), exact_dedup.drop_copies(docs, spark), near_dedup.near_groups(docs, spark=spark), substring_dedup.remove_repeats(docs, spark=spark), mixing.balance(docs, spark=spark), secrets.scan(docs, spark=spark), lm_scores.scores(docs, spark=spark), license_scan.scan(docs, spark=spark), toxicity.toxicity(docs, lex), dec.contamination(docs, bench)):
        assert out.count() == 0
