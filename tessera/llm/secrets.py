"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control. DataFrame operations only.

Match positions come from a marker that regexp_replace puts around each match: pieces between markers alternate, and
their lengths in code points add up to offsets.

The battery takes runs of 16 or more [A-Za-z0-9+/_-] whose characters fit an encoding (hexadecimal, base 32 and
alphanumeric of either case, base 64 with or without digits), and makes three statistics of each: chi-squared of the
alphabet's uniformity, runs (of characters of one class, and above and below the alphabet's middle) and lag-one serial
correlation. Each has a known distribution for random strings and another for text of the same length and encoding, whose
letters are uneven, whose classes change seldom and whose neighbours are alike. A string must not differ from random ones
in any test. How unlikely the three are for text gives three p-values; Brown's combination of them, which allows for tests
that depend on each other, is the string's p-value, and Benjamini-Hochberg thresholds by length class, read from a
histogram over all candidates, decide. Lower-case runs and runs without digits, which names in text share, have length
classes of their own. Letters of one case alone are words to the battery.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._scratch import Scratch

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
# Two noncharacters: the marker, and what stands for it where a text has it.
_MARK, _STAND_IN = "\ufdd0", "\ufdd1"
#: Pieces of a text that are folded at a time.
_BLOCK = 256
_ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower32": "abcdefghijklmnopqrstuvwxyz234567", "lower": "0123456789abcdefghijklmnopqrstuvwxyz", "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
# Sums of squares and cubes of the alphabet's shares in text: letters of words, and for hexadecimal the digits of numbers.
_UNEVEN = {k: (0.1, 0.01) if k == "hex" else (0.065, 0.0055) for k in _ALPHABETS}
# Added to the length class: kinds that names in text share don't dilute the others' control.
_GROUPS = {"hex": 0, "base32": 0, "upper": 0, "base64": 0, "lower32": 100, "lower": 100, "letters": 200}


@dataclass(frozen=True)
class Battery:
    """rate: false discoveries among those found in a length class; least_p: randomness tests must not fall below.

    Of text: change is the chance that two neighbours in names and numbers differ in class, alike their correlation.
    """

    rate: float = 0.01
    least_p: float = 0.001
    change: float = 0.15
    alike: float = 0.3


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, found) of the leftmost non-overlapping matches."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    # Pieces alternate between text and matches, so in a block of an even number of them every second one is a match.
    # Blocks are folded by themselves and then moved to where they begin: arrays grow by a block's matches or by blocks,
    # never by a text's matches.
    empty = F.expr("named_struct('at', 0, 'odd', false, 'out', cast(array() as array<struct<start:int,end:int,found:string>>))")

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.char_length(x)
        one = F.array(F.struct(acc["at"].alias("start"), end.alias("end"), x.alias("found")))
        return F.struct(end.alias("at"), (~acc["odd"]).alias("odd"), F.when(acc["odd"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def moved(m: Column, by: Column) -> Column:
        return F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["found"].alias("found"))

    def join(acc: Column, block: Column) -> Column:
        here = F.transform(block["out"], lambda m: moved(m, acc["at"]))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(here)).alias("out"))

    # One lambda binds the pieces, so that they are made once.
    blocks = F.transform(F.array(pieces), lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _BLOCK).cast("int")), lambda k: F.aggregate(F.slice(p, k * _BLOCK + 1, _BLOCK), empty, step)))[0]
    whole = F.aggregate(blocks, F.expr("named_struct('at', 0, 'out', cast(array() as array<array<struct<start:int,end:int,found:string>>>))"), join, lambda acc: F.flatten(acc["out"]))
    none = F.expr("cast(array() as array<struct<start:int,end:int,found:string>>)")
    return F.when(text.rlike(pattern), whole).otherwise(none)


def _named(spans: Column, kind: str, order: int) -> Column:
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("ord"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def _render(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ",")


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, to about 1e-7 relative to 1."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    low = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, low).otherwise(1 - low)


def _battery(c: Column, spec: Battery) -> Column:
    """For a match: its span, length class, score (-10 log10 of text's combined p) and whether it may be random; null without an encoding."""
    s = F.regexp_replace(c["found"], "=+$", "")
    digit, upper, lower = s.rlike("[0-9]"), s.rlike("[A-Z]"), s.rlike("[a-z]")
    kind = (
        F.when(digit & s.rlike("^([0-9a-f]+|[0-9A-F]+)$") & (upper | lower), F.lit("hex"))
        .when(digit & upper & s.rlike("^[A-Z2-7]+$"), F.lit("base32"))
        .when(digit & upper & s.rlike("^[A-Z0-9]+$"), F.lit("upper"))
        .when(digit & upper & lower, F.lit("base64"))
        .when(digit & lower & s.rlike("^[a-z2-7]+$"), F.lit("lower32"))
        .when(digit & lower & s.rlike("^[a-z0-9]+$"), F.lit("lower"))
        .when(upper & lower, F.lit("letters"))
    )
    folded = F.when(kind == "hex", F.lower(s)).otherwise(F.translate(s, "-_", "+/"))
    tables = (_ALPHABETS, _GROUPS, {k: v[0] for k, v in _UNEVEN.items()}, {k: v[1] for k, v in _UNEVEN.items()})
    known, groups, twice, thrice = (F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]) for table in tables)

    def stats(p: Column) -> Column:
        alphabet, text = p["alphabet"], p["text"]
        n, k = F.char_length(text).cast("double"), F.char_length(alphabet).cast("double")
        squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda acc, ch: acc + F.when(ch == "", 0.0).otherwise(F.pow((F.char_length(text) - F.char_length(F.replace(text, ch, F.lit("")))).cast("double"), 2.0)))
        chi = k / n * squares - n
        z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
        index = F.transform(F.filter(F.split(text, ""), lambda ch: ch != ""), lambda ch: (F.instr(alphabet, ch) - 1).cast("double") - (k - 1) / 2)
        pairs = F.zip_with(F.slice(index, 1, F.size(index) - 1), F.slice(index, 2, F.size(index) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        changes = F.aggregate(pairs, F.lit(0.0), lambda acc, q: acc + F.when((q["a"] < 0) != (q["b"] < 0), 1.0).otherwise(0.0))
        z_runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        serial = F.aggregate(pairs, F.lit(0.0), lambda acc, q: acc + q["a"] * q["b"]) / ((k * k - 1) / 12)
        z_serial = serial / F.sqrt(n - 1)
        classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(p["text"], "[0-9]", "\u0001"), "[A-Z]", "\u0002"), "[a-z+/]", "\u0003")
        edges = F.size(F.filter(F.split(F.regexp_replace(classes, "([\u0001\u0002\u0003])\\1*", "$1"), ""), lambda ch: ch != "")) - 1
        z_mix = (edges - spec.change * (n - 1)) / F.sqrt(spec.change * (1 - spec.change) * (n - 1))
        p_random = F.least(_tail(z_chi), 2 * _tail(F.abs(z_runs)), 2 * _tail(F.abs(z_serial)))
        # The same statistics for text: the moments of a sum of squared multinomial counts with uneven shares.
        s2, s3 = p["squares"], p["cubes"]
        text_squares = n + n * (n - 1) * s2
        text_spread = F.sqrt(2 * n * (n - 1) * (s2 + 2 * (n - 2) * s3 - (2 * n - 3) * s2 * s2))
        against = [(text_squares - squares) / text_spread, z_mix, (spec.alike - serial / (n - 1)) * F.sqrt(n - 1)]
        # Brown's combination: the sum of -2 log p is about 1.5 times a chi-squared number of 4 degrees, where three
        # independent tests would have 6, so that tests which depend on each other don't count as three.
        bounded = [F.least(F.greatest(_tail(z), F.lit(1e-38)), F.lit(1.0)) for z in against]
        half = sum((-F.log(q) for q in bounded), F.lit(0.0)) / 1.5
        combined = F.exp(-half) * (1 + half)
        score = F.least(F.lit(400.0), F.floor(-10 * F.log10(F.greatest(combined, F.lit(1e-40)))))
        return F.struct(p["start"].alias("start"), p["end"].alias("end"), (F.floor(F.log2(n) * 2).cast("int") + p["group"]).alias("bin"), score.cast("int").alias("score"), (p_random >= spec.least_p / 3).alias("random"))

    base = F.struct(c["start"].alias("start"), c["end"].alias("end"), folded.alias("text"), F.element_at(known, kind).alias("alphabet"), F.element_at(groups, kind).alias("group"), F.element_at(twice, kind).alias("squares"), F.element_at(thrice, kind).alias("cubes"))
    return F.when(kind.isNotNull(), F.transform(F.array(base), stats)[0])


def _thresholds(scanned: DataFrame, spec: Battery) -> dict[int, int]:
    """Least score of each length class at which expected false finds stay within the rate; a row per length class."""
    each = scanned.select(F.explode("candidates").alias("c")).select("c.*")
    table = each.groupBy("bin", "score").agg(F.count("*").alias("n"), F.sum(F.col("random").cast("long")).alias("found"))
    every, above = Window.partitionBy("bin"), Window.partitionBy("bin").orderBy(F.col("score").desc())
    table = table.withColumn("m", F.sum("n").over(every)).withColumn("over", F.sum("found").over(above))
    # At most 401 scores for each of some sixty length classes.
    within = table.where(F.col("m") * F.pow(F.lit(10.0), -F.col("score") / 10) <= spec.rate * F.col("over"))
    return {r["bin"]: r["least"] for r in within.groupBy("bin").agg(F.min("score").alias("least")).collect()}


def scan(docs: DataFrame, spec: Battery = Battery(), spark: SparkSession | None = None) -> DataFrame:  # noqa: B008
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Offsets count code points, ends are exclusive. Null texts count as empty, and have no spans; a null doc_id stays
    null; repeated rows are scanned each. An empty table gives an empty result; other columns are ignored.
    """
    spark = spark or docs.sparkSession
    scratch = Scratch(spark, "secrets")
    t = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _MARK, _STAND_IN)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("t"))
    assign = F.filter(_matches(F.col("t"), ASSIGN), lambda m: F.char_length(F.regexp_extract(m["found"], ASSIGN, 2)) >= 6)
    access = F.filter(_matches(F.col("t"), ACCESS), lambda m: F.char_length(m["found"]) >= 20)
    # A run of [0-9a-f] is maximal either way, so its least length can stand in the pattern.
    runs = _matches(F.col("t"), HEX.replace("+", "{24,}"))
    found = F.filter(F.transform(_matches(F.col("t"), CANDIDATE), lambda c: _battery(c, spec)), lambda c: c.isNotNull())
    scanned = scratch.keep(rows.select("doc_id", _named(assign, "assign", 0).alias("assign"), _named(access, "access", 1).alias("access"), _named(runs, "hex", 2).alias("hex"), found.alias("candidates")))
    least = _thresholds(scanned, spec)
    none = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string>>)")
    if least:
        limits = F.create_map(*[x for k, v in sorted(least.items()) for x in (F.lit(k), F.lit(v))])
        passed = F.filter(F.col("candidates"), lambda c: c["random"] & (c["score"] >= F.coalesce(F.element_at(limits, c["bin"]), F.lit(1000))))
        extra = F.transform(passed, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("ord"), c["end"].alias("end"), F.lit("random").alias("kind")))
    else:
        extra = none
    out = scanned.withColumn("base", F.concat("assign", "access", "hex")).withColumn("extra", extra)
    return out.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(F.encode(_render(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        _render(F.concat("base", "extra")).alias("spans"),
        F.size("extra").cast("long").alias("n_random"),
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), Battery(), spark)
