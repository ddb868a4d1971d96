"""Registered queries on whole rows of pixels: levels, sheets and what is cut out of them, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import raster as R
from tessera.operators import atlas, compose, edges, filters, layout, mips, packing, predict, view
from tessera.plans.registry import _KINDS, _ONE, _PX, _RECT, _RGBA, _pass, query
from tessera.plans.registry import _sums as _two_sums
from tessera.sources import views


def _counted(spark, sf_dir):
    """Rows of the images, counted from 0."""
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy("y")).cast("long") - 1
    return views.rows(spark, sf_dir).withColumn("y", rank)


def _sums(rows, *by):
    """Width, height and two sums of the samples of the images that rows (by, y, row) are of."""
    total = R.total(F.col("row"))
    sums = rows.groupBy(*by).agg(F.max(F.floor(F.size("row") / 4)).alias("width"), F.count("*").alias("height"), F.sum(total).alias("total"), F.sum(R.moment(F.col("row")) + F.col("y") * F.size("row") * total).alias("moment"))
    return sums.select(*by, "width", "height", "total", "moment")


#: Levels that the SQL goes down to: images of up to 2 ** 10 rows have no more.
_DEPTH = 10
_ROWS = f"""{_PX}, y0 AS (SELECT image_id, y, row_number() OVER (PARTITION BY image_id ORDER BY y) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS h FROM (SELECT DISTINCT image_id, y FROM px)),
l0 AS MATERIALIZED (SELECT image_id, 0 AS level, 16::BIGINT AS w, h, k AS y, x // 4 AS x, x % 4 AS c, p AS v FROM px JOIN y0 USING (image_id, y))"""


def _levels() -> str:
    out = f"WITH {_ROWS}"
    for k in range(1, _DEPTH):
        down = _pass(f"d{k}", f"t{k}", "x", "y")
        across = _pass(f"a{k}", f"s{k}", "y", "x").replace(f"a{k} AS (", f"a{k} AS MATERIALIZED (")
        out += f""", s{k} AS MATERIALIZED (SELECT image_id, w, h, y, x, c, v, w AS n, greatest(1, w // 2) AS m, least(w, h) * {_ONE} AS radius FROM l{k - 1} WHERE w > 1 OR h > 1), {across},
t{k} AS MATERIALIZED (SELECT a.*, h AS n, greatest(1, h // 2) AS m, least(w, h) * {_ONE} AS radius FROM a{k} a JOIN (SELECT DISTINCT image_id, w, h FROM s{k}) USING (image_id)), {down},
l{k} AS MATERIALIZED (SELECT image_id, {k} AS level, greatest(1, w // 2) AS w, greatest(1, h // 2) AS h, y, x, c, v FROM d{k} JOIN (SELECT DISTINCT image_id, w, h FROM s{k}) USING (image_id))"""
    every = " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(_DEPTH))
    return f"{out} SELECT image_id, level, w AS width, h AS height, sum(v)::BIGINT AS total, sum(v * ((y * w + x) * 4 + c + 1))::BIGINT AS moment FROM ({every}) GROUP BY image_id, level, w, h"


@query(_levels())
def mip_pixels(spark, sf_dir):
    """All levels of each image, put into one image with padding and cut out of it again."""
    sheets, at = mips.chain_rows(_counted(spark, sf_dir))
    return _sums(compose.cut_out(sheets, at).withColumnsRenamed({"sheet": "image_id", "id": "level"}), "image_id", "level")


@query(_levels())
def mip_chain(spark, sf_dir):
    """All levels of the image that one task makes of each image, cut out of its bytes."""
    made = mips.chains(views.images(spark, sf_dir)).select("image_id", F.col("width").alias("_w"), "rgba", F.inline("levels"))
    start = lambda r: ((F.col("y") + r) * F.col("_w") * 4 + F.col("x") * 4 + 1).cast("int")
    lines = F.transform(F.sequence(F.lit(0).cast("long"), F.col("h") - 1), lambda r: F.call_function("substring", F.col("rgba"), start(r), (F.col("w") * 4).cast("int")))
    own = F.aggregate(lines, F.lit(b""), lambda a, x: F.concat(a, x))
    return made.select("image_id", F.col("level").cast("int").alias("level"), F.col("w").alias("width"), F.col("h").alias("height"), R.byte_total(own).alias("total"), R.byte_moment(own).alias("moment"))


_AT = "spot AS (SELECT label % 3 AS sheet, label::BIGINT AS id, 16::BIGINT AS w, count(*) AS h, 20 * (row_number() OVER (PARTITION BY label % 3 ORDER BY label) - 1) + 2 AS x, label * 5 % 11::BIGINT - 3 AS y FROM embeddings GROUP BY label)"


@query(f"""WITH {_ROWS}, {_AT}, s AS (SELECT sheet, max(x) + 14 AS width, max(y + h) + 3 AS height FROM spot GROUP BY sheet),
cells AS (SELECT *, unnest(range(width)) AS sx FROM (SELECT *, unnest(range(height)) AS sy FROM s)),
met AS (SELECT c.sheet, c.sy, c.sx, a.id, least(greatest(c.sx - a.x, 0), a.w - 1) AS x, least(greatest(c.sy - a.y, 0), a.h - 1) AS y
  FROM cells c JOIN spot a ON a.sheet = c.sheet AND c.sx BETWEEN a.x - 2 AND a.x + a.w + 1 AND c.sy BETWEEN a.y - 2 AND a.y + a.h + 1),
v AS (SELECT m.sheet, m.sy, sum(v)::BIGINT AS total, sum(v * (m.sx * 4 + c + 1))::BIGINT AS moment FROM met m JOIN l0 ON l0.image_id = m.id AND l0.x = m.x AND l0.y = m.y GROUP BY m.sheet, m.sy)
SELECT sheet, sy AS y, width * 4 AS n, coalesce(total, 0) AS total, coalesce(moment, 0) AS moment FROM (SELECT DISTINCT sheet, sy, width FROM cells) LEFT JOIN v USING (sheet, sy)""")
def sheet_rows(spark, sf_dir):
    """Images side by side on three sheets, two pixels of padding around each, the last and some upper edges cut off."""
    rows = _counted(spark, sf_dir).withColumnRenamed("image_id", "id")
    each = rows.groupBy("id").agg(F.count("*").alias("h")).withColumns({"sheet": (F.col("id") % 3).cast("int"), "w": F.lit(16).cast("long")})
    rank = F.row_number().over(Window.partitionBy("sheet").orderBy("id")).cast("long") - 1
    at = each.withColumns({"x": 20 * rank + 2, "y": F.col("id") * 5 % 11 - 3})
    sizes = at.groupBy("sheet").agg((F.max("x") + 14).alias("width"), (F.max(F.col("y") + F.col("h")) + 3).alias("height"))
    made = compose.sheets(rows, at, sizes, 2)
    return made.select("sheet", "y", F.size("row").cast("long").alias("n"), R.total(F.col("row")).alias("total"), R.moment(F.col("row")).alias("moment"))


_BRANDS = "r AS (SELECT p_brand AS sheet, p_partkey AS id, p_size::BIGINT AS w, (51 - p_size)::BIGINT AS h FROM part)"


@query(f"""WITH {_BRANDS}, o AS (SELECT *, coalesce(sum(w + 2) OVER (PARTITION BY sheet ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x FROM r),
s AS (SELECT sheet, max(x + w) + 2 AS width FROM o GROUP BY sheet)
SELECT sheet, y, max(width) AS n, coalesce(sum(CASE WHEN y - 1 < h THEN (w + 2) * (id % 250 + 1) END), 0)::BIGINT + coalesce(sum(CASE WHEN y - 1 >= h AND y - 2 < h THEN (w + 2) * (id % 250 + 1) END), 0)::BIGINT AS total FROM o JOIN s USING (sheet), (SELECT unnest(range(52))::BIGINT AS y) GROUP BY sheet, y""")
def brand_sheets(spark, sf_dir):
    """A rectangle of one value for each part, in one row on the sheet of its brand; x by running sums, padding of one.
    Rows keep the place of their part, so parts of one key, on one sheet or on several, stay apart."""
    r = views.rects(spark, sf_dir).withColumnRenamed("grp", "sheet").withColumn("step", F.col("w") + 2)
    at = layout.offsets(r, "sheet", "id", "step").select("sheet", "id", (F.col("offset") + 1).alias("x"), F.lit(1).cast("long").alias("top"), "w", "h")
    value = F.array_repeat((F.col("id") % 250 + 1).cast("long"), F.col("w").cast("int"))
    rows = at.select("sheet", "x", "top", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1)).alias("y"), value.alias("row"))
    sizes = at.groupBy("sheet").agg((F.max(F.col("x") + F.col("w")) + 1).alias("width"), F.lit(52).cast("long").alias("height"))
    made = compose.composed(compose.padded(rows, 1, 1), sizes, 1)
    return made.select("sheet", "y", F.size("row").cast("long").alias("n"), R.total(F.col("row")).alias("total"))


@query(f"WITH {_PX} {_two_sums('p', 'px')}")
def paeth_fold(spark, sf_dir):
    """Paeth residuals of whole images undone in tiles of 24 samples, which leave smaller ones at the right and below."""
    coded = predict.residuals(_counted(spark, sf_dir))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy("y")).cast("long") - 1
    named = views.rows(spark, sf_dir).select("image_id", F.col("y").alias("own"), rank.alias("k"))
    back = predict.undo_paeth(coded, "paeth", 24)
    met = back.withColumnRenamed("y", "k").join(named, ["image_id", "k"]).select("image_id", F.col("own").alias("y"), "row")
    return predict.summary(met, "row")


_GRID = f"""WITH {_RGBA}{_KINDS}, k AS (SELECT image_id, y, row_number() OVER (PARTITION BY image_id ORDER BY y) AS k FROM (SELECT DISTINCT image_id, y FROM t)),
s AS (SELECT image_id, k, x, rank, transform, unnest(['R', 'G', 'B']) AS channel, unnest([r, g, b]) AS p FROM t JOIN k USING (image_id, y)),
l AS (SELECT *, coalesce(lag(p) OVER a, 0) AS l, coalesce(lag(p) OVER d, 0) AS u FROM s WINDOW a AS (PARTITION BY image_id, transform, channel, k ORDER BY x), d AS (PARTITION BY image_id, transform, channel, x ORDER BY k)),
n AS (SELECT *, coalesce(lag(u) OVER (PARTITION BY image_id, transform, channel, k ORDER BY x), 0) AS c FROM l),
q AS (SELECT *, CASE WHEN abs(u - c) <= abs(l - c) AND abs(u - c) <= abs(l + u - 2 * c) THEN l WHEN abs(l - c) <= abs(l + u - 2 * c) THEN u ELSE c END AS s FROM n),
e AS (SELECT image_id, rank, transform, channel, sum(least(p, 256 - p))::BIGINT AS none, sum(least((p - l + 256) % 256, 256 - (p - l + 256) % 256))::BIGINT AS delta, sum(least((p - u + 256) % 256, 256 - (p - u + 256) % 256))::BIGINT AS up, sum(least((p - s + 256) % 256, 256 - (p - s + 256) % 256))::BIGINT AS paeth FROM q GROUP BY ALL),
f AS (SELECT *, CASE WHEN paeth * 10000 <= least(delta, up) * 9200 THEN paeth ELSE least(delta, up) END AS best FROM e),
g AS (SELECT *, CASE WHEN none * 10000 <= best * 9800 THEN 'None' WHEN paeth * 10000 <= least(delta, up) * 9200 THEN 'Paeth' WHEN delta <= up THEN 'Delta' ELSE 'Up' END AS predictor FROM f),
w AS (SELECT image_id, rank, transform, sum(CASE predictor WHEN 'None' THEN none WHEN 'Paeth' THEN paeth WHEN 'Delta' THEN delta ELSE up END) AS cost FROM g GROUP BY ALL),
b AS (SELECT image_id, CASE WHEN min(cost) * 10000 <= max(cost) FILTER (rank = 0) * 9950 THEN first(transform ORDER BY cost, rank) ELSE 'None' END AS best FROM w GROUP BY image_id)
SELECT image_id, transform, channel, none, delta, up, paeth, predictor, transform = b.best AS chosen FROM g JOIN b USING (image_id)"""


@query(_GRID)
def candidate_costs(spark, sf_dir):
    """The costs of all transforms, channels and predictors of each image, and what they choose."""
    return predict.choose_candidates(predict.candidate_costs(views.rows(spark, sf_dir)))


_MOVES = """e AS (SELECT user_id AS viewer, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id AS seq, user_id % 700 + 50 AS w, user_id % 500 + 40 AS h, event_type AS op, value, event_id % 320 AS mx, event_id % 240 AS my FROM events)"""
_STEP = """RECURSIVE {moves}, f AS (SELECT *, least(greatest(least(320.0 / w, 240.0 / h, 1.0), 0.01), 8.0)::DOUBLE AS fitted FROM e),
r AS (SELECT viewer, 0::BIGINT AS k, 0::BIGINT AS seq, w, h, fitted, fitted AS scale, w / 2::DOUBLE AS x, h / 2::DOUBLE AS y FROM f WHERE k = 1
UNION ALL SELECT viewer, k, seq, w, h, fitted, scale, CASE WHEN 2 * (320 / scale / 2) >= w THEN w / 2::DOUBLE ELSE least(greatest(x, 320 / scale / 2), w - 320 / scale / 2) END, CASE WHEN 2 * (240 / scale / 2) >= h THEN h / 2::DOUBLE ELSE least(greatest(y, 240 / scale / 2), h - 240 / scale / 2) END FROM (
  SELECT viewer, k, seq, w, h, fitted, s AS scale,
    CASE op WHEN 'click' THEN (mx - 160::DOUBLE) / scale + x - (mx - 160::DOUBLE) / s WHEN 'view' THEN x - (mx - 160) / scale WHEN 'signup' THEN x + (mx - 160) WHEN 'error' THEN (160 - 160::DOUBLE) / scale + x - (160 - 160::DOUBLE) / s WHEN 'purchase' THEN w / 2::DOUBLE ELSE x END AS x,
    CASE op WHEN 'click' THEN (my - 120::DOUBLE) / scale + y - (my - 120::DOUBLE) / s WHEN 'view' THEN y - (my - 120) / scale WHEN 'signup' THEN y + (my - 120) WHEN 'error' THEN (120 - 120::DOUBLE) / scale + y - (120 - 120::DOUBLE) / s WHEN 'purchase' THEN h / 2::DOUBLE ELSE y END AS y
  FROM (SELECT r.*, f.k AS nk, f.seq AS nseq, f.op, f.mx, f.my, CASE f.op WHEN 'click' THEN least(greatest(r.scale * (CASE WHEN f.seq % 3 = 0 THEN 0.5 ELSE 1.25 END)::DOUBLE, r.fitted), 8.0::DOUBLE) WHEN 'error' THEN least(greatest(1.0::DOUBLE, r.fitted), 8.0::DOUBLE) WHEN 'purchase' THEN r.fitted ELSE r.scale END AS s FROM r JOIN f ON f.viewer = r.viewer AND f.k = r.k + 1) q (viewer, k0, seq0, w, h, fitted, scale, x, y, k, seq, op, mx, my, s)))"""


@query(f"WITH {_STEP.format(moves=_MOVES)} SELECT viewer, seq, floor(scale * 1e6 + 0.5)::BIGINT AS scale, floor(x * 1e6 + 0.5)::BIGINT AS x, floor(y * 1e6 + 0.5)::BIGINT AS y FROM r WHERE k > 0")
def viewport_replay(spark, sf_dir):
    """Viewports after every event of their viewers: zooms, drags, moves, one to one and fits."""
    e = views.table(spark, sf_dir, "events")
    op = F.element_at(F.create_map(*[F.lit(v) for v in ("click", "zoom", "view", "pan", "signup", "move", "error", "whole", "purchase", "fit")]), F.col("event_type"))
    mx, my = F.col("event_id") % 320, F.col("event_id") % 240
    factor = F.when(F.col("event_id") % 3 == 0, 0.5).otherwise(1.25)
    a, b = F.when(op == "zoom", factor).otherwise(mx - 160), F.when(op == "zoom", mx).otherwise(my - 120)
    moves = e.select(F.col("user_id").alias("viewer"), F.col("event_id").alias("seq"), (F.col("user_id") % 700 + 50).alias("width"), (F.col("user_id") % 500 + 40).alias("height"), op.alias("op"), a.alias("a"), b.alias("b"), my.alias("c"))
    micro = lambda c: F.floor(F.col(c) * 1e6 + 0.5).alias(c)
    return view.replay(moves, (320, 240)).select("viewer", "seq", micro("scale"), micro("x"), micro("y"))


@query(f"WITH {_ROWS} SELECT (image_id % 3)::INT AS grp, 0::BIGINT AS sheet, image_id AS id, w AS width, h AS height, sum(v)::BIGINT AS total, sum(v * ((y * w + x) * 4 + c + 1))::BIGINT AS moment FROM l0 GROUP BY image_id, w, h")
def atlas_rows(spark, sf_dir):
    """Images packed into three sheets, composed by rows and cut out of these again; longer images have longer sheets."""
    rows = _counted(spark, sf_dir).select((F.col("image_id") % 3).cast("int").alias("grp"), F.col("image_id").alias("id"), "y", "row")
    back = compose.cut_out(*atlas.area_sheets(rows, 1024, longer=True))
    return _sums(back.select(F.col("sheet.grp").alias("grp"), F.col("sheet.sheet").alias("sheet"), F.col("id.id").alias("id"), "y", "row"), "grp", "sheet", "id")


_SPLIT = f"""WITH RECURSIVE {_RECT}, o AS (SELECT *, w + 4 AS pw, h + 4 AS ph, row_number() OVER (PARTITION BY grp ORDER BY w * h DESC, greatest(w, h) DESC, id) AS n FROM rects),
s AS (SELECT grp, 1::BIGINT AS n, 0::BIGINT AS k, [struct_pack(x := 0::BIGINT, y := 0::BIGINT, s := 0::BIGINT)] AS open, NULL::BIGINT AS id, 0::BIGINT AS sheet, 0::BIGINT AS x, 0::BIGINT AS y, 0::BIGINT AS w, 0::BIGINT AS h FROM (SELECT DISTINCT grp FROM rects)
UNION ALL SELECT grp, CASE WHEN ok THEN n + 1 ELSE n END, CASE WHEN ok THEN 0 ELSE k + 1 END,
  list_concat(open[:k], [struct_pack(x := CASE WHEN ok THEN nx + pw ELSE nx END, y := ny, s := CASE WHEN ok THEN greatest(ns, ph) ELSE ns END)], open[k + 2:], CASE WHEN NOT ok AND k + 1 = len(open) THEN [struct_pack(x := 0::BIGINT, y := 0::BIGINT, s := 0::BIGINT)] ELSE [] END),
  CASE WHEN ok THEN oid END, k, nx + 2, ny + 2, ow, oh FROM (
  SELECT *, ny + ph <= 128 AS ok FROM (
    SELECT s.grp, s.n, s.k, s.open, o.id AS oid, o.w AS ow, o.h AS oh, o.pw, o.ph, CASE WHEN open[k + 1].x + o.pw > 128 THEN 0 ELSE open[k + 1].x END AS nx,
      CASE WHEN open[k + 1].x + o.pw > 128 THEN open[k + 1].y + open[k + 1].s ELSE open[k + 1].y END AS ny, CASE WHEN open[k + 1].x + o.pw > 128 THEN 0 ELSE open[k + 1].s END AS ns
    FROM s JOIN o ON o.grp = s.grp AND o.n = s.n)))
SELECT grp, id, sheet, x, y, w, h FROM s WHERE id IS NOT NULL"""


@query(_SPLIT)
def split_sheets(spark, sf_dir):
    """The sheets of each brand's rectangles at a limit that takes several, and where each rectangle stands."""
    return packing.split(views.rects(spark, sf_dir), 128, 2)


@query(f"WITH {_RECT} SELECT grp, arg_max(id, (w * h, id)) AS id, max(w * h) AS area FROM rects GROUP BY grp")
def seed_items(spark, sf_dir):
    """Of each group the item that an order by edges begins with."""
    return atlas.seeds(views.rects(spark, sf_dir))


@query(f"""WITH {_ROWS}, p AS (SELECT image_id, w, h, y, x, c, (v * a + 127) // 255 AS v FROM l0 JOIN (SELECT image_id, y, x, v AS a FROM l0 WHERE c = 3) USING (image_id, y, x) WHERE c < 3),
src AS (SELECT image_id, 'top' AS y, x, c, sum(v) // 2 AS v, 16 AS n, 24 AS m, {5 * _ONE} AS radius FROM p WHERE y < 2 GROUP BY ALL UNION ALL SELECT image_id, 'bottom', x, c, v, 16, 24, {5 * _ONE} FROM p WHERE y = h - 1
UNION ALL SELECT image_id, 'left', y, c, sum(v) // 2, h, 24, {5 * _ONE} FROM p WHERE x < 2 GROUP BY image_id, y, c, h UNION ALL SELECT image_id, 'right', y, c, v, h, 24, {5 * _ONE} FROM p WHERE x = 15), {_pass("e", "src", "y", "x")},
q AS (SELECT image_id, y, sum((77 * r + 150 * g + 29 * b)::BIGINT >> 8)::BIGINT // 24 AS mean FROM (SELECT image_id, y, x, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b FROM e GROUP BY ALL) GROUP BY ALL)
SELECT image_id, y AS side, sum(v)::BIGINT AS total, sum(v * (x * 3 + c + 1))::BIGINT AS moment, (any_value(mean) >> 3)::INT AS q FROM e JOIN q USING (image_id, y) GROUP BY image_id, y""")
def edge_signatures(spark, sf_dir):
    """The edges of all sides, resampled to 24 samples."""
    found = edges.edge_signatures(_counted(spark, sf_dir), 24)
    return found.select("image_id", "side", R.total(F.col("edge")).alias("total"), R.moment(F.col("edge")).alias("moment"), "q")


_TINT = [f"CASE WHEN image_id % 2 = 0 THEN {tint} ELSE {c} END AS {c}" for c, tint in (("r", "r % 20"), ("g", "120 + g % 100"), ("b", "CASE WHEN i % 4 = 0 THEN b % 20 ELSE 250 END"))]


@query(f"WITH {_RGBA}, k AS (SELECT image_id, y, row_number() OVER (PARTITION BY image_id ORDER BY y) - 1 AS k FROM (SELECT DISTINCT image_id, y FROM rgba)), i AS (SELECT image_id, k * 16 + x AS i, count(*) OVER (PARTITION BY image_id) AS n, r, g, b FROM rgba JOIN k USING (image_id, y)), t AS (SELECT image_id, {', '.join(_TINT)} FROM i WHERE i % greatest(1, n // (SELECT 4 * min(c) FROM (SELECT count(*) AS c FROM embeddings GROUP BY label))) = 0) SELECT image_id, avg(g) > 100 AND avg(g) > 6 * avg(r) AND avg(g) > 6 * avg(b) AS green FROM t GROUP BY image_id")
def green_cast_sampled(spark, sf_dir):
    """Some pixels looked at, every fourth of the smallest image; in tinted images the others would say something else."""
    counted = _counted(spark, sf_dir)
    quads = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda x: F.struct((F.col("y") * 16 + x).alias("i"), *[F.get("row", x * 4 + k).alias(c) for k, c in enumerate("rgb")]))
    px = counted.select("image_id", F.inline(quads)).selectExpr("image_id", "i", *_TINT)
    least = counted.groupBy("image_id").count().agg(F.min("count")).first()[0] or 1
    return filters.green_cast(px, least * 4)


def _window(of: str, name: str, radii: dict[str, int]) -> str:
    """3 x 3 medians of planes, then means along and across."""
    lists = ", ".join(f"list_sort(list(b.{c})) AS m{c}" for c in radii)
    along = ", ".join(f"avg(m{c}[len(m{c}) // 2 + 1]) OVER (PARTITION BY image_id, k ORDER BY x ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS a{c}" for c, r in radii.items())
    across = ", ".join(f"avg(a{c}) OVER (PARTITION BY image_id, x ORDER BY k ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS s{c}" for c, r in radii.items())
    return f"{name}1 AS (SELECT a.image_id, a.k, a.x, {lists} FROM {of} a JOIN {of} b ON b.image_id = a.image_id AND b.k BETWEEN a.k - 1 AND a.k + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL), {name}2 AS (SELECT image_id, k, x, {along} FROM {name}1), {name} AS (SELECT image_id, k, x, {across} FROM {name}2)"


_DENOISED = f"""WITH {_RGBA}, k AS (SELECT image_id, y, row_number() OVER (PARTITION BY image_id ORDER BY y) - 1 AS k FROM (SELECT DISTINCT image_id, y FROM rgba)),
p AS (SELECT image_id, k, x, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b, a, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS l FROM rgba JOIN k USING (image_id, y)),
c AS (SELECT *, b - l AS cb, r - l AS cr FROM p), {_window("c", "s", {"l": 2, "cb": 5, "cr": 5})},
t AS (SELECT *, least(greatest((170 - l) / 170, 0), 1) AS dark, least(greatest(abs(l - sl) / 45, 0), 1) AS detail, least(greatest((l - 175) / 80, 0), 1) AS bright FROM c JOIN s USING (image_id, k, x)),
n AS (SELECT *, l + (sl - l) * (pow(dark, 0.85) * 0.70::DOUBLE * (1 - detail * 0.45::DOUBLE)) AS l2, (cb + (scb - cb) * ((0.70::DOUBLE + dark * 0.28::DOUBLE) * (1 - bright * 0.55::DOUBLE))) * (1 - pow(dark, 1.25) * 0.18::DOUBLE) AS cb2, (cr + (scr - cr) * ((0.70::DOUBLE + dark * 0.28::DOUBLE) * (1 - bright * 0.55::DOUBLE))) * (1 - pow(dark, 1.25) * 0.18::DOUBLE) AS cr2 FROM t),
v AS (SELECT image_id, k, x, a, l2 + cr2 AS r, (l2 - 0.299::DOUBLE * (l2 + cr2) - 0.114::DOUBLE * (l2 + cb2)) / 0.587::DOUBLE AS g, l2 + cb2 AS b FROM n),
d AS (SELECT image_id, k, x, a, {", ".join(f"floor(least(greatest({c} + 0.5, 0), 255))::BIGINT AS {c}" for c in "rgb")} FROM v)"""


@query(_DENOISED + " SELECT image_id, k AS y, sum(r + g + b + a)::BIGINT AS total, sum(r * (4 * x + 1) + g * (4 * x + 2) + b * (4 * x + 3) + a * (4 * x + 4))::BIGINT AS moment FROM d GROUP BY image_id, k")
def denoise_rows(spark, sf_dir):
    return predict.summary(filters.denoise_rows(_counted(spark, sf_dir)), "row")


@query(_DENOISED + " SELECT image_id, 16::BIGINT AS width, count(*) // 16 AS height, sum(r + g + b + a)::BIGINT AS total FROM d GROUP BY image_id")
def denoise(spark, sf_dir):
    """The filter on whole images, one at a time."""
    out = filters.denoise(views.images(spark, sf_dir))
    return out.select("image_id", "width", "height", R.byte_total(F.col("rgba")).alias("total"))
