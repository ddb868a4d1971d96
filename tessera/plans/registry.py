"""Registered queries over the supplied tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import header, names
from tessera.functions import raster as R
from tessera.operators import filters, kernels, layout, packing, predict, resample, view
from tessera.sources import container, images, packfile, respack, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# DuckDB forms of the views.
_PX = """px AS (SELECT label::BIGINT AS image_id, vec_id AS y, unnest(range(len(embedding)))::BIGINT AS x,
  unnest(list_transform(embedding, lambda v: ((floor(v * 128)::BIGINT + 128) % 256 + 256) % 256)) AS p FROM embeddings)"""
_RGBA = _PX + """, rgba AS (SELECT image_id, y, x // 4 AS x, max(p) FILTER (x % 4 = 0) AS r, max(p) FILTER (x % 4 = 1) AS g, max(p) FILTER (x % 4 = 2) AS b, max(p) FILTER (x % 4 = 3) AS a FROM px GROUP BY ALL)"""
_RECT = "rects AS (SELECT p_partkey AS id, p_brand AS grp, p_size::BIGINT AS w, (51 - p_size)::BIGINT AS h FROM part)"
_NEAR = _PX + """, l AS (SELECT image_id, y, x, p, coalesce(lag(p) OVER r, 0) AS l, coalesce(lag(p) OVER c, 0) AS u FROM px WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)),
n AS (SELECT *, coalesce(lag(u) OVER (PARTITION BY y ORDER BY x), 0) AS c FROM l),
q AS (SELECT *, CASE WHEN abs(u - c) <= abs(l - c) AND abs(u - c) <= abs(l + u - 2 * c) THEN l WHEN abs(l - c) <= abs(l + u - 2 * c) THEN u ELSE c END AS s FROM n),
e AS (SELECT image_id, y, x, p AS none, (p - l + 256) % 256 AS delta, (p - u + 256) % 256 AS up, (p - s + 256) % 256 AS paeth FROM q)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sums(column: str, source: str = "e") -> str:
    return f"SELECT image_id, y, sum({column})::BIGINT AS total, sum({column} * (x + 1))::BIGINT AS moment FROM {source} GROUP BY image_id, y"


@query(f"WITH {_NEAR} {_sums('delta')}")
def delta_residual(spark, sf_dir):
    return predict.summary(views.rows(spark, sf_dir).withColumn("e", R.delta_row(F.col("row"))), "e")


@query(f"WITH {_PX} {_sums('p', 'px')}")
def delta_decode(spark, sf_dir):
    rows = views.rows(spark, sf_dir)
    return predict.summary(rows.withColumn("p", R.undelta_row(R.delta_row(F.col("row")))), "p")


@query(f"WITH {_NEAR} {_sums('up')}")
def up_residual(spark, sf_dir):
    return predict.summary(predict.residuals(views.rows(spark, sf_dir)), "up")


@query(f"WITH {_PX} SELECT image_id, x, sum(p)::BIGINT AS total, sum(p * (y + 1))::BIGINT AS moment FROM px GROUP BY image_id, x")
def up_decode(spark, sf_dir):
    p = predict.undo_up(predict.residuals(views.rows(spark, sf_dir)), "up")
    return p.groupBy("image_id", F.col("x").cast("long").alias("x")).agg(F.sum("p").alias("total"), F.sum(F.col("p") * (F.col("y") + 1)).alias("moment"))


@query(f"WITH {_NEAR} {_sums('paeth')}")
def paeth_residual(spark, sf_dir):
    return predict.summary(predict.residuals(views.rows(spark, sf_dir)), "paeth")


_KINDS = """, t AS (SELECT image_id, y, x, 0 AS rank, 'None' AS transform, r, g, b FROM rgba
UNION ALL SELECT image_id, y, x, 1, 'SubGreen', (r - g + 256) % 256, g, (b - g + 256) % 256 FROM rgba
UNION ALL SELECT image_id, y, x, 2, 'SubRed', r, (g - r + 256) % 256, (b - r + 256) % 256 FROM rgba
UNION ALL SELECT image_id, y, x, 3, 'SubBlue', (r - b + 256) % 256, (g - b + 256) % 256, b FROM rgba),
costs AS (SELECT image_id, rank, transform, sum(least(r, 256 - r))::BIGINT AS cost_r, sum(least(g, 256 - g))::BIGINT AS cost_g, sum(least(b, 256 - b))::BIGINT AS cost_b FROM t GROUP BY ALL)"""


@query(f"WITH {_RGBA}{_KINDS} SELECT image_id, transform, cost_r, cost_g, cost_b FROM costs")
def color_transform_costs(spark, sf_dir):
    return predict.transform_costs(views.pixels(spark, sf_dir)).drop("rank")


@query(f"WITH {_RGBA} SELECT image_id, t.transform, sum(r + 3 * g + 5 * b)::BIGINT AS checksum FROM rgba, (VALUES ('None'), ('SubGreen'), ('SubRed'), ('SubBlue')) t(transform) GROUP BY ALL")
def color_inverse(spark, sf_dir):
    p = predict.restored(predict.transformed(views.pixels(spark, sf_dir)))
    return p.groupBy("image_id", "transform").agg(F.sum(F.col("r") + 3 * F.col("g") + 5 * F.col("b")).alias("checksum"))


@query(f"WITH {_RGBA}{_KINDS}, s AS (SELECT *, cost_r + cost_g + cost_b AS cost FROM costs), m AS (SELECT image_id, arg_min(transform, cost * 10 + rank) AS best, min(cost) AS cost, max(cost) FILTER (rank = 0) AS plain FROM s GROUP BY image_id) SELECT image_id, CASE WHEN cost * 10000 <= plain * 9950 THEN best ELSE 'None' END AS transform FROM m")
def transform_choice(spark, sf_dir):
    return predict.choose_transform(predict.transform_costs(views.pixels(spark, sf_dir)))


@query(f"WITH {_NEAR}, m AS (SELECT image_id, x % 4 AS channel, sum(least(none, 256 - none))::BIGINT AS none, sum(least(delta, 256 - delta))::BIGINT AS delta, sum(least(up, 256 - up))::BIGINT AS up, sum(least(paeth, 256 - paeth))::BIGINT AS paeth FROM e GROUP BY ALL) SELECT *, CASE WHEN none * 10000 <= (CASE WHEN paeth * 10000 <= least(delta, up) * 9200 THEN paeth ELSE least(delta, up) END) * 9800 THEN 'None' WHEN paeth * 10000 <= least(delta, up) * 9200 THEN 'Paeth' WHEN delta <= up THEN 'Delta' ELSE 'Up' END AS predictor FROM m")
def predictor_choice(spark, sf_dir):
    e = predict.residuals(views.rows(spark, sf_dir)).select("image_id", F.explode(F.arrays_zip("none", "delta", "up", "paeth", F.sequence(F.lit(0), F.size("none") - 1).alias("x"))).alias("z"))
    kinds = ("none", "delta", "up", "paeth")
    m = e.groupBy("image_id", (F.col("z.x") % 4).cast("long").alias("channel")).agg(*[F.sum(R.magnitude(F.col(f"z.{k}"))).alias(k) for k in kinds])
    return m.withColumn("predictor", predict.choose_predictor(*[F.col(k) for k in kinds]))


_ALPHA = "CASE WHEN image_id % 4 = 0 THEN 255 WHEN image_id % 4 = 1 THEN 0 WHEN image_id % 4 = 2 THEN CASE WHEN a >= 128 THEN 255 ELSE 0 END ELSE a END"


@query(f"WITH {_RGBA}, m AS (SELECT image_id, {_ALPHA} AS a FROM rgba) SELECT image_id, CASE WHEN min(a) = 255 THEN 'Opaque255' WHEN max(a) = 0 THEN 'Transparent0' WHEN bool_and(a IN (0, 255)) THEN 'Mask1Bit' ELSE 'Normal' END AS mode FROM m GROUP BY image_id")
def alpha_mode(spark, sf_dir):
    p = views.pixels(spark, sf_dir).withColumn("a", F.expr(_ALPHA))
    return p.groupBy("image_id").agg(R.alpha_mode().alias("mode"))


@query(f"WITH {_RGBA} SELECT image_id, y, x // 8 AS byte_no, sum((CASE WHEN a >= 128 THEN 1 ELSE 0 END) << (x % 8)::INT)::BIGINT AS byte FROM rgba GROUP BY ALL")
def alpha_mask_pack(spark, sf_dir):
    alpha = F.transform(R.deinterleaved(F.col("row"), 4)[3], lambda a: F.when(a >= 128, 255).otherwise(0))
    packed = views.rows(spark, sf_dir).select("image_id", "y", F.posexplode(R.mask_bytes(alpha)).alias("byte_no", "byte"))
    return packed.select("image_id", "y", F.col("byte_no").cast("long").alias("byte_no"), F.col("byte").cast("long").alias("byte"))


@query(f"WITH {_RECT} SELECT id, (w << 48) + (h << 32) + ((id % 65536) << 16) + (w + h) AS packed, w AS x, h AS y, id % 65536 AS w, w + h AS h FROM rects")
def rect_pack_unpack(spark, sf_dir):
    r = views.rects(spark, sf_dir).select("id", R.pack_rect(F.col("w"), F.col("h"), F.col("id") % 65536, F.col("w") + F.col("h")).alias("packed"))
    return r.select("id", "packed", *[c.alias(n) for c, n in zip(R.unpack_rect(F.col("packed")), "xywh", strict=True)])


@query("SELECT p_partkey AS id, p_partkey // 65536 % 65536 AS pixfmt, p_partkey // 256 % 256 AS qval, p_partkey % 256 AS channels, p_partkey % 2 = 1 AS predictor, CASE p_partkey // 2 % 4 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Opaque255' WHEN 2 THEN 'Transparent0' ELSE 'Mask1Bit' END AS alpha, p_partkey // 8 % 2 = 1 AS has_meta, p_partkey // 16 % 4 AS transform FROM part")
def flags_parse(spark, sf_dir):
    f = F.col("p_partkey")
    fields = header.parse_flags(f) | header.parse_feature(f)
    return views.table(spark, sf_dir, "part").select(f.alias("id"), *[c.alias(n) for n, c in fields.items() if n != "transform"], F.shiftright(f, 4).bitwiseAND(F.lit(3)).alias("transform"))


@query(f"WITH {_RGBA} SELECT image_id, (((77 * r + 150 * g + 29 * b) >> 8) >> 3)::INT AS q, count(*) AS n FROM rgba GROUP BY ALL")
def luma_quant(spark, sf_dir):
    q = F.shiftright(R.luma(F.col("r"), F.col("g"), F.col("b")), 3)
    return views.pixels(spark, sf_dir).groupBy("image_id", q.alias("q")).agg(F.count("*").alias("n"))


@query(f"WITH {_RGBA} SELECT image_id, min(r) AS min_r, max(r) AS max_r, round(avg(r), 6) AS mean_r, min(g) AS min_g, max(g) AS max_g, round(avg(g), 6) AS mean_g, min(b) AS min_b, max(b) AS max_b, round(avg(b), 6) AS mean_b FROM rgba GROUP BY image_id")
def channel_stats(spark, sf_dir):
    stats = [x for c in "rgb" for x in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.round(F.avg(c), 6).alias(f"mean_{c}"))]
    return views.pixels(spark, sf_dir).groupBy("image_id").agg(*stats)


@query(f"WITH {_PX}, n AS (SELECT a.image_id, a.y, sum(abs(a.p - b.p))::BIGINT AS cost FROM px a JOIN (SELECT image_id, y, lag(y) OVER (PARTITION BY image_id ORDER BY y) AS up FROM (SELECT DISTINCT image_id, y FROM px)) k ON k.y = a.y JOIN px b ON b.y = k.up AND b.x = a.x GROUP BY ALL) SELECT * FROM n")
def edge_cost(spark, sf_dir):
    rows = predict.with_above(views.rows(spark, sf_dir)).where("above is not null")
    return rows.select("image_id", "y", R.l1(F.col("row"), F.col("above")).alias("cost"))


@query(f"WITH {_PX}, i AS (SELECT y AS id, (avg(p)::DOUBLE * 4)::BIGINT AS bucket FROM (SELECT y, floor(avg(p)) AS p FROM px GROUP BY y) GROUP BY y), k AS (SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY id DESC) AS rn FROM i), c AS (SELECT a.id, b.id AS other, (SELECT 0) AS z FROM i a JOIN k b ON b.bucket BETWEEN a.bucket - 3 AND a.bucket + 3 AND b.rn <= 64 AND a.id <> b.id), d AS (SELECT c.id, c.other, sum(abs(p.p - q.p))::BIGINT AS cost FROM c JOIN px p ON p.y = c.id JOIN px q ON q.y = c.other AND q.x = p.x GROUP BY ALL) SELECT id, arg_min(other, cost * 100000000 + other) AS other, min(cost) AS cost FROM d GROUP BY id")
def bucket_nearest(spark, sf_dir):
    mean = F.floor(R.total(F.col("row")) / F.size("row")) * 4
    return layout.nearest(views.rows(spark, sf_dir).select(F.col("y").alias("id"), mean.alias("bucket"), F.col("row").alias("edge")))


@query(f"WITH {_RECT} SELECT row_number() OVER (ORDER BY w * h DESC, greatest(w, h) DESC, id) - 1 AS ordinal, id FROM rects")
def area_order(spark, sf_dir):
    return layout.area_order(views.rects(spark, sf_dir))


_SHELF = f"""WITH RECURSIVE {_RECT}, o AS (SELECT *, w + 4 AS pw, h + 4 AS ph, row_number() OVER (PARTITION BY grp ORDER BY w * h DESC, greatest(w, h) DESC, id) AS n FROM rects),
s AS (SELECT grp, 0::BIGINT AS n, 0::BIGINT AS id, 0::BIGINT AS cx, 0::BIGINT AS cy, 0::BIGINT AS shelf, 0::BIGINT AS x, 0::BIGINT AS y, 0::BIGINT AS w, 0::BIGINT AS h, false AS placed FROM (SELECT DISTINCT grp FROM rects)
UNION ALL SELECT grp, n, id, CASE WHEN ok THEN nx + pw ELSE nx END, ny, CASE WHEN ok THEN greatest(ns, ph) ELSE ns END, CASE WHEN ok THEN nx + 2 END, CASE WHEN ok THEN ny + 2 END, w, h, ok FROM (
  SELECT *, fits AND ny + ph <= 256 AS ok FROM (
    SELECT s.grp, o.n, o.id, o.w, o.h, o.pw, o.ph, o.pw <= 256 AND o.ph <= 256 AS fits,
      CASE WHEN o.pw <= 256 AND o.ph <= 256 AND s.cx + o.pw > 256 THEN 0 ELSE s.cx END AS nx,
      CASE WHEN o.pw <= 256 AND o.ph <= 256 AND s.cx + o.pw > 256 THEN s.cy + s.shelf ELSE s.cy END AS ny,
      CASE WHEN o.pw <= 256 AND o.ph <= 256 AND s.cx + o.pw > 256 THEN 0 ELSE s.shelf END AS ns
    FROM s JOIN o ON o.grp = s.grp AND o.n = s.n + 1)))
"""


@query(_SHELF + "SELECT grp, id, x, y, w, h, placed FROM s WHERE n > 0")
def shelf_pack(spark, sf_dir):
    return packing.shelf_pack(views.rects(spark, sf_dir), 256, 2)


@query(_SHELF + "SELECT p.p_partkey AS id FROM part p WHERE EXISTS (SELECT 1 FROM s WHERE s.placed AND s.id = p.p_partkey)")
def chunk_semi(spark, sf_dir):
    placed = packing.shelf_pack(views.rects(spark, sf_dir), 256, 2).where("placed")
    return views.rects(spark, sf_dir).select("id").join(placed, "id", "left_semi")


@query(_SHELF + "SELECT p.p_partkey AS id FROM part p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.placed AND s.id = p.p_partkey)")
def chunk_anti(spark, sf_dir):
    placed = packing.shelf_pack(views.rects(spark, sf_dir), 256, 2).where("placed")
    return views.rects(spark, sf_dir).select("id").join(placed, "id", "left_anti")


@query("SELECT doc_id, source, n_chars, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars)::BIGINT AS \"offset\" FROM documents")
def blob_offsets(spark, sf_dir):
    return layout.offsets(views.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars")


@query(f"WITH RECURSIVE {_RECT}, m AS (SELECT id, 0 AS level, w, h FROM rects UNION ALL SELECT id, level + 1, greatest(1, w // 2), greatest(1, h // 2) FROM m WHERE w > 1 OR h > 1) SELECT * FROM m")
def mip_dims(spark, sf_dir):
    return layout.mip_levels(views.rects(spark, sf_dir))


@query("WITH r AS (SELECT label::BIGINT AS image_id, vec_id AS y, list_transform(embedding, lambda v: ((floor(v * 128)::BIGINT + 128) % 256 + 256) % 256) AS p FROM embeddings) SELECT image_id, y, (3 * p[1] + 3 * p[-1] + list_sum(p[2:-2]))::BIGINT - 0 AS total FROM r")
def pad_replicate(spark, sf_dir):
    rows = views.rows(spark, sf_dir)
    return rows.select("image_id", "y", R.total(layout.pad_row(F.col("row"), 2)).alias("total"))


@query("WITH h AS (SELECT label::BIGINT AS image_id, count(*) AS h, 64::BIGINT AS w FROM embeddings GROUP BY label), n AS (SELECT *, least(h, greatest(1, least(1024, w * h) // w)) AS n FROM h) SELECT image_id, i, i * h // n AS y FROM (SELECT image_id, h, n, unnest(range(n)) AS i FROM n)")
def sample_rows(spark, sf_dir):
    heights = views.rows(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("h")).withColumn("w", F.lit(64).cast("long"))
    return predict.sample_rows(heights, 1024)


@query(f"WITH {_PX} SELECT image_id, y, x, round(avg(p) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean FROM px")
def box_blur(spark, sf_dir):
    return filters.blurred_rows(views.rows(spark, sf_dir), 2).withColumn("mean", F.round("mean", 6))


@query(f"WITH {_PX}, s AS (SELECT image_id, y, x, sum(p) OVER h AS s, count(*) OVER h AS n FROM px WINDOW h AS (PARTITION BY y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT image_id, y, x, round(sum(s) OVER v::DOUBLE / sum(n) OVER v, 6) AS mean FROM s WINDOW v AS (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def box_blur_image(spark, sf_dir):
    """Both passes; box_blur is the horizontal one."""
    return layout.box_blur(views.rows(spark, sf_dir), 2).withColumn("mean", F.round("mean", 6))


@query(f"WITH {_PX}, k AS (SELECT image_id, x, p, row_number() OVER (PARTITION BY image_id, x ORDER BY y) - 1 AS k, count(*) OVER (PARTITION BY image_id, x) AS h FROM px), g AS (SELECT image_id, h, ty, unnest(range(68)) AS tx FROM (SELECT DISTINCT image_id, h, unnest(range(h + 4)) AS ty FROM k)) SELECT image_id, ty AS y, sum(p)::BIGINT AS total, sum(p * (tx + 1))::BIGINT AS moment FROM g JOIN k USING (image_id, h) WHERE k.k = least(greatest(ty - 2, 0), h - 1) AND k.x = least(greatest(tx - 2, 0), 63) GROUP BY image_id, ty")
def pad_replicate_image(spark, sf_dir):
    """All four sides and the corners; pad_replicate is left and right."""
    moment = R.total(F.transform("row", lambda v, i: v * (i + 1)))
    return layout.pad_image(views.rows(spark, sf_dir), 2).select("image_id", "y", R.total(F.col("row")).alias("total"), moment.alias("moment"))


@query(f"WITH {_PX}, v AS (SELECT image_id, y, x, list(p) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS c FROM px), w AS (SELECT image_id, y, x, list_sort(flatten(list(c) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))) AS s FROM v) SELECT image_id, y, x, s[len(s) // 2 + 1] AS median FROM w")
def median3(spark, sf_dir):
    return filters.median3(views.rows(spark, sf_dir))


_EXT = "('png', 'jpg', 'jpeg', 'bmp', 'tga', 'tif', 'tiff', 'gif', 'dng')"


@query(f"WITH n AS (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpeg' ELSE '' END AS path FROM pages) SELECT page_id, path FROM n WHERE lower(regexp_extract(path, '[^/][.]([^./]+)$', 1)) IN {_EXT}")
def ext_filter(spark, sf_dir):
    path = F.concat("url", F.expr("CASE page_id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpeg' ELSE '' END"))
    return views.table(spark, sf_dir, "pages").select("page_id", path.alias("path")).where(images.is_image(F.col("path")))


@query("WITH s AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> '') AS p FROM pages) SELECT page_id, p[1] || ':' || array_to_string(p[2:], '/') AS resource FROM s WHERE len(p) > 1 AND p[1] <> '' AND array_to_string(p[2:], '/') <> ''")
def resource_location(spark, sf_dir):
    relative = views.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("p")).where("p rlike '^[^/]+/+[^/]'")
    return relative.select("page_id", respack.location(F.col("p")).alias("resource"))


@query(f"WITH {_RGBA}, k AS (SELECT image_id, y, row_number() OVER (PARTITION BY image_id ORDER BY y) - 1 AS sy FROM (SELECT DISTINCT image_id, y FROM rgba)), s AS (SELECT r.image_id, k.sy, r.x AS sx, r.r, r.g, r.b, r.a FROM rgba r JOIN k USING (image_id, y)) SELECT s.image_id, ty, tx, (r * a + 127) // 255 AS r, (g * a + 127) // 255 AS g, (b * a + 127) // 255 AS b FROM s JOIN (SELECT unnest(range(24)) AS tx) ON floor((tx + 0.5) / 1.5) = sx JOIN (SELECT unnest(range(24)) AS ty) ON floor((ty + 0.5) / 1.5) = sy")
def viewport_render(spark, sf_dir):
    """The top of each image in a window of 24 x 24 at a scale of 1.5."""
    rank = views.rows(spark, sf_dir).select("image_id", "y", (F.row_number().over(Window.partitionBy("image_id").orderBy("y")).cast("long") - 1).alias("sy"))
    px = views.pixels(spark, sf_dir).join(rank, ["image_id", "y"]).drop("y").withColumnRenamed("sy", "y")
    return view.render(px, view.Viewport((16, 16), (24, 24), 1.5, (8.0, 8.0)))


_WHOLE = _PX + """, k AS (SELECT image_id, y, row_number() OVER (PARTITION BY image_id ORDER BY y) - 1 AS sy FROM (SELECT DISTINCT image_id, y FROM px)),
bytes AS (SELECT px.image_id, k.sy * 64 + px.x AS pos, px.p FROM px JOIN k USING (image_id, y))"""
_DIGEST = f"WITH {_WHOLE} SELECT image_id, 16::BIGINT AS width, count(*) // 64 AS height, 4 AS channels, sum(p)::BIGINT AS total, sum(p * (pos + 1))::BIGINT AS moment FROM bytes GROUP BY image_id"


def _digest(found: DataFrame) -> DataFrame:
    """Two sums over the bytes of each image."""
    return found.select("image_id", "width", "height", "channels", R.byte_total(F.col("rgba")).alias("total"), R.byte_moment(F.col("rgba")).alias("moment"))


@query(_DIGEST)
def container_roundtrip(spark, sf_dir):
    return _digest(container.decode(container.encode(views.images(spark, sf_dir)), strict=False).where("error is null"))


@query(_DIGEST)
def paeth_decode(spark, sf_dir):
    return _digest(container.decode(container.encode(views.images(spark, sf_dir), "fast", "Paeth"), strict=False).where("error is null"))


@query(f"WITH {_RGBA}, m AS (SELECT image_id, count(*) // 16 AS height, CASE WHEN min(a) = 255 THEN 'Opaque255' WHEN max(a) = 0 THEN 'Transparent0' WHEN bool_and(a IN (0, 255)) THEN 'Mask1Bit' ELSE 'Normal' END AS alpha FROM rgba GROUP BY image_id) SELECT image_id, 2 AS version, 16::BIGINT AS width, height, 4 AS channels, alpha, CASE WHEN alpha IN ('Normal', 'Mask1Bit') THEN 4 ELSE 3 END AS streams, (48 * height + CASE alpha WHEN 'Normal' THEN 16 * height WHEN 'Mask1Bit' THEN 2 * height ELSE 0 END)::BIGINT AS plain_size FROM m")
def container_inspect(spark, sf_dir):
    head = container.inspect(container.encode(views.images(spark, sf_dir)), strict=False).where("error is null")
    return head.select("image_id", "version", "width", "height", "channels", "alpha", F.size("streams").alias("streams"), R.total(F.col("streams.orig_size")).alias("plain_size"))


# Fixed-point numbers with 32 fraction bits as wide integers: products round down, quotients towards 0.
_ONE = 1 << 32


def _product(a: str, b: str) -> str:
    p = f"(({a})::HUGEINT * ({b}))"
    return f"(CASE WHEN {p} >= 0 THEN {p} // {_ONE} ELSE -((-{p} + {_ONE - 1}) // {_ONE}) END)"


def _quotient(a: str, b: str) -> str:
    return f"(sign({a})::INT * sign({b})::INT * ((abs({a})::HUGEINT * {_ONE}) // abs({b})))"


def _pass(name: str, of: str, line: str, along: str) -> str:
    """One resampling pass of the rows (image_id, line, along, c, v, n, m, radius) from n to m samples along."""
    sinc = ""
    for k, x in enumerate(("d", "e")):
        before = f"{name}{'k' if not k else 'd'}"
        sinc += f""", {name}{x}1 AS (SELECT *, {_product(resample.PI, f"{x} % {_ONE}")} AS t FROM {before}), {name}{x}2 AS (SELECT *, {_product("t", "t")} AS t2 FROM {name}{x}1),
{name}{x}3 AS (SELECT *, t + {_product(_product("t2", "t"), f"{resample.C3} + {_product(f'{resample.C5} + {_product(resample.C7, "t2")}', 't2')}")} AS sine FROM {name}{x}2),
{name}{x} AS (SELECT * EXCLUDE (t, t2, sine), CASE WHEN {x} = 0 THEN {_ONE} ELSE {_quotient(f"(CASE WHEN ({x} // {_ONE}) % 2 = 1 THEN -sine ELSE sine END)", _product(resample.PI, x))} END AS s{x} FROM {name}{x}3)"""
    return f"""{name}n AS (SELECT DISTINCT n, m, radius FROM {of}),
{name}c AS (SELECT n, m, radius, i, {_product(f"i * {_ONE} + {_ONE // 2}", f"(n * {_ONE}) // m")} - {_ONE // 2} AS centre FROM (SELECT *, unnest(range(m)) AS i FROM {name}n)),
{name}k AS (SELECT n, m, radius, i, s, d, {_quotient("d", "radius")} AS e FROM (SELECT *, abs(centre - s * {_ONE}::HUGEINT) AS d FROM (SELECT *, unnest(range(n)) AS s FROM {name}c)) WHERE d < radius){sinc},
{name}w AS (SELECT n, m, radius, i, s, {_product("sd", "se")} AS w FROM {name}e),
{name}v AS (SELECT n, m, radius, i, s, {_quotient("w", "total")} AS w FROM (SELECT *, sum(w) OVER (PARTITION BY n, m, radius, i) AS total FROM {name}w) WHERE total <> 0),
{name} AS (SELECT image_id, {line}, i AS {along}, c, greatest(0, least(255, (sum(v * k.w::HUGEINT) - (CASE WHEN sum(v * k.w::HUGEINT) < 0 THEN {_ONE - 1} ELSE 0 END))::HUGEINT // {_ONE}))::BIGINT AS v FROM {of} JOIN {name}v k USING (n, m, radius) WHERE k.s = {of}.{along} GROUP BY image_id, {line}, i, c)"""


_LANCZOS = f"""WITH {_PX}, y0 AS (SELECT image_id, y, row_number() OVER (PARTITION BY image_id ORDER BY y) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS h FROM (SELECT DISTINCT image_id, y FROM px)),
src AS (SELECT image_id, k AS y, x // 4 AS x, x % 4 AS c, p AS v, 16 AS n, 8 AS m, least(16, h) * {_ONE} AS radius FROM px JOIN y0 USING (image_id, y)), {_pass("across", "src", "y", "x")},
turned AS (SELECT a.*, h AS n, 8 AS m, least(16, h) * {_ONE} AS radius FROM across a JOIN (SELECT DISTINCT image_id, h FROM y0) USING (image_id)), {_pass("down", "turned", "x", "y")}
SELECT image_id, 8::BIGINT AS width, 8::BIGINT AS height, 4 AS channels, sum(v)::BIGINT AS total, sum(v * ((y * 8 + x) * 4 + c + 1))::BIGINT AS moment FROM down GROUP BY image_id"""


@query(_LANCZOS)
def lanczos_resize(spark, sf_dir):
    """The kernel join, and two sums over each image's samples."""
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy("y")).cast("long") - 1
    rows = kernels.resize(views.rows(spark, sf_dir).withColumn("y", rank), F.lit(8), F.lit(8))
    total = R.total(F.col("row"))
    sums = rows.groupBy("image_id").agg(F.max(F.floor(F.size("row") / 4)).alias("width"), F.count("*").alias("height"), F.lit(4).alias("channels"), F.sum(total).alias("total"), F.sum(R.moment(F.col("row")) + F.col("y") * F.size("row") * total).alias("moment"))
    return sums.select("image_id", "width", "height", "channels", "total", "moment")


@query(f"""WITH {_PX}, src AS (SELECT image_id, y, x, 0 AS c, p AS v, 64 AS n, 8 AS m, {5 * _ONE} AS radius FROM px), {_pass("across", "src", "y", "x")}
SELECT image_id, y, count(*) AS n, sum(v)::BIGINT AS total, sum(v * (x + 1))::BIGINT AS moment FROM across GROUP BY image_id, y""")
def resample_rows(spark, sf_dir):
    """Each row of samples by itself, from 64 to 8 of one channel, with a radius of five."""
    lines = views.rows(spark, sf_dir).select("image_id", F.col("y").alias("line"), F.lit(8).alias("dst"), F.lit(5 * resample.ONE).alias("radius"), "row")
    strips = kernels.resampled(lines, 1)
    return strips.select("image_id", F.col("line").alias("y"), F.size("strip").cast("long").alias("n"), R.total(F.col("strip")).alias("total"), R.moment(F.col("strip")).alias("moment"))


@query(f"""WITH {_RECT}, src AS (SELECT id AS image_id, 0 AS y, 0 AS x, 0 AS c, 0 AS v, unnest([w, h]) AS n, 8 AS m, least(w, h) * {_ONE} AS radius FROM rects), {_pass("k", "src", "y", "x")},
c AS (SELECT n, radius, count(*) AS taps FROM (SELECT *, sum(w) OVER (PARTITION BY n, radius, i) AS total FROM kw) WHERE total <> 0 AND w <> 0 GROUP BY n, radius)
SELECT id AS image_id, CASE WHEN w = 8 AND h = 8 THEN 0 ELSE a.taps * h + b.taps * 8 END::BIGINT AS taps FROM rects JOIN c a ON a.n = w AND a.radius = least(w, h) * {_ONE} JOIN c b ON b.n = h AND b.radius = least(w, h) * {_ONE}""")
def resize_taps(spark, sf_dir):
    """Weights that resizing each rectangle to 8 by 8 would use."""
    eight = F.lit(8).cast("long")
    sizes = views.rects(spark, sf_dir).select(F.col("id").alias("image_id"), F.col("w").alias("width"), F.col("h").alias("height"), eight.alias("new_width"), eight.alias("new_height"), (F.least("w", "h") * resample.ONE).alias("radius"))
    return kernels.resize_stats(sizes)


_GREEDY = """WITH RECURSIVE r AS (SELECT label::BIGINT AS grp, vec_id AS id, list_transform(embedding, lambda v: ((floor(v * 128)::BIGINT + 128) % 256 + 256) % 256) AS p FROM embeddings),
e AS (SELECT grp, id, list_sum(p)::BIGINT AS area, p[:16] AS head, p[-16:] AS tail FROM r),
q AS (SELECT *, (list_sum(head)::BIGINT // 16) >> 3 AS hq, (list_sum(tail)::BIGINT // 16) >> 3 AS tq FROM e),
i AS (SELECT *, row_number() OVER (PARTITION BY grp, hq ORDER BY id DESC) AS rn, row_number() OVER (PARTITION BY grp ORDER BY area DESC, id DESC) AS first FROM q),
s AS (SELECT grp, id, [id] AS used, 0::BIGINT AS ordinal FROM i WHERE first = 1
UNION ALL SELECT grp, coalesce(-best.n, lowest), list_append(used, coalesce(-best.n, lowest)), ordinal + 1 FROM (
  SELECT s.grp, s.used, s.ordinal, min(n.id) AS lowest,
    min(struct_pack(c := list_sum(list_transform(range(1, 17), lambda k: abs(c.tail[k] - n.head[k]))), d := abs(n.hq - c.tq), s := (n.hq > c.tq)::INT, n := -n.id)) FILTER (abs(n.hq - c.tq) <= 3 AND n.rn <= 64) AS best
  FROM s JOIN i c ON c.grp = s.grp AND c.id = s.id JOIN i n ON n.grp = s.grp AND NOT list_contains(s.used, n.id) GROUP BY s.grp, s.used, s.ordinal))
SELECT grp, id, ordinal FROM s"""


@query(_GREEDY)
def greedy_order(spark, sf_dir):
    """Rows of each image as items: their edges are the first and last quarter."""
    edge = {"head": F.slice("row", 1, 16), "tail": F.slice("row", -16, 16)}
    items = views.rows(spark, sf_dir).select(F.col("image_id").alias("grp"), F.col("y").alias("id"), R.total(F.col("row")).alias("area"), *[e.alias(n) for n, e in edge.items()], *[F.shiftright(F.floor(R.total(e) / 16).cast("int"), 3).alias(f"{n}_q") for n, e in edge.items()])
    return resample.greedy_order(items)


@query(f"WITH {_RGBA}, k AS (SELECT image_id, y, row_number() OVER (PARTITION BY image_id ORDER BY y) - 1 AS sy FROM (SELECT DISTINCT image_id, y FROM rgba)), s AS (SELECT r.image_id, r.x, k.sy AS y, r.r FROM rgba r JOIN k USING (image_id, y) WHERE k.sy < 8) SELECT image_id, o.o AS orientation, CASE o.o WHEN 1 THEN x WHEN 2 THEN 15 - x WHEN 3 THEN 15 - x WHEN 4 THEN x WHEN 5 THEN y WHEN 6 THEN 7 - y WHEN 7 THEN 7 - y ELSE y END::BIGINT AS x, CASE o.o WHEN 1 THEN y WHEN 2 THEN y WHEN 3 THEN 7 - y WHEN 4 THEN 7 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 15 - x ELSE 15 - x END::BIGINT AS y, r FROM s, (SELECT unnest(range(1, 9))::INT AS o) o")
def orient_crop(spark, sf_dir):
    """The first eight rows of each image in all eight orientations."""
    by = Window.partitionBy("image_id").orderBy("y")
    keep = views.rows(spark, sf_dir).withColumn("sy", F.row_number().over(by) - 1).where("sy < 8").select("image_id", "y", "sy")
    px = views.pixels(spark, sf_dir).join(keep, ["image_id", "y"]).select("image_id", "x", F.col("sy").cast("long").alias("y"), "r", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("orientation"))
    return layout.oriented(px, F.col("orientation"), F.lit(16), F.lit(8))


_PATH = "concat('in/', p_name, CASE p_size % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.tar.gz' ELSE '' END)"


@query(rf"""WITH p AS (SELECT p_partkey AS id, p_size AS n, {_PATH} AS path FROM part),
s AS (SELECT *, regexp_replace(path, '\.[^./]*$', '') AS base, nullif(regexp_extract(path, '\.([^./]*)$', 1), '') AS ext FROM p)
SELECT id, base, base || '.tile' AS encoded, base || '_' || n || '.' || coalesce(ext, 'tile') AS sheet, base || '_mip' || n || '.' || coalesce(ext, 'tile') AS level,
  CASE WHEN ext = 'png' THEN 'png' ELSE 'raw' END AS format FROM s""")
def output_names(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("n"), F.expr(_PATH).alias("path"))
    path, n = F.col("path"), F.col("n")
    return p.select("id", names.stem(path).alias("base"), names.with_extension(path, "tile").alias("encoded"), names.numbered(path, "_", n, "tile").alias("sheet"), names.numbered(path, "_mip", n, "tile").alias("level"), names.blob_format(path).alias("format"))


_SEARCH = f"""WITH RECURSIVE {_RECT}, g AS (SELECT grp, list_concat([struct_pack(w := 0::BIGINT, h := 0::BIGINT, x := 0::BIGINT, y := 0::BIGINT, s := 0::BIGINT, ok := true)], list(struct_pack(w := w + 4, h := h + 4, x := 0::BIGINT, y := 0::BIGINT, s := 0::BIGINT, ok := true) ORDER BY w * h DESC, greatest(w, h) DESC, id)) AS items, greatest(1, max(greatest(w, h)) + 4) AS low FROM rects GROUP BY grp),
b AS (SELECT grp, low, 16384::BIGINT AS high FROM g
UNION ALL SELECT grp, CASE WHEN fits THEN low ELSE m + 1 END, CASE WHEN fits THEN m ELSE high END FROM (
  SELECT grp, t.low, high, m, list_reduce(items, lambda a, e: struct_pack(w := e.w, h := e.h, x := CASE WHEN a.x + e.w > m THEN e.w ELSE a.x + e.w END, y := CASE WHEN a.x + e.w > m THEN a.y + a.s ELSE a.y END, s := CASE WHEN a.x + e.w > m THEN e.h ELSE greatest(a.s, e.h) END, ok := a.ok AND CASE WHEN a.x + e.w > m THEN a.y + a.s ELSE a.y END + e.h <= m)).ok AS fits
  FROM (SELECT *, (low + high) // 2 AS m FROM b WHERE low < high) t JOIN g USING (grp)))
SELECT grp, low AS side FROM b WHERE low >= high"""


@query(_SEARCH)
def least_side(spark, sf_dir):
    return packing.least_side(views.rects(spark, sf_dir), 16384, 2)


@query(_DIGEST.replace("SELECT image_id, 16::BIGINT AS width", "SELECT image_id AS pack_id, 0::BIGINT AS sheet, 16::BIGINT AS width").replace(", 4 AS channels", ""))
def pack_roundtrip(spark, sf_dir):
    """Each image as the only sheet of a pack: written, inspected and sliced out again."""
    sheet = F.struct(F.lit(0).cast("long").alias("index"), "width", "height", F.lit(1).cast("long").alias("entries"), F.col("rgba").alias("content"))
    packs = views.images(spark, sf_dir).select(F.col("image_id").alias("pack_id"), F.lit("p").alias("name"), F.lit("").alias("description"), F.lit(None).cast("string").alias("pack_mcmeta"), F.lit(None).cast("binary").alias("icon"), F.lit(None).cast("string").alias("icon_format"), F.array(sheet).alias("atlases"))
    got = packfile.sheets(packfile.write(packs))
    return got.select("pack_id", F.col("index").alias("sheet"), "width", "height", R.byte_total(F.col("content")).alias("total"), R.byte_moment(F.col("content")).alias("moment"))


from tessera.plans import assets, folders, pixels  # noqa: E402, F401  their queries register themselves
