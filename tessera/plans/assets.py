"""Registered queries on files, packs, atlases, mip chains and raw samples, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import formats, header
from tessera.functions import raster as R
from tessera.operators import atlas, develop, edges, filters, layout, mips, predict, view
from tessera.plans.registry import _DIGEST, _PX, _RECT, _RGBA, _WHOLE, _digest, query
from tessera.sources import container, images, respack, tiff, views

_PART = "part"


@query("""WITH p AS (SELECT p_partkey AS id, p_size::BIGINT AS w, CASE p_size % 4 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Opaque255' WHEN 2 THEN 'Transparent0' ELSE 'Mask1Bit' END AS alpha, CASE p_size % 3 WHEN 0 THEN 'None' WHEN 1 THEN 'SubGreen' ELSE 'SubRed' END AS transform, p_partkey % 2 = 1 AS predictor, p_partkey % 3 = 0 AS has_meta FROM part),
f AS (SELECT *, predictor::INT + 2 * (CASE alpha WHEN 'Normal' THEN 0 WHEN 'Opaque255' THEN 1 WHEN 'Transparent0' THEN 2 ELSE 3 END) + 8 * has_meta::INT + 16 * (CASE transform WHEN 'None' THEN 0 WHEN 'SubGreen' THEN 1 ELSE 2 END) AS feature FROM p)
SELECT id, feature, 65536 + feature * 256 + 4 AS flags, (w << 32) + id AS dimmask, alpha, transform, predictor, has_meta, 'None' AS transform_v1, w AS width, id AS height FROM f""")
def header_fields(spark, sf_dir):
    """Header fields from their parts, and the parts from these again."""
    names = lambda n, of: F.element_at(F.array(*map(F.lit, of)), (F.col("p_size") % n + 1).cast("int"))
    p = views.table(spark, sf_dir, _PART).select(F.col("p_partkey").alias("id"), F.col("p_size").alias("w"), names(4, header.ALPHA).alias("alpha"), names(3, header.TRANSFORMS[:3]).alias("transform"))
    f = p.withColumn("feature", header.feature(F.col("id") % 2 == 1, F.col("alpha"), F.col("id") % 3 == 0, F.col("transform")))
    f = f.withColumns({"flags": header.flags(F.lit(1), F.col("feature"), F.lit(4)), "dimmask": header.dimmask(F.col("w"), F.col("id"))})
    back, sides = header.parse_feature(header.parse_flags(F.col("flags"))["qval"]), header.parse_dimmask(F.col("dimmask"))
    old = header.parse_feature(F.col("feature"), F.lit(1))["transform"]
    return f.select("id", "feature", "flags", "dimmask", *[c.alias(n) for n, c in back.items()], old.alias("transform_v1"), *[c.alias(n) for n, c in sides.items()])


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'None,None,None,None' WHEN p_partkey // 2 % 4 = 3 THEN 'Delta,Delta,Delta,None' ELSE 'Delta,Delta,Delta,Delta' END AS predictors FROM part")
def legacy_predictors(spark, sf_dir):
    p = views.table(spark, sf_dir, _PART).select(F.col("p_partkey").alias("id"))
    return p.select("id", F.array_join(header.legacy_predictors(F.col("id") % 256, F.lit(4)), ",").alias("predictors"))


@query("SELECT p_partkey AS id, printf('%.1fMB', p_partkey * 0.25) AS mb, CASE WHEN p_size % 6 < 3 OR (p_size % 6 = 3 AND p_partkey % 2 = 0) THEN ['R', 'G', 'B', 'A'][p_size % 6 + 1] ELSE 'C' || (p_size % 6) END AS channel, printf('%d.%09d sec', p_partkey // 1000, p_partkey % 1000 * 1000000) AS took, printf('%.1f%%', p_size * 100.0 / 8) AS share FROM part")
def number_texts(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    return views.table(spark, sf_dir, _PART).select(key.alias("id"), formats.megabytes(key * (1 << 18)).alias("mb"), formats.channel_name(size % 6, 4 - key % 2).alias("channel"), formats.seconds(key * 1_000_000).alias("took"), formats.percent(size, F.lit(8)).alias("share"))


@query("SELECT p_partkey AS id, least(9223372036854775807 - 100::HUGEINT + p_partkey, 9223372036854775807)::BIGINT AS plus, least(p_partkey::HUGEINT * 92233720368547758, 9223372036854775807)::BIGINT AS times FROM part")
def saturating(spark, sf_dir):
    key = F.col("p_partkey").cast("long")
    return views.table(spark, sf_dir, _PART).select(key.alias("id"), R.saturating_add(F.lit(R.LARGEST - 100), key).alias("plus"), R.saturating_multiply(key, F.lit(92233720368547758)).alias("times"))


@query("WITH p AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') || '.png' AS path FROM pages UNION SELECT DISTINCT 'x/' || p_brand || CASE p_size % 2 WHEN 0 THEN '/a.png' ELSE '-b.txt' END FROM part) SELECT row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS id, path FROM p WHERE path LIKE '%.png' AND path NOT LIKE '%/.png'")
def scan_order(spark, sf_dir):
    """Files of two inputs, each once, numbered by the components of their paths."""
    pages = views.table(spark, sf_dir, "pages").select(F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit(".png")).alias("path"))
    part = views.table(spark, sf_dir, _PART).select(F.concat(F.lit("x/"), "p_brand", F.expr("CASE p_size % 2 WHEN 0 THEN '/a.png' ELSE '-b.txt' END")).alias("path"))
    return images.numbered(pages.union(part).where(images.is_image(F.col("path"))).dropDuplicates(["path"])).select("id", "path")


_LISTING = f"p AS (SELECT p_partkey, {views.PACK_PATH} AS path, CASE WHEN p_partkey % 5 = 0 THEN 'patch' END AS overlay, lower(replace(p_brand, '#', '_')) || ':tex/' || p_partkey || '.png' AS resource FROM part)"


@query("SELECT 0 AS ordinal, NULL::VARCHAR AS overlay, 'd/pack/assets' AS assets UNION ALL SELECT 1, 'patch', 'd/pack/patch/assets'")
def pack_layers(spark, sf_dir):
    return respack.layers(views.pack_listing(spark, sf_dir), "d/pack")


@query(f"WITH {_LISTING} SELECT path, resource, overlay, CASE WHEN p_partkey % 3 = 0 THEN '{{\"n\":' || p_partkey || '}}' END AS mcmeta FROM p WHERE p_partkey % 7 <> 0")
def pack_textures(spark, sf_dir):
    files = views.pack_listing(spark, sf_dir)
    return respack.textures(files, respack.layers(files, "d/pack"))


@query(f"WITH {_LISTING} SELECT resource, overlay, '{{\"n\":' || p_partkey || '}}' AS mcmeta FROM p WHERE p_partkey % 21 = 0")
def pack_sidecars(spark, sf_dir):
    files = views.pack_listing(spark, sf_dir)
    return respack.sidecars(files, respack.layers(files, "d/pack"))


_AT = "r AS (SELECT p_brand AS sheet, p_partkey AS id, p_partkey * 7 % 200 AS x, p_partkey * 13 % 200 AS y, p_size::BIGINT AS w, (51 - p_size)::BIGINT AS h FROM part)"


@query(f"WITH {_AT} SELECT p.sheet, p.id * 11 % 256 AS px, p.id * 17 % 256 AS py, (SELECT min(r.id) FROM r WHERE r.sheet = p.sheet AND p.id * 11 % 256 >= r.x AND p.id * 11 % 256 < r.x + r.w AND p.id * 17 % 256 >= r.y AND p.id * 17 % 256 < r.y + r.h) AS id FROM r p")
def rect_lookup(spark, sf_dir):
    key = F.col("p_partkey")
    r = views.table(spark, sf_dir, _PART).select(F.col("p_brand").alias("sheet"), key.alias("id"), (key * 7 % 200).alias("x"), (key * 13 % 200).alias("y"), F.col("p_size").cast("long").alias("w"), (51 - F.col("p_size")).cast("long").alias("h"))
    return layout.rect_at(r.select("sheet", (F.col("id") * 11 % 256).alias("px"), (F.col("id") * 17 % 256).alias("py")), r)


@query(f"WITH {_RECT} SELECT grp, id, id % 200 AS x, id % 300 AS y, w, h FROM rects")
def placement_join(spark, sf_dir):
    r = views.rects(spark, sf_dir)
    return layout.placed_items(r.select("grp", "id", (F.col("id") % 200).alias("x"), (F.col("id") % 300).alias("y")), r.select("grp", "id", "w", "h"))


_TINT = [f"CASE WHEN image_id % 2 = 0 THEN {tint} ELSE {c} END AS {c}" for c, tint in (("r", "r % 20"), ("g", "120 + g % 100"), ("b", "b % 20"))]


@query(f"WITH {_RGBA}, t AS (SELECT image_id, {', '.join(_TINT)} FROM rgba) SELECT image_id, avg(g) > 100 AND avg(g) > 6 * avg(r) AND avg(g) > 6 * avg(b) AS green FROM t GROUP BY image_id")
def green_cast(spark, sf_dir):
    rows = views.rows(spark, sf_dir).groupBy("image_id").agg(F.min("y").alias("y0"))
    px = views.pixels(spark, sf_dir).join(F.broadcast(rows), "image_id")
    return filters.green_cast(px.selectExpr("image_id", "(y - y0) * 16 + x AS i", *_TINT))


@query(f"WITH {_PX} SELECT image_id, y, sum(CASE WHEN x % 4 = 2 THEN p ELSE 0 END)::BIGINT AS blue, sum(p * (x + 1))::BIGINT AS moment FROM px GROUP BY image_id, y")
def plane_interleave(spark, sf_dir):
    planes = R.deinterleaved(F.col("row"), 4)
    return views.rows(spark, sf_dir).select("image_id", "y", R.total(planes[2]).alias("blue"), R.moment(R.interleaved(planes)).alias("moment"))


@query(f"WITH {_PX} SELECT image_id, y, count(*) // 8 AS bytes, sum(CASE WHEN p >= 128 THEN 255 * (x + 1) ELSE 0 END)::BIGINT AS moment FROM px GROUP BY image_id, y")
def alpha_mask_unpack(spark, sf_dir):
    alpha = F.transform("row", lambda v: F.when(v >= 128, 255).otherwise(0))
    packed = views.rows(spark, sf_dir).select("image_id", "y", R.mask_bytes(alpha).alias("m"), F.size("row").alias("n"))
    return packed.select("image_id", "y", F.size("m").cast("long").alias("bytes"), R.moment(R.mask_samples(F.col("m"), F.col("n"))).alias("moment"))


_BANDS = _RGBA + """, k AS (SELECT image_id, y, row_number() OVER (PARTITION BY image_id ORDER BY y) AS k, count(*) OVER (PARTITION BY image_id) AS h FROM (SELECT DISTINCT image_id, y FROM rgba)),
e AS (SELECT image_id, x, side, sum((r * a + 127) // 255 * f) // 2 AS r, sum((g * a + 127) // 255 * f) // 2 AS g, sum((b * a + 127) // 255 * f) // 2 AS b FROM (SELECT rgba.*, CASE WHEN k <= 2 THEN 'top' ELSE 'bottom' END AS side, CASE WHEN k <= 2 THEN 1 ELSE 2 END AS f FROM rgba JOIN k USING (image_id, y) WHERE k <= 2 OR k = h) GROUP BY ALL)"""


@query(f"WITH {_BANDS} SELECT image_id, side, sum(r + 3 * g + 5 * b)::BIGINT AS checksum, ((sum((77 * r + 150 * g + 29 * b)::BIGINT >> 8)::BIGINT // 16) >> 3)::INT AS q FROM e GROUP BY image_id, side")
def edge_bands(spark, sf_dir):
    """Top and bottom signatures of as many samples as the images are wide, so that nothing is resampled."""
    s = edges.signatures(views.images(spark, sf_dir), 16)
    each = s.select("image_id", F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.col(n).alias("e"), F.col(f"{n}_q").alias("q")) for n in ("top", "bottom")])).alias("s")).select("image_id", "s.*")
    weights = F.transform("e", lambda v, i: v.cast("long") * F.element_at(F.array(F.lit(1), F.lit(3), F.lit(5)), i % 3 + 1))
    return each.select("image_id", "side", R.total(weights).alias("checksum"), "q")


@query(f"WITH {_RECT}, l AS (SELECT id, w, h, unnest([0, 1, 2]) AS level, unnest([0, 20, 7]) AS th FROM rects) SELECT id, level, CASE level WHEN 0 THEN w ELSE least(w, greatest(1, (w * th + h // 2) // h)) END AS w, CASE level WHEN 0 THEN h ELSE th END AS h FROM l WHERE level = 0 OR th < h")
def mip_heights(spark, sf_dir):
    return mips.explicit_levels(views.rects(spark, sf_dir), [20, 7])


_LEVELS = f"WITH RECURSIVE {_RECT}, m AS (SELECT id, 0 AS level, w, h FROM rects UNION ALL SELECT id, level + 1, greatest(1, w // 2), greatest(1, h // 2) FROM m WHERE w > 1 OR h > 1)"


@query(_LEVELS + """, o AS (SELECT id, level, w + 2 AS w, h + 2 AS h FROM m),
s AS (SELECT id, max(w) FILTER (level = 0) AS w0, max(h) FILTER (level = 0) AS h0, coalesce(max(w) FILTER (level > 0), 0) AS mw, coalesce(max(h) FILTER (level > 0), 0) AS mh, coalesce(sum(w) FILTER (level > 0), 0)::BIGINT AS sw, coalesce(sum(h) FILTER (level > 0), 0)::BIGINT AS sh FROM o GROUP BY id),
c AS (SELECT id, w0, h0, w0 + mw AS rw, greatest(h0, sh) AS rh, greatest(w0, sw) AS bw, h0 + mh AS bh FROM s),
d AS (SELECT *, (greatest(rw, rh), rw * rh, rw + rh) <= (greatest(bw, bh), bw * bh, bw + bh) AS beside FROM c),
u AS (SELECT id, level, coalesce(sum(CASE WHEN level > 0 THEN w END) OVER q, 0)::BIGINT AS bx, coalesce(sum(CASE WHEN level > 0 THEN h END) OVER q, 0)::BIGINT AS by_ FROM o WINDOW q AS (PARTITION BY id ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id, CASE WHEN beside THEN 'right' ELSE 'bottom' END AS side, CASE WHEN beside THEN rw ELSE bw END AS width, CASE WHEN beside THEN rh ELSE bh END AS height, level, 1 + CASE WHEN level = 0 THEN 0 WHEN beside THEN w0 ELSE bx END AS x, 1 + CASE WHEN level = 0 THEN 0 WHEN beside THEN by_ ELSE h0 END AS y FROM d JOIN u USING (id)""")
def mip_layout(spark, sf_dir):
    return mips.layout(layout.mip_levels(views.rects(spark, sf_dir)))


_JSON = """printf('{"kind":"tessera.mipchain","version":1,"pad":1,"levels":[{"level":0,"x":1,"y":1,"w":16,"h":%d},{"level":1,"x":19,"y":1,"w":8,"h":%d}]}', h, h // 2)"""


@query(f"SELECT image_id, 'mipchain' AS kind, {_JSON} AS json FROM (SELECT label::BIGINT AS image_id, count(*) AS h FROM embeddings GROUP BY label)")
def metadata_json(spark, sf_dir):
    """Metadata written into containers, found there again and rendered."""
    made = mips.chains(views.images(spark, sf_dir), mips.MipSpec(1)).where("error is null")
    return images.metadata_json(container.encode(made))


@query(_DIGEST)
def png_roundtrip(spark, sf_dir):
    """Containers as PNG files, and their pixels read back."""
    files = images.png(container.encode(views.images(spark, sf_dir), "fast"), strict=False).where("error is null")
    back = images.decoded(files.select(F.col("image_id").cast("string").alias("path"), "content")).where("error is null")
    return _digest(back.select(F.col("path").cast("long").alias("image_id"), "width", "height", F.lit(4).alias("channels"), "rgba"))


@query(f"WITH {_WHOLE}, n AS (SELECT image_id, count(*) // 4 AS n FROM bytes GROUP BY image_id) SELECT image_id, sum(p)::BIGINT AS total, sum(p * (pos % 4 * n + pos // 4 + 1))::BIGINT AS moment FROM bytes JOIN n USING (image_id) GROUP BY image_id")
def planar_raw(spark, sf_dir):
    files = images.planar(container.encode(views.images(spark, sf_dir), "fast"), strict=False).where("error is null")
    return files.select("image_id", R.byte_total(F.col("content")).alias("total"), R.byte_moment(F.col("content")).alias("moment"))


@query("SELECT count(*) AS files, sum(64 * n)::BIGINT AS raw, sum(3 + length(label::VARCHAR))::BIGINT AS meta, sum(length(label::VARCHAR) + 3 + 4 + 17 + 17 * 4)::BIGINT AS beside FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def encode_totals(spark, sf_dir):
    """Sums over containers with metadata; what a file has beside its streams are headers and metadata."""
    named = views.images(spark, sf_dir).withColumn("meta", F.concat(F.lit("id="), F.col("image_id").cast("string")).cast("binary"))
    t = container.totals(container.inspect(container.encode(named, "fast"), strict=False))
    return t.select("files", "raw", "meta", (F.col("stored") - F.col("streams")).alias("beside"))


@query("WITH i AS (SELECT label::BIGINT AS image_id, 16 * count(*) AS n FROM embeddings GROUP BY label) SELECT image_id, unnest(['R', 'G', 'B', 'A']) AS channel, n AS orig_size FROM i")
def stream_sizes(spark, sf_dir):
    return container.stream_stats(container.inspect(container.encode(views.images(spark, sf_dir), "fast"), strict=False)).select("image_id", "channel", "orig_size")


@query("SELECT label::BIGINT AS image_id, 48 AS candidates, 12 AS predictors FROM (SELECT DISTINCT label FROM embeddings)")
def candidate_grid(spark, sf_dir):
    """Every transform, channel and predictor of each image, with the sampled size of each."""
    sizes = predict.candidate_sizes(views.images(spark, sf_dir)).where("size > 0")
    return sizes.groupBy("image_id").agg(F.count("*").cast("int").alias("candidates"), F.count_distinct("channel", "predictor").cast("int").alias("predictors"))


@query("SELECT 't/' || p_partkey || '.dng' AS path, unnest([256, 257, 259, 273, 274, 279])::INT AS tag, unnest([p_size, p_partkey % 300 + 1, 7, 164, p_partkey % 8 + 1, 4])::BIGINT AS number FROM part")
def tiff_entries(spark, sf_dir):
    """The first directory's entries."""
    return tiff.entries(views.tiffs(spark, sf_dir)).where("directory = 8").select("path", "tag", F.col("numbers")[0].alias("number"))


@query("SELECT 't/' || p_partkey || '.dng' AS path, greatest(p_size * (p_partkey % 300 + 1), 51 * (p_partkey % 200 + 1))::BIGINT AS pixels, (p_partkey % 8 + 1)::INT AS orientation, 'jpeg' AS kind, 'tiff' AS file_kind FROM part")
def tiff_embedded(spark, sf_dir):
    files = views.tiffs(spark, sf_dir).withColumn("file_kind", F.coalesce(tiff.magic(F.col("content")), F.lit("tiff")))
    found = tiff.embedded(files).select("path", "pixels", "orientation", tiff.magic(F.col("content")).alias("kind"))
    return found.join(files.select("path", "file_kind"), "path")


#: A camera with uneven levels, gains and a matrix.
CAMERA = develop.Camera(black=(8.0, 4.0, 2.0, 4.0), white=(250.0, 240.0, 255.0, 240.0), gains=(2.0, 1.0, 1.5, 1.0), matrix=((0.5, 0.3, 0.1), (0.2, 0.7, 0.1), (0.0, 0.1, 0.8)))
_GAMMA = "floor(least(greatest((CASE WHEN {0} <= 0.0031308 THEN {0} * 12.92 ELSE 1.055 * pow({0}, 1 / 2.4::DOUBLE) - 0.055 END) * 255 + 0.5, 0), 255))::BIGINT"
_RAW = _PX + """, k AS (SELECT image_id, y, row_number() OVER (PARTITION BY image_id ORDER BY y) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS h FROM (SELECT DISTINCT image_id, y FROM px)),
v AS (SELECT image_id, k AS y, h, x, p, CASE WHEN k % 2 = 0 THEN x % 2 ELSE 1 + x % 2 END AS c FROM px JOIN k USING (image_id, y)),
l AS (SELECT *, CASE c WHEN 0 THEN least(greatest((p - 8) / 242::DOUBLE, 0), 1) * 2 WHEN 1 THEN least(greatest((p - 4) / 236::DOUBLE, 0), 1) ELSE least(greatest((p - 2) / 253::DOUBLE, 0), 1) * 1.5::DOUBLE END AS v FROM v)"""
_SRGB = """x AS (SELECT image_id, y, x, 0.5::DOUBLE * r + 0.3::DOUBLE * g + 0.1::DOUBLE * b AS cx, 0.2::DOUBLE * r + 0.7::DOUBLE * g + 0.1::DOUBLE * b AS cy, 0.1::DOUBLE * g + 0.8::DOUBLE * b AS cz FROM rgb),
s AS (SELECT image_id, y, x, least(greatest(3.2406::DOUBLE * cx - 1.5372::DOUBLE * cy - 0.4986::DOUBLE * cz, 0), 1) AS r, least(greatest(-0.9689::DOUBLE * cx + 1.8758::DOUBLE * cy + 0.0415::DOUBLE * cz, 0), 1) AS g, least(greatest(0.0557::DOUBLE * cx - 0.2040::DOUBLE * cy + 1.0570::DOUBLE * cz, 0), 1) AS b FROM x)"""
_SRGB += f" SELECT image_id, y, sum({_GAMMA.format('r')})::BIGINT AS r, sum({_GAMMA.format('g')})::BIGINT AS g, sum({_GAMMA.format('b')})::BIGINT AS b, count(*) AS n FROM s GROUP BY image_id, y"


def _samples(spark, sf_dir):
    """Each image as raw samples, its rows counted from 0."""
    rows = views.rows(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("image_id").orderBy("y")).cast("long") - 1)
    return rows.select("image_id", F.col("k").alias("y"), F.posexplode("row").alias("x", "v")).withColumn("x", F.col("x").cast("long"))


@query(f"WITH {_RAW}, n AS (SELECT a.image_id, a.y, a.x, b.c, avg(b.v) AS v FROM l a JOIN l b ON b.image_id = a.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND (b.c <> a.c OR (b.x = a.x AND b.y = a.y)) GROUP BY ALL), rgb AS (SELECT image_id, y, x, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b FROM n GROUP BY ALL), {_SRGB}")
def raw_demosaic(spark, sf_dir):
    """Rows of developed images, by channel sums."""
    px = develop.demosaic(_samples(spark, sf_dir), CAMERA)
    return px.groupBy("image_id", "y").agg(*[F.sum(c).alias(c) for c in "rgb"], F.count("*").alias("n"))


@query(f"WITH {_RAW}, m AS (SELECT image_id, y - 2 AS y, least(greatest((p - 4) / 236::DOUBLE, 0), 1) AS v FROM l WHERE y >= 2 AND y < h - 1 AND x >= 3 AND x < 60) SELECT image_id, y, sum({_GAMMA.format('v')})::BIGINT AS gray, count(*) AS n FROM m GROUP BY image_id, y")
def raw_monochrome(spark, sf_dir):
    """Developed without colours, each image cropped by 2, 4, 1 and 3."""
    raw = _samples(spark, sf_dir)
    heights = raw.groupBy("image_id").agg((F.max("y") + 1).alias("h"))
    inside = develop.crop_by(raw.join(heights, "image_id"), F.lit(64), F.col("h"), 2, 4, 1, 3)
    return develop.monochrome(inside, CAMERA).groupBy("image_id", "y").agg(F.sum("r").alias("gray"), F.count("*").alias("n"))


@query(f"WITH {_RGBA}, k AS (SELECT image_id, y, row_number() OVER (PARTITION BY image_id ORDER BY y) - 1 AS k FROM (SELECT DISTINCT image_id, y FROM rgba)), rgb AS (SELECT image_id, k AS y, x, least(greatest((r - 8) / 242::DOUBLE, 0), 1) * 2 AS r, least(greatest((g - 4) / 236::DOUBLE, 0), 1) AS g, least(greatest((b - 2) / 253::DOUBLE, 0), 1) * 1.5::DOUBLE AS b FROM rgba JOIN k USING (image_id, y)), {_SRGB}")
def raw_camera_rgb(spark, sf_dir):
    rank = views.rows(spark, sf_dir).select("image_id", "y", (F.row_number().over(Window.partitionBy("image_id").orderBy("y")).cast("long") - 1).alias("k"))
    px = views.pixels(spark, sf_dir).join(rank, ["image_id", "y"]).select("image_id", F.col("k").alias("y"), "x", *[F.col(c).alias(f"v{i}") for i, c in enumerate("rgb")])
    return develop.camera_rgb(px, CAMERA).groupBy("image_id", "y").agg(*[F.sum(c).alias(c) for c in "rgb"], F.count("*").alias("n"))


@query("SELECT (label % 3)::VARCHAR AS grp, 0::BIGINT AS sheet, count(DISTINCT label) AS items, NULL::VARCHAR AS error FROM embeddings GROUP BY label % 3")
def atlas_sheets(spark, sf_dir):
    """Images in three atlases: the items of the only sheet of each."""
    found = views.images(spark, sf_dir).select((F.col("image_id") % 3).alias("grp"), F.col("image_id").alias("id"), "width", "height", "rgba")
    return atlas.sheets(found, atlas.Options(profile="fast")).select("grp", "sheet", "items", "error")


@query(_DIGEST.replace("SELECT image_id, 16::BIGINT AS width", "SELECT (image_id % 3)::VARCHAR AS grp, image_id AS id, 16::BIGINT AS width"))
def atlas_rects(spark, sf_dir):
    """What the sheets hold at the rectangles that their metadata tell: the images."""
    found = views.images(spark, sf_dir).select((F.col("image_id") % 3).alias("grp"), F.col("image_id").alias("id"), "width", "height", "rgba")
    made = atlas.sheets(found, atlas.Options(profile="fast")).select(F.col("grp").cast("long").alias("image_id"), "content")
    met = atlas.cut_out(made).where("error is null")
    return met.select(F.col("image_id").cast("string").alias("grp"), "id", "width", "height", F.lit(4).alias("channels"), R.byte_total(F.col("rgba")).alias("total"), R.byte_moment(F.col("rgba")).alias("moment"))


@query("SELECT p_partkey AS id, least(p_size, greatest(1, (p_size * 30 + 32) // 64))::BIGINT AS side, p_size * 30 // 64 AS pad FROM part")
def atlas_mip_scaling(spark, sf_dir):
    size = F.col("p_size").cast("long")
    return views.table(spark, sf_dir, _PART).select(F.col("p_partkey").alias("id"), mips.scaled(size, F.lit(64), F.lit(30)).alias("side"), F.floor(size * 30 / 64).alias("pad"))


@query("WITH w AS (SELECT p_partkey AS id, 2 * p_size AS w, p_partkey % 90 + 1 AS h FROM part) SELECT id, least(40 / w::DOUBLE, 30 / h::DOUBLE, 1) AS scale, w / 2::DOUBLE AS x, h / 2::DOUBLE AS y FROM w")
def viewport_fit(spark, sf_dir):
    p = views.table(spark, sf_dir, _PART).select(F.col("p_partkey").alias("id"), (2 * F.col("p_size")).alias("w"), (F.col("p_partkey") % 90 + 1).alias("h"))
    return p.select("id", view.fit_scale(F.col("w"), F.col("h"), 40, 30).alias("scale"), (F.col("w") / 2.0).alias("x"), (F.col("h") / 2.0).alias("y"))
