"""Registered pixel, blob, flow and mosaic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinelog.functions import colour
from brinelog.operators import blobs, flow, pixels
from brinelog.plans.registry import query

H = W = 8


# -- geometry and histograms ------------------------------------------------------------------------------------------

@query("stereo_half", "SELECT img, y, x - 4 AS x, v FROM pixels WHERE x >= 4")
def _(t):
    return pixels.stereo_half(t.pixels, W, right=True)


@query("roll_pixels", "SELECT img, (y + 3) % 8 AS y, (x + 6) % 8 AS x, v FROM pixels")
def _(t):
    return pixels.roll_pixels(t.pixels, H, W, 3, -2)


@query("masked_pixels", "SELECT * FROM pixels WHERE (img, y, x) IN (SELECT (img, y, x) FROM mask)")
def _(t):
    return pixels.masked_pixels(t.pixels, t.mask)


HIST = ", hist AS (SELECT i.img, l.v, coalesce(n, 0) AS n FROM (SELECT DISTINCT img FROM pixels) i CROSS JOIN (SELECT unnest(range(256)) AS v) l " \
       "LEFT JOIN (SELECT img, v, count(*) AS n FROM pixels GROUP BY 1, 2) c ON c.img = i.img AND c.v = l.v) "


@query("pixel_histogram", HIST + "SELECT * FROM hist")
def _(t):
    return pixels.pixel_histogram(t.pixels)


@query("histogram_mean_var", HIST + """, m AS (SELECT img, sum(n * v) / (sum(n) + 0.000001::DOUBLE) AS mean, sum(n) + 0.000001::DOUBLE AS t FROM hist GROUP BY 1)
SELECT img, any_value(mean) AS mean, sum(n * (v - mean) * (v - mean)) / any_value(t) AS variance FROM hist JOIN m USING (img) GROUP BY 1""")
def _(t):
    return pixels.histogram_mean_var(pixels.pixel_histogram(t.pixels))


@query("cumulative_threshold", HIST + """SELECT img, min(v) AS threshold FROM (SELECT *, sum(n) OVER (PARTITION BY img ORDER BY v) AS c, sum(n) OVER (PARTITION BY img) AS t FROM hist)
  WHERE c > t * 0.95 GROUP BY 1""")
def _(t):
    return pixels.cumulative_threshold(pixels.pixel_histogram(t.pixels))


STRETCH = """, q AS (SELECT img, quantile_cont(v, {a}) AS lo, quantile_cont(v, {b}) AS hi FROM pixels GROUP BY 1),
st AS (SELECT img, y, x, CASE WHEN hi > lo THEN (least(greatest(v, lo), hi) - lo) / (hi - lo) * 255 END AS v FROM pixels JOIN q USING (img)) """


@query("contrast_stretch", STRETCH.format(a=0.02, b=0.98) + "SELECT * FROM st")
def _(t):
    return pixels.contrast_stretch(t.pixels)


@query("texture_pixels", STRETCH.format(a=0.01, b=0.99) + "SELECT * FROM st JOIN mask USING (img, y, x)")
def _(t):
    return pixels.texture_pixels(t.pixels, t.mask)


@query("texture_stats", """, s AS (SELECT img, avg(v) AS mean, stddev_pop(v) AS std, var_pop(v) AS var, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi, count(*) AS n FROM pixels GROUP BY 1),
b AS (SELECT img, CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * 256), 255) ELSE 0 END AS bin, n FROM pixels JOIN s USING (img)),
h AS (SELECT img, bin, count(*) / any_value(n) AS p FROM b GROUP BY 1, 2),
e AS (SELECT img, sum(p * p) AS uniformity, -sum(p * log2(p + 2.220446049250313e-16)) AS entropy FROM h GROUP BY 1),
m AS (SELECT img, avg((v - mean) ** 3) / 65025 AS third_moment FROM pixels JOIN s USING (img) GROUP BY 1)
SELECT img, mean, std, 1 - 1 / (1 + var / 65025) AS smoothness, third_moment, uniformity, entropy FROM s JOIN e USING (img) JOIN m USING (img)""")
def _(t):
    return pixels.texture_stats(t.pixels)


@query("distribution_stats", """, m AS (SELECT l_suppkey AS supp, avg(l_extendedprice) AS mean, median(l_extendedprice) AS median FROM lineitem GROUP BY 1),
z AS (SELECT supp, any_value(mean) AS mean, any_value(median) AS median, avg((l_extendedprice - mean) ** 2) AS m2, avg((l_extendedprice - mean) ** 3) AS m3, avg((l_extendedprice - mean) ** 4) AS m4
  FROM lineitem JOIN m ON supp = l_suppkey GROUP BY 1)
SELECT supp, round(mean, 4) AS mean, median, round(m3 / m2 ** 1.5, 7) AS skewness, round(m4 / m2 ** 2, 7) AS kurtosis FROM z""")
def _(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("price"))
    out = pixels.distribution_stats(rows, ["supp"], "price")
    return out.select("supp", F.round("mean", 4).alias("mean"), "median", F.round("skewness", 7).alias("skewness"), F.round("kurtosis", 7).alias("kurtosis"))


# -- thresholds -------------------------------------------------------------------------------------------------------

TWO = """, lev AS (SELECT img, v, count(*) AS n FROM pixels GROUP BY 1, 2),
cut AS (SELECT a.img, a.v AS c, sum(b.n * b.v) FILTER (b.v <= a.v) / sum(b.n) FILTER (b.v <= a.v) AS lo, sum(b.n * b.v) FILTER (b.v > a.v) / sum(b.n) FILTER (b.v > a.v) AS hi
  FROM lev a JOIN lev b ON a.img = b.img GROUP BY 1, 2),
err AS (SELECT c.img, c, lo, hi, sum(n * least((v - lo) ** 2, (v - coalesce(hi, lo)) ** 2)) AS sse FROM cut c JOIN lev USING (img) WHERE hi IS NOT NULL GROUP BY 1, 2, 3, 4),
best AS (SELECT img, (arg_min(lo, (round(sse, 6), c)) + arg_min(hi, (round(sse, 6), c))) / 2 AS mid FROM err GROUP BY 1) """


@query("kmeans_threshold", TWO + "SELECT img, y, x, v, v > mid AS above FROM pixels JOIN best USING (img)")
def _(t):
    return pixels.kmeans_threshold(t.pixels)


@query("dark_threshold", TWO + "SELECT img, y, x, v, v < mid * 0.65 AS dark FROM pixels JOIN best USING (img)")
def _(t):
    return pixels.dark_threshold(t.pixels)


@query("gmm_threshold")
def _(t):
    return pixels.gmm_threshold(t.pixels)


@query("kmeans_image")
def _(t):
    return pixels.kmeans_image(t.color, [0, 1, 2], 3).select("img", "y", "x", "cluster", "centre")


@query("feature_vectors", """SELECT img, y, x, max(v) FILTER (c = 0)::DOUBLE AS c0, max(v) FILTER (c = 1)::DOUBLE AS c1, max(v) FILTER (c = 2)::DOUBLE AS c2 FROM color GROUP BY 1, 2, 3""")
def _(t):
    from pyspark.ml.functions import vector_to_array
    rows = pixels.feature_vectors(t.color, [0, 1, 2]).withColumn("a", vector_to_array("features"))
    return rows.select("img", "y", "x", *[F.col("a")[i].alias(f"c{i}") for i in range(3)])


@query("sample_with_replacement")
def _(t):
    return pixels.sample_with_replacement(t.pixels, 0.25, seed=3)


# -- colour and light maps --------------------------------------------------------------------------------------------

@query("gray_value", "SELECT img, avg(m) AS gray FROM (SELECT img, c, avg(v) AS m FROM color GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return pixels.gray_value(t.color)


@query("gray_world", """, m AS (SELECT img, c, avg(v) AS m FROM color GROUP BY 1, 2), g AS (SELECT img, avg(m) AS g FROM m GROUP BY 1)
SELECT img, y, x, c, CASE WHEN m <> 0 THEN v * (g / m) END AS v FROM color JOIN m USING (img, c) JOIN g USING (img)""")
def _(t):
    return pixels.gray_world(t.color).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


@query("lightmap_accumulate", "SELECT y, x, sum(v)::DOUBLE * 2 AS total, count(*) * 2 AS images FROM pixels GROUP BY 1, 2")
def _(t):
    return pixels.lightmap_accumulate(t.pixels, pixels.lightmap_accumulate(t.pixels))


MAP = ", lm AS (SELECT y, x, avg(v) AS m FROM pixels GROUP BY 1, 2), lc AS (SELECT y, x, c, avg(v) AS m FROM color GROUP BY 1, 2, 3) "


@query("lightmap_average", MAP + "SELECT y, x, m AS v FROM lm")
def _(t):
    return pixels.lightmap_average(t.pixels)


@query("lightmap_correct_raw", MAP + "SELECT img, y, x, v / m * (SELECT max(m) - min(m) FROM lm) AS v FROM pixels JOIN lm USING (y, x)")
def _(t):
    return pixels.lightmap_correct_raw(t.pixels, pixels.lightmap_average(t.pixels))


@query("lightmap_correct_rgb", MAP + "SELECT img, y, x, c, v / m * (SELECT max(m) - min(m) FROM lc) * 1.5 AS v FROM color JOIN lc USING (y, x, c)")
def _(t):
    return pixels.lightmap_correct_rgb(t.color, pixels.lightmap_average(t.color), brightness=1.5)


RGB = ", rgb AS (SELECT img, y, x, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b, max(v) FILTER (c = 3) AS a FROM color GROUP BY 1, 2, 3) "


def _rgb(t):
    return pixels.channel_columns(t.color, {"r": 0, "g": 1, "b": 2, "a": 3})


def _clip(e):
    return f"CAST(floor(least(greatest({e}, 0.0), 255.0)) AS BIGINT)"


@query("rgb_to_ycbcr", RGB + "SELECT img, y AS py, x AS px, " + _clip("r * 0.25678824::DOUBLE + g * 0.50412941::DOUBLE + b * 0.09790588::DOUBLE + 16.5::DOUBLE") + " AS y, "
       + _clip("r * -0.14822353::DOUBLE + g * -0.29099216::DOUBLE + b * 0.43921569::DOUBLE + 128.5::DOUBLE") + " AS cb, "
       + _clip("r * 0.43921569::DOUBLE + g * -0.36778824::DOUBLE + b * -0.07142745::DOUBLE + 128.5::DOUBLE") + " AS cr FROM rgb")
def _(t):
    p = colour.rgb_to_ycbcr(F.col("r"), F.col("g"), F.col("b"))
    return _rgb(t).select("img", F.col("y").alias("py"), F.col("x").alias("px"), p.alias("p")).select("img", "py", "px", "p.*")


@query("ycbcr_to_rgb", RGB + "SELECT img, y, x, " + _clip("r * 1.16438281::DOUBLE + g * 0.0::DOUBLE + b * 1.59602734::DOUBLE - 222.421::DOUBLE") + " AS r, "
       + _clip("r * 1.16438281::DOUBLE + g * -0.39176172::DOUBLE + b * -0.81296875::DOUBLE + 136.076::DOUBLE") + " AS g, "
       + _clip("r * 1.16438281::DOUBLE + g * 2.01723438::DOUBLE + b * 0.0::DOUBLE - 276.336::DOUBLE") + " AS b FROM rgb")
def _(t):
    p = colour.ycbcr_to_rgb(F.col("r"), F.col("g"), F.col("b"))
    return _rgb(t).select("img", "y", "x", p.alias("p")).select("img", "y", "x", "p.*")


@query("scale_saturation", RGB + """, h AS (SELECT img, y, x, r / 255 AS r, g / 255 AS g, b / 255 AS b, greatest(r, g, b) / 255 AS v, least(r, g, b) / 255 AS lo FROM rgb),
s AS (SELECT *, CASE WHEN v > 0 THEN (v - lo) / v ELSE 0 END AS s FROM h), k AS (SELECT *, CASE WHEN s > 0 THEN least(s * 1.5::DOUBLE, 1) / s ELSE 1 END AS q FROM s)
SELECT img, y, x, v - (v - r) * q AS r, v - (v - g) * q AS g, v - (v - b) * q AS b FROM k""")
def _(t):
    p = colour.scale_saturation(*[F.col(c) / 255 for c in "rgb"], factor=1.5)
    return _rgb(t).select("img", "y", "x", p.alias("p")).select("img", "y", "x", "p.*")


@query("alpha_overlay", RGB + "SELECT img, y, x, r * (a / 255) + b * (1 - a / 255) AS v FROM rgb")
def _(t):
    return _rgb(t).select("img", "y", "x", colour.alpha_overlay(F.col("r"), F.col("b"), F.col("a") / 255).alias("v"))


# -- neighbourhoods ---------------------------------------------------------------------------------------------------

def _box(name, source, size, mirror, value="v"):
    """SQL box mean by plain neighbour lookup with clamped or mirrored places."""
    lo, hi = size // 2, size - size // 2 - 1

    def at(c, n):
        raw = f"(p.{c} + {c}k)"
        return f"CASE WHEN {raw} < 0 THEN -{raw} - 1 WHEN {raw} > {n - 1} THEN {2 * n - 1} - {raw} ELSE {raw} END" if mirror else \
            f"least(greatest({raw}, 0), {n - 1})"
    return f""", {name} AS (SELECT p.img, p.y, p.x, avg(q.{value}) AS m FROM {source} p CROSS JOIN range({-lo}, {hi + 1}) a(yk) CROSS JOIN range({-lo}, {hi + 1}) b(xk)
  JOIN {source} q ON q.img = p.img AND q.y = {at('y', H)} AND q.x = {at('x', W)} GROUP BY 1, 2, 3) """


@query("uniform_filter_color", _box("box", "pixels", 4, False) + "SELECT img, y, x, m AS v FROM box")
def _(t):
    return pixels.uniform_filter(t.pixels, 4, H, W)


@query("uniform_filter_cfa", """, parts AS (SELECT img * 8 + (x // 4) * 4 + (y % 2) * 2 + x % 4 % 2 AS k, img, y, x, y // 2 AS y2, x % 4 // 2 AS x2, v FROM pixels)
SELECT p.img, p.y, p.x, avg(q.v) AS v FROM parts p CROSS JOIN range(-1, 1) a(yk) CROSS JOIN range(-1, 1) b(xk) JOIN parts q ON q.k = p.k AND q.y2 = least(greatest(p.y2 + yk, 0), 3)
  AND q.x2 = least(greatest(p.x2 + xk, 0), 1) GROUP BY 1, 2, 3""")
def _(t):
    return pixels.uniform_filter_cfa(t.pixels, 4, H, W, stereo=True)


@query("local_variance", _box("box", "pixels", 3, True) + _box("sq", "(SELECT img, y, x, v * v AS v FROM pixels)", 3, True) +
       "SELECT box.img, box.y, box.x, sq.m - box.m * box.m AS v FROM box JOIN sq USING (img, y, x)")
def _(t):
    return pixels.local_variance(t.pixels, H, W)


@query("varfilt", _box("box", "pixels", 5, True) + ", dev AS (SELECT img, y, x, (v - m) * (v - m) AS v FROM pixels JOIN box USING (img, y, x)) " +
       _box("out", "dev", 5, True) + "SELECT img, y, x, m AS v FROM out")
def _(t):
    return pixels.varfilt(t.pixels, 5, H, W)


@query("classify_pixels")
def _(t):
    return pixels.classify_pixels(t.color.where("c < 3"), 4, 4)


@query("hog_histogram", """, g AS (SELECT p.img, p.y, p.x, coalesce(r.v, 0) - coalesce(l.v, 0) AS gx, coalesce(u.v, 0) - coalesce(d.v, 0) AS gy FROM pixels p
  LEFT JOIN pixels r ON r.img = p.img AND r.y = p.y AND r.x = p.x + 1 LEFT JOIN pixels l ON l.img = p.img AND l.y = p.y AND l.x = p.x - 1
  LEFT JOIN pixels u ON u.img = p.img AND u.x = p.x AND u.y = p.y - 1 LEFT JOIN pixels d ON d.img = p.img AND d.x = p.x AND d.y = p.y + 1),
a AS (SELECT *, atan2(gy::DOUBLE, gx::DOUBLE) AS ang, sqrt(gx * gx + gy * gy) AS m FROM g),
w AS (SELECT img, n * 3 + k AS win, CAST(floor((ang + pi()) / (2 * pi() / 9)) AS BIGINT) AS bin, sum(m) AS s FROM a, range(3) a1(n), range(3) a2(k)
  WHERE y >= n * 2 AND y < (n + 2) * 2 AND x >= k * 2 AND x < (k + 2) * 2 AND ang < pi() GROUP BY 1, 2, 3)
SELECT img, win, bin, s / (sqrt(sum(s * s) OVER (PARTITION BY img, win)) + 0.01) AS h FROM w""")
def _(t):
    return pixels.hog_histogram(t.pixels, H, W)


# -- blobs ------------------------------------------------------------------------------------------------------------



def _components(mask):
    """SQL components: the smallest pixel of each, by repeated minimum over neighbours (an 8 x 8 image needs few rounds)."""
    sql = f""", nb AS MATERIALIZED (SELECT a.img, a.y * 2147483648 + a.x AS u, b.y * 2147483648 + b.x AS v FROM {mask} a JOIN {mask} b ON a.img = b.img
  AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1), r0 AS (SELECT DISTINCT img, u, u AS r FROM nb) """
    for k in range(1, 7):
        # Each round takes the minimum over neighbours twice and jumps to the root of the root.
        sql += f""", a{k} AS MATERIALIZED (SELECT nb.img, nb.u, min(r) AS r FROM nb JOIN r{k - 1} p ON p.img = nb.img AND p.u = nb.v GROUP BY 1, 2),
b{k} AS MATERIALIZED (SELECT nb.img, nb.u, min(r) AS r FROM nb JOIN a{k} p ON p.img = nb.img AND p.u = nb.v GROUP BY 1, 2),
c{k} AS MATERIALIZED (SELECT nb.img, nb.u, min(r) AS r FROM nb JOIN b{k} p ON p.img = nb.img AND p.u = nb.v GROUP BY 1, 2),
r{k} AS MATERIALIZED (SELECT a.img, a.u, least(a.r, b.r) AS r FROM c{k} a JOIN c{k} b ON a.img = b.img AND a.r = b.u) """
    return sql + ", comp AS (SELECT img, u // 2147483648 AS y, u % 2147483648 AS x, r AS root FROM r6), areas AS (SELECT img, root, count(*) AS area FROM comp GROUP BY 1, 2) "


CC = _components("mask")


@query("connected_components", CC + "SELECT img, y, x, root, dense_rank() OVER (PARTITION BY img ORDER BY root) AS label FROM comp")
def _(t):
    return blobs.connected_components(t.mask)


@query("find_blobs", CC + "SELECT img, root, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, count(*) AS area FROM comp GROUP BY 1, 2")
def _(t):
    return blobs.find_blobs(blobs.label_blobs(t.mask))


@query("blobs_by_area", CC + "SELECT img, root, area, row_number() OVER (PARTITION BY img ORDER BY area DESC, root) AS rank FROM areas")
def _(t):
    return blobs.blobs_by_area(blobs.find_blobs(blobs.label_blobs(t.mask))).select("img", "root", "area", "rank")


@query("remove_small", CC + "SELECT img, y, x, root FROM comp JOIN areas USING (img, root) WHERE area >= 5")
def _(t):
    return blobs.remove_small(blobs.label_blobs(t.mask), 5)


@query("remove_large", CC + "SELECT img, y, x, root FROM comp JOIN areas USING (img, root) WHERE area <= 5")
def _(t):
    return blobs.remove_large(blobs.label_blobs(t.mask), 5)


@query("remove_smallest", CC + "SELECT img, y, x, root FROM comp JOIN areas USING (img, root) JOIN (SELECT img, min(area) AS lo, max(area) AS hi FROM areas GROUP BY 1) USING (img) WHERE area > least(hi, lo * 2.0)")
def _(t):
    return blobs.remove_smallest(blobs.label_blobs(t.mask), 2.0)


@query("remove_largest", CC + "SELECT img, y, x, root FROM comp JOIN areas USING (img, root) JOIN (SELECT img, max(area) AS hi FROM areas GROUP BY 1) USING (img) WHERE area < greatest(1, hi / 1.0)")
def _(t):
    return blobs.remove_largest(blobs.label_blobs(t.mask))


@query("hysteresis", _components("(SELECT * FROM pixels WHERE v > 130)") + "SELECT img, y, x, root FROM comp WHERE (img, root) IN (SELECT (img, root) FROM comp JOIN pixels USING (img, y, x) WHERE v > 170)")
def _(t):
    return blobs.hysteresis(t.pixels, 170, 130)


@query("blob_area", "SELECT img, count(*) AS area FROM mask GROUP BY 1")
def _(t):
    return blobs.blob_area(t.mask)


@query("blob_extent", "SELECT img, count(*) / 64 AS extent FROM mask GROUP BY 1")
def _(t):
    return blobs.blob_extent(t.mask, H * W)


@query("equiv_diameter", "SELECT img, sqrt(4 * count(*) / pi()) AS diameter FROM mask GROUP BY 1")
def _(t):
    return blobs.blob_area(t.mask).select("img", blobs.equiv_diameter(F.col("area")).alias("diameter"))


ELL = """, cv AS (SELECT img, var_samp(y) AS a, var_samp(x) AS d, covar_samp(y, x) AS b FROM mask GROUP BY 1), ev AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS big,
  greatest((a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b), 0) AS small FROM cv WHERE a IS NOT NULL),
ell AS (SELECT img, 4 * sqrt(big) AS major, 4 * sqrt(small) AS minor, sqrt(1 - small / big) AS eccentricity, CASE WHEN b <> 0 THEN degrees(atan((big - a) / b)) WHEN a >= d THEN 0 ELSE 90 END - 90 AS orientation FROM ev) """


@query("blob_ellipse", ELL + """SELECT img, round(major, 5) AS major, round(minor, 5) AS minor, round(eccentricity, 5) AS eccentricity,
  round(orientation, 4) AS orientation FROM ell""")
def _(t):
    return blobs.blob_ellipse(t.mask).select("img", *[F.round(c, 5).alias(c) for c in ("major", "minor", "eccentricity")],
                                             F.round("orientation", 4).alias("orientation"))


@query("blob_inv_moments", """, c AS (SELECT img, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM mask GROUP BY 1),
e AS (SELECT img, sum((x - cx) ** 2) / any_value(n) ** 2 AS e20, sum((y - cy) ** 2) / any_value(n) ** 2 AS e02, sum((x - cx) * (y - cy)) / any_value(n) ** 2 AS e11,
  sum((x - cx) ** 3) / any_value(n) ** 2.5 AS e30, sum((y - cy) ** 3) / any_value(n) ** 2.5 AS e03, sum((x - cx) * (y - cy) ** 2) / any_value(n) ** 2.5 AS e12,
  sum((x - cx) ** 2 * (y - cy)) / any_value(n) ** 2.5 AS e21 FROM mask JOIN c USING (img) GROUP BY 1)
SELECT img, e20 + e02 AS phi1, (e20 - e02) ** 2 + 4 * e11 ** 2 AS phi2, (e30 - 3 * e12) ** 2 + (3 * e21 - e03) ** 2 AS phi3, (e30 + e12) ** 2 + (e21 + e03) ** 2 AS phi4,
  (e30 - 3 * e12) * (e30 + e12) * ((e30 + e12) ** 2 - 3 * (e21 + e03) ** 2) + (3 * e21 - e03) * (e21 + e03) * (3 * (e30 + e12) ** 2 - (e21 + e03) ** 2) AS phi5,
  (e20 - e02) * ((e30 + e12) ** 2 - (e21 + e03) ** 2) + 4 * e11 * (e30 + e12) * (e21 + e03) AS phi6,
  (3 * e21 - e03) * (e30 + e12) * ((e30 + e12) ** 2 - 3 * (e21 + e03) ** 2) + (3 * e12 - e30) * (e21 + e03) * (3 * (e30 + e12) ** 2 - (e21 + e03) ** 2) AS phi7
  FROM e""")
def _(t):
    return blobs.blob_inv_moments(t.mask).select("img", *[f"phi{i}" for i in range(1, 8)])


HULL = """, outer_points AS (SELECT DISTINCT img, y, unnest([min(x), max(x)]) AS x FROM mask GROUP BY img, y),
side AS (SELECT p.img, p.y AS py, p.x AS px, q.y AS qy, q.x AS qx, min((q.y - p.y) * (r.x - p.x) - (q.x - p.x) * (r.y - p.y)) AS low,
  bool_and((q.y - p.y) * (r.x - p.x) - (q.x - p.x) * (r.y - p.y) <> 0 OR ((r.y - p.y) * (r.y - q.y) <= 0 AND (r.x - p.x) * (r.x - q.x) <= 0)) AS whole
  FROM outer_points p JOIN outer_points q ON p.img = q.img AND (p.y, p.x) <> (q.y, q.x) JOIN outer_points r ON r.img = p.img GROUP BY ALL),
edges AS (SELECT img, py, px, qy, qx FROM side WHERE low >= 0 AND whole) """


@query("convex_hull", HULL + "SELECT DISTINCT img, py AS y, px AS x FROM edges")
def _(t):
    return blobs.convex_hull(t.mask).select("img", "y", "x").where(F.lit(True)).join(
        blobs.blob_area(t.mask).where("area > 1").select("img"), "img", "left_semi")


@query("hull_perimeter", HULL + "SELECT img, sum(sqrt((py - qy) ** 2 + (px - qx) ** 2)) AS perimeter FROM edges GROUP BY 1")
def _(t):
    return blobs.hull_perimeter(blobs.convex_hull(t.mask)).where("perimeter > 0")


SOLID = HULL + """, cvx AS (SELECT img, abs(sum(py * qx - qy * px)) / 2 + sum(gcd(abs(py - qy), abs(px - qx))) / 2 + 1 AS convex_area FROM edges GROUP BY 1),
ar AS (SELECT img, count(*) AS area FROM mask GROUP BY 1) """


@query("solidity", SOLID + "SELECT img, convex_area, area / convex_area AS solidity FROM ar JOIN cvx USING (img) WHERE area > 1")
def _(t):
    return blobs.solidity(t.mask).join(blobs.blob_area(t.mask).where("area > 1").select("img"), "img", "left_semi")


PER = """, per AS (SELECT img, y, x FROM mask m WHERE (SELECT count(*) FROM mask n WHERE n.img = m.img AND abs(n.y - m.y) + abs(n.x - m.x) = 1) <
  4 - (y = 0)::INT - (y = 7)::INT - (x = 0)::INT - (x = 7)::INT) """


@query("perimeter_pixels", PER + "SELECT * FROM per")
def _(t):
    return blobs.perimeter_pixels(t.mask, H, W)




def _dist(a, b, how):
    one = f"SELECT img, {how}(d) AS d FROM (SELECT a.img, a.y, a.x, min(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS d FROM {{}} a JOIN {{}} b ON a.img = b.img GROUP BY 1, 2, 3) GROUP BY 1"
    return f"SELECT p.img, greatest(p.d, q.d) AS distance FROM ({one.format(a, b)}) p JOIN ({one.format(b, a)}) q ON p.img = q.img"


BRIGHT = "(SELECT img, y, x FROM pixels WHERE v > 150)"


@query("hausdorff", _dist("mask", BRIGHT, "max"))
def _(t):
    return blobs.hausdorff(t.mask, t.pixels.where("v > 150").select("img", "y", "x"))


@query("hausdorff_modified", _dist("mask", BRIGHT, "avg"))
def _(t):
    return blobs.hausdorff_modified(t.mask, t.pixels.where("v > 150").select("img", "y", "x"))


@query("hausdorff_symmetry", PER + """, cen AS (SELECT img, avg(y) AS cy, avg(x) AS cx FROM mask GROUP BY 1), p0 AS (SELECT img, y - cy AS y, x - cx AS x FROM per JOIN cen USING (img)),
p1 AS (SELECT img, -y AS y, -x AS x FROM p0), p2 AS (SELECT img, x AS y, y AS x FROM p0), p3 AS (SELECT img, -y AS y, x FROM p0), """ +
       ", ".join(f"d{k} AS ({_dist('p0', f'p{k}', 'avg')})" for k in (1, 2, 3)) +
       " SELECT img, d1.distance AS h180, d2.distance AS h90, d3.distance AS hflip FROM d1 JOIN d2 USING (img) JOIN d3 USING (img)")
def _(t):
    return blobs.hausdorff_symmetry(t.mask, H, W)


@query("pairwise_distances", """, dia AS (SELECT img, sqrt(4 * count(*) / pi()) AS dia FROM mask GROUP BY 1),
d AS (SELECT a.img, sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) / dia AS d FROM mask a JOIN mask b ON a.img = b.img AND a.y * 8 + a.x < b.y * 8 + b.x JOIN dia ON dia.img = a.img),
m AS (SELECT img, avg(d) AS mean, median(d) AS median FROM d GROUP BY 1), z AS (SELECT img, any_value(mean) AS mean, any_value(median) AS median, avg((d - mean) ** 2) AS m2, avg((d - mean) ** 3) AS m3,
  avg((d - mean) ** 4) AS m4, count(*) AS n FROM d JOIN m USING (img) GROUP BY 1)
SELECT img, mean, median, CASE WHEN n > 1 AND m2 > 1e-20 THEN m3 / m2 ** 1.5 END AS skewness, CASE WHEN n > 1 AND m2 > 1e-20 THEN m4 / m2 ** 2 END AS kurtosis FROM z""")
def _(t):
    dia = blobs.blob_area(t.mask).select("img", blobs.equiv_diameter(F.col("area")).alias("diameter"))
    return blobs.pairwise_distances(t.mask, dia)


@query("sor_volume", "SELECT img, sum((n * 0.5) ** 2 * pi()) AS volume FROM (SELECT img, x, count(*) AS n FROM mask GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return blobs.sor_volume(t.mask)


VOL = PER + """, dm AS (SELECT a.img, a.y, a.x, min(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) + 1 AS d FROM mask a JOIN per b ON a.img = b.img GROUP BY 1, 2, 3),
dv AS (SELECT img, 4 * avg(d) - 2 AS transect, sum(d) AS s FROM dm GROUP BY 1), vol AS (SELECT img, transect ** 2 / (transect ** 2 + 2 * transect + 0.5) * pi() * s AS distmap, transect FROM dv) """


@query("distmap_volume", VOL + "SELECT img, distmap AS volume, transect FROM vol")
def _(t):
    return blobs.distmap_volume(t.mask, blobs.perimeter_pixels(t.mask, H, W))


@query("biovolume_select", (SOLID + VOL + ELL).replace("WITH", "") + """, sv AS (SELECT img, sum((n * 0.5) ** 2 * pi()) AS sor FROM (SELECT img, x, count(*) AS n FROM mask GROUP BY 1, 2) GROUP BY 1)
SELECT img, round(CASE WHEN rot THEN sor ELSE distmap END, 6) AS biovolume, CASE WHEN rot THEN 0 ELSE transect END AS transect FROM
  (SELECT img, sor, distmap, transect, convex_area / area < 1.2 OR (eccentricity < 0.8 AND sqrt(4 * area / pi()) / major > 0.8) AS rot FROM ar JOIN cvx USING (img) JOIN vol USING (img) JOIN ell USING (img) JOIN sv USING (img))""")
def _(t):
    m = t.mask
    shapes = blobs.solidity(m).select("img", "convex_area").join(blobs.blob_area(m), "img").join(blobs.blob_ellipse(m), "img").join(
        blobs.sor_volume(m).withColumnRenamed("volume", "sor"), "img").join(
        blobs.distmap_volume(m, blobs.perimeter_pixels(m, H, W)).withColumnRenamed("volume", "distmap"), "img").withColumn(
        "diameter", blobs.equiv_diameter(F.col("area")))
    return blobs.biovolume_select(shapes).select("img", F.round("biovolume", 6).alias("biovolume"), "transect")


# -- flow -------------------------------------------------------------------------------------------------------------

def _points(t):
    """Targets by supplier; some lie at the sentinel place."""
    return t.raw_targets.select(F.col("supp").alias("bin"), (F.col("bin") * 8 + F.col("line")).alias("n"), F.col("part").alias("p"),
                                F.when(F.col("part") % 17 == 0, F.lit(-999)).otherwise(F.col("left")).alias("x"),
                                (F.col("bin") * 7 % 1035).alias("y"))


PTS = """, pts0 AS (SELECT supp AS bin, bin * 8 + line AS n, CASE WHEN part % 17 = 0 THEN -999 ELSE "left" END AS x, bin * 7 % 1035 AS y FROM raw_targets),
pts AS (SELECT * FROM pts0 WHERE x <> -999 AND y <> -999),
dd AS (SELECT p.*, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d FROM pts p JOIN (SELECT bin, avg(x) AS cx, avg(y) AS cy FROM pts GROUP BY 1) c USING (bin)),
prof AS (SELECT bin, n, d, row_number() OVER (PARTITION BY bin ORDER BY d, n) AS rn, count(*) OVER (PARTITION BY bin) AS cnt, min(d) OVER (PARTITION BY bin) AS lo, max(d) OVER (PARTITION BY bin) AS hi FROM dd),
nrm AS (SELECT bin, n, d, rn, CASE WHEN cnt > 1 THEN (rn - 1) / (cnt - 1) ELSE 0 END AS i, CASE WHEN hi > lo THEN (d - lo) / (hi - lo) END AS s FROM prof),
elb AS (SELECT bin, arg_min(rn, (round(s - i, 12), rn)) AS e FROM nrm WHERE s IS NOT NULL GROUP BY 1),
spot AS (SELECT bin, max(share) AS camera_spot FROM (SELECT bin, side, max(c) / sum(c) AS share FROM (SELECT bin, rn >= e AS side, d, count(*) AS c FROM nrm JOIN elb USING (bin) GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1),
clip AS (SELECT bin, 100 - 100 * count(*) FILTER (x >= x0 + (x1 - x0) * 0.01::DOUBLE AND x <= x1 - (x1 - x0) * 0.01::DOUBLE AND y >= y0 + (y1 - y0) * 0.01::DOUBLE AND y <= y1 - (y1 - y0) * 0.01::DOUBLE) / count(*) AS clipping
  FROM pts JOIN (SELECT bin, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts GROUP BY 1) USING (bin) GROUP BY 1) """


@query("drop_sentinel", PTS + "SELECT bin, n, x, y FROM pts")
def _(t):
    return flow.drop_sentinel(_points(t)).select("bin", "n", "x", "y")


@query("index_normalize", """, r AS (SELECT ts_label, id, duration, row_number() OVER (PARTITION BY ts_label ORDER BY duration, id) AS rn, count(*) OVER (PARTITION BY ts_label) AS n,
  min(duration) OVER (PARTITION BY ts_label) AS lo, max(duration) OVER (PARTITION BY ts_label) AS hi FROM bins) SELECT ts_label, id, (rn - 1) / (n - 1) AS i, (duration - lo) / (hi - lo) AS s FROM r""")
def _(t):
    return flow.index_normalize(t.bins.select("ts_label", "id", "duration"), ["ts_label"], "duration", ["id"]).select("ts_label", "id", "i", "s")


@query("flow_distance_profile", PTS + "SELECT bin, i, round(s, 9) AS s FROM nrm")
def _(t):
    return flow.flow_distance_profile(flow.drop_sentinel(_points(t))).select("bin", "i", F.round("s", 9).alias("s"))


@query("flow_camera_spot", PTS + "SELECT * FROM spot")
def _(t):
    return flow.flow_camera_spot(flow.drop_sentinel(_points(t)))


@query("flow_clipping", PTS + "SELECT * FROM clip")
def _(t):
    return flow.flow_clipping(flow.drop_sentinel(_points(t)))


CORE = PTS + """, num AS (SELECT bin, n, x::DOUBLE AS x, y::DOUBLE AS y, row_number() OVER (PARTITION BY bin ORDER BY n) AS rn, count(*) OVER (PARTITION BY bin) AS cnt FROM pts),
sel AS (SELECT bin, rn, x, y FROM num WHERE (rn - 1) % greatest(1, cnt // 1000) = 0),
cv0 AS (SELECT bin, count(*) AS m, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS d FROM sel GROUP BY 1),
cv AS (SELECT bin, m, d / (a * d - b * b) / m ** (-1.0/3) AS ia, -b / (a * d - b * b) / m ** (-1.0/3) AS ib, a / (a * d - b * b) / m ** (-1.0/3) AS id FROM cv0 WHERE m > 2 AND a * d - b * b > 1e-9),
den AS (SELECT p.bin, p.rn, any_value(p.x) AS x, any_value(p.y) AS y, sum(exp(-0.5 * (ia * (p.x - q.x) ** 2 + 2 * ib * (p.x - q.x) * (p.y - q.y) + id * (p.y - q.y) ** 2))) AS f FROM sel p JOIN sel q ON p.bin = q.bin JOIN cv ON cv.bin = p.bin GROUP BY 1, 2),
lim AS (SELECT bin, quantile_cont(f, 0.1) AS t FROM den GROUP BY 1),
box AS (SELECT bin, max(x) - min(x) AS w, max(y) - min(y) AS h FROM den JOIN lim USING (bin) WHERE f > t GROUP BY 1),
core AS (SELECT bin, CASE WHEN w > 0 AND h > 0 THEN least(w / h, h / w) END AS core_aspect FROM (SELECT DISTINCT bin FROM pts) LEFT JOIN box USING (bin)) """


@query("flow_core_aspect", CORE + "SELECT * FROM core")
def _(t):
    return flow.flow_core_aspect(flow.drop_sentinel(_points(t)))


@query("flow_metrics", CORE + "SELECT bin, camera_spot, clipping, core_aspect, camera_spot * 10 + clipping * 0.5::DOUBLE + core_aspect * 2.5::DOUBLE AS position FROM spot JOIN clip USING (bin) JOIN core USING (bin)")
def _(t):
    return flow.flow_metrics(_points(t))


# -- mosaic -----------------------------------------------------------------------------------------------------------

def _layout(t):
    tiles = t.targets.select("bin", F.col("targetNumber").alias("n"), F.col("width").alias("w"), F.col("height").alias("h"))
    return flow.mosaic_layout(tiles, 60, 60)


@query("mosaic_layout")
def _(t):
    return _layout(t)


@query("mosaic_scaled")
def _(t):
    pid = F.concat_ws("_", F.col("bin").cast("string"), F.col("n").cast("string"))
    return flow.mosaic_scaled(_layout(t), pid, 0.33)
