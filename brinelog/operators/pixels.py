"""Statistics on pixel tables ``img, y, x[, c], v``.

Rows of one image line are the largest group any window here sees; histograms are grouped by level before any join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinelog.functions.colour import rgb_to_ycbcr
from brinelog.operators import ordered
from brinelog.operators.grouped import per_group

# Fixed value: guards a division by an empty histogram.
TINY = 0.000001


# -- geometry ---------------------------------------------------------------------------------------------------------

def stereo_half(pixels: DataFrame, width: int, right: bool = False) -> DataFrame:
    half = width // 2
    return pixels.where(F.col("x") >= half).withColumn("x", F.col("x") - half) if right else pixels.where(F.col("x") < half)


def roll_pixels(pixels: DataFrame, height: int, width: int, dy: int, dx: int) -> DataFrame:
    """Cyclic shift in both directions."""
    return pixels.withColumns({"y": F.pmod(F.col("y") + dy, F.lit(height)), "x": F.pmod(F.col("x") + dx, F.lit(width))})


def masked_pixels(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    return pixels.join(mask.select("img", "y", "x"), ["img", "y", "x"], "left_semi")


# -- histograms -------------------------------------------------------------------------------------------------------

def pixel_histogram(pixels: DataFrame, levels: int = 256) -> DataFrame:
    """Count of every level of every image, zeros included."""
    counts = pixels.groupBy("img", "v").agg(F.count("*").alias("n"))
    spine = counts.select("img").distinct().withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)).cast("array<bigint>")))
    return spine.join(counts, ["img", "v"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def histogram_mean_var(histogram: DataFrame) -> DataFrame:
    """Mean and population variance of ``img, v, n``; the tiny count keeps an empty histogram defined."""
    n, v = F.col("n"), F.col("v")
    sums = histogram.groupBy("img").agg(F.sum(n).alias("s0"), F.sum(n * v).alias("s1"), F.sum(n * v * v).alias("s2"))
    total = F.col("s0") + F.lit(TINY)
    mean = F.col("s1") / total
    spread = F.col("s2") - 2 * mean * F.col("s1") + mean * mean * F.col("s0")
    return sums.select("img", mean.alias("mean"), (spread / total).alias("variance"))


def cumulative_threshold(histogram: DataFrame, share: float = 0.95) -> DataFrame:
    """Smallest level whose cumulative count exceeds a share of all pixels."""
    upto = Window.partitionBy("img").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = F.sum("n").over(Window.partitionBy("img"))
    rows = histogram.withColumns({"_c": F.sum("n").over(upto), "_t": totals})
    return rows.where(F.col("_c") > F.col("_t") * share).groupBy("img").agg(F.min("v").alias("threshold"))


def _stretched(pixels: DataFrame, low: float, high: float, top: float) -> DataFrame:
    # Levels are few, so the exact percentile keeps one counter per level.
    limits = pixels.groupBy("img").agg(F.percentile("v", F.array(F.lit(low), F.lit(high))).alias("_q"))
    rows = pixels.join(limits, "img")
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    clipped = F.least(F.greatest(F.col("v"), lo), hi)
    return rows.withColumn("v", F.when(hi > lo, (clipped - lo) / (hi - lo) * top)).drop("_q")


def contrast_stretch(pixels: DataFrame, amount: float = 2, top: float = 255.0) -> DataFrame:
    """Rescale each image between its ``amount`` and ``100 - amount`` percentiles."""
    return _stretched(pixels, amount / 100, 1 - amount / 100, top)


def texture_pixels(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    return masked_pixels(_stretched(pixels, 0.01, 0.99, 255.0), mask)


def texture_stats(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """Gray level, contrast, smoothness, third moment, uniformity and entropy of the histogram of each image."""
    v = F.col("v").cast("double")
    stats = pixels.groupBy("img").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.var_pop(v).alias("_var"), F.skewness(v).alias("_skew"),
        F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count("*").alias("_n"))
    rows = pixels.join(stats.select("img", "_lo", "_hi", "_n"), "img")
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(
        F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(0)
    p = F.col("_c") / F.col("_n")
    shares = rows.groupBy("img", "_n", place.alias("_bin")).agg(F.count("*").alias("_c"))
    eps = 2.0**-52
    shape = shares.groupBy("img").agg(F.sum(p * p).alias("uniformity"), (-F.sum(p * F.log2(p + eps))).alias("entropy"))
    d = float((bins - 1) ** 2)
    third = F.when(F.col("_var") > 0, F.col("_skew") * F.pow(F.col("std"), F.lit(3.0))).otherwise(0.0)
    return stats.join(shape, "img").select(
        "img", "mean", "std", (1 - 1 / (1 + F.col("_var") / d)).alias("smoothness"), (third / d).alias("third_moment"),
        "uniformity", "entropy")


def distribution_stats(rows: DataFrame, keys: Sequence[str], col: str, count: str | None = None) -> DataFrame:
    """Mean, median, skewness and kurtosis (3 for a normal distribution) of values, optionally with a count each.

    Values are counted first; the running count that finds the median goes over distinct values only, in slices.
    """
    weight = F.lit(1) if count is None else F.col(count)
    levels = rows.groupBy(*keys, F.col(col).cast("double").alias("_v")).agg(F.sum(weight).alias("_n"))
    n, v = F.col("_n"), F.col("_v")
    # Slices by order of magnitude and leading digits: they follow the value and need no look at the data.
    size = F.floor(F.log2(F.greatest(F.abs(v), F.lit(1e-300))) * 16)
    slices = F.when(v < 0, -size - 100000).when(v > 0, size + 100000).otherwise(0)
    ranked = ordered.accumulate(levels, keys, ["_v"], slices, {"_upto": n}, whole={"_t": ("sum", n), "_s": ("sum", n * v)})
    ranked = ranked.withColumn("mean", F.col("_s") / F.col("_t")).drop("_s")
    lower, upper = F.floor((F.col("_t") - 1) / 2) + 1, F.floor(F.col("_t") / 2) + 1
    d = F.col("_v") - F.col("mean")
    sums = ranked.groupBy(*keys, "mean", "_t").agg(
        F.min(F.when(F.col("_upto") >= lower, F.col("_v"))).alias("_a"), F.min(F.when(F.col("_upto") >= upper, F.col("_v"))).alias("_b"),
        F.sum(n * d * d).alias("_m2"), F.sum(n * d * d * d).alias("_m3"), F.sum(n * d * d * d * d).alias("_m4"))
    m2, m3, m4 = (F.col(c) / F.col("_t") for c in ("_m2", "_m3", "_m4"))
    return sums.select(*keys, "mean", ((F.col("_a") + F.col("_b")) / 2).alias("median"),
                       F.when(m2 > 0, m3 / F.pow(m2, F.lit(1.5))).alias("skewness"), F.when(m2 > 0, m4 / (m2 * m2)).alias("kurtosis"))


# -- thresholds -------------------------------------------------------------------------------------------------------

def two_means(pixels: DataFrame, keys: Sequence[str] = ("img",)) -> DataFrame:
    """Exact best split of the levels of each image into two groups: ``low, high`` centres.

    In one dimension the best two clusters are cut at one level, so running sums over the histogram try every cut.
    """
    v = F.col("v").cast("double")
    levels = pixels.groupBy(*keys, v.alias("v")).agg(F.count("*").alias("_n"))
    up = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    n, s = F.col("_n"), F.col("_n") * F.col("v")
    cuts = levels.withColumns({"_n1": F.sum(n).over(up), "_s1": F.sum(s).over(up), "_t": F.sum(n).over(whole), "_s": F.sum(s).over(whole)})
    n2, s2 = F.col("_t") - F.col("_n1"), F.col("_s") - F.col("_s1")
    # The squared error is smallest where the between-group sum is largest.
    gain = F.when(n2 > 0, F.col("_s1") * F.col("_s1") / F.col("_n1") + s2 * s2 / n2)
    centres = F.struct((F.col("_s1") / F.col("_n1")).alias("low"), F.when(n2 > 0, s2 / n2).alias("high"))
    best = cuts.groupBy(*keys).agg(F.max_by(centres, F.struct(gain.alias("g"), (-F.col("v")).alias("v"))).alias("c"))
    return best.select(*keys, "c.low", F.coalesce("c.high", "c.low").alias("high"))


def kmeans_threshold(pixels: DataFrame) -> DataFrame:
    """Pixels above the middle of the two centres of their image."""
    cut = two_means(pixels).select("img", ((F.col("low") + F.col("high")) / 2).alias("_cut"))
    return pixels.join(cut, "img").withColumn("above", F.col("v") > F.col("_cut")).drop("_cut")


def dark_threshold(pixels: DataFrame, adjust: float = 0.65) -> DataFrame:
    """Pixels darker than the adjusted middle of the two centres."""
    cut = two_means(pixels).select("img", ((F.col("low") + F.col("high")) / 2 * adjust).alias("_cut"))
    return pixels.join(cut, "img").withColumn("dark", F.col("v") < F.col("_cut")).drop("_cut")


def gmm_threshold(pixels: DataFrame, rounds: int = 200) -> DataFrame:
    """Pixels above the middle of the means of a two-part Gaussian mixture, fitted to the histogram of each image.

    The fit sees one row per level (at most 256), whatever the size of the image.
    """
    def fit(img: object, cols: dict) -> list[tuple]:
        import numpy as np
        v, n = cols["v"].astype(float), cols["n"].astype(float)
        mean = np.average(v, weights=n)
        var = np.average((v - mean) ** 2, weights=n)
        mu, s2, w = mean + np.array([-1, 1]) * np.sqrt(var), np.array([var, var]) + 1e-6, np.array([0.5, 0.5])
        for _ in range(rounds):
            log = np.log(w) - 0.5 * np.log(s2) - (v[:, None] - mu) ** 2 / (2 * s2)
            part = np.exp(log - log.max(axis=1, keepdims=True))
            part *= (n / part.sum(axis=1))[:, None]
            mass = part.sum(axis=0) + 1e-12
            before, mu = mu, (part * v[:, None]).sum(axis=0) / mass
            s2, w = (part * (v[:, None] - mu) ** 2).sum(axis=0) / mass + 1e-6, mass / mass.sum()
            if np.abs(mu - before).max() < 1e-6:
                break
        return [(img, float(mu.mean()))]

    levels = pixels.groupBy("img", "v").agg(F.count("*").alias("n"))
    cuts = per_group(levels, "img", ["v"], fit, f"img {dict(pixels.dtypes)['img']}, _cut double")
    return pixels.join(cuts, "img").withColumn("above", F.col("v") > F.col("_cut")).drop("_cut")


def feature_vectors(color: DataFrame, channels: Sequence[int]) -> DataFrame:
    """One vector per pixel with one dimension per channel."""
    from pyspark.ml.feature import VectorAssembler
    wide = channel_columns(color, {f"c{c}": c for c in channels})
    return VectorAssembler(inputCols=[f"c{c}" for c in channels], outputCol="features").transform(wide)


def channel_columns(color: DataFrame, names: dict[str, int]) -> DataFrame:
    """Channels as columns, one row per pixel."""
    return color.groupBy("img", "y", "x").agg(*[F.max(F.when(F.col("c") == c, F.col("v"))).alias(n) for n, c in names.items()])


def kmeans_image(color: DataFrame, channels: Sequence[int], k: int, seed: int = 1) -> DataFrame:
    """Replace each pixel by the centre of its cluster; the model is fitted on the whole table."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import vector_to_array
    rows = feature_vectors(color, channels)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    labelled = model.transform(rows)
    return labelled.select("img", "y", "x", "cluster", F.element_at(centres, F.col("cluster") + 1).alias("centre"),
                           vector_to_array("features").alias("pixel"))


def sample_with_replacement(pixels: DataFrame, fraction: float, seed: int = 1, n: int | None = None) -> DataFrame:
    """Rows drawn with replacement; ``n`` of the draw are a random choice of it."""
    drawn = pixels.sample(withReplacement=True, fraction=fraction, seed=seed)
    return drawn if n is None else drawn.orderBy(F.rand(seed)).limit(n)


# -- colour and light maps --------------------------------------------------------------------------------------------

def gray_value(color: DataFrame) -> DataFrame:
    """Mean of the channel means of each image."""
    means = color.groupBy("img", "c").agg(F.avg("v").alias("m"))
    return means.groupBy("img").agg(F.avg("m").alias("gray"))


def gray_world(color: DataFrame, gray: float | None = None) -> DataFrame:
    """Scale each channel so that its mean is the gray value of the image (or a given one)."""
    means = color.groupBy("img", "c").agg(F.avg("v").alias("_m"))
    if gray is None:
        target = means.groupBy("img").agg(F.avg("_m").alias("_g"))
        scale = means.join(target, "img").select("img", "c", (F.col("_g") / F.col("_m")).alias("_k"))
    else:
        scale = means.select("img", "c", (F.lit(float(gray)) / F.col("_m")).alias("_k"))
    return color.join(scale, ["img", "c"]).withColumn("v", F.col("v") * F.col("_k")).drop("_k")


def _place(pixels: DataFrame) -> list[str]:
    return [c for c in ("y", "x", "c") if c in pixels.columns]


def lightmap_accumulate(pixels: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Sum and count of images per place; adds to an earlier accumulation."""
    place = _place(pixels)
    new = pixels.groupBy(*place).agg(F.sum("v").cast("double").alias("total"), F.count("*").alias("images"))
    if before is None:
        return new
    return before.unionByName(new).groupBy(*place).agg(F.sum("total").alias("total"), F.sum("images").alias("images"))


def lightmap_average(pixels: DataFrame, smooth: int = 0, height: int = 0, width: int = 0, raw: bool = False) -> DataFrame:
    """Mean image, smoothed over ``smooth`` pixels when asked; raw images are smoothed per colour filter phase."""
    mean = lightmap_accumulate(pixels).withColumn("v", F.col("total") / F.col("images")).drop("total", "images")
    if smooth <= 0:
        return mean
    return uniform_filter_cfa(mean, smooth, height, width) if raw else uniform_filter(mean, smooth, height, width)


def _corrected(pixels: DataFrame, lightmap: DataFrame, brightness: float) -> DataFrame:
    place = _place(lightmap)
    spread = lightmap.agg((F.max("v") - F.min("v")).alias("s")).select("s").scalar()
    rows = pixels.join(lightmap.withColumnRenamed("v", "_m"), place)
    return rows.withColumn("v", F.col("v") / F.col("_m") * spread * brightness).drop("_m")


def lightmap_correct_raw(pixels: DataFrame, lightmap: DataFrame) -> DataFrame:
    return _corrected(pixels, lightmap, 1.0)


def lightmap_correct_rgb(color: DataFrame, lightmap: DataFrame, balance: bool = False, brightness: float = 1.0) -> DataFrame:
    return _corrected(gray_world(color) if balance else color, lightmap, brightness)


# -- neighbourhoods ---------------------------------------------------------------------------------------------------

def _padded(rows: DataFrame, pos: str, size: Column, lo: int, hi: int, mirror: bool) -> DataFrame:
    """Add copies beyond both borders: the edge value, or the values mirrored at the edge."""
    p = F.col(pos)
    if mirror:
        copies = [F.when(p < lo, F.array(-p - 1)), F.when(p >= size - hi, F.array(2 * size - 1 - p))]
    else:
        copies = [F.when(p == 0, F.sequence(F.lit(-lo), F.lit(-1)).cast("array<bigint>")) if lo else None,
                  F.when(p == size - 1, F.sequence(size, size + hi - 1).cast("array<bigint>")) if hi else None]
    extra = [F.coalesce(c, F.array().cast("array<bigint>")) for c in copies if c is not None]
    every = F.concat(F.array(p.cast("bigint")), *extra)
    return rows.withColumn("_own", p).withColumn(pos, F.explode(every))


def _axis_mean(rows: DataFrame, pos: str, keys: Sequence[str], extent: int, size: int, cols: Sequence[str], mirror: bool,
               whole: bool) -> DataFrame:
    lo, hi = size // 2, size - size // 2 - 1
    padded = _padded(rows, pos, F.lit(extent), lo, hi, mirror)
    near = Window.partitionBy(*keys).orderBy(pos).rangeBetween(-lo, hi)
    means = {c: F.avg(c).over(near) for c in cols}
    out = padded.withColumns({c: F.floor(m) if whole else m for c, m in means.items()})
    return out.where(F.col(pos) == F.col("_own")).drop("_own")


def uniform_filter(rows: DataFrame, size: int, height: int, width: int, cols: Sequence[str] = ("v",), mirror: bool = False,
                   whole: bool = False, keys: Sequence[str] | None = None) -> DataFrame:
    """Box mean of ``size`` x ``size`` pixels, along y and then x; one image line is the largest group.

    Borders repeat the edge value, or mirror it. ``whole`` drops fractions after each direction, as byte images do.
    """
    keys = [k for k in ("img", "c") if k in rows.columns] if keys is None else list(keys)
    once = _axis_mean(rows, "y", [*keys, "x"], height, size, cols, mirror, whole)
    return _axis_mean(once, "x", [*keys, "y"], width, size, cols, mirror, whole)


def uniform_filter_cfa(rows: DataFrame, size: int, height: int, width: int, stereo: bool = False) -> DataFrame:
    """Box mean per colour filter phase (even and odd lines and columns apart), halves of a stereo pair apart."""
    half = width // 2 if stereo else width
    parts = rows.withColumns({"_side": F.floor(F.col("x") / half), "_py": F.col("y") % 2, "_px": F.col("x") % half % 2})
    small = parts.withColumns({"y": F.floor(F.col("y") / 2), "x": F.floor(F.col("x") % half / 2)})
    keys = [k for k in ("img", "c") if k in rows.columns] + ["_side", "_py", "_px"]
    mean = uniform_filter(small, size // 2, height // 2, half // 2, keys=keys)
    back = mean.withColumns({"y": F.col("y") * 2 + F.col("_py"), "x": F.col("x") * 2 + F.col("_px") + F.col("_side") * half})
    return back.drop("_side", "_py", "_px")


def local_variance(pixels: DataFrame, height: int, width: int, size: int = 3) -> DataFrame:
    """Population variance in a square neighbourhood, borders mirrored."""
    rows = pixels.withColumns({"v": F.col("v").cast("double"), "_q": F.col("v").cast("double") * F.col("v")})
    means = uniform_filter(rows, size, height, width, ("v", "_q"), mirror=True)
    spread = F.greatest(F.col("_q") - F.col("v") * F.col("v"), F.lit(0.0))
    return means.withColumn("v", spread).drop("_q")


def varfilt(pixels: DataFrame, size: int, height: int, width: int) -> DataFrame:
    """Box mean of the squared deviation from the box mean."""
    rows = pixels.withColumns({"_v": F.col("v").cast("double"), "v": F.col("v").cast("double")})
    centred = uniform_filter(rows, size, height, width, mirror=True)
    squares = centred.withColumn("v", (F.col("_v") - F.col("v")) * (F.col("_v") - F.col("v"))).drop("_v")
    return uniform_filter(squares, size, height, width, mirror=True)


def classify_pixels(color: DataFrame, height: int, width: int, size: int = 5) -> DataFrame:
    """Sea floor class per pixel: 1 rubble, 2 sand, 3 coral, 0 none, by mean and variance of YCbCr in a box."""
    rgb = channel_columns(color, {"r": 0, "g": 1, "b": 2})
    px = rgb.select("img", "y", "x", rgb_to_ycbcr(F.col("r"), F.col("g"), F.col("b")).alias("_p"))
    rows = px.select("img", "y", "x", *[F.col(f"_p.{n}").alias(f"_{n}") for n in ("y", "cb", "cr")])
    mean = uniform_filter(rows, size, height, width, ("_y", "_cb", "_cr"), mirror=True, whole=True)
    long = rows.select("img", "y", "x", F.explode(F.array(F.struct(F.lit(0).alias("c"), F.col("_y").alias("v")),
                                                          F.struct(F.lit(2).alias("c"), F.col("_cr").alias("v")))).alias("s"))
    var = channel_columns(varfilt(long.select("img", "y", "x", "s.c", "s.v"), size, height, width), {"_vy": 0, "_vcr": 2})
    m = mean.join(var, ["img", "y", "x"])
    y, cb, cr, vy, vcr = (F.col(c) for c in ("_y", "_cb", "_cr", "_vy", "_vcr"))
    # The class rules.
    coral = (vy < 10) & (cb < cr) & (y > 5) & (cr > 130)
    sand = (y > 130) & (vcr < 30) & (cb > cr - 20) & ~coral
    shadow = (y < 30) & (vy < 15) & ~coral & ~sand
    rubble = ~(coral | shadow | sand) & (vy > 20)
    return m.select("img", "y", "x", F.when(coral, 3).when(sand, 2).when(rubble, 1).otherwise(0).alias("class"))


def hog_histogram(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Nine-bin gradient histograms of 3 x 3 half-overlapping windows, each scaled by its length plus 0.01."""
    # Windows per direction, bins.
    windows, bins = 3, 9
    step_y, step_x = height // (windows + 1), width // (windows + 1)
    row, col = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    zero = F.lit(0)

    def at(fn, w) -> Column:
        return F.coalesce(fn("v").over(w), zero).cast("double")

    g = pixels.withColumns({"_gx": at(F.lead, row) - at(F.lag, row)}).withColumns({"_gy": at(F.lag, col) - at(F.lead, col)})
    angle, size = F.atan2("_gy", "_gx"), F.hypot("_gx", "_gy")
    slot = F.floor((angle + F.pi()) / (2 * F.pi() / bins))

    def members(pos: str, step: int) -> Column:
        k = F.floor(F.col(pos) / step)
        return F.filter(F.array(k - 1, k), lambda w: (w >= 0) & (w < windows))

    rows = g.select("img", size.alias("_m"), F.when(angle < F.pi(), slot).alias("bin"), F.explode(members("y", step_y)).alias("wy"), "x")
    rows = rows.select("img", "_m", "bin", "wy", F.explode(members("x", step_x)).alias("wx"))
    sums = rows.where("bin IS NOT NULL").groupBy("img", (F.col("wy") * windows + F.col("wx")).alias("win"), "bin").agg(F.sum("_m").alias("_s"))
    norm = F.sqrt(F.sum(F.col("_s") * F.col("_s")).over(Window.partitionBy("img", "win")))
    return sums.select("img", "win", "bin", (F.col("_s") / (norm + F.lit(0.01))).alias("h"))
