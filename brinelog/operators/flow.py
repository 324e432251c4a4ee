"""Flow metrics of a bin from the places of its targets (``bin, n, x, y``), and mosaics of its images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinelog.operators import ordered
from brinelog.operators.grouped import per_group, per_groups
from brinelog.session import cut_lineage

# Fixed value: the place of a target without an image.
SENTINEL = -999
PAIRS_AT_ONCE = 1 << 16


def drop_sentinel(points: DataFrame) -> DataFrame:
    return points.where((F.col("x") != SENTINEL) & (F.col("y") != SENTINEL))


def index_normalize(rows: DataFrame, keys: list[str], value: str, tie: list[str], slices: Column | None = None,
                    sizes: tuple[int, int] | None = None) -> DataFrame:
    """``i``: 0..1 place in value order; ``s``: value scaled to 0..1. ``slices``, if given, never decreases with the value."""
    one = F.lit(1).cast("bigint")
    ranked = ordered.accumulate(rows, keys, [value, *tie], slices, {"_rn": one},
                                whole={"_lo": ("min", F.col(value)), "_hi": ("max", F.col(value)), "_n": ("sum", one)}, sizes=sizes)
    span = F.col("_hi") - F.col("_lo")
    place = F.when(F.col("_n") > 1, (F.col("_rn") - 1) / (F.col("_n") - 1)).otherwise(0.0)
    scaled = F.when(span > 0, (F.col(value) - F.col("_lo")) / span)
    return ranked.withColumns({"i": place, "s": scaled}).drop("_lo", "_hi", "_n")


def flow_distance_profile(points: DataFrame, slice_pixels: float = 16.0, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Distance of each target to the centre of its bin, sorted and scaled: ``bin, n, d, _rn, i, s``. ``sizes``: ``key_sizes`` of the bins."""
    sizes = sizes or ordered.key_sizes(points, ["bin"])
    rows = ordered.with_group_stats(points, ["bin"], sizes, _cx=F.avg("x"), _cy=F.avg("y"))
    dx, dy = F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy")
    distances = rows.select("bin", "n", F.sqrt(dx * dx + dy * dy).alias("d"))
    return index_normalize(distances, ["bin"], "d", ["n"], F.floor(F.col("d") / slice_pixels), (0, sizes[1]))


def flow_camera_spot(points: DataFrame, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Share of the most frequent distance on either side of the elbow of the profile, the larger one."""
    sizes = sizes or ordered.key_sizes(points, ["bin"])
    profile = flow_distance_profile(points, sizes=sizes).where("bin IS NOT NULL").select(
        "bin", "d", "_rn", (F.col("s") - F.col("i")).alias("_g"))
    # Small bins are dealt once, by the profile; only where a bin is cut is the profile read twice, and written before.
    profile = profile if sizes[1] <= ordered.HOT_ROWS else cut_lineage(profile)
    elbow = ordered.with_group_stats(profile, ["bin"], (0, sizes[1]), _low=F.min(F.struct("_g", "_rn")))
    sides = elbow.withColumn("_side", F.col("_rn") >= F.col("_low._rn"))
    counts = sides.groupBy("bin", "_side", "d").agg(F.count("*").alias("_c"))
    shares = counts.groupBy("bin", "_side").agg((F.max("_c") / F.sum("_c")).alias("_share"))
    return shares.groupBy("bin").agg(F.max("_share").alias("camera_spot"))


def flow_clipping(points: DataFrame, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Percent of targets outside the box that is one percent of the range smaller on each side."""
    box = ordered.with_group_stats(points, ["bin"], sizes, x0=F.min("x"), x1=F.max("x"), y0=F.min("y"), y1=F.max("y"))

    def inside(c: str) -> Column:
        pad = (F.col(f"{c}1") - F.col(f"{c}0")) * 0.01
        return (F.col(c) >= F.col(f"{c}0") + pad) & (F.col(c) <= F.col(f"{c}1") - pad)

    share = F.count_if(inside("x") & inside("y")) / F.count("*")
    return box.groupBy("bin").agg((F.lit(100.0) - F.lit(100.0) * share).alias("clipping"))


def flow_core_aspect(points: DataFrame, sample: int = 1000, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Aspect ratio of the dense core: every k-th target, Gaussian kernel density at the targets, the top nine tenths.

    The stride leaves fewer than ``2 * sample`` targets per bin, which bounds what one task sees.
    """
    one = F.lit(1).cast("bigint")
    numbered = ordered.accumulate(points, ["bin"], ["n"], ordered.block_slice("n"), {"_rn": one}, whole={"_n": ("sum", one)},
                                   sizes=sizes)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / sample))
    chosen = numbered.where((F.col("_rn") - 1) % step == 0)

    def aspects(cuts: list[int], cols: dict) -> list[tuple]:
        first, sizes = np.array(cuts[:-1]), np.diff(cuts)
        x, y = (np.asarray(cols[c], dtype=float) for c in ("x", "y"))
        ratios: list[float | None] = [None] * len(first)
        for n in np.unique(sizes[sizes > 2]).tolist():  # bins of one size at once
            same = np.flatnonzero(sizes == n)
            at_once = max(1, PAIRS_AT_ONCE // n ** 2)
            for k in range(0, len(same), at_once):
                own = same[k:k + at_once]
                place = first[own][:, None] + np.arange(n)
                for bin, ratio in zip(own.tolist(), _core_aspects(np.stack([x[place], y[place]], axis=1))):
                    ratios[bin] = ratio
        return list(zip(cols["bin"][first], ratios))

    schema = f"bin {dict(points.dtypes)['bin']}, core_aspect double"
    return per_groups(chosen.select("bin", "n", "x", "y"), "bin", ["n"], aspects, schema)


def _core_aspects(xy: np.ndarray) -> list[float | None]:
    """Aspect ratio of the dense core of each bin; ``xy`` is bins by two by targets."""
    n, out = xy.shape[2], np.full(len(xy), np.nan)
    off = xy - xy.mean(axis=2, keepdims=True)
    cov = off @ off.transpose(0, 2, 1) * (1 / (n - 1)) * n ** (-1 / 3)
    wide = np.flatnonzero(np.linalg.det(cov) > 1e-12)
    white = np.linalg.solve(np.linalg.cholesky(cov[wide]), xy[wide])
    density, step = np.empty((len(wide), n)), max(1, PAIRS_AT_ONCE // n)
    for k in range(0, n, step):
        pairs = (white[:, 0, None, :] - white[:, 0, k:k + step, None]) ** 2
        pairs += (white[:, 1, None, :] - white[:, 1, k:k + step, None]) ** 2
        pairs *= -0.5
        density[:, k:k + step] = np.exp(pairs, out=pairs).sum(axis=2)
    core = (density > np.percentile(density, 10, axis=1, keepdims=True))[:, None, :]
    sides = np.where(core, xy[wide], -np.inf).max(axis=2) - np.where(core, xy[wide], np.inf).min(axis=2)
    flat = (sides > 0).all(axis=1)
    width, height = sides[flat].T
    out[wide[flat]] = np.minimum(width / height, height / width)
    return [None if np.isnan(r) else r for r in out.tolist()]


def flow_metrics(points: DataFrame, bins: DataFrame | None = None) -> DataFrame:
    """The three metrics and their weighted sum; a bin without targets (in ``bins``) scores 0."""
    # Six passes follow, so the places are written once instead of being derived each time.
    rows = cut_lineage(drop_sentinel(points).select("bin", "n", "x", "y"))
    sizes = ordered.key_sizes(rows, ["bin"])
    out = flow_camera_spot(rows, sizes).join(flow_clipping(rows, sizes), "bin").join(flow_core_aspect(rows, sizes=sizes), "bin")
    # The weights.
    position = F.col("camera_spot") * 10 + F.col("clipping") * 0.5 + F.col("core_aspect") * 2.5
    out = out.withColumn("position", position)
    if bins is None:
        return out
    return bins.select("bin").distinct().join(out.withColumn("_some", F.lit(True)), "bin", "left").withColumn(
        "position", F.when(F.col("_some"), F.col("position")).otherwise(0.0)).drop("_some")


# -- mosaic -----------------------------------------------------------------------------------------------------------

def mosaic_layout(tiles: DataFrame, width: int, height: int, page: int = 1, threshold: float = 1.0) -> DataFrame:
    """Places of the tiles (``bin, n, w, h``) on one page of a mosaic, largest area first.

    A page holds at most page area / tile area tiles of one size, so later tiles of that size can never be placed on
    the asked page or before it and stay out of the grouped step; they still count as misses. This keeps a group below
    a bound set by the page alone, and the result is that of packing every tile.
    """
    one = F.lit(1).cast("bigint")
    sized = tiles.withColumn("_down", -F.col("w") * F.col("h"))
    sizes = ordered.key_sizes(tiles, ["bin"])
    ranked = ordered.accumulate(sized, ["bin"], ["_down", "n"], ordered.block_slice("_down", 256), {"_rank": one},
                                whole={"_total": ("sum", one)}, sizes=sizes)
    per_size = ordered.number_rows(ranked, ["bin", "w", "h"], ["n"], ordered.block_slice("n"), out="_k", sizes=(0, sizes[1]))
    able = per_size.where((F.col("w") <= width) & (F.col("h") <= height) & (F.col("w") > 0) & (F.col("h") > 0) &
                          (F.col("_k") <= F.floor(F.lit(page * width * height) / (F.col("w") * F.col("h")))))

    def pack(bin: object, cols: dict) -> list[tuple]:
        todo = list(zip(*(cols[c].tolist() for c in ("n", "w", "h", "_rank"))))
        total, gone = int(cols["_total"][0]), []
        placed: list = []
        for _ in range(page):
            free, placed, left, last = [(0, 0, width, height)], [], [], 0
            limit, stopped = (total - len(gone)) * threshold, False
            for tile in todo:
                n, w, h, rank = tile
                place = rank - sum(g < rank for g in gone) if gone else rank
                if stopped or place - 1 - last > limit:
                    stopped = True
                    left.append(tile)
                    continue
                for at, (x, y, fw, fh) in enumerate(free):
                    if w <= fw and h <= fh:
                        side, below = (x + w, y, fw - w, fh), (x, y + h, w, fh - h)
                        if fw - w <= fh - h:
                            side, below = (x + w, y, fw - w, h), (x, y + h, fw, fh - h)
                            rest = [side, below]
                        else:
                            rest = [below, side]
                        free[at:at + 1] = [r for r in rest if r[2] > 0 and r[3] > 0]
                        placed.append((n, x, y, w, h, rank))
                        last = place
                        break
                else:
                    left.append(tile)
            gone += [p[5] for p in placed]
            todo = left
        return [(bin, *p[:5]) for p in placed]

    types = dict(tiles.dtypes)
    schema = f"bin {types['bin']}, n {types['n']}, x long, y long, w long, h long"
    return per_group(able, "bin", ["_rank"], pack, schema)


def mosaic_scaled(layout: DataFrame, pid: Column, scale: float) -> DataFrame:
    return layout.select(pid.alias("pid"), *[(F.col(a) * scale).cast("int").alias(b) for a, b in
                                             (("x", "x"), ("y", "y"), ("w", "width"), ("h", "height"))])
