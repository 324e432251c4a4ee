import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinelog.operators import blobs, flow, pixels


def mask_of(spark, arrays):
    rows = [(k, int(y), int(x)) for k, a in enumerate(arrays) for y, x in zip(*np.nonzero(a))]
    return spark.createDataFrame(rows, "img int, y long, x long")


def snake(n):
    a = np.zeros((n, n), int)
    for i in range(0, n, 2):
        a[i] = 1
        if i + 1 < n:
            a[i + 1, -1 if i % 4 == 0 else 0] = 1
    return a


def test_snake_is_one_component_and_dots_are_many(spark):
    dots = np.zeros((9, 9), int)
    dots[::2, ::2] = 1
    out = blobs.connected_components(mask_of(spark, [snake(31), dots])).toPandas()
    assert out[out.img == 0].label.nunique() == 1 and len(out[out.img == 0]) == snake(31).sum()
    assert sorted(out[out.img == 1].label) == list(range(1, 26))
    order = out[out.img == 1].sort_values("label")
    assert list(zip(order.y, order.x)) == list(itertools.product(range(0, 9, 2), repeat=2))


def test_random_components(spark):
    a = (np.random.default_rng(2).random((24, 24)) < 0.4).astype(int)
    out = blobs.label_blobs(mask_of(spark, [a])).toPandas()
    seen, groups = np.full(a.shape, -1), 0
    for y, x in zip(*np.nonzero(a)):
        if seen[y, x] < 0:
            stack = [(y, x)]
            while stack:
                p, q = stack.pop()
                if 0 <= p < 24 and 0 <= q < 24 and a[p, q] and seen[p, q] < 0:
                    seen[p, q] = groups
                    stack += [(p + i, q + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            groups += 1
    pairs = {(seen[r.y, r.x], r.root) for r in out.itertuples()}
    assert len(pairs) == groups == out.root.nunique() and len(out) == a.sum()


def test_wide_lines_touch_at_corners_and_across_blocks(spark):
    """Runs longer than a block, gaps of one pixel, corners, repeated pixels."""
    lines = {0: [(0, 300), (302, 310)], 1: [(301, 301), (320, 400)], 3: [(0, 63), (65, 127), (129, 129)], 4: [(64, 64)], 5: [(128, 128)], 6: [(126, 126), (130, 130)]}
    rows = [(1, y, x) for y, runs in lines.items() for a, b in runs for x in range(a, b + 1)]
    mask = spark.createDataFrame(rows + rows[:50], "img long, y long, x long")
    runs = blobs.line_runs(mask.distinct())
    assert sorted((r.y, r.x0, r.x1) for r in runs.collect()) == sorted((y, a, b) for y, own in lines.items() for a, b in own)
    got = blobs.label_blobs(mask)
    assert got.count() == len(rows)
    boxes = sorted((r.y0, r.y1, r.x0, r.x1, r.area) for r in blobs.find_blobs(got).collect())
    assert boxes == sorted([(0, 1, 0, 310, 311), (1, 1, 320, 400, 81), (3, 4, 0, 127, 128), (3, 3, 129, 129, 1), (5, 5, 128, 128, 1),
                            (6, 6, 126, 126, 1), (6, 6, 130, 130, 1)])


def test_no_set_pixel(spark):
    empty = mask_of(spark, [np.eye(2, dtype=int)]).where("y < 0")
    assert blobs.connected_components(empty).count() == 0


def test_nearest_distance(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random((20, 2)) * 9, rng.random((15, 2)) * 9
    da = spark.createDataFrame([(1, float(y), float(x)) for y, x in a], "img int, y double, x double")
    db = spark.createDataFrame([(1, float(y), float(x)) for y, x in b], "img int, y double, x double")
    got = blobs.nearest_distance(da, db).toPandas().sort_values(["y"])
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)).min(1)[np.argsort(a[:, 0])]
    assert np.allclose(got["d"], want)


def test_pair_distances_refuse_what_is_larger_than_the_frame(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 5000, 0)], "img int, y long, x long")
    with pytest.raises(Exception, match="larger than the frame"):
        blobs.pair_distances(df).collect()


def test_two_means_against_every_cut(spark):
    rng = np.random.default_rng(4)
    imgs = [rng.integers(0, 256, 40) for _ in range(6)] + [np.full(9, 7)]
    df = spark.createDataFrame([(k, int(v)) for k, a in enumerate(imgs) for v in a], "img int, v long")
    got = {r.img: (r.low, r.high) for r in pixels.two_means(df).collect()}
    for k, a in enumerate(imgs[:-1]):
        cuts = [(((a[a <= c] - a[a <= c].mean()) ** 2).sum() + ((a[a > c] - a[a > c].mean()) ** 2).sum(), a[a <= c].mean(), a[a > c].mean())
                for c in np.unique(a)[:-1]]
        assert np.allclose(got[k], min(cuts)[1:])
    assert got[6] == (7, 7)


def test_gmm_threshold_splits_two_humps(spark):
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(60, 5, 3000), rng.normal(180, 8, 1000)]).astype(int)
    out = pixels.gmm_threshold(spark.createDataFrame([(1, i, 0, int(x)) for i, x in enumerate(v)], "img int, y long, x long, v long"))
    assert out.where(F.col("above") != (F.col("v") > 120)).count() == 0


def packed(tiles, width, height, page, threshold):
    """Guillotine packing of every tile, as a tree."""
    def node(x, y, w, h):
        return dict(x=x, y=y, w=w, h=h, used=False, kids=None)

    def put(t, w, h):
        if t["kids"]:
            return put(t["kids"][0], w, h) or put(t["kids"][1], w, h)
        if t["used"] or w > t["w"] or h > t["h"]:
            return None
        if (w, h) == (t["w"], t["h"]):
            t["used"] = True
            return t
        if t["w"] - w > t["h"] - h:
            t["kids"] = [node(t["x"], t["y"], w, t["h"]), node(t["x"] + w, t["y"], t["w"] - w, t["h"])]
        else:
            t["kids"] = [node(t["x"], t["y"], t["w"], h), node(t["x"], t["y"] + h, t["w"], t["h"] - h)]
        return put(t["kids"][0], w, h)

    for _ in range(page):
        root, run, placed, left = node(0, 0, width, height), 0, [], []
        for i, (n, w, h) in enumerate(tiles):
            at = put(root, w, h)
            if at is None:
                run += 1
                left.append((n, w, h))
                if run > len(tiles) * threshold:
                    left += tiles[i + 1:]
                    break
            else:
                run = 0
                placed.append((n, at["x"], at["y"], w, h))
        tiles = left
    return sorted(placed)


@pytest.mark.parametrize("page, threshold", [(1, 1.0), (2, 1.0), (3, 1.0), (1, 0.05), (2, 0.1)])
def test_mosaic_is_that_of_packing_every_tile(spark, page, threshold):
    rng = np.random.default_rng(8)
    tiles = [(i, int(w), int(h)) for i, (w, h) in enumerate(rng.integers(1, 18, (400, 2)))] + [(400 + i, 16, 16) for i in range(60)]
    df = spark.createDataFrame([(1, *t) for t in tiles] + [(2, 1, 5, 5)], "bin int, n long, w long, h long")
    got = flow.mosaic_layout(df, 50, 40, page, threshold).where("bin = 1").collect()
    ordered_tiles = sorted(tiles, key=lambda t: (-t[1] * t[2], t[0]))
    assert sorted((r.n, r.x, r.y, r.w, r.h) for r in got) == packed(ordered_tiles, 50, 40, page, threshold)


def test_flow_core_uses_a_stride_on_large_bins(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(1, i, int(a), int(b)) for i, (a, b) in enumerate(rng.normal([500, 300], [40, 90], (2500, 2)))], "bin int, n long, x long, y long")
    r = flow.flow_metrics(df, spark.createDataFrame([(1,), (2,)], "bin int")).orderBy("bin").collect()
    assert 0.3 < r[0].core_aspect < 0.6 and r[1].position == 0
    assert flow.drop_sentinel(df.withColumn("x", F.lit(-999))).count() == 0


def test_box_means_at_borders(spark):
    a = np.arange(36.0).reshape(6, 6)
    df = spark.createDataFrame([(1, y, x, float(a[y, x])) for y in range(6) for x in range(6)], "img int, y long, x long, v double")
    for mirror, mode in ((False, "edge"), (True, "symmetric")):
        got = pixels.uniform_filter(df, 4, 6, 6, mirror=mirror).toPandas().sort_values(["y", "x"])["v"].to_numpy().reshape(6, 6)
        pad = np.pad(a, ((2, 1), (2, 1)), mode=mode)
        want = np.array([[pad[y:y + 4, x:x + 4].mean() for x in range(6)] for y in range(6)])
        assert np.allclose(got, want)


def test_classify_flat_sand(spark):
    rows = [(1, y, x, c, v) for y in range(6) for x in range(6) for c, v in enumerate((150, 160, 170))]
    df = spark.createDataFrame(rows, "img int, y long, x long, c int, v long")
    assert {r["class"] for r in pixels.classify_pixels(df, 6, 6).collect()} == {2}


def test_spot_of_small_bins_is_shuffled_once(spark):
    df = spark.createDataFrame([(b, i, (i * 7) % 31, (i * i) % 17) for b in (1, 2, None) for i in range(40)], "bin int, n long, x long, y long")
    out = flow.flow_camera_spot(df)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(r.bin for r in out.collect()) == [1, 2]


def test_cores_of_many_bins_at_once(spark):
    def alone(xy):
        cov = np.cov(xy) * xy.shape[1] ** (-1 / 3)
        if np.linalg.det(cov) <= 1e-12:
            return None
        white = np.linalg.solve(np.linalg.cholesky(cov), xy)
        density = np.array([np.exp(-0.5 * ((white - white[:, [k]]) ** 2).sum(axis=0)).sum() for k in range(xy.shape[1])])
        core = xy[:, density > np.percentile(density, 10)]
        width, height = np.ptp(core, axis=1) if core.size else (0, 0)
        return float(min(width / height, height / width)) if width > 0 and height > 0 else None

    rng = np.random.default_rng(3)
    for n, high in ((3, 3), (4, 50), (7, 4), (300, 90)):
        xy = rng.integers(0, high, (60 if n < 100 else 3, 2, n)).astype(float)
        got = flow._core_aspects(xy)
        assert [g is None for g in got] == [alone(b) is None for b in xy]
        assert all(a is None or abs(a - g) < 1e-9 for a, g in zip(map(alone, xy), got))
    df = spark.createDataFrame([(b, i, (i * 7 * b) % 31, (i * i) % 17) for b in range(1, 9) for i in range(b)], "bin int, n long, x long, y long")
    got = {r.bin: r.core_aspect for r in flow.flow_core_aspect(df).collect()}
    want = {b: alone(np.array([[(i * 7 * b) % 31 for i in range(b)], [(i * i) % 17 for i in range(b)]], float)) if b > 2 else None for b in range(1, 9)}
    assert got == pytest.approx(want)
