"""Sequence operators with a hot key, many slices, null keys and null order values, against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brinelog.operators import annotations, ordered, tracks


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    n = 3000
    key = np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abcdef"), n)).astype(object)
    key[rng.random(n) < 0.05] = None
    value = rng.integers(0, 50, n).astype(float)
    value[rng.random(n) < 0.4] = np.nan
    return pd.DataFrame({"k": key, "at": rng.permutation(n), "v": value})


@pytest.fixture(scope="module")
def df(spark, rows):
    data = [(k, int(a), None if np.isnan(v) else float(v)) for k, a, v in rows.itertuples(index=False)]
    return spark.createDataFrame(data, "k string, at long, v double").repartition(7)


def by_place(df, *cols):
    return df.select("at", *cols).toPandas().set_index("at").sort_index()


def expected(rows):
    return rows.fillna({"k": "(null)"}).sort_values("at")


@pytest.mark.parametrize("limit", [100, 700, 1 << 17])
@pytest.mark.parametrize("sliced", [True, False])
def test_accumulate_with_hot_and_small_keys(df, rows, limit, sliced, monkeypatch):
    """All keys cut, only the hot one cut, none cut: the same sums and facts."""
    monkeypatch.setattr(ordered, "HOT_ROWS", limit)
    out = ordered.accumulate(df, ["k"], ["at"], ordered.block_slice("at", 100) if sliced else None, {"up": F.lit(2), "below": F.col("at")}, ["below"],
                             {"lo": ("min", F.col("at")), "n": ("sum", F.lit(1))})
    assert out.columns == ["k", "at", "v", "up", "below", "lo", "n"]
    got = by_place(out, "up", "below", "lo", "n")
    by = expected(rows).set_index("at", drop=False).groupby("k")["at"]
    assert (got["up"] == 2 * (by.cumcount() + 1)).all() and (got["below"] == by.cumsum() - by.transform(lambda a: a)).all()
    assert (got["lo"] == by.transform("min")).all() and (got["n"] == by.transform("size")).all() and len(got) == len(rows)


def test_small_keys_are_shuffled_once(spark):
    """No table of slices, as long as the rows, is made and joined where no key is hot."""
    many = spark.range(2000).selectExpr("id % 900 AS k", "id AS at")
    out = ordered.accumulate(many, ["k"], ["at"], F.col("at"), {"rn": F.lit(1)}, whole={"n": ("sum", F.lit(1))})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and out.where("rn = n").count() == 900


def test_number_rows(df, rows):
    got = by_place(ordered.number_rows(df, ["k"], ["at"], ordered.block_slice("at", 100)), "rn")["rn"]
    want = expected(rows).set_index("at").groupby("k").cumcount() + 1
    assert (got == want.sort_index()).all() and len(got) == len(rows)


def test_number_rows_without_key(df, rows):
    got = by_place(ordered.number_rows(df, [], ["at"], ordered.block_slice("at", 100)), "rn")["rn"]
    assert got.tolist() == list(range(1, len(rows) + 1))


def test_running_sum_and_whole(df, rows):
    out = ordered.accumulate(df, ["k"], ["at"], ordered.block_slice("at", 64), {"s": F.coalesce("v", F.lit(0.0)), "before": F.lit(1)},
                             ["before"], {"top": ("max", F.col("v")), "n": ("sum", F.lit(1))})
    got = by_place(out, "s", "before", "top", "n")
    w = expected(rows).set_index("at")
    g = w.fillna({"v": 0}).groupby("k")["v"]
    assert np.allclose(got["s"], g.cumsum().sort_index())
    assert (got["before"] == w.groupby("k").cumcount().sort_index()).all()
    assert np.allclose(got["top"], w.groupby("k")["v"].transform("max").sort_index())
    assert (got["n"] == w.groupby("k")["v"].transform("size").sort_index()).all()


def test_neighbours(df, rows):
    out = ordered.neighbours(df, ["k"], ["at"], ordered.block_slice("at", 50), prev={"at": "p", "v": "pv"}, next={"at": "q"})
    got = by_place(out, "p", "pv", "q")
    w = expected(rows).set_index("at", drop=False)
    g = w.groupby("k")
    for col, want in (("p", g["at"].shift(1)), ("pv", g["v"].shift(1)), ("q", g["at"].shift(-1))):
        assert np.allclose(got[col].astype(float), want.sort_index().astype(float), equal_nan=True)


def test_fill_forward(df, rows):
    got = by_place(ordered.fill_forward(df, ["k"], ["at"], ordered.block_slice("at", 80), ["v"]), "v")["v"]
    want = expected(rows).set_index("at").groupby("k")["v"].ffill()
    assert np.allclose(got.astype(float), want.sort_index(), equal_nan=True)


def test_null_order_values_are_kept(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 900, 3)], "k string, at long, v int")
    got = ordered.number_rows(df, ["k"], ["at"], ordered.block_slice("at", 100)).orderBy("v").collect()
    assert [r.rn for r in got] == [1, 2, 3]


def test_empty_input(df):
    empty = df.where("at < 0")
    s = ordered.block_slice("at")
    assert ordered.number_rows(empty, ["k"], ["at"], s).count() == 0
    assert ordered.neighbours(empty, ["k"], ["at"], s, prev={"v": "p"}).count() == 0
    assert ordered.fill_forward(empty, ["k"], ["at"], s, ["v"]).count() == 0


def test_spines_over_many_blocks(spark):
    scores = spark.createDataFrame([(0, [0.9, 0.1]), (5000, [0.1, 0.9]), (3 * annotations.ROIS_PER_ARRAY, [0.2, 0.1])], "roi int, scores array<double>")
    got = annotations.class_numbers(scores, 0.5)
    assert got.count() == 3 * annotations.ROIS_PER_ARRAY + 1 == got.select("roi").distinct().count()
    assert {r.roi: r.class_number for r in got.where("class_number <> 0").collect()} == {5000: 1, 3 * annotations.ROIS_PER_ARRAY: -1}
    assert annotations.class_numbers(scores.limit(0)).count() == 0
    steps = 2 * tracks.SPINE_BLOCK
    fixes = spark.range(2).selectExpr(f"timestamp_seconds(id * {steps} * 10) AS ts", "double(id) AS v", "'a' AS k")
    filled = tracks.time_bin_mean(fixes, "ts", "10 seconds", ["v"], ["k"], fill=True)
    assert filled.count() == filled.select("bin").distinct().count() == steps + 1 and filled.where("v IS NOT NULL").count() == 2


def test_ranges_split_one_key_one_hour_and_one_prefix(spark):
    """A single key whose rows lie in one hour and share a long prefix: even ranges, right numbers."""
    rows = spark.range(20_000).select(
        F.lit("one").alias("k"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1000).cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("the-same-long-prefix-"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("path"), "id").repartition(5)
    for order in (["ts"], ["path"], ["id"]):
        sizes = [r["count"] for r in rows.groupBy(ordered.range_slice(rows, ["k"], order, ranges=16)).count().collect()]
        assert len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16
        got = ordered.number_rows(rows, ["k"], order, out="n")
        assert got.where(F.col("n") != F.col("id") + 1).count() == 0
    hot = ordered.neighbours(rows, ["k"], ["path"], next={"id": "after"})
    assert hot.where("after <> id + 1 OR after IS NULL AND id < 19999").count() == 0


def test_ranges_follow_nulls_and_mixed_keys(df, rows, spark):
    for keys, order in ((["k"], ["at"]), ([], ["k", "at"]), (["k"], ["v", "at"])):
        number = ordered.range_slice(df, keys, order, ranges=12)
        placed = df.withColumn("r", number).orderBy(*keys, *order).toPandas()["r"]
        assert placed.is_monotonic_increasing and placed.nunique() == 12
    got = by_place(ordered.number_rows(df, ["k"], ["at"], out="n"), "n")["n"]
    want = expected(rows).set_index("at").groupby("k").cumcount() + 1
    assert (got == want.sort_index()).all()
    kinds = spark.range(300).selectExpr("date_add(DATE'2020-01-01', int(id / 3)) AS d", "decimal(id) AS m", "timestamp_seconds(id * 7) AS z",
                                        "binary(string(id)) AS b", "id")
    for order in (["d", "m"], ["z"], ["b"]):
        placed = kinds.withColumn("r", ordered.range_slice(kinds, [], order, ranges=7)).orderBy(*order).toPandas()["r"]
        assert placed.is_monotonic_increasing and placed.nunique() == 7
    assert ordered.number_rows(df.where("at < 0"), ["k"], ["at"]).count() == 0


def test_rows_are_spread_by_their_number(spark, monkeypatch):
    """Tasks get a bounded number of rows, whatever the number of shuffle partitions; steps by the same keys shuffle no more."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(ordered, "RANGE_ROWS", 10)
    rows = spark.range(1000).selectExpr("id % 300 AS k", "id AS v")
    assert ordered.spread(rows, ["k"], 10 * parts).rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    dealt = ordered.spread(rows, ["k"], 1000)
    assert dealt.rdd.getNumPartitions() == 100
    stats = ordered.with_group_stats(rows, ["k"], ordered.key_sizes(rows, ["k"]), lo=F.min("v"))
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and stats.where("lo = v").count() == 300


def test_more_rows_than_a_task_should_have_are_never_joined_again(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 10)
    rows = spark.range(1000).selectExpr("id % 300 AS k", "id AS v")
    assert "REPARTITION_BY_NUM" in ordered.spread(rows, ["k"], 11)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in ordered.spread(rows, ["k"], 10)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ranges", [2, 3, 4, 5, 8, 9, 33])
def test_ranges_are_found_by_halving(spark, ranges):
    rows = spark.range(0, 4000, 1, 3).selectExpr("id % 7 AS k", "IF(id % 11 = 0, NULL, id) AS v")
    number = ordered.range_slice(rows, ["k"], ["v"], ranges=ranges)
    assert "filter(" not in str(number)
    placed = rows.withColumn("r", number).orderBy("k", "v").toPandas()["r"]
    assert placed.is_monotonic_increasing and placed.iat[0] == 0 and placed.nunique() == ranges and placed.max() == ranges - 1


def test_scores_of_a_bin_are_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 10)
    long = spark.range(600).selectExpr("concat('b', id % 90) AS bin_lid", "concat('c', id % 2) AS class_label", "id AS roi", "id / 7 AS score")
    stored = annotations.scores_to_arrays(long)
    assert stored._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert "REPARTITION_BY_NUM" in stored._jdf.queryExecution().executedPlan().toString()
    assert stored.selectExpr("sum(size(roinums))").first()[0] == 600 and stored.count() == 90
    monkeypatch.setattr(ordered, "HOT_ROWS", 3)
    assert sorted(map(str, annotations.scores_to_arrays(long).collect())) == sorted(map(str, stored.collect()))
