from datetime import datetime

import pytest

from brinelog.operators import feed, tags

SCHEMA = "id long, ts_label string, lid string, sample_time timestamp_ntz, skip boolean"


@pytest.fixture(scope="module")
def bins(spark):
    t = [datetime(2020, 1, 1), datetime(2020, 1, 1, 12), datetime(2020, 1, 2), datetime(2020, 1, 2, 6), datetime(2020, 1, 4)]
    return spark.createDataFrame([(i, "a", f"b{i}", x, i == 3) for i, x in enumerate(t)], SCHEMA)


def ids(df):
    return [r.id for r in df.collect()]


def test_midnight_belongs_to_both_days(bins):
    assert ids(feed.day_bins(bins, "a", datetime(2020, 1, 1))) == [0, 1, 2]
    assert ids(feed.day_bins(bins, "a", datetime(2020, 1, 2))) == [2]
    assert ids(feed.day_bins(bins, "a", datetime(2020, 1, 2), include_skip=True)) == [2, 3]
    assert ids(feed.day_bins_parts(bins, "a", datetime(2020, 1, 1))) == [1, 0]


def test_nearest_is_by_absolute_difference(bins):
    assert ids(feed.nearest(bins, "a", datetime(2020, 1, 2, 1), 1)) == [2]
    assert ids(feed.nearest(bins, "a", datetime(2020, 1, 2, 1), 3)) == [2, 1, 0]
    assert ids(feed.nearest(bins, "a", datetime(2020, 1, 2), 2)) == [2, 1]


def test_before_and_after_are_strict(bins):
    assert ids(feed.bins_before(bins, "a", "b2", 5)) == [1, 0]
    assert ids(feed.bins_after(bins, "a", "b2", 5)) == [4]
    assert ids(feed.bins_after(bins, "a", "nowhere", 5)) == []


def test_elapsed_without_bins_has_no_row(bins):
    assert feed.elapsed(bins, "none", datetime(2020, 1, 5)).count() == 0
    assert feed.elapsed(bins, "a", datetime(2020, 1, 5)).first().seconds == 86400


def test_pages(bins):
    pages = [feed.page_query(bins, ["id"], p, 2).orderBy("id").collect() for p in (1, 2, 3, 4)]
    assert [[r.id for r in p] for p in pages] == [[0, 1], [2, 3], [4], []]
    assert [[r.has_next for r in p] for p in pages] == [[True, True], [True, True], [False], []]
    assert feed.page_query(bins, ["id"], 0, 2).count() == 5


def test_volume_counts_thirds_of_files(spark, bins):
    files = spark.createDataFrame([(0, 100)] * 5 + [(1, 50)] * 3, "bin_id long, length long")
    row = feed.daily_data_volume(bins, files, "a", unit=100).collect()
    assert [(str(r.day), str(r.gb), r.bin_count) for r in row] == [("2020-01-01", "6.50", 2)]


def test_total_volume_of_nothing_is_null(spark, bins):
    none = spark.createDataFrame([], "bin_id long, length long")
    assert feed.total_data_volume(bins, none, "a").first().total_bytes is None


def test_tags_and_terms(spark, bins):
    t = spark.createDataFrame([(0, "x", None), (0, "y", None), (1, "x", None), (2, "y", None)], "bin_id long, tag string, ts timestamp_ntz")
    assert ids(feed.tag_semi_join(bins, t, ["x", "y"])) == [0]
    assert ids(feed.tag_semi_join(bins, t, ["x", "x"]).orderBy("id")) == [0, 1]
    added = tags.add_tag(t, spark.createDataFrame([(0, "X!"), (3, "New Tag"), (3, "new tag")], "bin_id long, tag string"))
    assert sorted((r.bin_id, r.tag) for r in added.collect()) == [(0, "x"), (0, "y"), (1, "x"), (2, "y"), (3, "new tag")]
    c = spark.createDataFrame([(1, "Two diatoms were seen."), (2, "a diatom"), (3, "seeing nothing")], "bin_id long, comment string")
    assert {r.bin_id for r in tags.search_comments(c, "the diatoms", key="bin_id").collect()} == {1, 2}
    assert tags.search_comments(c, "the").count() == 0


BINS = "id long, ts_label string, lid string, sample_time timestamp_ntz, skip boolean"


def test_open_bounds_drop_nothing(spark):
    rows = [(1, "a", "x", datetime(2040, 5, 1), False), (2, "a", "y", None, False), (3, "a", "z", datetime(1950, 1, 1), False)]
    bins = spark.createDataFrame(rows, BINS)
    assert feed.total_bins(bins, "a").first().n_bins == 3
    assert [r.id for r in feed.latest(bins, "a", 1).collect()] == [1]
    assert [r.id for r in feed.nearest(bins, "a", datetime(2039, 1, 1), 2).collect()] == [1, 3]


def test_a_day_may_hold_any_volume(spark):
    bins = spark.createDataFrame([(1, "a", "x", datetime(2020, 1, 1), False)], BINS)
    files = spark.createDataFrame([(1, 20_000 * 2**30)] * 3, "bin_id long, length long")
    assert float(feed.daily_data_volume(bins, files, "a").first().gb) == 60_000.0


def test_any_number_of_tags(spark):
    tags = [f"t{i}" for i in range(80)]
    held = spark.createDataFrame([(b, t) for b in (1, 2) for t in tags if (b, t) != (2, "t70")], "bin_id long, tag string")
    assert [r.bin_id for r in feed.having_all_tags(held, tags).collect()] == [1]


def test_the_whole_backlog_is_reported(spark):
    from pyspark.sql import functions as F

    from brinelog.operators import ingest
    bins = spark.range(60_000).select(F.col("id").cast("string").alias("lid"), F.lit(datetime(2020, 1, 1)).alias("sample_time"))
    none = spark.createDataFrame([], "lid string, product string")
    assert ingest.missing_blobs(bins, none).count() == 60_000
    assert ingest.missing_blobs(bins, none, newest=10).count() == 10
