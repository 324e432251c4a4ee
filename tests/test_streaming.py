from datetime import datetime

import pytest
from pyspark.sql import functions as F

from brinelog.operators import products
from brinelog.streaming import flows


def feed_files(spark, folder, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_filesets_complete_over_several_batches(spark, tmp_path):
    batches = [[("a", "hdr"), ("b", "hdr")], [("a", "adc"), ("b", "adc"), ("c", "roi")], [("a", "roi"), ("a", "roi"), ("k", "hdr")], [("b", "roi"), ("a", "hdr")]]
    stream = feed_files(spark, tmp_path / "in", batches, "lid string, ext string")
    bins = spark.createDataFrame([("k",)], "lid string")
    flows.acquire(stream, bins, str(tmp_path / "pending"), str(tmp_path / "complete"), str(tmp_path / "check"))
    assert sorted(r.lid for r in spark.read.parquet(str(tmp_path / "complete")).collect()) == ["a", "b"]


EVENTS = "pid string, ts timestamp_ntz, seq long, state string, event string, message string, ttl int"


def test_product_state_is_folded_over_batches(spark, tmp_path):
    t = [datetime(2020, 1, 1, h) for h in range(6)]
    batches = [[("p", t[0], 1, "running", "start", "m", 60), ("q", t[0], 2, "waiting", None, None, None)],
               [("p", t[2], 3, None, "heartbeat", None, None)], [("p", t[3], 4, "available", None, None, -1), ("q", t[1], 5, "running", None, None, 10)]]
    stream = feed_files(spark, tmp_path / "in", batches, EVENTS)
    flows.product_state(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    got = {r.pid: r for r in flows.current_state(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert (got["p"].state, got["p"].event, got["p"].message, got["p"].ttl, got["p"].expires) == ("available", "heartbeat", "m", None, None)
    assert (got["q"].state, got["q"].expires) == ("running", datetime(2020, 1, 1, 1, 0, 10))
    late = products.expire_ttl(flows.current_state(spark.read.parquet(str(tmp_path / "out"))), datetime(2020, 1, 2)).collect()
    assert {r.pid: r.state for r in late} == {"p": "available", "q": "waiting"}


def test_a_job_can_stop_the_queue(spark, tmp_path):
    schema = "queue string, message string, outcome string"
    stream = feed_files(spark, tmp_path / "in", [[("w", "1", "WIN"), ("w", "2", "DIE")]], schema)
    with pytest.raises(Exception):
        flows.queue_route(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert {r.route for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"w_win", "_die"}


def test_late_rows_and_duplicates(spark, tmp_path):
    schema = "ts_label string, lid string, sample_time timestamp_ntz"
    rows = [[("a", "1", datetime(2020, 1, 1)), ("a", "1", datetime(2020, 1, 1, 0, 1)), ("a", "2", datetime(2020, 1, 1))],
            [("a", "3", datetime(2021, 1, 1)), ("a", "2", datetime(2021, 1, 1))], [("a", "1", datetime(2019, 1, 1)), ("b", "1", None)]]
    stream = feed_files(spark, tmp_path / "in", rows, schema)
    flows.dedup(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted((r.ts_label, r.lid) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", "1"), ("a", "2"), ("a", "3"), ("b", "1")]


def test_seen_keys_cost_a_batch_no_more_than_its_own(spark, tmp_path):
    schema, per_batch = "ts_label string, lid string, sample_time timestamp_ntz", 200
    rows = [[("a" if b % 2 else None, str(k), datetime(2020, 1, 1)) for k in range(b * per_batch - per_batch // 2, (b + 1) * per_batch)] for b in range(20)]
    stream = feed_files(spark, tmp_path / "in", rows, schema)
    query = flows.dedup(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    got = [(r.ts_label, r.lid) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(map(str, got)) == sorted({str((x, k)) for batch in rows for x, k, _ in batch})
    states = [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]]
    assert len(states) == 20 and states[-1]["numRowsTotal"] == len(got)
    looked_up = [s["customMetrics"]["rocksdbGetCount"] for s in states]
    written = [s["customMetrics"]["rocksdbBytesCopied"] for s in states]
    assert max(looked_up) <= 2 * len(rows[0]) and max(written[5:]) <= 2 * max(written[:5]) + 100_000
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")  # set for this flow alone


@pytest.mark.parametrize("slide", [None, "5 minutes"])
def test_late_rows_are_kept(spark, tmp_path, slide):
    schema, at = "k string, ts timestamp_ntz, v long", lambda h, m=0: datetime(2020, 1, 1, h, m)
    batches = [[("a", at(1), 1), ("a", at(1, 5), 2), ("b", at(1, 2), 4)], [("a", at(2), 8), ("b", None, 16)], [("a", at(1, 3), 32), ("b", at(1, 58), None)],
               [("b", at(1, 1), 64), ("b", at(1, 1), 64)], [("b", None, 1)], [("a", at(5), 128), ("a", at(1, 56), 256)]]
    stream = feed_files(spark, tmp_path / "in", batches, schema)
    sums = {"total": F.col("v"), "n": F.lit(1)}
    out = str(tmp_path / "out")
    flows.windowed_with_late(stream, "ts", "10 minutes", sums, out, str(tmp_path / "check"), ["k"], slide)
    rows = spark.createDataFrame([r for b in batches for r in b], schema)
    w = F.window("ts", "10 minutes", slide) if slide else F.window("ts", "10 minutes")
    want = rows.groupBy("k", w.alias("w")).agg(F.sum("v").alias("total"), F.count("*").alias("n")).select("k", "w.start", "total", "n")
    key = lambda df: sorted(map(repr, df.select("k", "start", "total", "n").collect()))
    assert key(flows.all_windows(spark, out, ["k"], ["total", "n"])) == key(want)
    closed = spark.read.parquet(f"{out}/closed")
    assert closed.groupBy("k", "start").count().where("count > 1").isEmpty() and closed.count() > 0
    if slide is None:
        assert sorted((r.k, r.ts, r.v) for r in spark.read.parquet(f"{out}/late").collect()) == [("a", at(1, 3), 32), ("b", at(1, 1), 64), ("b", at(1, 1), 64)]
        assert [(r.k, r.start) for r in spark.read.parquet(f"{out}/open").collect()] == [("a", at(5))]


def test_freshness_and_means_follow_a_stream(spark, tmp_path):
    schema, at = "ts_label string, sample_time timestamp_ntz, v double", lambda h, m=0: datetime(2020, 1, 1, h, m)
    batches = [[("a", at(1), 1.0), ("b", at(2), 2.0)], [("a", at(9), 4.0), ("a", at(9, 30), None), ("b", at(1), 8.0)], [("a", at(1, 30), 16.0), ("c", None, 1.0)]]
    stream = feed_files(spark, tmp_path / "in", batches, schema)
    flows.newest_bins(stream, str(tmp_path / "newest"), str(tmp_path / "check1"))
    fresh = flows.feed_freshness(spark.read.parquet(str(tmp_path / "newest")), at(10)).collect()
    assert {r.ts_label: r.seconds for r in fresh} == {"a": 1800.0, "b": 8 * 3600.0, "c": None}
    means = flows.time_bin_mean(stream, "sample_time", "1 hour", ["v"], str(tmp_path / "means"), str(tmp_path / "check2"), ["ts_label"])
    assert {(r.ts_label, r.bin.hour): r.v for r in means.collect()} == {("a", 1): 8.5, ("a", 9): 4.0, ("b", 2): 2.0, ("b", 1): 8.0}


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_may_be_a_file_or_a_folder(spark, sf_dir, tmp_path, files):
    if files > 1:
        spark.read.parquet(f"{sf_dir}/orders.parquet").repartition(files).write.parquet(str(tmp_path / "orders.parquet"))
        sf_dir = str(tmp_path)
    stream = flows.table_stream(spark, sf_dir, "orders")
    flows.run_once(stream.select("o_orderkey"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_closure_of_a_diamond(spark):
    deps = spark.createDataFrame([("d", "b", "any"), ("d", "c", "any"), ("b", "a", "any"), ("c", "a", "any")], "downstream string, upstream string, role string")
    seeds = spark.createDataFrame([("d",)], "pid string")
    assert sorted(r.pid for r in products.ancestors(deps, seeds).collect()) == ["a", "b", "c"]
    assert products.descendants(deps, seeds).count() == 0
    prods = spark.createDataFrame([("a", "available", 1), ("b", "available", 1), ("c", "running", 1), ("d", "waiting", 1)], "pid string, state string, priority int")
    assert products.next_ready(prods, deps, ["any", "any"]).count() == 0
    assert products.next_ready(prods, deps).first().pid == "d"  # the running upstream is left out, not blocking
    assert [r.pid for r in products.delete_tree(prods, deps, seeds.select(F.lit("b").alias("pid"))).orderBy("pid").collect()] == ["c", "d"]
