"""Registered streaming queries: each runs a stream over the given tables to its end and reads the result back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from brinelog.operators import ingest
from brinelog.plans.product_queries import PROV, SC, SCOLS, FOLD, _runs
from brinelog.operators import products
from brinelog.plans.registry import query
from brinelog.streaming import flows


def _stream(t, name):
    return flows.table_stream(t.spark, t.sf_dir, name)


def _finished(t, stream, name):
    out, checkpoint = flows.scratch(t.spark, name)
    flows.run_once(stream, out, checkpoint)
    return t.spark.read.parquet(out)


@query("stream_acquire", "SELECT 'O' || bin_id AS lid FROM files GROUP BY bin_id HAVING count(DISTINCT filetype % 3) = 3 "
       "AND bin_id NOT IN (SELECT p_partkey FROM part)")
def _(t):
    ext = F.element_at(F.array(F.lit("hdr"), F.lit("adc"), F.lit("roi")), F.col("l_linenumber") % 3 + 1)
    arrivals = _stream(t, "lineitem").select(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("lid"), ext.alias("ext"))
    out, checkpoint = flows.scratch(t.spark, "acquire")
    known = t.part.select(F.concat(F.lit("O"), F.col("p_partkey").cast("string")).alias("lid"))
    flows.acquire(arrivals, known, f"{out}/pending", f"{out}/complete", checkpoint)
    return t.spark.read.parquet(f"{out}/complete").select("lid")


@query("stream_accession", """SELECT 'O' || o_orderkey AS lid, CASE WHEN o_orderkey IN (SELECT p_partkey FROM part) THEN 'EXISTS' WHEN o_totalprice > 100000
  THEN 'ADDED' ELSE 'FAILED' END AS status FROM orders""")
def _(t):
    lid = F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("lid")
    known = t.part.select(F.concat(F.lit("O"), F.col("p_partkey").cast("string")).alias("lid"))

    def register(batch):
        checks = batch.select("lid", (F.col("o_totalprice") > 100000).alias("ok"))
        return ingest.accession_status(batch.select("lid"), known, checks)

    out, checkpoint = flows.scratch(t.spark, "accession")
    flows.accession(_stream(t, "orders").select(lid, "o_totalprice"), register, out, checkpoint)
    return t.spark.read.parquet(out).select("lid", "status")


@query("stream_dedup", "SELECT DISTINCT event_type AS ts_label, 'u' || user_id AS lid FROM events")
def _(t):
    rows = _stream(t, "events").select(F.col("event_type").alias("ts_label"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("lid"),
                                       F.col("ts").alias("sample_time"))
    out, checkpoint = flows.scratch(t.spark, "dedup")
    flows.dedup(rows, out, checkpoint)
    return t.spark.read.parquet(out).select("ts_label", "lid")


def _all_windows(t, name, every, sums, slide=None):
    out, checkpoint = flows.scratch(t.spark, name)
    flows.windowed_with_late(_stream(t, "events"), "ts", every, sums, out, checkpoint, ["event_type"], slide)
    return flows.all_windows(t.spark, out, ["event_type"], list(sums))


@query("tenmin_window_late", "SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts) AS start, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def _(t):
    return _all_windows(t, "tenmin-late", "10 minutes", {"n": F.lit(1)})


@query("metric_windows_late", """, w AS (SELECT event_type, k, time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * unnest([0, 1, 2, 3])) AS start FROM event_k)
SELECT event_type, start, CAST(sum(k) AS BIGINT) AS total, count(*) AS n FROM w GROUP BY 1, 2""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return _all_windows(t, "metric-late", "1 day", {"total": k, "n": F.lit(1)}, "6 hours")


@query("tenmin_window", """SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2
  HAVING time_bucket(INTERVAL 10 MINUTE, any_value(ts)) + INTERVAL 20 MINUTE <= (SELECT max(ts) FROM events)""")
def _(t):
    return _finished(t, flows.tenmin_window(_stream(t, "events"), "ts", ["event_type"]), "tenmin")


@query("metric_windows", """, w AS (SELECT event_type, k, time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * unnest([0, 1, 2, 3])) AS start FROM event_k)
SELECT event_type, start, CAST(sum(k) AS BIGINT) AS total, count(*) AS n FROM w GROUP BY 1, 2 HAVING start + INTERVAL 24 HOUR + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM events)""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return _finished(t, flows.metric_windows(_stream(t, "events"), "ts", k, ["event_type"]), "metric")


def _streamed(t, name):
    """The bindings of ``t`` with one table read as a stream."""
    twin, stream = type(t)(t.spark, t.sf_dir), _stream(t, name)
    twin.read = lambda asked: stream if asked == name else t.read(asked)
    return twin


@query("stream_feed_freshness", """SELECT ts_label, max(sample_time) AS latest, (epoch_us(TIMESTAMP '2024-02-01') -
  epoch_us(max(sample_time))) / 1000000.0 AS seconds FROM bins GROUP BY 1""")
def _(t):
    out, checkpoint = flows.scratch(t.spark, "freshness")
    flows.newest_bins(_streamed(t, "events").bins.select("ts_label", "sample_time"), out, checkpoint)
    return flows.feed_freshness(t.spark.read.parquet(out), datetime(2024, 2, 1))


@query("stream_time_bin_mean", "SELECT instrument, time_bucket(INTERVAL 1 HOUR, sample_time) AS bin, avg(triggers) AS triggers FROM bins GROUP BY 1, 2")
def _(t):
    out, checkpoint = flows.scratch(t.spark, "bin-mean")
    bins = _streamed(t, "events").bins.select("instrument", "sample_time", "triggers")
    return flows.time_bin_mean(bins, "sample_time", "1 hour", ["triggers"], out, checkpoint, ["instrument"])


@query("stream_product_state", FOLD + f"SELECT {SC} FROM state")
def _(t):
    stream = _stream(t, "events")
    twin = type(t)(t.spark, t.sf_dir)
    twin.read = lambda name: stream if name == "events" else t.read(name)
    out, checkpoint = flows.scratch(t.spark, "state")
    flows.product_state(twin.product_events, out, checkpoint)
    return flows.current_state(t.spark.read.parquet(out)).select(*SCOLS)


def _messages(rows):
    outcome = F.element_at(F.array(F.lit("PASS"), F.lit("WIN"), F.lit("FAIL"), F.lit("SKIP"), F.lit(None)), (F.col("conv_id") % 5 + 1).cast("int"))
    return rows.select("conv_id", "turn", F.col("role").alias("queue"), F.col("text").alias("message"), outcome.alias("outcome"))


@query("queue_route", """SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN role WHEN 2 THEN role || '_fail' ELSE role || '_win' END AS route FROM conversations
  WHERE conv_id % 5 <> 3""")
def _(t):
    out, checkpoint = flows.scratch(t.spark, "route")
    flows.queue_route(_messages(_stream(t, "conversations")), out, checkpoint)
    return t.spark.read.parquet(out).select("conv_id", "turn", "route")


@query("queue_retry", "SELECT conv_id, turn, 'work' AS queue FROM conversations WHERE conv_id % 5 = 2 AND length(text) > 100")
def _(t):
    failed = _messages(_stream(t, "conversations")).where("outcome = 'FAIL'")
    return _finished(t, flows.requeue(failed, "work", F.length("message") > 100), "retry").select("conv_id", "turn", "queue")


@query("queue_trigger", "SELECT conv_id, turn, 'next' AS queue FROM conversations WHERE conv_id % 5 = 1 AND role = 'user'")
def _(t):
    won = _messages(_stream(t, "conversations")).where("outcome = 'WIN'")
    return _finished(t, flows.requeue(won, "next", F.col("queue") == "user"), "trigger").select("conv_id", "turn", "queue")


@query("pass_filter", r"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '\A[^\n]*the') THEN 'PASS' ELSE 'WIN' END AS outcome FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", flows.pass_filter(F.col("text"), "the").alias("outcome"))


@query("queue_health", """, q AS (SELECT n_name AS queue, CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END AS consumers, s_suppkey % 30 AS ready FROM supplier JOIN nation
  ON n_nationkey = s_nationkey), a AS (SELECT queue, sum(consumers)::BIGINT AS consumers, sum(ready)::BIGINT AS ready FROM q GROUP BY 1)
SELECT *, CASE WHEN consumers > 0 THEN ready / consumers END AS per_consumer, CASE WHEN consumers = 0 AND ready = 0 THEN 'WARNING' WHEN consumers = 0 THEN 'CRITICAL'
  WHEN ready / consumers >= 30 THEN 'CRITICAL' WHEN ready / consumers >= 15 THEN 'WARNING' ELSE 'OK' END AS level FROM a""")
def _(t):
    q = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("n_name").alias("queue"), F.when(F.col("s_acctbal") > 5000, 1).otherwise(0).alias("consumers"), (F.col("s_suppkey") % 30).alias("ready"))
    return flows.queue_health(q, 15, 30)


@query("provenance_append", f"SELECT process_id, algorithm_id, direction, no_earlier_than, no_later_than, fixity_md5, fixity_length, replace(replace(pathname, '/in/', ''), '/out/', '') "
       f"AS imagename FROM ({PROV})")
def _(t):
    twin = type(t)(t.spark, t.sf_dir)
    stream = _stream(t, "documents")
    twin.read = lambda name: stream if name == "documents" else t.read(name)
    records = products.provenance_records(_runs(twin))
    messages = records.select(F.to_json(F.struct(*records.columns)).alias("message"))
    return _finished(t, flows.provenance_append(messages), "provenance")
