"""Structured Streaming forms: file sources in, Parquet tables out, checkpoints in the shared folder.

Each flow takes a streaming (or, where noted, a batch) DataFrame; ``run_once`` drives one to the end of its input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brinelog.functions.times import instant, seconds_between
from brinelog.operators import files, products
from brinelog.session import scratch_path

# Outcomes of a job.
PASS, WIN, FAIL, SKIP, DIE = "PASS", "WIN", "FAIL", "SKIP", "DIE"


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table as a stream of new files, whether it is a single file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # as a pattern, the path may be a file; without one, the source takes folders only
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def run_once(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> StreamingQuery:
    """Append all available input to a Parquet table, exactly once per input file; the finished query has the progress of its batches."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB on the executors' disks; a batch reads its own keys and checkpoints its own changes."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    writer = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def _batch_path(path: str, batch: int) -> str:
    """One folder per micro-batch: a batch that runs again overwrites its own output only."""
    return f"{path}/batch={batch}"


# -- acquisition and accession ----------------------------------------------------------------------------------------

def acquire(arrivals: DataFrame, bins: DataFrame, pending: str, complete: str, checkpoint: str) -> None:
    """Arriving files (``lid, ext``) to filesets that became complete.

    Files of unfinished filesets are kept as a table per micro-batch, not as operator state, so an instrument may take any
    time; each batch reads only what the batch before left open. Filesets that are bins already are ignored.
    """
    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("lid", "ext")
        if number > 0:
            rows = rows.unionByName(spark.read.schema("lid string, ext string").parquet(_batch_path(pending, number - 1)))
        state, full = _batch_path(pending, number), _batch_path(complete, number)
        fresh = rows.join(bins.select("lid"), "lid", "left_anti").distinct()
        files.fileset_complete(fresh).where("complete").select("lid").write.mode("overwrite").parquet(full)
        done = spark.read.schema("lid string").parquet(full)
        fresh.join(done, "lid", "left_anti").write.mode("overwrite").parquet(state)

    run_batches(arrivals, each, checkpoint)


def accession(filesets: DataFrame, register: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Run the batch accession operators on every micro-batch of filesets and keep their statuses."""
    def each(batch: DataFrame, number: int) -> None:
        register(batch).write.mode("overwrite").parquet(_batch_path(out, number))

    run_batches(filesets, each, checkpoint)


def dedup(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the first row of each (label, lid), however late another one comes; a missing label or lid is a value like any other.

    The state holds every key once, so it grows with the keys; a batch looks up its own keys only. The number of state partitions is
    ``spark.sql.shuffle.partitions`` of the first start.
    """
    with keyed_state(stream.sparkSession):
        return run_once(stream.dropDuplicates(["ts_label", "lid"]), out, checkpoint)


# -- windows ----------------------------------------------------------------------------------------------------------

def windowed(stream: DataFrame, time: str, every: str, aggs: list[Column], keys: list[str] = [], slide: str | None = None,
             late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding windows; closed windows only, since late rows may change open ones."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    w = F.window(time, every, slide) if slide else F.window(time, every)
    return timed.groupBy(*keys, w).agg(*aggs).select(
        F.col("window.start").cast("timestamp_ntz").alias("start"), "*").drop("window")


def tenmin_window(stream: DataFrame, time: str, keys: list[str] = []) -> DataFrame:
    return windowed(stream, time, "10 minutes", [F.count("*").alias("n")], keys)


def metric_windows(stream: DataFrame, time: str, metric: Column, keys: list[str], every: str = "1 day", slide: str = "6 hours") -> DataFrame:
    return windowed(stream, time, every, [F.sum(metric).alias("total"), F.count("*").alias("n")], keys, slide)


def windowed_with_late(stream: DataFrame, time: str, every: str, sums: Mapping[str, Column], out: str, checkpoint: str,
                       keys: list[str] = [], slide: str | None = None, late: str = "10 minutes") -> None:
    """Window sums with two outputs: ``out/closed`` has each closed window once, ``out/late`` the rows that came after one was closed.

    A window closes once the latest time seen passed its end by ``late``. A row of ``late`` has the columns of the stream, the ``start`` of
    the window it missed and its terms of the sums; with sliding windows it may miss some and reach others. Windows that are still open
    are a table per micro-batch, read by the next one only. Rows without a time are in no window.
    """
    wait = F.expr(f"INTERVAL {late}")
    shape = [*keys, "start", "end"]

    def each(batch: DataFrame, number: int) -> None:
        read = batch.sparkSession.read
        put = lambda rows, part: rows.write.mode("overwrite").parquet(_batch_path(f"{out}/{part}", number))
        before = {part: read.parquet(_batch_path(f"{out}/{part}", number - 1)) for part in ("state", "seen")} if number else {}
        seen = before["seen"].agg(F.max("seen")).scalar() if number else F.lit(None).cast(batch.schema[time].dataType)
        w = F.window(time, every, slide) if slide else F.window(time, every)
        rows = batch.withColumns(dict(sums)).withColumn("_w", w).withColumns(
            {"start": F.col("_w.start"), "end": F.col("_w.end")}).drop("_w")
        missed = F.coalesce(F.col("end") <= seen - wait, F.lit(False))
        put(rows.where(missed).drop("end"), "late")
        fresh = rows.where(~missed).groupBy(*shape).agg(*[F.sum(c).alias(c) for c in sums], F.max(time).alias("_last"))
        if number:
            both = fresh.unionByName(before["state"].where(~missed))
            merged = both.groupBy(*shape).agg(*[F.sum(c).alias(c) for c in sums], F.max("_last").alias("_last"))
            fresh = merged.select([F.col(f.name).cast(f.dataType) for f in fresh.schema])
        put(fresh, "state")
        state = read.parquet(_batch_path(f"{out}/state", number))
        put(state.agg(F.greatest(F.max("_last"), seen).alias("seen")), "seen")
        seen = read.parquet(_batch_path(f"{out}/seen", number)).agg(F.max("seen")).scalar()
        closes = F.coalesce(F.col("end") <= seen - wait, F.lit(False))
        put(state.where(closes).drop("end", "_last"), "closed")
        state.where(~closes).drop("end", "_last").write.mode("overwrite").parquet(f"{out}/open")

    run_batches(stream, each, checkpoint)


def all_windows(spark: SparkSession, out: str, keys: list[str], sums: list[str]) -> DataFrame:
    """Closed and open windows of ``windowed_with_late``, with the late rows added to the windows they missed."""
    closed, still_open, late = (spark.read.parquet(f"{out}/{part}").select(*keys, "start", *sums) for part in ("closed", "open", "late"))
    return closed.unionByName(still_open).unionByName(late).groupBy(*keys, "start").agg(*[F.sum(c).alias(c) for c in sums])


def feed_freshness(bins: DataFrame, now: datetime) -> DataFrame:
    """Seconds since the latest bin of each series; the same aggregate runs on a stream in complete mode."""
    newest = bins.groupBy("ts_label").agg(F.max("sample_time").alias("latest"))
    return newest.withColumn("seconds", seconds_between(instant(now), F.col("latest")))


def newest_bins(bins: DataFrame, out: str, checkpoint: str) -> None:
    """``ts_label, sample_time`` of the latest bin of each series of a stream, kept current at ``out``; the input of ``feed_freshness``."""
    newest = bins.groupBy("ts_label").agg(F.max("sample_time").alias("sample_time"))
    with keyed_state(bins.sparkSession):
        run_batches(newest, lambda batch, number: batch.write.mode("overwrite").parquet(out), checkpoint, "complete")


def time_bin_mean(track: DataFrame, time: str, every: str, cols: list[str], out: str, checkpoint: str, keys: list[str] = []) -> DataFrame:
    """Mean per fixed time bin (start in ``bin``) of a stream, late rows included; sums and counts are kept, so a bin may change."""
    sums = {f"_sum_{c}": F.col(c) for c in cols} | {f"_n_{c}": F.col(c).isNotNull().cast("long") for c in cols}
    windowed_with_late(track, time, every, sums, out, checkpoint, keys)
    mean = [F.try_divide(f"_sum_{c}", f"_n_{c}").alias(c) for c in cols]
    return all_windows(track.sparkSession, out, keys, list(sums)).select(*keys, F.col("start").alias("bin"), *mean)


# -- product states ---------------------------------------------------------------------------------------------------

def product_state(events: DataFrame, changes: str, checkpoint: str) -> None:
    """Fold product events; every micro-batch writes the rows it changed."""
    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_path(changes, number))

    run_batches(products.fold_events(events), each, checkpoint, "update")


def current_state(changes: DataFrame) -> DataFrame:
    """Newest change of each product."""
    rest = [c for c in changes.columns if c not in ("pid", "batch")]
    return changes.groupBy("pid").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("pid", "r.*")


# -- queues -----------------------------------------------------------------------------------------------------------

def pass_filter(message: Column, verboten: str) -> Column:
    """PASS when the first line of the message has the pattern, else WIN."""
    return F.when(message.rlike(rf"^[^\n]*{verboten}"), PASS).otherwise(WIN)


def routed(messages: DataFrame) -> DataFrame:
    """``route`` of messages with ``queue, outcome``: PASS goes back, WIN and FAIL to their own queues, SKIP is dropped.

    A missing outcome counts as a win; an unknown one, like an exception, as a failure.
    """
    outcome = F.coalesce("outcome", F.lit(WIN))
    route = (F.when(outcome == PASS, F.col("queue")).when(outcome == WIN, F.concat("queue", F.lit("_win")))
             .when(outcome == DIE, F.lit("_die")).otherwise(F.concat("queue", F.lit("_fail"))))
    return messages.where(outcome != SKIP).withColumn("route", route)


def queue_route(messages: DataFrame, out: str, checkpoint: str) -> None:
    """Route every micro-batch in one write, partitioned by target queue; a DIE stops the flow after its batch."""
    def each(batch: DataFrame, number: int) -> None:
        routed(batch).write.mode("overwrite").partitionBy("route").parquet(_batch_path(out, number))
        spark = batch.sparkSession
        done = spark.read.parquet(_batch_path(out, number))
        if "route" in done.columns and not done.where("route = '_die'").isEmpty():
            raise RuntimeError("a job asked to stop")

    run_batches(messages, each, checkpoint)


def requeue(queue: DataFrame, to: str, keep: Column) -> DataFrame:
    """Messages that pass a filter go to another queue (retry of failures, or a trigger on wins)."""
    return queue.where(keep).withColumn("queue", F.lit(to))


def queue_health(queues: DataFrame, warning: float, critical: float) -> DataFrame:
    """``queue, consumers, ready`` to a level: messages per consumer against two limits."""
    totals = queues.groupBy("queue").agg(F.sum("consumers").alias("consumers"), F.sum("ready").alias("ready"))
    load = F.col("ready") / F.col("consumers")
    level = (F.when((F.col("consumers") == 0) & (F.col("ready") == 0), "WARNING").when(F.col("consumers") == 0, "CRITICAL")
             .when(load >= critical, "CRITICAL").when(load >= warning, "WARNING").otherwise("OK"))
    return totals.withColumns({"per_consumer": F.when(F.col("consumers") > 0, load), "level": level})


PROVENANCE_SCHEMA = ("process_id string, algorithm_id string, direction string, pathname string, no_earlier_than string, "
                     "no_later_than string, fixity_md5 string, fixity_length long")


def provenance_append(messages: DataFrame, col: str = "message") -> DataFrame:
    """JSON messages to table rows; the image name is the last part of the path. Text that does not parse is left out."""
    rows = messages.select(F.from_json(col, PROVENANCE_SCHEMA).alias("r")).select("r.*").where("pathname IS NOT NULL")
    return rows.withColumn("imagename", F.substring_index("pathname", "/", -1)).drop("pathname")


def scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    """Output and checkpoint paths in the shared folder."""
    base = scratch_path(spark, name)
    return f"{base}/out", f"{base}/checkpoint"
