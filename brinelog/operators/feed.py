"""Time-series queries over sample bins.

``bins`` has ``id, ts_label, lid, sample_time, skip``. Every function returns a lazy DataFrame; time bounds are literals
without zone, so they reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinelog.functions.times import instant, micros, seconds_between

def having_all_tags(bin_tags: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Bins that hold every tag; any number of tags."""
    asked = list(dict.fromkeys(tags))
    hits = bin_tags.where(F.col("tag").isin(*asked)).groupBy("bin_id").agg(
        *[F.bool_or(F.col("tag") == tag).alias(f"_{i}") for i, tag in enumerate(asked)])
    return hits.where(" AND ".join(f"_{i}" for i in range(len(asked)))).select("bin_id")


def tag_semi_join(bins: DataFrame, bin_tags: DataFrame, tags: Sequence[str]) -> DataFrame:
    if not tags:
        return bins
    tagged = having_all_tags(bin_tags, list(dict.fromkeys(tags)))
    return bins.join(tagged, bins.id == tagged.bin_id, "left_semi")


def skip_clause(bins: DataFrame, include_skip: bool = False) -> DataFrame:
    """Drop skipped bins, if the table knows skipping at all."""
    return bins if include_skip or "skip" not in bins.columns else bins.where(~F.col("skip"))


def ts_query(bins: DataFrame, label: str | None = None, start: datetime | None = None, end: datetime | None = None,
             include_skip: bool = False, tags: Sequence[str] = (), bin_tags: DataFrame | None = None) -> DataFrame:
    """Bins of a series within the given bounds; without a bound that side is open and bins without a time stay."""
    out = bins if label is None else bins.where(F.col("ts_label") == label)
    if start is not None:
        out = out.where(F.col("sample_time") >= instant(start))
    if end is not None:
        out = out.where(F.col("sample_time") <= instant(end))
    return tag_semi_join(skip_clause(out, include_skip), bin_tags, tags)


def time_range(bins: DataFrame, label: str | None = None, start=None, end=None, **kw) -> DataFrame:
    return ts_query(bins, label, start, end, **kw).orderBy("sample_time")


def between(bins: DataFrame, start: datetime, end: datetime, label: str | None = None) -> DataFrame:
    return ts_query(bins, label, start, end)


def day_bins(bins: DataFrame, label: str | None, day: datetime, include_skip: bool = False) -> DataFrame:
    """Both midnights included: a bin at the next midnight belongs to both days."""
    return time_range(bins, label, day, day + timedelta(days=1), include_skip=include_skip)


def day_bins_parts(bins: DataFrame, label: str | None, day: datetime) -> DataFrame:
    """Calendar day, newest first; the day is a half-open range so that it is pushed down."""
    start, stop = instant(day), instant(day + timedelta(days=1))
    out = skip_clause(bins if label is None else bins.where(F.col("ts_label") == label))
    return out.where((F.col("sample_time") >= start) & (F.col("sample_time") < stop)).orderBy(F.desc("sample_time"))


def latest(bins: DataFrame, label: str | None = None, n: int = 25, timestamp: datetime | None = None, **kw) -> DataFrame:
    return ts_query(bins, label, None, timestamp, **kw).orderBy(F.desc("sample_time"), "id").limit(n)


def nearest(bins: DataFrame, label: str | None, timestamp: datetime, n: int = 1, **kw) -> DataFrame:
    """The n bins with the smallest absolute time difference: n on each side, then the best n of those."""
    before = latest(bins, label, n, timestamp, **kw)
    after = ts_query(bins, label, timestamp, None, **kw).orderBy("sample_time", "id").limit(n)
    gap = F.abs(micros("sample_time") - micros(instant(timestamp)))
    both = before.unionByName(after).dropDuplicates(["id"])
    return both.withColumn("_gap", gap).orderBy("_gap", "id").limit(n).drop("_gap")


def _time_of(bins: DataFrame, lid: str) -> Column:
    return bins.where(F.col("lid") == lid).agg(F.min("sample_time")).scalar()


def bins_after(bins: DataFrame, label: str | None, lid: str, n: int = 1, **kw) -> DataFrame:
    later = ts_query(bins, label, **kw).where(F.col("sample_time") > _time_of(bins, lid))
    return later.orderBy("sample_time", "id").limit(n)


def bins_before(bins: DataFrame, label: str | None, lid: str, n: int = 1, **kw) -> DataFrame:
    earlier = ts_query(bins, label, **kw).where(F.col("sample_time") < _time_of(bins, lid))
    return earlier.orderBy(F.desc("sample_time"), "id").limit(n)


def random_bins(bins: DataFrame, label: str | None, n: int, seed: int | None = None, **kw) -> DataFrame:
    return ts_query(bins, label, **kw).orderBy(F.rand(seed)).limit(n)


def elapsed(bins: DataFrame, label: str | None, timestamp: datetime, **kw) -> DataFrame:
    """Seconds from the latest bin to ``timestamp``; no row when there is no bin."""
    newest = ts_query(bins, label, **kw).agg(F.max("sample_time").alias("latest")).where(F.col("latest").isNotNull())
    return newest.select(seconds_between(instant(timestamp), F.col("latest")).alias("seconds"))


def page_query(rows: DataFrame, order: Sequence[str | Column], page: int, page_size: int = 10) -> DataFrame:
    """1-based page with ``has_next``; page 0 is everything. The window sees at most one page and one row."""
    if page == 0:
        return rows.withColumn("has_next", F.lit(False))
    window = rows.orderBy(*order).offset((page - 1) * page_size).limit(page_size + 1)
    numbered = window.withColumns({"_rn": F.row_number().over(Window.orderBy(*order)),
                                   "_n": F.count(F.lit(1)).over(Window.partitionBy())})
    return numbered.where(F.col("_rn") <= page_size).withColumn("has_next", F.col("_n") > page_size).drop("_rn", "_n")


def total_bins(bins: DataFrame, label: str | None = None, tags=(), bin_tags=None) -> DataFrame:
    return ts_query(bins, label, include_skip=True, tags=tags, bin_tags=bin_tags).agg(F.count("*").alias("n_bins"))


def bin_file_join(bins: DataFrame, files: DataFrame) -> DataFrame:
    return bins.join(files, bins.id == files.bin_id)


def file_totals(files: DataFrame) -> DataFrame:
    """One row per bin before any join, so that a bin with very many files is combined on the map side."""
    return files.groupBy("bin_id").agg(F.sum("length").alias("bytes"), F.count("*").alias("n_files"))


def total_data_volume(bins: DataFrame, files: DataFrame, label: str | None = None) -> DataFrame:
    """Bytes of the files of these bins: files are semi-joined, then summed at once, so no row per bin is made."""
    chosen = ts_query(bins, label, include_skip=True)
    return files.join(chosen, files.bin_id == chosen.id, "left_semi").agg(F.sum("length").alias("total_bytes"))


def _volume_by_day(bins: DataFrame, files: DataFrame, unit: int) -> DataFrame:
    joined = bin_file_join(bins.select("id", "sample_time"), file_totals(files))
    days = joined.groupBy(F.to_date("sample_time").alias("day")).agg(
        F.sum("bytes").alias("bytes"), F.sum("n_files").alias("n"))
    return days.select("day", F.round(F.col("bytes") / unit, 2).cast("decimal(38,2)").alias("gb"),
                       F.floor(F.col("n") / 3).alias("bin_count")).orderBy("day")


def daily_data_volume(bins: DataFrame, files: DataFrame, label: str | None = None, start=None, end=None,
                      unit: int = 2**30, **kw) -> DataFrame:
    """Per day: volume in ``unit`` bytes to two places, and a third of the file count as whole bins."""
    return _volume_by_day(ts_query(bins, label, start, end, **kw), files, unit)


def data_volume_summary(bins: DataFrame, files: DataFrame, unit: int = 2**30) -> DataFrame:
    return _volume_by_day(bins, files, unit)


def bin_exists(bins: DataFrame, lid: str, include_skip: bool = True) -> DataFrame:
    found = skip_clause(bins, include_skip).where(F.col("lid") == lid).limit(1)
    return found.agg((F.count("*") > 0).alias("found"))


def set_skip_day(bins: DataFrame, label: str, day: datetime, skip: bool) -> DataFrame:
    hit = (F.col("ts_label") == label) & F.col("sample_time").between(instant(day), instant(day + timedelta(days=1)))
    return bins.withColumn("skip", F.when(hit, F.lit(skip)).otherwise(F.col("skip")))


def bin_rows(bins: DataFrame, namespace: str, with_skip: bool = False) -> DataFrame:
    """(pid, date) of bins for a feed answer."""
    from brinelog.functions.ids import canonicalize
    from brinelog.functions.times import iso8601
    cols = [canonicalize(namespace, F.col("ts_label"), F.col("lid")).alias("pid"),
            iso8601(F.col("sample_time")).alias("date")]
    return bins.select(*cols, "skip") if with_skip else bins.select(*cols)


def trigger_rate(triggers: Column, duration: Column) -> Column:
    return F.when(duration.isNull() | (duration < 0.1), F.lit(0.0)).otherwise(triggers / duration)


def metric_series(bins: DataFrame, label: str | None, metric: Column, end: datetime, seconds: int = 86400) -> DataFrame:
    """Any numeric expression on a bin as a metric over the last ``seconds`` before ``end``."""
    rows = ts_query(bins, label, end - timedelta(seconds=seconds), end)
    return rows.select("lid", "sample_time", metric.cast("double").alias("metric")).orderBy("sample_time")


def props_nonnull(props: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Properties of a row as a map without the null ones."""
    pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("string"))]
    return props.select(key, F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("props"))


def destination_dirs(data_dirs: DataFrame) -> DataFrame:
    return data_dirs.where("destination").orderBy("priority")


def enabled_series(series: DataFrame) -> DataFrame:
    described = F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("label"))
    return series.where("enabled").select("label", described.alias("description")).orderBy("label")
