"""GPS time, vehicle and cruise tracks, and run timing of bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelog.functions.times import add_seconds, seconds_between
from brinelog.operators import ordered

# GPS epoch, week cycle, offset between the time scales, and leap seconds as (Julian date, offset).
GPS_EPOCH_JULIAN = 2444244.5
GPS_CYCLE_WEEKS = 1024
DAY_SECONDS = 86400.0
UTC_TAI_OFFSET = 19
LEAP_SECONDS = [
    (2457204.5, 36), (2456109.5, 35), (2454832.5, 34), (2453736.5, 33), (2451179.5, 32), (2450630.5, 31), (2450083.5, 30),
    (2449534.5, 29), (2449169.5, 28), (2448804.5, 27), (2448257.5, 26), (2447892.5, 25), (2447161.5, 24), (2446247.5, 23),
    (2445516.5, 22), (2445151.5, 21), (2444786.5, 20), (2444239.5, 19), (2443874.5, 18), (2443509.5, 17), (2443144.5, 16),
    (2442778.5, 15), (2442413.5, 14), (2442048.5, 13), (2441683.5, 12), (2441499.5, 11), (2441317.5, 10),
]
# Run start offsets and uptake times in seconds.
OFFSET_NO_DEBUBBLE, OFFSET_DEBUBBLE, UPTAKE_SECONDS_PER_ML, VALVE_SECONDS = 35, 182, 10, 6
UNIX_EPOCH_JULIAN_DAY = 2440588
SPINE_BLOCK = 4096


def gps_to_julian(time_of_week: Column, week: Column, cycle: int = 0) -> Column:
    days = (week + cycle * GPS_CYCLE_WEEKS) * F.lit(7.0) + time_of_week / F.lit(DAY_SECONDS) + F.lit(0.5)
    return F.lit(GPS_EPOCH_JULIAN) + days - F.lit(0.5)


def leap_second_lookup(julian: Column) -> Column:
    """Seconds between GPS and UTC: the latest entry strictly before the date, none gives 0."""
    out = F.lit(0)
    for start, offset in reversed(LEAP_SECONDS):
        out = F.when(julian > start, offset - UTC_TAI_OFFSET).otherwise(out)
    return out


def gps_to_utc(time_of_week: Column, week: Column, cycle: int = 0) -> Column:
    """UTC time, floored to microseconds. Julian dates in double precision resolve about 40 microseconds."""
    julian = gps_to_julian(time_of_week, week, cycle)
    shifted = julian + leap_second_lookup(julian) * F.lit(-1.0) / F.lit(DAY_SECONDS)
    whole = F.floor(shifted)
    rest = shifted - whole
    day = whole + F.when(rest >= 0.5, 1).otherwise(0)
    seconds = F.when(rest >= 0.5, rest - 0.5).otherwise(rest + 0.5) * F.lit(DAY_SECONDS)
    minutes = F.floor(seconds / 60)
    within = seconds % F.lit(60.0)
    micros = F.floor(within) * 1000000 + F.floor((within % F.lit(1.0)) * F.lit(1000000.0))
    total = ((day - UNIX_EPOCH_JULIAN_DAY) * 1440 + minutes) * 60000000 + micros
    return F.timestamp_micros(total.cast("bigint")).cast("timestamp_ntz")


def first_nonzero_epoch(gps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """GPS second and week at clock zero, from the first row with a GPS time (``LineNo, TimeUS, GMS, GWk``)."""
    first = gps.where("GMS <> 0").groupBy(*keys).agg(F.min_by(F.struct("TimeUS", "GMS", "GWk"), "LineNo").alias("r"))
    return first.where(F.col("r").isNotNull()).select(
        *keys, (F.col("r.GMS") / F.lit(1000.0) - F.col("r.TimeUS") / F.lit(1000000.0)).alias("gps_s"),
        F.col("r.GWk").alias("gps_week"))


def gps_table_utc(table: DataFrame, gps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Telemetry with its UTC time; ``keys`` name the vehicle log, whose epoch is one row."""
    rows = table.join(first_nonzero_epoch(gps, keys), list(keys))
    second = F.col("TimeUS") / F.lit(1000000.0) + F.col("gps_s")
    return rows.withColumn("utc", gps_to_utc(second, F.col("gps_week"))).drop("gps_s", "gps_week")


def asof_join_track(bins: DataFrame, track: DataFrame, keys: Sequence[str] = (), time: str = "sample_time") -> DataFrame:
    """Latest latitude and longitude at or before each bin, each on its own; bins before the first fix are dropped."""
    fixes = track.select(*keys, F.col("ts").alias(time), "latitude", "longitude", F.lit(0).alias("_bin"))
    rows = bins.withColumn("_bin", F.lit(1)).unionByName(fixes, allowMissingColumns=True)
    filled = ordered.fill_forward(rows, keys, [time, "_bin"], None, ["latitude", "longitude"],
                                  position=F.col(time))
    return filled.where("_bin = 1 AND latitude IS NOT NULL AND longitude IS NOT NULL").drop("_bin")


def forward_fill(rows: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str]) -> DataFrame:
    """Last value before each row, then rows that still lack one are dropped."""
    return ordered.fill_forward(rows, keys, [time], None, cols).na.drop(subset=list(cols))


def time_bin_mean(track: DataFrame, time: str, every: str, cols: Sequence[str], keys: Sequence[str] = (),
                  fill: bool = False) -> DataFrame:
    """Mean per fixed time bin (start in ``bin``); ``fill`` adds the empty bins between first and last of a key."""
    means = track.groupBy(*keys, F.window(time, every).start.alias("bin")).agg(*[F.avg(c).alias(c) for c in cols])
    if not fill:
        return means
    spans = means.groupBy(*keys).agg(F.min("bin").alias("_a"), F.max("bin").alias("_b"))
    # Blocks of bins are dealt out first, so that no cell and no task holds a whole span.
    width = F.expr(f"INTERVAL {every}")
    block = F.expr(f"INTERVAL {every} * {SPINE_BLOCK}")
    blocks = spans.select(*keys, "_b", F.explode(F.sequence("_a", "_b", block)).alias("_c")).repartition(*keys, "_c")
    upto = F.least(F.col("_c") + block - width, "_b")
    spine = blocks.select(*keys, F.explode(F.sequence("_c", upto, width)).alias("bin"))
    return spine.join(means, [*keys, "bin"], "left")


def next_bin(files: DataFrame, folder: str = "dir", path: str = "path", slice_by: Column | None = None) -> DataFrame:
    """Next file of the sorted folder."""
    return ordered.neighbours(files, [folder], [path], slice_by, next={path: "next_path"})


def next_bin_offset(headers: DataFrame, folder: str = "dir", slice_by: Column | None = None, ml: float = 1.0) -> DataFrame:
    """Seconds from start-up to sample uptake; ``headers`` has ``dir, path, init_time, run_time, debubble``."""
    rows = ordered.neighbours(headers, [folder], ["path"], slice_by, next={"init_time": "_next"})
    gap = seconds_between(F.col("_next"), F.col("init_time"))
    used = F.col("run_time") + VALVE_SECONDS + ml * UPTAKE_SECONDS_PER_ML
    last = F.when(F.col("debubble") == "1", OFFSET_DEBUBBLE).otherwise(OFFSET_NO_DEBUBBLE).cast("double")
    return rows.withColumn("time_offset", F.coalesce(gap - used, last)).drop("_next")


def sample_time_series(headers: DataFrame, **kw) -> DataFrame:
    """(lid, sample_time) of each bin."""
    rows = next_bin_offset(headers, **kw)
    return rows.select("lid", add_seconds(F.col("init_time"), F.col("time_offset")).alias("sample_time"))


def trigger_utc(targets: DataFrame, series: DataFrame, seconds: str = "trigger_time") -> DataFrame:
    """UTC time of each target row: uptake time of its bin plus its trigger seconds."""
    return targets.join(series, "lid").withColumn("utc", add_seconds(F.col("sample_time"), F.col(seconds))).drop("sample_time")
