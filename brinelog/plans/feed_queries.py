"""Registered feed queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from brinelog.functions.times import iso8601
from brinelog.operators import feed, ordered
from brinelog.plans.registry import query

T0, T1, MID = datetime(2024, 1, 5), datetime(2024, 1, 20, 12), datetime(2024, 1, 15, 6, 30)
COLS = ["id", "ts_label", "lid", "sample_time", "skip"]
C = "id, ts_label, lid, sample_time, skip"
RANGE = "ts_label = 'view' AND sample_time BETWEEN '2024-01-05' AND '2024-01-20 12:00:00'"


@query("daily_data_volume", """
SELECT CAST(sample_time AS DATE) AS day, CAST(round(sum(length) / 1048576.0, 2) AS DECIMAL(38,2)) AS gb,
  count(*) // 3 AS bin_count FROM obins JOIN files ON id = bin_id WHERE ts_label = 'F' AND NOT skip GROUP BY 1""")
def _(t):
    return feed.daily_data_volume(t.obins, t.files, "F", unit=2**20)


@query("data_volume_summary", """
SELECT CAST(sample_time AS DATE) AS day, CAST(round(sum(length) / 1048576.0, 2) AS DECIMAL(38,2)) AS gb,
  count(*) // 3 AS bin_count FROM obins JOIN files ON id = bin_id GROUP BY 1""")
def _(t):
    return feed.data_volume_summary(t.obins, t.files, unit=2**20)


@query("time_range", f"SELECT {C} FROM bins WHERE NOT skip AND {RANGE}")
def _(t):
    return feed.time_range(t.bins, "view", T0, T1).select(*COLS)


@query("ts_query", f"""SELECT {C} FROM obins WHERE NOT skip AND ts_label = 'O'
  AND id IN (SELECT bin_id FROM bin_tags WHERE tag = 'R') AND id IN (SELECT bin_id FROM bin_tags WHERE tag = 'F')""")
def _(t):
    return feed.ts_query(t.obins, "O", tags=["R", "F"], bin_tags=t.bin_tags).select(*COLS)


@query("between", f"SELECT {C} FROM bins WHERE NOT skip AND {RANGE}")
def _(t):
    return feed.between(t.bins, T0, T1, "view").select(*COLS)


@query("day_bins", f"""SELECT {C} FROM obins WHERE NOT skip AND ts_label = 'P'
  AND sample_time BETWEEN '1997-06-01' AND '1997-06-02'""")
def _(t):
    return feed.day_bins(t.obins, "P", datetime(1997, 6, 1)).select(*COLS)


@query("day_bins_parts", f"""SELECT {C} FROM bins WHERE NOT skip AND ts_label = 'click'
  AND CAST(sample_time AS DATE) = DATE '2024-01-10'""")
def _(t):
    return feed.day_bins_parts(t.bins, "click", datetime(2024, 1, 10)).select(*COLS)


@query("skip_clause", "SELECT (SELECT count(*) FROM bins WHERE NOT skip) AS with_column, (SELECT count(*) FROM files) AS without_column")
def _(t):
    a = feed.skip_clause(t.bins).agg(F.count("*").alias("n")).scalar()
    return feed.skip_clause(t.files).agg(F.count("*").alias("without_column")).select(
        a.alias("with_column"), "without_column")


@query("set_skip_day", """SELECT skip, count(*) AS n FROM (SELECT CASE WHEN ts_label = 'view' AND sample_time BETWEEN
  '2024-01-10' AND '2024-01-11' THEN true ELSE skip END AS skip FROM bins) GROUP BY 1""")
def _(t):
    return feed.set_skip_day(t.bins, "view", datetime(2024, 1, 10), True).groupBy("skip").agg(F.count("*").alias("n"))


@query("bin_exists", "SELECT count(*) > 0 AS found FROM bins WHERE lid = 'E77'")
def _(t):
    return feed.bin_exists(t.bins, "E77")


@query("bin_rows", """SELECT 'http://data.example.org/' || ts_label || '/' || lid AS pid,
  strftime(sample_time, '%Y-%m-%dT%H:%M:%SZ') AS date, skip FROM bins""")
def _(t):
    return feed.bin_rows(t.bins, "http://data.example.org/", with_skip=True)


@query("total_bins", "SELECT count(*) AS n_bins FROM bins WHERE ts_label = 'click'")
def _(t):
    return feed.total_bins(t.bins, "click")


@query("total_data_volume", """SELECT CAST(sum(length) AS BIGINT) AS total_bytes FROM obins JOIN files ON id = bin_id
  WHERE ts_label = 'F'""")
def _(t):
    return feed.total_data_volume(t.obins, t.files, "F")


@query("bin_file_join", """SELECT id, lid, filename, length, count(*) AS copies FROM obins JOIN files ON id = bin_id
  GROUP BY ALL""")
def _(t):
    rows = t.files.count()
    joined = feed.bin_file_join(ordered.spread(t.obins, ["id"], rows), ordered.spread(t.files, ["bin_id"], rows))
    return joined.groupBy("id", "lid", "filename", "length").agg(
        F.count("*").alias("copies"))


@query("tag_semi_join", f"""SELECT {C} FROM obins WHERE id IN (SELECT bin_id FROM bin_tags WHERE tag = 'A')
  AND id IN (SELECT bin_id FROM bin_tags WHERE tag = 'O')""")
def _(t):
    return feed.tag_semi_join(t.obins, t.bin_tags, ["A", "O"]).select(*COLS)


@query("latest", f"""SELECT {C} FROM bins WHERE NOT skip AND ts_label = 'error' AND sample_time <= '2024-01-15 06:30:00'
  ORDER BY sample_time DESC, id LIMIT 25""")
def _(t):
    return feed.latest(t.bins, "error", 25, MID).select(*COLS)


@query("latest_v1", f"SELECT {C} FROM bins WHERE NOT skip AND sample_time <= '2024-01-15 06:30:00' ORDER BY sample_time DESC, id LIMIT 10")
def _(t):
    return feed.latest(t.bins, None, 10, MID).select(*COLS)


@query("nearest", f"""SELECT {C} FROM bins WHERE NOT skip AND ts_label = 'view'
  ORDER BY abs(epoch_us(sample_time) - epoch_us(TIMESTAMP '2024-01-15 06:30:00')), id LIMIT 7""")
def _(t):
    return feed.nearest(t.bins, "view", MID, 7).select(*COLS)


@query("nearest_v1", f"""SELECT {C} FROM bins WHERE NOT skip
  ORDER BY abs(epoch_us(sample_time) - epoch_us(TIMESTAMP '2024-01-15 06:30:00')), id LIMIT 1""")
def _(t):
    return feed.nearest(t.bins, None, MID, 1).select(*COLS)


@query("bins_after", f"""SELECT {C} FROM bins WHERE NOT skip AND ts_label = 'view' AND sample_time >
  (SELECT sample_time FROM bins WHERE lid = 'E100') ORDER BY sample_time, id LIMIT 5""")
def _(t):
    return feed.bins_after(t.bins, "view", "E100", 5).select(*COLS)


@query("bins_before", f"""SELECT {C} FROM bins WHERE NOT skip AND ts_label = 'view' AND sample_time <
  (SELECT sample_time FROM bins WHERE lid = 'E100') ORDER BY sample_time DESC, id LIMIT 5""")
def _(t):
    return feed.bins_before(t.bins, "view", "E100", 5).select(*COLS)


@query("before_v1", f"""SELECT {C} FROM bins WHERE NOT skip AND sample_time <
  (SELECT sample_time FROM bins WHERE lid = 'E200') ORDER BY sample_time DESC, id LIMIT 3""")
def _(t):
    return feed.bins_before(t.bins, None, "E200", 3).select(*COLS)


@query("random_bins")
def _(t):
    return feed.random_bins(t.bins, "view", 10, seed=7).select(*COLS)


@query("elapsed", """SELECT (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(sample_time))) / 1000000.0 AS seconds
  FROM bins WHERE NOT skip AND ts_label = 'click'""")
def _(t):
    return feed.elapsed(t.bins, "click", datetime(2024, 2, 1))


@query("page_query", f"""SELECT {C}, true AS has_next FROM bins WHERE NOT skip AND ts_label = 'view'
  ORDER BY sample_time DESC, id LIMIT 10 OFFSET 20""")
def _(t):
    rows = feed.ts_query(t.bins, "view").select(*COLS)
    return feed.page_query(rows, [F.desc("sample_time"), "id"], 3, 10)


@query("trigger_rate", """SELECT id, CASE WHEN duration IS NULL OR duration < 0.1 THEN 0 ELSE triggers / duration END
  AS rate FROM bins""")
def _(t):
    return t.bins.select("id", feed.trigger_rate(F.col("triggers"), F.col("duration")).alias("rate"))


@query("metric_series", """SELECT lid, sample_time, CAST(triggers AS DOUBLE) AS metric FROM bins WHERE NOT skip AND
  ts_label = 'view' AND sample_time BETWEEN '2024-01-14 06:30:00' AND '2024-01-15 06:30:00'""")
def _(t):
    return feed.metric_series(t.bins, "view", F.col("triggers"), MID)


@query("metric_callback", """SELECT lid, sample_time, triggers / duration AS metric FROM bins WHERE NOT skip AND
  ts_label = 'click' AND duration > 0 AND sample_time BETWEEN '2024-01-08 06:30:00' AND '2024-01-15 06:30:00'""")
def _(t):
    by = lambda r: F.col("triggers") / F.col("duration")
    return feed.metric_series(t.bins.where("duration > 0"), "click", by(None), MID, 7 * 86400)


@query("feed_freshness", """SELECT ts_label, max(sample_time) AS latest, (epoch_us(TIMESTAMP '2024-02-01') -
  epoch_us(max(sample_time))) / 1000000.0 AS seconds FROM bins GROUP BY 1""")
def _(t):
    from brinelog.streaming import flows
    return flows.feed_freshness(t.bins, datetime(2024, 2, 1))


@query("props_nonnull", """SELECT id, CAST(nullif(triggers, 50) AS VARCHAR) AS triggers,
  (triggers IS DISTINCT FROM 50) AS has_triggers FROM bins""")
def _(t):
    rows = t.bins.withColumn("triggers", F.nullif(F.col("triggers"), F.lit(50)))
    m = feed.props_nonnull(rows, "id", ["triggers", "lid"])
    return m.select("id", F.try_element_at("props", F.lit("triggers")).alias("triggers"),
                    F.map_contains_key("props", "triggers").alias("has_triggers"))


@query("destination_dirs", """SELECT s_suppkey AS id, s_name AS path, s_nationkey AS priority FROM supplier
  WHERE s_suppkey % 2 = 0""")
def _(t):
    dirs = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("path"),
                             F.col("s_nationkey").alias("priority"), (F.col("s_suppkey") % 2 == 0).alias("destination"))
    return feed.destination_dirs(dirs).drop("destination")


@query("enabled_series", """SELECT c_name AS label, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE c_mktsegment END
  AS description FROM customer WHERE c_acctbal > 0""")
def _(t):
    series = t.customer.select(F.col("c_name").alias("label"), (F.col("c_acctbal") > 0).alias("enabled"),
                               F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment"))
                               .alias("description"))
    return feed.enabled_series(series)


@query("feed_sink", """, feed AS (SELECT 'http://data.example.org/' || ts_label || '/' || lid AS pid,
  strftime(sample_time, '%Y-%m-%dT%H:%M:%SZ') AS date FROM bins WHERE ts_label = 'view')
SELECT pid, date, (SELECT max(date) FROM feed) AS max_date FROM feed""")
def _(t):
    from brinelog.sources import sinks
    return sinks.feed_rows(feed.bin_rows(t.bins.where("ts_label = 'view'"), "http://data.example.org/"))


@query("after_year", "SELECT id, sample_time FROM obins WHERE year(sample_time) > 1996")
def _(t):
    from brinelog.operators import files
    return files.after_year(t.obins, 1996).select("id", "sample_time")


@query("after_start_bin", "SELECT lid FROM bins WHERE lid > 'E500'")
def _(t):
    return t.bins.where(F.col("lid") > "E500").select("lid")


@query("iso8601", "SELECT id, strftime(sample_time, '%Y-%m-%dT%H:%M:%SZ') AS text FROM bins")
def _(t):
    return t.bins.select("id", iso8601(F.col("sample_time")).alias("text"))
