"""Registered product, track, annotation and score queries."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from brinelog.functions import text
from brinelog.operators import annotations, products, tracks
from brinelog.plans.registry import query
from brinelog.session import scratch_path

NOW = datetime(2024, 1, 31)


@query("product_count", "SELECT count(*) AS n FROM products")
def _(t):
    return products.product_count(t.products)


FOLD = """, folded AS (SELECT pid, arg_max(state, (ts, seq)) FILTER (state IS NOT NULL) AS state,
  arg_max(event, (ts, seq)) FILTER (event IS NOT NULL) AS event, arg_max(message, (ts, seq)) FILTER (message IS NOT NULL) AS message,
  nullif(arg_max(ttl, (ts, seq)) FILTER (ttl IS NOT NULL), -1) AS ttl, max(ts) AS ts FROM product_events GROUP BY 1),
state AS (SELECT *, ts + to_seconds(ttl) AS expires FROM folded) """
SC = "pid, state, event, message, ttl, ts, expires"
SCOLS = ["pid", "state", "event", "message", "ttl", "ts", "expires"]


@query("product_state", FOLD + f"SELECT {SC} FROM state")
def _(t):
    return products.fold_events(t.product_events).select(*SCOLS)


@query("expire_ttl", FOLD + """SELECT pid, CASE WHEN late THEN 'waiting' ELSE state END AS state, CASE WHEN late THEN 'expired' ELSE event END AS event,
  CASE WHEN late THEN 'heartbeat' ELSE message END AS message, ttl, CASE WHEN late THEN TIMESTAMP '2024-01-31' ELSE ts END AS ts,
  CASE WHEN late THEN TIMESTAMP '2024-01-31' + to_seconds(ttl) ELSE expires END AS expires
  FROM (SELECT *, coalesce(expires < TIMESTAMP '2024-01-31', false) AS late FROM state)""")
def _(t):
    return products.expire_ttl(products.fold_events(t.product_events), NOW).select(*SCOLS)


@query("heartbeat", FOLD + """SELECT pid, state, 'heartbeat' AS event, ttl, TIMESTAMP '2024-01-31' AS ts, TIMESTAMP '2024-01-31' + to_seconds(ttl) AS expires FROM state""")
def _(t):
    e = t.product_events
    beats = products.heartbeat(products.fold_events(e), NOW, e.select("pid").distinct()).withColumn("seq", F.lit(0).cast("bigint"))
    return products.fold_events(e.unionByName(beats)).select("pid", "state", "event", "ttl", "ts", "expires")


@query("most_recent", FOLD + f"SELECT {SC} FROM state ORDER BY ts DESC, pid LIMIT 10")
def _(t):
    return products.most_recent(products.fold_events(t.product_events), 10).select(*SCOLS)


@query("younger_than", "SELECT seq FROM product_events WHERE ts > TIMESTAMP '2024-01-29'")
def _(t):
    return products.younger_than(t.product_events, NOW, timedelta(days=2)).select("seq")


@query("older_than", "SELECT seq FROM product_events WHERE ts < TIMESTAMP '2024-01-29'")
def _(t):
    return products.older_than(t.product_events, NOW, timedelta(days=2)).select("seq")


@query("search_ilike", "SELECT pid FROM products WHERE message ILIKE '%wid%' OR event ILIKE '%wid%' OR state ILIKE '%wid%' OR pid::VARCHAR ILIKE '%wid%'")
def _(t):
    p = t.products.withColumn("pid_text", F.col("pid").cast("string"))
    return p.where(text.search_ilike(["pid_text", "state", "event", "message"], "WID")).select("pid")


@query("roots", "SELECT pid FROM products WHERE pid NOT IN (SELECT downstream FROM dependencies)")
def _(t):
    return products.roots(t.products, t.dependencies).select("pid")


@query("leaves", "SELECT pid FROM products WHERE pid NOT IN (SELECT upstream FROM dependencies)")
def _(t):
    return products.leaves(t.products, t.dependencies).select("pid")


READY = """, ready AS (SELECT p.pid, p.priority FROM products p JOIN dependencies d ON d.downstream = p.pid JOIN products u ON u.pid = d.upstream
  WHERE p.state = 'waiting' AND u.state = 'available' AND d.role IN ({roles}) GROUP BY 1, 2 HAVING count(d.role) = {n} AND count(DISTINCT d.role) = {n}) """


def _two_edges(t):
    """Each product depends on its half and on its third."""
    third = t.part.where("p_partkey > 2").select(F.col("p_partkey").alias("downstream"), F.floor(F.col("p_partkey") / 3).alias("upstream"),
                                                 F.col("p_brand").substr(1, 5).alias("role"))
    return t.dependencies.unionByName(third)


READY2 = ", edges AS (SELECT * FROM dependencies UNION ALL SELECT p_partkey, p_partkey // 3, substr(p_brand, 1, 5) FROM part WHERE p_partkey > 2)" + \
    READY.replace("JOIN dependencies d", "JOIN edges d")


@query("downstream_ready", READY2.format(roles="'SMALL', 'Brand'", n=2) + "SELECT * FROM ready")
def _(t):
    return products.downstream_ready(t.products, _two_edges(t), ["SMALL", "Brand"], "waiting", "available").select("pid", "priority")


@query("next_ready", READY2.format(roles="'Brand'", n=1) + "SELECT pid, priority FROM ready ORDER BY priority, pid LIMIT 1")
def _(t):
    return products.next_ready(t.products, _two_edges(t), ["Brand"]).select("pid", "priority")


@query("start_next", READY2.format(roles="'Brand'", n=1) + "SELECT pid, TIMESTAMP '2024-01-31' AS ts, 'running' AS state, 'start_next' AS event FROM ready ORDER BY priority, pid LIMIT 1")
def _(t):
    return products.start_next(t.products, _two_edges(t), NOW, ["Brand"]).drop("message")


@query("conditional_update", """SELECT pid, CASE WHEN state = 'waiting' AND pid IN (SELECT s_suppkey FROM supplier) THEN 'running' ELSE state END AS state FROM products""")
def _(t):
    updates = t.supplier.select(F.col("s_suppkey").alias("pid"), F.lit("waiting").alias("expected"), F.lit("running").alias("new_state"))
    return products.conditional_update(t.products, updates).select("pid", "state")


@query("intermediates", """SELECT pid FROM products p WHERE state = 'available' AND pid IN (SELECT downstream FROM dependencies)
  AND pid IN (SELECT upstream FROM dependencies) AND NOT EXISTS (SELECT 1 FROM dependencies d JOIN products q ON q.pid = d.downstream
  WHERE d.upstream = p.pid AND q.state <> 'available')""")
def _(t):
    return products.intermediates(t.products, t.dependencies).select("pid")




@query("ancestors", """, up AS (SELECT p_partkey AS seed, p_partkey // CAST(2 ** k AS BIGINT) AS pid FROM part, range(1, 60) levels(k))
SELECT seed, pid FROM up WHERE pid >= 1""")
def _(t):
    return products.ancestors(t.dependencies, t.products)


@query("descendants", """, up AS (SELECT p_partkey AS pid, p_partkey // CAST(2 ** k AS BIGINT) AS seed FROM part, range(1, 60) levels(k))
SELECT seed, pid FROM up WHERE seed >= 1""")
def _(t):
    return products.descendants(t.dependencies, t.products)


@query("reachable_chain", "SELECT p_partkey AS pid FROM part WHERE p_partkey < (SELECT max(p_partkey) FROM part)")
def _(t):
    """Every product depends on the one before it: a chain as long as the table."""
    pid = F.col("p_partkey")
    chain = t.part.where("p_partkey > 0").select(pid.alias("downstream"), (pid - 1).alias("upstream"))
    return products.reachable(chain, t.part.agg(F.max("p_partkey").alias("pid")))


NODE = """, down AS (SELECT p_partkey AS pid FROM part WHERE 5 IN (p_partkey // 2, p_partkey // 4, p_partkey // 8, p_partkey // 16, p_partkey // 32,
  p_partkey // 64, p_partkey // 128, p_partkey // 256, p_partkey // 512, p_partkey // 1024, p_partkey // 2048, p_partkey // 4096, p_partkey // 8192)),
nodes AS (SELECT pid FROM down UNION SELECT unnest([5, 2, 1]))"""


@query("dependency_graph", NODE + " SELECT downstream, upstream, role FROM dependencies WHERE downstream IN (SELECT pid FROM nodes)")
def _(t):
    return products.dependency_graph(t.dependencies, t.products.where("pid = 5")).select("downstream", "upstream", "role")


@query("delete_tree", "SELECT pid FROM products WHERE pid NOT IN (77, 38, 19, 9, 4, 2, 1)")
def _(t):
    return products.delete_tree(t.products, t.dependencies, t.products.where("pid = 77")).select("pid")


@query("add_dependency", """, new AS (SELECT c_custkey AS downstream, c_custkey + 1 AS upstream FROM customer)
SELECT pid, state FROM products UNION ALL SELECT pid, CASE WHEN pid IN (SELECT upstream FROM new) THEN 'available' ELSE 'waiting' END FROM
  (SELECT upstream AS pid FROM new UNION SELECT downstream FROM new) WHERE pid NOT IN (SELECT pid FROM products)""")
def _(t):
    new = t.customer.select(F.col("c_custkey").alias("downstream"), (F.col("c_custkey") + 1).alias("upstream"), F.lit("any").alias("role"),
                            F.lit(5).alias("priority"))
    return products.add_dependency(t.products, t.dependencies, new)[0].select("pid", "state")


@query("product_deps", """, e AS (SELECT DISTINCT lid FROM bins) SELECT lid || '.jpg' AS pid, lid || unnest(['_gray', '_canny', '_final', '_final']) AS product,
  unnest([lid || '.jpg', lid || '_gray', lid || '_canny', lid || '.jpg']) AS upstream_product, unnest(['color', 'gray', 'overlay', 'background']) AS role FROM e""")
def _(t):
    return products.product_deps(t.bins.select(F.concat("lid", F.lit(".jpg")).alias("pid")))


@query("schedule_products", """SELECT lid || unnest(['_binzip', '_webcache', '_blobs', '_features']) AS downstream,
  lid || unnest(['_raw', '_binzip', '_binzip', '_blobs']) AS upstream, unnest(['raw2binzip', 'binzip2webcache', 'binzip2blobs', 'blobs2features']) AS role FROM bins""")
def _(t):
    from brinelog.operators import ingest
    return ingest.schedule_products(t.bins, "lid")


@query("batch_schedule", """SELECT 'n/' || lid || '_raw' AS downstream, 'n/' || lid || '_wild' AS upstream, 'wild2raw' AS role FROM bins
  WHERE id NOT IN (SELECT p_partkey FROM part)""")
def _(t):
    from brinelog.operators import ingest
    known = t.part.select(F.concat(F.lit("E"), F.col("p_partkey").cast("string")).alias("lid"))
    return ingest.batch_schedule(t.bins, known, "n/")



@query("work_outcome", """SELECT pid, CASE WHEN priority > 40 THEN 'error' ELSE 'available' END AS state, CASE WHEN priority > 40 THEN 'exception' ELSE 'completed' END
  AS event, CASE WHEN priority > 40 THEN 'ValueError: too large' ELSE 'done' END AS message FROM products""")
def _(t):
    failure = F.when(F.col("priority") > 40, "ValueError: too large")
    return products.work_outcome(t.products.select("pid", "priority"), failure, "done")


@query("open_process", """SELECT 'used' AS kind, o_orderkey AS process_id, CAST(o_custkey AS VARCHAR) AS detail FROM orders UNION ALL
SELECT 'processes', o_orderkey, '2024-01-31 00:00:00' FROM orders UNION ALL SELECT 'events', o_orderkey, 'new' FROM orders UNION ALL
SELECT 'algorithms', o_orderkey, o_orderpriority FROM orders""")
def _(t):
    rows = t.orders.select(F.col("o_orderkey").alias("process_id"), F.col("o_orderpriority").alias("algorithm"), F.lit("1").alias("version"),
                           F.lit("{}").alias("parameters"), F.array(F.col("o_custkey").cast("string")).alias("inputs"))
    made = products.open_process(rows, NOW)
    detail = {"used": "pid", "processes": "opened", "events": "status", "algorithms": "algorithm"}
    parts = [made[k].select(F.lit(k).alias("kind"), "process_id", F.col(c).cast("string").alias("detail")) for k, c in detail.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("latest_status", "SELECT user_id AS process_id, arg_max(event_type, ts) AS status FROM events GROUP BY 1")
def _(t):
    e = t.events.select(F.col("user_id").alias("process_id"), F.col("event_type").alias("status"), F.col("ts").alias("observed"))
    return products.latest_status(e)


@query("process_inputs", "SELECT l_partkey AS pid FROM lineitem WHERE l_orderkey = 3")
def _(t):
    links = t.lineitem.select(F.col("l_orderkey").alias("process_id"), F.col("l_partkey").alias("pid"))
    return products.process_ids(links, 3)


@query("process_outputs", "SELECT l_suppkey AS pid FROM lineitem WHERE l_orderkey = 5")
def _(t):
    links = t.lineitem.select(F.col("l_orderkey").alias("process_id"), F.col("l_suppkey").alias("pid"))
    return products.process_ids(links, 5)


def _runs(t):
    return t.documents.select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("process_id"), F.lit("a1").alias("algorithm_id"),
                              F.lit("2020-01-01T00:00:00Z").alias("start"), F.lit("2020-01-01T00:01:00Z").alias("stop"),
                              F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("in_path"), F.md5("text").alias("in_md5"),
                              F.col("n_chars").alias("in_length"), F.concat(F.lit("/out/"), F.col("doc_id").cast("string")).alias("out_path"),
                              F.md5("lang").alias("out_md5"), F.lit(2).cast("bigint").alias("out_length"))


PROV = """SELECT 'p' || doc_id AS process_id, 'a1' AS algorithm_id, '2020-01-01T00:00:00Z' AS no_earlier_than, '2020-01-01T00:01:00Z' AS no_later_than,
  unnest(['used', 'generated by']) AS direction, unnest(['/in/' || doc_id, '/out/' || doc_id]) AS pathname, unnest([md5(text), md5(lang)]) AS fixity_md5,
  unnest([n_chars, 2]) AS fixity_length FROM documents"""


@query("provenance_records", PROV)
def _(t):
    return products.provenance_records(_runs(t))


# -- tracks -----------------------------------------------------------------------------------------------------------

JD = "(2444244.5 + ((1600 + id % 500)::DOUBLE * 7.0 + duration * 1000 / 86400.0 + 0.5) - 0.5)"
LEAP = "CASE " + " ".join(f"WHEN jd > {j} THEN {o - 19}" for j, o in tracks.LEAP_SECONDS) + " ELSE 0 END"
GPS = f""", g AS (SELECT id, {JD} AS jd FROM bins), g1 AS (SELECT id, jd, {LEAP} AS leap FROM g),
g2 AS (SELECT *, jd + leap * -1.0::DOUBLE / 86400.0::DOUBLE AS s FROM g1), g3 AS (SELECT *, floor(s) AS w, s - floor(s) AS r FROM g2),
g4 AS (SELECT *, w + CASE WHEN r >= 0.5 THEN 1 ELSE 0 END AS day, CASE WHEN r >= 0.5 THEN r - 0.5 ELSE r + 0.5 END * 86400.0::DOUBLE AS sec FROM g3) """


def _gps(t):
    return t.bins.select("id", (F.col("duration") * 1000).alias("tow"), (1600 + F.col("id") % 500).alias("week"))


@query("gps_to_julian", GPS + "SELECT id, jd FROM g")
def _(t):
    return _gps(t).select("id", tracks.gps_to_julian(F.col("tow"), F.col("week")).alias("jd"))


@query("leap_second_lookup", GPS.replace("1600 + id % 500", "id % 2000") + "SELECT id, leap FROM g1")
def _(t):
    rows = _gps(t).withColumn("week", F.col("id") % 2000)
    return rows.select("id", tracks.leap_second_lookup(tracks.gps_to_julian(F.col("tow"), F.col("week"))).alias("leap"))


@query("gps_to_utc", GPS + """SELECT id, make_timestamp(CAST(((day - 2440588) * 1440 + floor(sec / 60)) * 60000000 + floor(sec % 60) * 1000000 +
  floor((sec % 60) % 1 * 1000000) AS BIGINT)) AS utc FROM g4""")
def _(t):
    return _gps(t).select("id", tracks.gps_to_utc(F.col("tow"), F.col("week")).alias("utc"))


def _vehicle(t):
    """One log per user: clock microseconds, GPS milliseconds (zero until the receiver has a fix) and week."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.select(F.col("user_id").alias("log"), F.col("event_id").alias("LineNo"), (F.col("event_id") * 1000).alias("TimeUS"),
                           F.when(F.col("event_type") == "error", 0).otherwise(F.col("event_id") * 7 + k).alias("GMS"), F.lit(2000).alias("GWk"))


EPOCH = """, v AS (SELECT user_id AS log, event_id AS n, event_id * 1000 AS us, CASE WHEN event_type = 'error' THEN 0 ELSE event_id * 7 + k END AS gms FROM event_k),
ep AS (SELECT log, arg_min(gms, n) / 1000.0::DOUBLE - arg_min(us, n) / 1000000.0::DOUBLE AS gps_s FROM v WHERE gms <> 0 GROUP BY 1) """


@query("first_nonzero_epoch", EPOCH + "SELECT log, gps_s, 2000 AS gps_week FROM ep")
def _(t):
    return tracks.first_nonzero_epoch(_vehicle(t), ["log"])


@query("gps_table_utc", EPOCH + """, g1 AS (SELECT n, 2444244.5 + (2000 * 7.0::DOUBLE + (us / 1000000.0::DOUBLE + gps_s) / 86400.0::DOUBLE + 0.5) - 0.5 AS jd FROM v JOIN ep USING (log)),
g2 AS (SELECT n, jd + 17 * -1.0::DOUBLE / 86400.0::DOUBLE AS s FROM g1), g3 AS (SELECT n, floor(s) AS w, s - floor(s) AS r FROM g2),
g4 AS (SELECT n, w + CASE WHEN r >= 0.5 THEN 1 ELSE 0 END AS day, CASE WHEN r >= 0.5 THEN r - 0.5 ELSE r + 0.5 END * 86400.0::DOUBLE AS sec FROM g3)
SELECT n AS "LineNo", make_timestamp(CAST(((day - 2440588) * 1440 + floor(sec / 60)) * 60000000 + floor(sec % 60) * 1000000 +
  floor((sec % 60) % 1 * 1000000) AS BIGINT)) AS utc FROM g4""")
def _(t):
    v = _vehicle(t)
    return tracks.gps_table_utc(v, v, ["log"]).select("LineNo", "utc")


@query("asof_join_track", """SELECT b.id, f.latitude, f.longitude FROM bins b ASOF JOIN fixes f ON b.sample_time >= f.ts WHERE b.ts_label <> 'signup'""")
def _(t):
    bins = t.bins.where("ts_label <> 'signup'").select("id", "sample_time")
    return tracks.asof_join_track(bins, t.fixes).select("id", "latitude", "longitude")


@query("forward_fill", """SELECT id, state, message FROM (SELECT seq AS id, last_value(state IGNORE NULLS) OVER w AS state, last_value(message IGNORE NULLS) OVER w AS message
  FROM product_events WINDOW w AS (PARTITION BY pid ORDER BY ts ROWS UNBOUNDED PRECEDING)) WHERE state IS NOT NULL AND message IS NOT NULL""")
def _(t):
    rows = t.product_events.select(F.col("seq").alias("id"), "pid", "ts", "state", "message")
    return tracks.forward_fill(rows, ["pid"], "ts", ["state", "message"]).select("id", "state", "message")


@query("time_bin_mean", """, m AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bin, avg(latitude) AS latitude FROM fixes GROUP BY 1),
s AS (SELECT unnest(generate_series((SELECT min(bin) FROM m), (SELECT max(bin) FROM m), INTERVAL 1 HOUR)) AS bin)
SELECT s.bin, round(latitude, 9) AS latitude FROM s LEFT JOIN m USING (bin)""")
def _(t):
    out = tracks.time_bin_mean(t.fixes, "ts", "1 hour", ["latitude"], fill=True)
    return out.select("bin", F.round("latitude", 9).alias("latitude"))


@query("roi_position_binned", """SELECT instrument, time_bucket(INTERVAL 1 HOUR, sample_time) AS bin, avg(triggers) AS triggers FROM bins GROUP BY 1, 2""")
def _(t):
    return tracks.time_bin_mean(t.bins, "sample_time", "1 hour", ["triggers"], ["instrument"])


@query("roll_pitch_binned", """SELECT time_bucket(INTERVAL 10 SECOND, sample_time) AS bin, avg(triggers) AS triggers, round(avg(duration), 9) AS duration FROM bins GROUP BY 1""")
def _(t):
    out = tracks.time_bin_mean(t.bins, "sample_time", "10 seconds", ["triggers", "duration"])
    return out.withColumn("duration", F.round("duration", 9))


def _headers(t):
    """Header rows of bins: one folder per instrument, file names in time order."""
    path = F.concat(F.date_format("sample_time", "yyyyMMdd'T'HHmmssSSSSSS"), F.lit("_"), F.col("id").cast("string"))
    return t.bins.select(F.col("instrument").alias("dir"), path.alias("path"), "lid", F.col("sample_time").alias("init_time"),
                         F.col("duration").alias("run_time"), (F.col("triggers") % 2).cast("string").alias("debubble"))


HEAD = """, h AS (SELECT instrument AS dir, lid, sample_time AS init_time, duration AS run_time, triggers % 2 = 1 AS deb, strftime(sample_time, '%Y%m%dT%H%M%S%f') || '_' || id AS path
  FROM bins), o AS (SELECT *, lead(init_time) OVER w AS nt, lead(path) OVER w AS np FROM h WINDOW w AS (PARTITION BY dir ORDER BY path)),
offs AS (SELECT *, coalesce((epoch_us(nt) - epoch_us(init_time)) / 1000000.0::DOUBLE - (run_time + 6 + 10), CASE WHEN deb THEN 182 ELSE 35 END) AS off FROM o) """


@query("next_bin", HEAD + "SELECT lid, path, np AS next_path FROM o")
def _(t):
    return tracks.next_bin(_headers(t)).select("lid", "path", "next_path")


@query("next_bin_offset", HEAD + "SELECT lid, off AS time_offset FROM offs")
def _(t):
    return tracks.next_bin_offset(_headers(t)).select("lid", "time_offset")


@query("sample_time_series", HEAD + "SELECT lid, make_timestamp(epoch_us(init_time) + CAST(round(off * 1000000) AS BIGINT)) AS sample_time FROM offs")
def _(t):
    return tracks.sample_time_series(_headers(t))


@query("trigger_utc", HEAD + """SELECT bin, "targetNumber", make_timestamp(epoch_us(init_time) + CAST(round(off * 1000000) AS BIGINT) + CAST(round(price * 1000000) AS BIGINT)) AS utc
  FROM targets JOIN offs ON lid = 'E' || bin""")
def _(t):
    rows = t.targets.select(F.concat(F.lit("E"), F.col("bin").cast("string")).alias("lid"), "bin", "targetNumber", F.col("price").alias("trigger_time"))
    return tracks.trigger_utc(rows, tracks.sample_time_series(_headers(t))).select("bin", "targetNumber", "utc")


# -- annotations ------------------------------------------------------------------------------------------------------

@query("pending_nulls", "SELECT seq || '.tif' AS imagename FROM product_events WHERE message IS NULL")
def _(t):
    rows = t.product_events.withColumn("imagename", F.col("seq").cast("string"))
    return annotations.pending_nulls(rows, "message")


@query("fetch_by_key", "SELECT image_id, category_id, scope_id FROM annotations WHERE image_id = (SELECT min(image_id) FROM annotations) LIMIT 1")
def _(t):
    held = t.annotations.agg(F.min("image_id")).scalar()  # a key that some row has
    return annotations.fetch_by_key(t.annotations, "image_id", held).select("image_id", "category_id", "scope_id")


@query("deprecate", "SELECT image_id, image_id = 3 AS deprecated FROM annotations")
def _(t):
    return annotations.deprecate(t.annotations.withColumn("deprecated", F.lit(False)), "image_id", 3).select("image_id", "deprecated")


@query("annotation_insert", """SELECT image_id, scope_id, category_id, '"x":' || image_id AS geometry_text, 'me' AS annotator_id FROM annotations""")
def _(t):
    path = scratch_path(t.spark, "annotations")
    new = t.annotations.withColumn("geometry", F.struct(F.col("image_id").alias("x")))
    annotations.annotation_insert(new, path, "me")
    return t.spark.read.parquet(path).select("image_id", "scope_id", "category_id", "geometry_text", "annotator_id")


@query("geometry_json", "SELECT image_id, category_id AS y FROM annotations")
def _(t):
    doc = annotations.geometry_json(F.concat(F.lit('"y":'), F.col("category_id").cast("string")))
    return t.annotations.select("image_id", F.variant_get(doc, "$.y", "int").alias("y"))


@query("image_list_struct", "SELECT doc_id, lang || '.jpg' AS one, source AS two FROM documents")
def _(t):
    s = annotations.image_list_struct(F.array("lang", "source"))
    return t.documents.select("doc_id", s[0]["image"].alias("one"), annotations.image_list_text(s)[1].alias("two"))


@query("categories_join", """SELECT DISTINCT s_suppkey AS class_id, s_name AS class_name, n_nationkey AS facet_id, n_name AS facet_name, r_regionkey AS scope_id,
  r_name AS scope_name, 'BUILDING' AS idmode_id, 'BUILDING' AS idmode_name FROM customer JOIN supplier ON s_suppkey = c_custkey % 50 JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey WHERE c_mktsegment = 'BUILDING' AND s_acctbal > 0""")
def _(t):
    facets = t.nation.select(F.col("n_nationkey").alias("facet_id"), F.col("n_name").alias("facet_name"), F.col("n_regionkey").alias("scope_id"))
    scopes = t.region.select(F.col("r_regionkey").alias("scope_id"), F.col("r_name").alias("scope_name"))
    classes = t.supplier.select(F.col("s_suppkey").alias("class_id"), F.col("s_name").alias("class_name"), F.col("s_nationkey").alias("facet_id"),
                                (F.col("s_acctbal") <= 0).alias("deprecated"))
    modes = t.customer.select((F.col("c_custkey") % 50).alias("class_id"), F.col("c_mktsegment").alias("idmode_id"), F.col("c_mktsegment").alias("idmode_name"))
    return annotations.categories_join(facets, scopes, classes, modes, "BUILDING")


@query("categories_by_mode", "SELECT p_partkey FROM part WHERE p_type = 'SMALL' OR p_brand = 'SMALL'")
def _(t):
    return annotations.categories_by_mode(t.part.withColumn("modes", F.array("p_type", "p_brand")), "SMALL").select("p_partkey")


@query("distinct_idmodes", "SELECT DISTINCT message AS idmode_id, message AS idmode_name FROM product_events WHERE message IS NOT NULL")
def _(t):
    return annotations.distinct_idmodes(t.product_events.select(F.col("message").alias("idmode_id"), F.col("message").alias("idmode_name")))


@query("list_assignments", "SELECT c_custkey AS assignment_id, c_custkey || ': ' || c_name || ' @ ' || c_mktsegment AS label FROM customer")
def _(t):
    rows = t.customer.select(F.col("c_custkey").alias("assignment_id"), F.col("c_name").alias("project_name"), F.col("c_mktsegment").alias("site_description"))
    return annotations.list_assignments(rows).select("assignment_id", "label")


def _imagelist(t):
    return t.bins.select(F.col("ts_label").alias("assignment_id"), F.concat(F.lit("i"), F.col("id").cast("string")).alias("imagename"),
                         F.when(F.col("triggers") > 90, "done").otherwise("new").alias("status"))


IMG = ", il AS (SELECT ts_label AS assignment_id, 'i' || id AS imagename, CASE WHEN triggers > 90 THEN 'done' ELSE 'new' END AS status FROM bins)"


@query("list_images", IMG + "SELECT imagename FROM il WHERE assignment_id = 'view' AND status = 'done' ORDER BY imagename LIMIT 10 OFFSET 2")
def _(t):
    return annotations.list_images(_imagelist(t), "view", 10, 2, "done").select("imagename")


@query("find_image", IMG + """SELECT min(place) AS place FROM (SELECT status, row_number() OVER (ORDER BY imagename) AS place FROM il WHERE assignment_id = 'view')
  WHERE place > 3 AND status = 'done'""")
def _(t):
    return annotations.find_image(_imagelist(t), "view", 3, "done")


@query("set_status", IMG + "SELECT assignment_id, imagename, CASE WHEN imagename = 'i17' AND assignment_id = (SELECT ts_label FROM bins WHERE id = 17) THEN 'seen' ELSE status END AS status FROM il")
def _(t):
    il = _imagelist(t)
    label = t.bins.where("id = 17").agg(F.min("ts_label")).scalar()
    return annotations.set_status(il, label, "i17", "seen")


@query("altitude_metadata_join", "SELECT 'i' || l_partkey AS imagename, p_retailprice AS pitch, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def _(t):
    alt = t.lineitem.select(F.concat(F.lit("i"), F.col("l_partkey").cast("string"), F.lit(".tif")).alias("imagename"))
    meta = t.part.select(F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("imagename"), F.col("p_retailprice").alias("pitch"), F.lit(0.0).alias("roll"))
    return annotations.altitude_metadata_join(alt, meta).groupBy("imagename", "pitch").agg(F.count("*").alias("n"))


@query("every_nth", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY ts_label ORDER BY sample_time) AS rn FROM bins) WHERE (rn - 1) % 7 = 0")
def _(t):
    return annotations.every_nth(t.bins, ["ts_label"], ["sample_time"], 7).select("id")


# -- scores -----------------------------------------------------------------------------------------------------------

LABELS = [f"c{i}" for i in range(64)]
BEST = ", best AS (SELECT img AS roi, CAST(min(i) AS INTEGER) AS k, any_value(m) AS score FROM (SELECT *, max(e) OVER (PARTITION BY img) AS m FROM elements) WHERE e = m GROUP BY 1) "


@query("max_class", BEST + "SELECT roi, CASE WHEN score > 0.3 THEN k ELSE -1 END AS class FROM best")
def _(t):
    return t.scores.select("roi", annotations.max_class(F.col("scores"), 0.3).alias("class"))


@query("class_labels", BEST + "SELECT roi, CASE WHEN score > 0.3 THEN 'c' || k ELSE 'unclassified' END AS label FROM best")
def _(t):
    return t.scores.select("roi", annotations.class_labels(F.col("scores"), LABELS, 0.3).alias("label"))


@query("class_label_score", BEST + "SELECT roi, 'c' || k AS label, score FROM best")
def _(t):
    s = annotations.class_label_score(F.col("scores"), LABELS)
    return t.scores.select("roi", s["label"].alias("label"), s["score"].alias("score"))


@query("class_numbers", BEST + """SELECT r.roi, (CASE WHEN best.roi IS NULL THEN 0 WHEN score > 0.3 THEN k ELSE -1 END)::INTEGER AS class_number FROM
  (SELECT unnest(range((SELECT max(vec_id) * 2 + 1 FROM embeddings))) AS roi) r LEFT JOIN best ON best.roi * 2 = r.roi""")
def _(t):
    return annotations.class_numbers(t.scores.withColumn("roi", F.col("roi") * 2), 0.3)


def _autoclass(t):
    long = t.targets.select(F.concat(F.lit("O"), F.col("bin").cast("string")).alias("bin_lid"), F.concat(F.lit("c"), F.col("trigger").cast("string")).alias("class_label"),
                            F.col("targetNumber").alias("roi"), (F.col("price") / 100000).alias("score"))
    return long


AUTO = ", auto AS (SELECT 'O' || bin AS bin_lid, 'c' || trigger AS class_label, \"targetNumber\" AS roi, price / 100000 AS score FROM targets) "


@query("scores_to_arrays", AUTO + """SELECT bin_lid, class_label, string_agg(roi::VARCHAR, ',' ORDER BY roi) AS rois, count(*)::INTEGER AS n FROM auto WHERE bin_lid NOT IN
  (SELECT 'O' || p_partkey FROM part) GROUP BY 1, 2""")
def _(t):
    done = t.part.select(F.concat(F.lit("O"), F.col("p_partkey").cast("string")).alias("bin_lid"))
    out = annotations.scores_to_arrays(_autoclass(t), done)
    return out.select("bin_lid", "class_label", F.array_join(F.col("roinums").cast("array<string>"), ",").alias("rois"), F.size("scores").alias("n"))


@query("distinct_classes", AUTO + "SELECT DISTINCT class_label FROM auto")
def _(t):
    return annotations.distinct_classes(_autoclass(t))


@query("rois_of_class", AUTO + """SELECT bin_lid || '_' || lpad(roi::VARCHAR, 5, '0') AS pid FROM auto WHERE class_label = 'c1' AND score > 0.2 AND bin_lid IN (SELECT lid FROM obins
  WHERE sample_time BETWEEN '1995-01-01' AND '1997-01-01' ORDER BY sample_time, lid LIMIT 10 OFFSET 10)""")
def _(t):
    stored = annotations.scores_to_arrays(_autoclass(t))
    return annotations.rois_of_class(stored, t.obins, "c1", datetime(1995, 1, 1), datetime(1997, 1, 1), 0.2, page=2)


@query("class_count_by_day", AUTO + """SELECT CAST(sample_time AS DATE) AS day, count(*) AS count FROM auto JOIN obins ON lid = bin_lid WHERE class_label = 'c1' AND
  sample_time BETWEEN '1995-01-01' AND '1997-01-01' GROUP BY 1""")
def _(t):
    stored = annotations.scores_to_arrays(_autoclass(t))
    return annotations.class_count_by_day(stored, t.obins, "c1", datetime(1995, 1, 1), datetime(1997, 1, 1))


@query("autoclass_bins_join", AUTO + "SELECT bin_lid, class_label, sample_time, count(*)::INTEGER AS n FROM auto JOIN obins ON lid = bin_lid GROUP BY 1, 2, 3")
def _(t):
    stored = annotations.scores_to_arrays(_autoclass(t))
    return stored.join(t.obins, F.col("bin_lid") == F.col("lid")).select("bin_lid", "class_label", "sample_time", F.size("roinums").alias("n"))


@query("parallax_altitude", "SELECT p_partkey, 0.235 * 0.012 * 1.25 / (p_size * 0.00000645::DOUBLE) AS altitude FROM part")
def _(t):
    return t.part.select("p_partkey", annotations.parallax_altitude(F.col("p_size")).alias("altitude"))


@query("altitude_or_default", """SELECT p_partkey, CASE WHEN p_size > 20 THEN p_size - 20 ELSE -1 END AS x, CASE WHEN p_size > 20 THEN 0 ELSE -1 END AS y,
  CASE WHEN p_size > 20 THEN 0.235 * 0.012 * 1.25 / ((p_size - 20) * 0.00000645::DOUBLE) ELSE 1.6 END AS altitude FROM part""")
def _(t):
    s = annotations.altitude_or_default(F.col("p_size") - 20)
    return t.part.select("p_partkey", *[s[c].alias(c) for c in ("x", "y", "altitude")])


@query("median_offset", """SELECT bin, CAST(trunc(quantile_cont("left", 0.5)) AS INTEGER) AS "left", CAST(trunc(quantile_cont(bottom, 0.5)) AS INTEGER) AS bottom FROM targets GROUP BY 1""")
def _(t):
    return annotations.median_offset(t.targets, ["bin"], ["left", "bottom"])
