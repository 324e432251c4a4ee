"""Registered rule combinators and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinelog.functions import ids, nested, text, times
from brinelog.operators import ordered, rules
from brinelog.plans.registry import query
from brinelog.session import scratch_path
from brinelog.sources import readers, sinks

L = "l_orderkey, l_linenumber, l_partkey, l_quantity"
LC = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]


@query("project_include", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(t):
    return rules.project_include(t.orders, ["o_orderkey", "o_custkey", "o_orderstatus", "nowhere"], ["o_custkey"])


@query("project_flatten", "SELECT o_orderkey FROM orders")
def _(t):
    return rules.project_include(t.orders, ["o_orderkey", "o_orderstatus"], ["o_orderstatus"])


@query("rename", "SELECT r_regionkey AS key, r_name FROM region")
def _(t):
    return rules.rename(t.region, {"r_regionkey": "key", "absent": "x"})


@query("pre_block", "SELECT c_custkey AS pid, c_name FROM customer")
def _(t):
    return rules.pre_block(t.customer, ["c_custkey", "c_name", "c_acctbal"], ["c_acctbal"], {"c_custkey": "pid"})


@query("post_block", """SELECT p_type, p_size, row_number() OVER (ORDER BY p_type, p_size) AS n
  FROM (SELECT DISTINCT p_type, p_size FROM part)""")
def _(t):
    return rules.post_block(t.part, ["p_type", "p_size"], ["p_type", "p_size"], count="n")


@query("retain", "SELECT o_orderkey, o_orderkey + 1 AS nxt FROM orders")
def _(t):
    return rules.retain(t.orders, t.orders.withColumn("nxt", F.col("o_orderkey") + 1), ["o_orderkey"])


@query("using_args", f"""SELECT {L}, p_type FROM lineitem JOIN part ON l_partkey = p_partkey""")
def _(t):
    rule = lambda a: a.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    return rules.using_args(t.lineitem.select(*LC), ["l_partkey"], rule)


@query("uses_required", """SELECT id, state FROM (SELECT seq AS id, state, message FROM product_events)
  WHERE state IS NOT NULL AND message IS NOT NULL""")
def _(t):
    return rules.uses_required(t.product_events.withColumnRenamed("seq", "id"), ["state", "message"]).select("id", "state")


@query("assign", "SELECT seq, 'job-' || message || '/' || pid AS text FROM product_events WHERE message IS NOT NULL")
def _(t):
    return rules.assign(t.product_events, "text", "job-${message}/${pid}").select("seq", "text")


@query("interpolate", "SELECT seq, 'm=' || coalesce(message, '') || ' s=' || coalesce(state, '') || ' ' AS text FROM product_events")
def _(t):
    e = t.product_events
    return e.select("seq", rules.interpolate("m=${message} s=${state} ${none}", e.columns, fail_fast=False).alias("text"))


@query("substitute_lenient", "SELECT seq, coalesce(message, '${message}') || ' ${none}' AS text FROM product_events")
def _(t):
    e = t.product_events
    return e.select("seq", rules.substitute_lenient("${message} ${none}", e.columns).alias("text"))


@query("assign_values", """SELECT n_nationkey, unnest([n_name, 'D' || n_nationkey, 'flat']) AS dir FROM nation
  JOIN customer ON c_nationkey = n_nationkey""")
def _(t):
    rows = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"))
    return rules.assign_values(rows, "dir", ["${n_name}", "D${n_nationkey}", "flat"]).select("n_nationkey", "dir")


@query("assign_multi", """, v AS (SELECT p_partkey, unnest([1, 2]) AS i FROM part)
SELECT p_partkey, CASE i WHEN 1 THEN p_partkey || '_gray' ELSE p_partkey || '_canny' END AS product,
  CASE i WHEN 1 THEN p_partkey || '' ELSE p_partkey || '_gray' END AS upstream,
  CASE i WHEN 2 THEN 'gray' END AS role FROM v""")
def _(t):
    out = rules.assign_multi(t.part, ["product", "upstream", "role"],
                             ["${p_partkey}_gray,${p_partkey}", "${p_partkey}_canny,${p_partkey}_gray,gray"], ",")
    return out.select("p_partkey", "product", "upstream", "role")


@query("filter_test", f"SELECT {L} FROM lineitem WHERE l_quantity >= 30")
def _(t):
    return rules.filter_test(t.lineitem, F.col("l_quantity"), ge=30).select(*LC)


@query("compare_coerce", """SELECT id, lid, (triggers >= 50) AS num, (lid < 'E5') AS txt FROM bins""")
def _(t):
    return t.bins.select("id", "lid", rules.compare_coerce(F.col("triggers"), "ge", F.lit("50.0")).alias("num"),
                         rules.compare_coerce(F.col("lid"), "lt", F.lit("E5")).alias("txt"))


URL = r"'^(https?)://([^/]+)/(\w+)/(\d+)(?:\?page=(\d+))?'"


@query("filter_match", f"""SELECT page_id, regexp_extract(url, {URL}, 1) AS scheme, regexp_extract(url, {URL}, 2) AS host,
  regexp_extract(url, {URL}, 3) AS lang, regexp_extract(url, {URL}, 4) AS item,
  nullif(regexp_extract(url, {URL}, 5), '') AS page FROM pages WHERE regexp_matches(url, {URL})""")
def _(t):
    pattern = r"(https?)://(?P<host>[^/]+)/(\w+)/(\d+)(?:\?page=(?P<page>\d+))?"
    out = rules.filter_match(t.pages, "url", pattern, ["scheme", "lang", "item"])
    return out.select("page_id", "scheme", "host", "lang", "item", "page")


@query("filter_match_optional", r"SELECT page_id, nullif(regexp_extract(url, 'page=(\d+)', 1), '') AS page FROM pages")
def _(t):
    return rules.filter_match(t.pages, "url", r".*page=(\d+)", ["page"], optional=True).select("page_id", "page")


@query("filter_match_fullvalue", "SELECT p_partkey, p_type FROM part WHERE regexp_full_match(p_type, 'S\\w+')")
def _(t):
    return rules.filter_match(t.part, "p_type", r"S\w+", full=True).select("p_partkey", "p_type")


@query("miss", "SELECT r_name FROM region WHERE false")
def _(t):
    return rules.miss(t.region).select("r_name")


@query("passthrough", "SELECT * FROM region")
def _(t):
    return rules.passthrough(t.region)


@query("hit", "SELECT n_name, NULL::VARCHAR AS r_name FROM nation UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    rest = lambda d: d.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rules.hit(t.nation, rest).select("n_name", "r_name")


@query("slice_default", "SELECT p_partkey, upper(p_name) AS p_name, 'none' AS note FROM part")
def _(t):
    return rules.slice_default(t.part, {"p_partkey": None, "p_name": F.upper, "note": None}, default="none").withColumn(
        "p_partkey", F.col("p_partkey").cast("bigint"))


@query("rename_only", "SELECT p_partkey AS pid, p_type AS kind FROM part")
def _(t):
    return rules.rename_only(t.part, {"p_partkey": "pid", "p_type": "kind", "nothing": "x"})


@query("order_columns", "SELECT * FROM part")
def _(t):
    return rules.order_columns(t.part, ["p_type", "p_partkey"])


@query("tail_column_order", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS \"HOG1\", p_retailprice AS area FROM part")
def _(t):
    wide = t.part.select("p_partkey", F.col("p_size").cast("double").alias("HOG1"), F.col("p_retailprice").alias("area"))
    return wide.select(*rules.tail_columns(["p_partkey", "trigger"], ["HOG1", "area"]))


@query("template_match", "SELECT seq FROM product_events WHERE (state IS NULL OR state = 'click') AND pid = 7")
def _(t):
    return rules.template_match(t.product_events, {"state": "click", "pid": 7, "other": 1}).select("seq")


@query("template_match_regex", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, '(?i)^eco') AND regexp_matches(p_brand, '(?i)BRAND#1')")
def _(t):
    return rules.template_match_regex(t.part, {"p_type": "^eco", "p_brand": "BRAND#1"}).select("p_partkey")


@query("conjunction_all", """SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P'""")
def _(t):
    return rules.conjunction_all(
        t.orders, lambda d: rules.filter_test(d, F.col("o_orderstatus"), eq="P"),
        lambda d: d.join(t.customer, F.col("o_custkey") == F.col("c_custkey")),
        lambda d: d.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))).select("o_orderkey", "c_name", "n_name")


@query("invoke_rule", """SELECT o_orderkey, o_custkey, c_mktsegment AS o_orderstatus FROM orders JOIN customer
  ON c_custkey = o_custkey""")
def _(t):
    rule = lambda a: a.join(t.customer.select(F.col("c_custkey").alias("o_custkey"),
                                              F.col("c_mktsegment").alias("o_orderstatus")), "o_custkey")
    return rules.invoke_rule(t.orders, rule, ["o_custkey"]).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("import_rule", """SELECT s_name, s_nationkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL
  SELECT NULL, n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)""")
def _(t):
    rule = lambda a: a.join(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    return rules.import_rule(t.supplier, rule, ["s_nationkey"], also_hits=True).select("s_name", "s_nationkey", "n_name")


@query("negation_none", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def _(t):
    big = t.orders.where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return rules.negation_none(t.customer, lambda d: d.join(big, "c_custkey"), ["c_custkey"]).select("c_custkey")


@query("union_any", """SELECT p_partkey, p_type AS kind, NULL::INTEGER AS size FROM part UNION ALL
  SELECT p_partkey, NULL, p_size FROM part WHERE p_size > 10""")
def _(t):
    return rules.union_any(t.part, lambda d: d.select("p_partkey", F.col("p_type").alias("kind")),
                           lambda d: d.where("p_size > 10").select("p_partkey", F.col("p_size").alias("size")))


@query("first_branch", """SELECT p_partkey, CASE WHEN p_size > 40 THEN 'big' WHEN p_type = 'SMALL' THEN 'small' ELSE 'rest' END
  AS kind FROM part""")
def _(t):
    return rules.first_branch(t.part, [
        lambda d: d.where("p_size > 40").withColumn("kind", F.lit("big")),
        lambda d: d.where("p_type = 'SMALL'").withColumn("kind", F.lit("small")),
        lambda d: d.withColumn("kind", F.lit("rest"))], ["p_partkey"]).select("p_partkey", "kind")


@query("first_branch_v1", """SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey FROM orders GROUP BY 1""")
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey")
    return rules.first_row(rows, [lambda d: d], ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("first_solution", "SELECT p_partkey, p_name FROM part WHERE p_size = 7 ORDER BY p_partkey LIMIT 1")
def _(t):
    return rules.first_solution(t.part.where("p_size = 7"), ["p_partkey"]).select("p_partkey", "p_name")


@query("distinct_project", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(t):
    return rules.distinct_project(t.lineitem, ["l_returnflag", "l_linestatus"])


@query("merge_store", """SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey NOT IN (SELECT p_partkey FROM part)
  UNION ALL SELECT p_partkey, p_type FROM part""")
def _(t):
    mine = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return rules.merge_store(mine, t.part.select(F.col("p_partkey").alias("k"), F.col("p_type").alias("v")), ["k"])


@query("scope_flatten", "SELECT seq, coalesce(message, 'outer') AS message, 'root' AS root FROM product_events")
def _(t):
    e = t.product_events
    return e.select("seq", *[c.alias(n) for n, c in rules.scope_flatten(
        e.columns, {"message": F.lit("outer"), "root": F.lit("root")}).items()])


@query("coalesce_args", "SELECT seq, coalesce(message, state, event) AS v FROM product_events")
def _(t):
    return t.product_events.select("seq", F.coalesce("message", "state", "event").alias("v"))


@query("rule_function", """SELECT p_partkey, p_type || '/' || p_size AS path FROM part""")
def _(t):
    fn = rules.rule_function(lambda d: rules.assign(d, "path", "${kind}/${size}"), ["kind", "size"])
    return fn(t.part, kind=F.col("p_type"), size=F.col("p_size")).select("p_partkey", "path")


@query("rule_function_positional", """SELECT p_partkey, p_type || '/x' AS path FROM part""")
def _(t):
    fn = rules.rule_function_positional(lambda d: rules.assign(d, "path", "${kind}/${size}"), ["kind", "size"])
    return fn(t.part, F.col("p_type"), "x").select("p_partkey", "path")


@query("row_count", """SELECT l_orderkey, l_partkey, l_shipdate, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate,
  l_orderkey, l_partkey, l_linenumber, l_extendedprice) AS n FROM lineitem""")
def _(t):
    rows = ordered.number_rows(t.lineitem, ["l_returnflag"],
                               ["l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"], out="n")
    return rows.select("l_orderkey", "l_partkey", "l_shipdate", "n")


@query("split_rows", """SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part""")
def _(t):
    return rules.split_rows(t.part, "p_name", "word").select("p_partkey", "word")


@query("split_cols", """SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b,
  string_split(p_name, ' ')[3] AS c FROM part""")
def _(t):
    return rules.split_cols(t.part, "p_name", ["a", "b", "c"]).select("p_partkey", "a", "b", "c")


@query("json_select", """, j AS (SELECT o_orderkey, o_orderstatus, o_custkey, unnest([1, 2]) AS i FROM orders)
SELECT o_orderkey, o_orderkey || '_' || i AS hit FROM j WHERE i = 2 OR o_custkey % 2 = 1""")
def _(t):
    doc = F.to_json(F.struct(F.array(
        F.struct(F.concat_ws("_", F.col("o_orderkey").cast("string"), F.lit("1")).alias("pid"),
                 (F.col("o_custkey") % 2).alias("stitched")),
        F.struct(F.concat_ws("_", F.col("o_orderkey").cast("string"), F.lit("2")).alias("pid"),
                 F.lit(1).alias("stitched"))).alias("targets")))
    rows = t.orders.select("o_orderkey", doc.alias("doc"))
    return nested.json_select(rows, "doc", "targets stitched=1 pid", "hit").select("o_orderkey", "hit")


@query("json_scan", "SELECT id, CAST(triggers AS VARCHAR) AS k FROM bins")
def _(t):
    rows = t.events.select(F.col("event_id").alias("id"), "props")
    return nested.json_select(rows, "props", "k", "k").select("id", "k")


def _catalogue(t):
    """One document per order: a list of two objects with different keys, and a note."""
    key = F.col("o_orderkey").cast("string")
    plain = F.struct(F.concat_ws("_", key, F.lit("1")).alias("pid"), (F.col("o_custkey") % 2).alias("stitched"))
    more = F.struct(F.concat_ws("_", key, F.lit("2")).alias("pid"), F.lit(1).alias("stitched"), F.col("o_orderstatus").alias("status"))
    lists = F.array(F.to_json(plain), F.to_json(more))
    return F.concat(F.lit('{"note": "made", "targets": ['), F.concat_ws(",", lists), F.lit("]}"))


@query("json_scan_open", """, j AS (SELECT o_orderkey, o_orderstatus, o_custkey, unnest([1, 2]) AS i FROM orders)
SELECT o_orderkey, o_orderkey || '_' || i AS pid, CASE i WHEN 1 THEN (o_custkey % 2)::VARCHAR ELSE '1' END AS stitched,
  CASE i WHEN 2 THEN o_orderstatus ELSE 'outer' END AS status FROM j WHERE i = 2 OR o_custkey % 2 = 1""")
def _(t):
    rows = t.orders.select("o_orderkey", F.lit("outer").alias("status"), _catalogue(t).alias("doc"))
    return nested.json_bind(rows, "doc", "targets stitched=1").drop("doc")


@query("json_file_scan", "SELECT 's' || s_suppkey AS pid, s_name AS name, s_acctbal::VARCHAR AS balance FROM supplier")
def _(t):
    """Documents as files, one for each supplier, read whole."""
    doc = F.to_json(F.struct(F.struct(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("pid"), F.col("s_name").alias("name"),
                                      F.col("s_acctbal").cast("string").alias("balance")).alias("supplier")), {"pretty": "true"})
    folder = scratch_path(t.spark, "json-files")
    sinks.write_text_files(t.supplier.select(doc.alias("value"), "s_suppkey"), "s_suppkey", "value", folder)
    return nested.json_bind(readers.json_file_scan(t.spark, folder).select("doc"), "doc", "supplier").drop("doc")


@query("map_recursive", """SELECT p_partkey, p_name || '!' AS name, p_size || '!' AS size FROM part""")
def _(t):
    d = t.part.select("p_partkey", F.struct("p_name", F.array("p_size").alias("sizes")).alias("s"))
    got = nested.map_recursive(lambda c: F.concat(c.cast("string"), F.lit("!")), F.col("s"), d.schema["s"].dataType)
    return d.select("p_partkey", got["p_name"].alias("name"), got["sizes"][0].alias("size"))


@query("struct_roundtrip", """SELECT event_id, '{"k":' || k || '}' AS text, k FROM event_k""")
def _(t):
    s = F.from_json("props", "k int")
    return t.events.select("event_id", nested.struct_roundtrip(F.col("props"), "k int").alias("text"), s["k"].alias("k"))


# -- scalar functions -------------------------------------------------------------------------------------------------

V1 = "'http://x.org/bay1/IFCB' || (o_custkey % 9 + 1) || '_' || strftime(o_orderdate, '%Y_%j_') || '075913'"
V2 = "'http://x.org/bay1/D' || strftime(o_orderdate, '%Y%m%d') || 'T075913_IFCB' || lpad((o_custkey % 900)::VARCHAR, 3, '0')"
ENDS = "['', '_00042', '_00042_blobs.zip', '_features.csv', '.hdr']"


def _pid_rows(t):
    """Identifiers of both layouts with five kinds of tail, built from orders."""
    v1 = F.concat(F.lit("http://x.org/bay1/IFCB"), (F.col("o_custkey") % 9 + 1).cast("string"), F.lit("_"),
                  F.date_format("o_orderdate", "yyyy_DDD_"), F.lit("075913"))
    v2 = F.concat(F.lit("http://x.org/bay1/D"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("T075913_IFCB"),
                  F.lpad((F.col("o_custkey") % 900).cast("string"), 3, "0"))
    end = F.element_at(F.array(*[F.lit(e) for e in ["", "_00042", "_00042_blobs.zip", "_features.csv", ".hdr"]]),
                       (F.col("o_orderkey") % 5 + 1).cast("int"))
    base = F.when(F.col("o_orderkey") % 2 == 0, v1).otherwise(v2)
    return t.orders.select("o_orderkey", "o_custkey", "o_orderdate", F.concat(base, end).alias("pid"), base.alias("bin_pid"))


PIDS = f""", pids AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderkey % 2 = 0 THEN {V1} ELSE {V2} END
  AS bin_pid, {ENDS}[o_orderkey % 5 + 1] AS ending, o_orderkey % 2 = 0 AS one, strftime(o_orderdate, '%Y') AS year,
  substr(bin_pid, 19) AS bin_lid, bin_pid || ending AS pid,
  CASE WHEN o_orderkey % 5 IN (1, 2) THEN '00042' END AS target,
  CASE o_orderkey % 5 WHEN 2 THEN 'blobs' WHEN 3 THEN 'features' ELSE 'raw' END AS product,
  CASE o_orderkey % 5 WHEN 2 THEN 'zip' WHEN 3 THEN 'csv' WHEN 4 THEN 'hdr' END AS extension,
  CASE WHEN one THEN strftime(o_orderdate, '%Y_%j') ELSE strftime(o_orderdate, '%Y%m%d') END AS yearday FROM orders)
"""


@query("parse_pid", PIDS + """SELECT o_orderkey, 'http://x.org/bay1/' AS namespace, 'bay1' AS ts_label, bin_lid,
  bin_lid || coalesce('_' || target, '') AS lid, CASE WHEN one THEN yearday || '_075913' ELSE yearday || 'T075913' END
  AS timestamp, CASE WHEN one THEN 'v1' ELSE 'v2' END AS schema_version, CASE WHEN one THEN
  (o_custkey % 9 + 1)::VARCHAR ELSE lpad((o_custkey % 900)::VARCHAR, 3, '0') END AS instrument, year, yearday, target,
  product, extension FROM pids""")
def _(t):
    return ids.parse_pid(_pid_rows(t)).drop("pid", "bin_pid", "o_custkey", "o_orderdate")


@query("parse_pid_legacy", PIDS + """SELECT o_orderkey, 'bay1' AS time_series, bin_lid, bin_lid || coalesce('_' || target, '')
  AS lid, target, nullif(product, 'raw') AS product, extension, year, CASE WHEN one THEN 'v1' ELSE 'v2' END
  AS schema_version FROM pids""")
def _(t):
    out = ids.parse_pid_legacy(_pid_rows(t))
    return out.select("o_orderkey", "time_series", "bin_lid", "lid", "target", "product", "extension", "year",
                      "schema_version")


IMAGE_SQL = """, images AS (SELECT event_id, ts, 'UN.' || strftime(ts, '%Y%m%d.%H%M%S') || lpad((event_id % 1000)::VARCHAR, 3, '0')
  || '.' || event_id AS imagename FROM events)"""


def _images(t):
    return t.events.select("event_id", "ts", F.concat(
        F.lit("UN."), F.date_format("ts", "yyyyMMdd.HHmmss"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"),
        F.lit("."), F.col("event_id").cast("string")).alias("imagename"))


@query("parse_image_name", IMAGE_SQL + """ SELECT event_id, imagename, strftime(ts, '%Y%m%d') AS ymd, strftime(ts, '%Y%m') AS ym,
  strftime(ts, '%Y') AS y, strftime(ts, '%H%M%S')[1:3] AS tenmin, strftime(ts, '%H') AS h, 'rgb' AS product, 'jpg' AS
  extension, strftime(ts, '%Y%m%d_%H%M')[1:12] || '0' AS img_dir FROM images""")
def _(t):
    rows = _images(t).select("event_id", F.concat("imagename", F.lit("_rgb.jpg")).alias("pid"))
    return ids.parse_image_name(rows).drop("pid", "ts")


@query("parse_image_bin", """SELECT event_id, 'UN.' || strftime(ts, '%Y%m%d.%H%M') AS bin_lid,
  'UN.' || strftime(ts, '%Y%m%d.') || strftime(ts, '%H%M')[1:3] AS prefix, 'json' AS extension FROM events""")
def _(t):
    rows = t.events.select("event_id", F.concat(F.lit("UN."), F.date_format("ts", "yyyyMMdd.HHmm"), F.lit(".json")).alias("pid"))
    return ids.parse_image_bin(rows).drop("pid")


@query("bin_of_image", IMAGE_SQL + "SELECT event_id, strftime(ts, '%Y%m%d_%H%M')[1:12] || '0' AS bin FROM images")
def _(t):
    return _images(t).select("event_id", ids.bin_of_image(F.col("imagename")).alias("bin"))


@query("distinct_bins_of_assignments", IMAGE_SQL + """ SELECT DISTINCT strftime(ts, '%Y%m%d_%H%M')[1:12] || '0' AS bin FROM images
  JOIN labels ON doc_id = event_id WHERE quality = 1""")
def _(t):
    chosen = t.labels.where("quality = 1").select(F.col("doc_id").alias("event_id"))
    return _images(t).join(chosen, "event_id").select(ids.bin_of_image(F.col("imagename")).alias("bin")).distinct()


@query("sql_function", IMAGE_SQL + "SELECT event_id FROM images WHERE regexp_matches(imagename, '(?i)^un\\.20240110')")
def _(t):
    return rules.template_match_regex(_images(t), {"imagename": r"^un\.20240110"}).select("event_id")


@query("image_prefix_lookup", IMAGE_SQL + "SELECT event_id, imagename FROM images WHERE imagename LIKE 'UN.20240110%' ORDER BY imagename LIMIT 1")
def _(t):
    from brinelog.operators import annotations
    return annotations.image_prefix_lookup(_images(t), "UN.20240110.jpg").select("event_id", "imagename")


@query("image_bin_prefix", IMAGE_SQL + "SELECT event_id, imagename FROM images WHERE imagename LIKE 'UN.20240110.11%'")
def _(t):
    from brinelog.operators import annotations
    return annotations.image_bin_prefix(_images(t), "UN.20240110.110").select("event_id", "imagename")


@query("as_product", PIDS + "SELECT o_orderkey, bin_pid || coalesce('_' || target, '') || '_features' AS pid FROM pids")
def _(t):
    p = ids.parse_pid(_pid_rows(t))
    return p.select("o_orderkey", ids.as_product(F.col("namespace"), F.col("lid"), F.lit("features")).alias("pid"))


@query("time_pattern_regex", """SELECT o_orderkey, strftime(o_orderdate, '%Y') AS yyyy, strftime(o_orderdate, '%m') AS mm,
  strftime(o_orderdate, '%d') AS dd, o_orderkey::VARCHAR AS n1 FROM orders""")
def _(t):
    name = F.concat(F.lit("D"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_X"), F.col("o_orderkey").cast("string"))
    rows = t.orders.select("o_orderkey", name.alias("name"))
    return ids.match_time_pattern(rows, "name", "D(yyyymmdd)_X111").drop("name")


@query("remove_extension", r"SELECT page_id, regexp_replace(url, '\.[a-zA-Z][a-zA-Z0-9]*$', '') AS v FROM pages")
def _(t):
    return t.pages.select("page_id", text.remove_extension(F.col("url")).alias("v"))


@query("change_extension", r"SELECT filename || '' AS filename, filename || '.roi' AS v FROM files")
def _(t):
    return t.files.select("filename", text.change_extension(F.concat("filename", F.lit(".adc")), "roi").alias("v"))


@query("relocate", "SELECT page_id, '/new/' || regexp_extract(url, '[^/]*$') || '.x' AS v FROM pages")
def _(t):
    return t.pages.select("page_id", text.relocate(F.concat("url", F.lit(".htm")), "/new", "x").alias("v"))


@query("decamel", """SELECT p_partkey, 'Brand' || upper(substr(p_type, 1, 1)) || ' ' AS v FROM part WHERE false
  UNION ALL SELECT p_partkey, upper(p_type[1]) || lower(p_type[2:]) || ' Camel' FROM part""")
def _(t):
    return t.part.select("p_partkey", text.decamel(F.concat(F.lower("p_type"), F.lit("Camel"))).alias("v"))


@query("rpad_text", "SELECT p_partkey, CASE WHEN length(p_name) < 10 THEN rpad(p_name, 10, '.') ELSE p_name END AS v FROM part")
def _(t):
    return t.part.select("p_partkey", text.rpad_text(F.col("p_name"), 10, ".").alias("v"))


@query("sizeof_fmt", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN length < 1024 THEN printf('%.1fB', length * 1.0::DOUBLE)
  WHEN length < 1048576 THEN printf('%.1fKiB', length / 1024.0::DOUBLE) WHEN length < 1073741824 THEN
  printf('%.1fMiB', length / 1048576.0::DOUBLE) ELSE printf('%.1fGiB', length / 1073741824.0::DOUBLE) END AS v FROM
  (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) * l_partkey AS length FROM lineitem)""")
def _(t):
    size = F.floor("l_extendedprice") * F.col("l_partkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", text.sizeof_fmt(size).alias("v"))


CSVN = r"regexp_replace(regexp_replace(printf('%.12f', {}), '0+$', ''), '\.$', '')"


@query("csv_number", f"SELECT id, {CSVN.format('duration')} AS v FROM bins")
def _(t):
    return t.bins.select("id", text.csv_number(F.col("duration")).alias("v"))


@query("csv_quote", r"""SELECT id, CASE WHEN regexp_matches(v, '^-?[0-9]*(\.[0-9]+)?$') THEN v ELSE '"' || v || '"' END AS v
  FROM (SELECT id, CASE WHEN id % 3 = 0 THEN lid ELSE duration::VARCHAR END AS v FROM bins)""")
def _(t):
    v = F.when(F.col("id") % 3 == 0, F.col("lid")).otherwise(F.col("duration").cast("string"))
    return t.bins.select("id", text.csv_quote(v).alias("v"))


@query("canonicalize", "SELECT id, 'http://x.org/' || ts_label || '/' || lid AS pid FROM bins")
def _(t):
    return t.bins.select("id", ids.canonicalize("http://x.org/", F.col("ts_label"), F.col("lid")).alias("pid"))


@query("target_pid", "SELECT id, lid || '_' || CASE WHEN id < 100000 THEN lpad(id::VARCHAR, 5, '0') ELSE id::VARCHAR END AS pid FROM bins")
def _(t):
    return t.bins.select("id", ids.target_pid(F.col("lid"), F.col("id")).alias("pid"))


@query("add_pids", """SELECT bin, "targetNumber", 'O' || bin AS "binID", 'O' || bin || '_' || lpad("targetNumber"::VARCHAR, 5, '0') AS pid FROM targets""")
def _(t):
    out = ids.add_pids(t.targets, F.concat(F.lit("O"), F.col("bin").cast("string")))
    return out.select("bin", "targetNumber", "binID", "pid")


@query("lid_of_url", "SELECT page_id, regexp_extract(url, '[^/]*$') AS lid FROM pages")
def _(t):
    return t.pages.select("page_id", ids.lid_of_url(F.col("url")).alias("lid"))


@query("fix_url", "SELECT page_id, url FROM pages")
def _(t):
    return t.pages.select("page_id", ids.fix_url(F.regexp_replace("url", "//", "/")).alias("url"))


@query("product_file_name", "SELECT id, lid || '_fea_v2.csv' AS name FROM bins")
def _(t):
    url = F.concat(F.lit("http://x.org/a/"), F.col("lid"), F.lit(".csv"))
    return t.bins.select("id", ids.product_file_name(url).alias("name"))


@query("path_params", """SELECT id, triggers::VARCHAR AS size, lid AS bin, '1' AS page FROM bins""")
def _(t):
    path = F.concat_ws("/", F.lit(""), F.lit("size"), F.col("triggers").cast("string"), F.lit("bin"), F.col("lid"))
    m = ids.path_params(path, {"page": "1", "size": "9"})
    return t.bins.select("id", *[m[k].alias(k) for k in ("size", "bin", "page")])


@query("sha1", "SELECT doc_id, sha1(text) AS v FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha1("text").alias("v"))


@query("md5", "SELECT doc_id, md5(text) AS v FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5("text").alias("v"))


@query("gen_id", "SELECT count(*) AS n, count(*) AS n_distinct, 47 AS len FROM events")
def _(t):
    made = t.events.select(text.gen_id("http:x/").alias("v"))
    return made.groupBy("v").agg(F.count("*").alias("c")).agg(
        F.sum("c").alias("n"), F.count("*").alias("n_distinct"), F.max(F.length("v")).alias("len"))


@query("iso8601ms", "SELECT id, strftime(sample_time, '%Y-%m-%dT%H:%M:%S.%gZ') AS v FROM bins")
def _(t):
    return t.bins.select("id", times.iso8601ms(F.col("sample_time")).alias("v"))


@query("rfc822", "SELECT id, strftime(sample_time, '%a, %d %b %Y %H:%M:%S +0000') AS v FROM bins")
def _(t):
    return t.bins.select("id", times.rfc822(F.col("sample_time")).alias("v"))


@query("parse_time", "SELECT o_orderkey, o_orderdate + INTERVAL 28753 SECOND AS v1, o_orderdate + INTERVAL 28753 SECOND AS v2 FROM orders")
def _(t):
    one = F.concat(F.date_format("o_orderdate", "yyyy_DDD"), F.lit("_075913"))
    two = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("T075913"))
    return t.orders.select("o_orderkey", times.parse_time(one, times.PID_V1_TIME).alias("v1"),
                           times.parse_time(two, times.PID_V2_TIME).alias("v2"))


@query("parse_date_param", """SELECT id, CASE id % 5 WHEN 0 THEN date_trunc('day', sample_time)
  WHEN 1 THEN date_trunc('second', sample_time) WHEN 2 THEN date_trunc('second', sample_time)
  WHEN 3 THEN sample_time END AS v FROM bins""")
def _(t):
    ts = F.col("sample_time")
    shown = F.when(F.col("id") % 5 == 0, F.date_format(ts, "yyyy-MM-dd")).when(
        F.col("id") % 5 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(
        F.col("id") % 5 == 2, times.iso8601(ts)).when(
        F.col("id") % 5 == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise(F.lit("yesterday"))
    return t.bins.select("id", times.parse_date_param(shown).alias("v"))


@query("epoch_to_utc", "SELECT event_id, TIMESTAMP '1970-01-01' + to_seconds(event_id * 86399) AS v FROM events")
def _(t):
    return t.events.select("event_id", times.epoch_to_utc(F.col("event_id") * 86399).alias("v"))


@query("as_utc", "SELECT id, date_trunc('second', sample_time) AS v FROM bins")
def _(t):
    return t.bins.select("id", times.as_utc(F.col("sample_time")).alias("v"))


@query("local_to_utc", "SELECT id, sample_time + INTERVAL 5 HOUR AS v, sample_time - INTERVAL 5 HOUR AS back FROM bins")
def _(t):
    ts = F.col("sample_time")
    return t.bins.select("id", times.local_to_utc(ts, "America/New_York").alias("v"),
                         times.utc_to_local(ts, "America/New_York").alias("back"))


@query("message_prefix", "SELECT id, strftime(sample_time, '%Y-%m-%dT%H:%M:%SZ') || ' ' || lid AS v FROM bins")
def _(t):
    return t.bins.select("id", times.message_prefix(F.col("lid"), F.col("sample_time")).alias("v"))


@query("make_time", "SELECT id, date_trunc('second', sample_time) AS v FROM bins")
def _(t):
    ts = F.col("sample_time")
    parts = [F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts)]
    return t.bins.select("id", times.make_time(*[p.cast("double") + 0.25 for p in parts]).alias("v"))


@query("add_seconds", "SELECT id, make_timestamp(epoch_us(sample_time) + CAST(round(duration * 1000000) AS BIGINT)) AS v FROM bins")
def _(t):
    return t.bins.select("id", times.add_seconds(F.col("sample_time"), F.col("duration")).alias("v"))


@query("utc_text", "SELECT id, strftime(sample_time, '%Y-%m-%dT%H:%M:%SZ') AS v FROM bins")
def _(t):
    return t.bins.select("id", times.utc_text(F.col("sample_time")).alias("v"))
