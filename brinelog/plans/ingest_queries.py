"""Registered sources, ingest, stitching, file and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinelog.functions import ids
from brinelog.operators import files, ingest, ordered, stitching
from brinelog.plans.registry import query
from brinelog.session import scratch_path
from brinelog.sources import readers, sinks

TC = ["bin", "targetNumber", "trigger", "left", "bottom", "width", "height"]
TS = 'bin, "targetNumber", trigger, "left", bottom, width, height'


def _lines_v2(t):
    """Target lines of the second layout: path = bin, n = target number."""
    r = t.targets
    zero = F.col("part") % 11 == 0  # some targets without an image
    order = dict(trigger="trigger", processingEndTime="price", bottom="bottom", left="left", byteOffset="byteOffset")
    fields = []
    for c in readers.ADC_V2_COLUMNS:
        if c == "width":
            fields.append(F.when(zero, F.lit("0")).otherwise(F.col("width").cast("string")))
        elif c == "height":
            fields.append(F.col("height").cast("string"))
        elif c in order:
            fields.append(F.col(order[c]).cast("string"))
        else:
            fields.append(F.lit("0.5" if readers.ADC_V2_TYPES[readers.ADC_V2_COLUMNS.index(c)] == "double" else "1"))
    return r.select(F.col("bin").cast("string").alias("path"), F.col("targetNumber").alias("n"),
                    F.concat_ws(",", *fields, F.lit("extra")).alias("line"))


ADC = ', adc AS (SELECT CAST(bin AS VARCHAR) AS path, "targetNumber", CAST(trigger AS INTEGER) AS trigger, price AS "processingEndTime", ' \
      'CAST(bottom AS INTEGER) AS bottom, CAST("left" AS INTEGER) AS "left", CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) ' \
      'AS height, part FROM targets WHERE part % 11 <> 0 AND width * height > 0) '
AC = 'path, "targetNumber", trigger, "processingEndTime", bottom, "left", width, height'
ACOLS = ["path", "targetNumber", "trigger", "processingEndTime", "bottom", "left", "width", "height"]


@query("adc_scan", ADC + f"SELECT {AC} FROM adc")
def _(t):
    return readers.adc_scan(_lines_v2(t)).select(*ACOLS)


@query("adc_scan_v1", ADC + f"""SELECT path, "targetNumber", trigger, "processingEndTime" + 0.0 AS "processingEndTime", width, height,
  CAST(0.25 AS DOUBLE) AS "valveStatus" FROM adc""")
def _(t):
    cells = {"trigger": "trigger", "processingEndTime": "price", "width": "width", "height": "height"}
    fields = [F.col(cells[c]).cast("string") if c in cells else F.lit("0.25" if y == "double" else "3")
              for c, y in zip(readers.ADC_V1_COLUMNS, readers.ADC_V1_TYPES)]
    rows = t.targets.where("part % 11 <> 0").select(F.col("bin").cast("string").alias("path"), F.col("targetNumber").alias("n"),
                                                    F.concat_ws(",", *fields).alias("line"))
    return readers.adc_scan(rows, "v1").select("path", "targetNumber", "trigger", "processingEndTime", "width", "height",
                                               "valveStatus")


@query("adc_rule_targets", ADC + f"SELECT {AC} FROM adc")
def _(t):
    return readers.adc_rule_targets(_lines_v2(t)).select(*ACOLS)


@query("adc_slice", ADC + f'SELECT {AC} FROM adc WHERE "targetNumber" BETWEEN 2 AND 3')
def _(t):
    return readers.adc_slice(_lines_v2(t), 2, 2).select(*ACOLS)


@query("adc_target", ADC + f"""SELECT {AC} FROM adc WHERE path = (SELECT min(path) FROM adc WHERE "targetNumber" = 2)
  AND "targetNumber" = 2""")
def _(t):
    lines = _lines_v2(t)
    first = readers.adc_scan(lines).where("targetNumber = 2").agg(F.min("path")).scalar()
    return readers.adc_scan(lines.where((F.col("n") == 2) & (F.col("path") == first))).select(*ACOLS)


@query("target_number", 'SELECT bin, part, price, "targetNumber" FROM targets')
def _(t):
    return t.targets.select("bin", "part", "price", "targetNumber")


@query("csv_scan_positional", "SELECT l_orderkey, CAST(n AS BIGINT) AS n, l_partkey, l_quantity FROM (SELECT *, row_number() OVER "
       "(PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS n FROM lineitem) WHERE n BETWEEN 2 AND 4")
def _(t):
    rows = ordered.number_rows(t.lineitem, ["l_orderkey"], ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"],
                               ordered.block_slice("l_partkey"), out="n")
    lines = rows.select(F.col("l_orderkey").alias("path"), "n", F.concat_ws(
        ",", F.col("l_partkey").cast("string"), F.col("l_quantity").cast("string"), F.lit("x")).alias("line"))
    out = readers.csv_scan_positional(lines, "l_partkey bigint, l_quantity double", 1, 3)
    return out.withColumnRenamed("path", "l_orderkey")


@query("cast_truncate", "SELECT p_partkey, p_size, p_retailprice FROM part")
def _(t):
    lines = t.part.select(F.lit("part").alias("path"), (F.col("p_partkey") + 1).alias("n"), F.concat_ws(
        ",", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"), F.lit("extra")).alias("line"))
    return readers.cast_truncate(lines, "p_size int, p_retailprice double").select((F.col("n") - 1).alias("p_partkey"), "p_size",
                                                                                   "p_retailprice")


def _written(t, df, name, fmt="csv", **options):
    path = scratch_path(t.spark, name)
    df.write.format(fmt).options(**options).save(path)
    return path


@query("csv_scan", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name FROM part")
def _(t):
    path = _written(t, t.part.select("p_partkey", "p_name"), "csv", header="true")
    return readers.csv_scan(t.spark, path).select("p_partkey", "p_name")


@query("lines_scan", "SELECT p_name AS _ FROM part")
def _(t):
    return readers.lines_scan(t.spark, _written(t, t.part.select(F.concat("p_name", F.lit("  "))), "lines", "text"))


@query("line_slice", "SELECT name, n, text FROM (SELECT p_brand AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, "
       "p_name AS text FROM part) WHERE n BETWEEN 3 AND 6")
def _(t):
    numbered = ordered.number_rows(t.part, ["p_brand"], ["p_partkey"], ordered.block_slice("p_partkey"), out="n")
    lines = numbered.select(F.col("p_brand").alias("path"), "n", F.col("p_name").alias("line"))
    return readers.line_slice(lines, 2, 4).select(F.col("path").alias("name"), "n", F.col("line").alias("text"))


@query("byte_slice", "SELECT doc_id, from_hex(substr(hex(encode(text)), 21, 60)) AS part FROM documents")
def _(t):
    return t.documents.select("doc_id", readers.byte_slice(F.col("text"), 10, 30).alias("part"))


@query("path_scan")
def _(t):
    listing = readers.path_scan(t.spark, t.sf_dir, "*.parquet", recursive=True)
    return listing.select(F.substring_index("path", "/", -1).alias("name"), "length")


@query("file_fixity")
def _(t):
    return readers.file_fixity(t.spark, t.sf_dir, recursive=True).select("filename", "length", "sha1")


# Targets of a task: pixels of more than 65,536 groups leave Spark's small map of sums for one several times slower.
SCANNED_TARGETS = 1 << 15


@query("roi_pixels_scan")
def _(t):
    # The bytes of a stored table serve as image file: its files end to end, again and again, so that every target lies in them.
    listing = readers.path_scan(t.spark, f"{t.sf_dir}/orders.parquet", recursive=True).select("path", "length").collect()
    # The image file of a bin begins at the byte of the bin's number.
    keys = ["bin", "targetNumber"]
    placed = t.targets.select(*keys, (F.col("byteOffset") + F.col("bin")).alias("byteOffset"), "width", "height")
    dealt = ordered.spread(placed, keys, t.targets.count(), SCANNED_TARGETS)
    pixels = readers.roi_pixels_scan(dealt.withColumn("path", F.lit("orders")), keys, {"orders": [tuple(r) for r in listing]})
    return pixels.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def _hdr_lines(t):
    """Header files in three layouts, one per order."""
    o = t.orders
    key, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string")
    kv = F.array(F.lit("softwareVersion: 1.0"), F.concat(F.lit("temperature: "), price),
                 F.concat(F.lit("humidity: "), (F.col("o_custkey") / 4).cast("string")),
                 F.concat(F.lit("sampleTime: "), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit("no pair here"))
    quoted = F.array(F.lit('"made"'), F.concat(F.lit('"for '), key, F.lit('"')), F.lit('"by"'), F.lit('"hand"'),
                     F.lit('"Temp  Humidity  BinarizeThresh"'),
                     F.concat(F.lit('"'), price, F.lit('  '), (F.col("o_custkey") / 4).cast("string"), F.lit(' , 17"')))
    fixed = F.array(F.lit(readers.FIXED_HDR_LINE), F.lit("ignored"))
    lines = F.when(F.col("o_orderkey") % 3 == 0, kv).when(F.col("o_orderkey") % 3 == 1, quoted).otherwise(fixed)
    return o.select(key.alias("path"), F.posexplode(lines).alias("n", "line")).withColumn("n", F.col("n") + 1)


@query("hdr_scan", """SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 3 < 2 THEN o_totalprice END AS temperature,
  CASE WHEN o_orderkey % 3 < 2 THEN o_custkey / 4 END AS humidity,
  CASE WHEN o_orderkey % 3 = 1 THEN 17 END AS "binarizeThreshold" FROM orders""")
def _(t):
    return readers.hdr_typed(readers.hdr_scan(_hdr_lines(t))).select("path", "temperature", "humidity", "binarizeThreshold")


@query("split_hdr", """, c AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN ['softwareVersion: 1.0']
  WHEN 1 THEN ['made', 'for ' || o_orderkey, 'by', 'hand'] ELSE ['Imaging FlowCytobot Acquisition Software version 2.0; May 2010'] END
  AS lines, CASE o_orderkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 3 ELSE 0 END AS n_props FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS path, unnest(lines) AS text, n_props::BIGINT AS n_props FROM c""")
def _(t):
    context, props = readers.split_hdr(readers.hdr_scan(_hdr_lines(t)))
    n = props.groupBy("path").agg(F.count("*").alias("n_props"))
    return context.join(n, "path", "left").select("path", "text", F.coalesce("n_props", F.lit(0)).alias("n_props"))


@query("fileset_listing", """SELECT 'O' || bin_id AS lid, '/d/O' || bin_id || '.hdr' AS hdr_path, '/d/O' || bin_id || '.adc' AS adc_path,
  '/d/O' || bin_id || '.roi' AS roi_path FROM files GROUP BY bin_id HAVING count(DISTINCT filetype % 3) = 3""")
def _(t):
    return files.fileset_listing(_listing(t))


def _listing(t):
    """Files of bins; the line number picks the file type."""
    ext = F.element_at(F.array(F.lit("hdr"), F.lit("adc"), F.lit("roi")), F.col("filetype") % 3 + 1)
    return t.files.select(F.concat(F.lit("/d/O"), F.col("bin_id").cast("string"), F.lit("."), ext).alias("path"))


@query("fileset_complete", "SELECT bin_id, count(DISTINCT filetype % 3) = 3 AS complete FROM files GROUP BY 1")
def _(t):
    ext = F.element_at(F.array(F.lit("hdr"), F.lit("adc"), F.lit("roi")), F.col("filetype") % 3 + 1)
    return files.fileset_complete(t.files.withColumn("ext", ext), "bin_id")


@query("table_scan_store", "SELECT p_partkey FROM part WHERE p_type = 'SMALL' AND p_size = 7")
def _(t):
    return t.part.where((F.col("p_type") == "SMALL") & (F.col("p_size") == 7)).select("p_partkey")


@query("table_create", "SELECT p_type, p_size, count(*) AS n FROM part GROUP BY 1, 2")
def _(t):
    path = scratch_path(t.spark, "table")
    sinks.table_create(t.part.groupBy("p_type", "p_size").agg(F.count("*").alias("n")), path)
    return t.spark.read.parquet(path)


@query("table_exists_rows", "SELECT count(*) > 0 AS found FROM part WHERE p_size > 49")
def _(t):
    return t.part.where("p_size > 49").limit(1).agg((F.count("*") > 0).alias("found"))


@query("table_insert", "SELECT p_partkey, p_name, NULL::INTEGER AS p_size FROM part UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def _(t):
    path = scratch_path(t.spark, "insert")
    names, types = ["p_partkey", "p_name", "p_size"], {"p_size": "int"}
    sinks.table_insert(t.part.select("p_partkey", "p_name"), path, names, types)
    sinks.table_insert(t.supplier.toDF("p_partkey", "p_name", "p_size", "bal"), path, names, types)
    return t.spark.read.parquet(path)


@query("bulk_load", "SELECT seq, state, message FROM product_events")
def _(t):
    path = _written(t, t.product_events.select("seq", "state", "message"), "bulk", nullValue="NULL")
    return readers.bulk_load(t.spark, path, "seq bigint, state string, message string")


@query("import_manual", """SELECT 'http://x.org/' || 'b' || p_size || '_' || p_partkey AS image, p_type AS category,
  p_brand AS annotator FROM part""")
def _(t):
    path = _written(t, t.part.select(F.concat(F.lit("b"), F.col("p_size").cast("string"), F.lit(".mat")), "p_partkey",
                                     "p_type", "p_brand"), "manual")
    return readers.import_manual(t.spark, path, "http://x.org/").select("image", "category", "annotator")


@query("import_manual_list", "SELECT p_name AS lid, p_type AS category, p_brand AS annotator FROM part")
def _(t):
    return readers.import_manual_list(t.spark, _written(t, t.part.select("p_name", "p_type", "p_brand"), "list"))


@query("scores_long", "SELECT img AS roi, CAST(i AS INTEGER) AS class, e AS score FROM elements")
def _(t):
    return readers.scores_long(t.scores).select("roi", "class", "score")


@query("cruise_track_scan", "SELECT date_trunc('second', ts) AS ts, latitude, longitude FROM fixes")
def _(t):
    ts = F.col("ts")
    names = ("year", "month", "day", "hour", "minute", "second")
    parts = (F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts))
    return readers.cruise_track_scan(t.fixes.withColumns(dict(zip(names, parts))))


@query("vehicle_table_scan", "SELECT p_partkey AS \"LineNo\", p_size AS \"Roll\", p_retailprice AS \"Pitch\" FROM part")
def _(t):
    return readers.vehicle_table_scan(t.part.select("p_partkey", "p_size", "p_retailprice"), ["LineNo", "Roll", "Pitch"])


@query("image_line_lookup", "SELECT p_name AS line FROM part WHERE p_name = 'red widget'")
def _(t):
    rows = t.part.select(F.col("p_name"), F.concat("p_name", F.lit(".tif,7")).alias("line"))
    return readers.image_line_lookup(rows, "red widget").select(F.col("p_name").alias("line"))


# -- stitching and integrity ------------------------------------------------------------------------------------------

PAIRS = """, sides AS (SELECT *, lag("targetNumber") OVER w AS pn, lag(trigger) OVER w AS pt, lag("left") OVER w AS pl, lag(bottom) OVER w AS pb,
  lag(width) OVER w AS pw, lag(height) OVER w AS ph, lag("byteOffset") OVER w AS po FROM targets
  WINDOW w AS (PARTITION BY bin ORDER BY "targetNumber")),
over AS (SELECT *, coalesce(trigger = pt AND "left" < pl + pw AND "left" + width > pl AND bottom < pb + ph AND bottom + height > pb, false)
  AS closes FROM sides),
marked AS (SELECT *, coalesce(lead(closes) OVER w, false) AS opens, lead("left") OVER w AS nl, lead(bottom) OVER w AS nb,
  lead(width) OVER w AS nw, lead(height) OVER w AS nh FROM over WINDOW w AS (PARTITION BY bin ORDER BY "targetNumber")),
stitched AS (SELECT bin, "targetNumber", CASE WHEN opens THEN least("left", nl) ELSE "left" END AS "left",
  CASE WHEN opens THEN least(bottom, nb) ELSE bottom END AS bottom,
  CASE WHEN opens THEN greatest("left" + width, nl + nw) - least("left", nl) ELSE width END AS width,
  CASE WHEN opens THEN greatest(bottom + height, nb + nh) - least(bottom, nb) ELSE height END AS height,
  CAST(opens AS INTEGER) AS stitched FROM marked WHERE NOT closes) """


@query("box_overlap", PAIRS + 'SELECT bin, "targetNumber" FROM over WHERE closes')
def _(t):
    return stitching.find_pairs(t.targets).select("bin", F.col("second").alias("targetNumber"))


@query("find_pairs", PAIRS + 'SELECT bin, pn AS first, "targetNumber" AS second FROM over WHERE closes')
def _(t):
    return stitching.find_pairs(t.targets)


@query("list_stitched_targets", PAIRS + "SELECT * FROM stitched")
def _(t):
    return stitching.list_stitched_targets(t.targets).select("bin", "targetNumber", "left", "bottom", "width", "height", "stitched")


@query("stitched_box", """SELECT bin, min("left") AS "left", min(bottom) AS bottom, max("left" + width) - min("left") AS width,
  max(bottom + height) - min(bottom) AS height FROM targets GROUP BY 1""")
def _(t):
    return stitching.group_box(t.targets, ["bin"])


@query("stitch_composite", """, two AS (SELECT img // 2 AS grp, img % 2 AS ord, img % 5 AS l, img % 3 AS b, y, x, v FROM pixels),
placed AS (SELECT grp, ord, l + x AS x, b + y AS y, v FROM two),
top AS (SELECT grp, x, y, arg_max(v, ord) AS v FROM placed GROUP BY ALL),
box AS (SELECT grp, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM placed GROUP BY 1),
canvas AS (SELECT grp, x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM box))
SELECT canvas.grp, canvas.x, canvas.y, coalesce(v, 0) AS v FROM canvas LEFT JOIN top USING (grp, x, y)""")
def _(t):
    px = t.pixels.select(F.floor(F.col("img") / 2).alias("grp"), (F.col("img") % 2).alias("ord"), "x", "y", "v")
    boxes = t.embeddings.select(F.floor(F.col("vec_id") / 2).alias("grp"), (F.col("vec_id") % 2).alias("ord"),
                                (F.col("vec_id") % 5).alias("left"), (F.col("vec_id") % 3).alias("bottom"),
                                F.lit(8).cast("bigint").alias("width"), F.lit(8).cast("bigint").alias("height"))
    return stitching.stitch_composite(px, boxes, ["grp"], "ord")


@query("bin_targets", PAIRS + """SELECT bin, "targetNumber", stitched, 'O' || bin || '_' || lpad("targetNumber"::VARCHAR, 5, '0') AS pid FROM stitched""")
def _(t):
    pid = F.concat(F.lit("O"), F.col("bin").cast("string"))
    return ingest.bin_targets(t.targets, pid, stitched=True).select("bin", "targetNumber", "stitched", "pid")


@query("prev_next_pid", """SELECT bin, "targetNumber", lag(pid) OVER w AS prev_pid, lead(pid) OVER w AS next_pid FROM
  (SELECT *, 'T' || "targetNumber" AS pid FROM targets) WINDOW w AS (PARTITION BY bin ORDER BY "targetNumber")""")
def _(t):
    rows = t.targets.withColumn("pid", F.concat(F.lit("T"), F.col("targetNumber").cast("string")))
    return ingest.prev_next_pid(rows).select("bin", "targetNumber", "prev_pid", "next_pid")


@query("prev_next_pid_v1", """SELECT bin, "targetNumber", lag(pid) OVER w AS prev_pid, lead(pid) OVER w AS next_pid FROM
  (SELECT supp AS bin, row_number() OVER (PARTITION BY supp ORDER BY part, bin, price) AS "targetNumber", 'T' || part AS pid FROM targets)
  WINDOW w AS (PARTITION BY bin ORDER BY "targetNumber")""")
def _(t):
    rows = t.targets.select(F.col("supp").alias("bin"), F.col("bin").alias("o"), "part", "price",
                            F.concat(F.lit("T"), F.col("part").cast("string")).alias("pid"))
    rows = ordered.number_rows(rows, ["bin"], ["part", "o", "price"], ordered.block_slice("part", 100), out="targetNumber")
    return ingest.prev_next_pid(rows).select("bin", "targetNumber", "prev_pid", "next_pid")


INTEGRITY = """, pairs AS (SELECT bin, count(*) FILTER (trigger = pt) AS pairs, count(*) FILTER (trigger = pt AND bottom = pb AND "left" = pl)
  AS colocated FROM sides GROUP BY 1),
roi AS (SELECT bin, bool_or(coalesce("byteOffset" < po + pw * ph, false)) AS non_monotonic, max("byteOffset" + width * height) >
  max(100 + bin * 2) AS too_long FROM sides GROUP BY 1) """


@query("pair_integrity", PAIRS + INTEGRITY + "SELECT *, NOT (pairs > 0 AND pairs = colocated) AS adc_ok FROM pairs")
def _(t):
    return ingest.pair_integrity(t.targets)


def _roi_files(t):
    return t.targets.select("bin").distinct().withColumn("length", 100 + F.col("bin") * 2)


@query("byte_offset_check", PAIRS + INTEGRITY + "SELECT *, NOT non_monotonic AND NOT too_long AS roi_ok FROM roi")
def _(t):
    return ingest.byte_offset_check(t.targets, _roi_files(t))


@query("last_line_metrics", """SELECT CAST(bin AS VARCHAR) AS path, CAST(arg_max(trigger, "targetNumber") AS INTEGER) AS triggers,
  arg_max(price, "targetNumber") AS duration, CASE WHEN bin % 3 < 2 THEN any_value(o_totalprice) END AS temperature
  FROM targets LEFT JOIN orders ON o_orderkey = bin GROUP BY bin""")
def _(t):
    hdr = readers.hdr_typed(readers.hdr_scan(_hdr_lines(t)))
    return ingest.last_line_metrics(_lines_v2(t), hdr).drop("humidity")


STATUS = PAIRS + INTEGRITY + """, st AS (SELECT 'O' || pairs.bin AS lid, CASE WHEN pairs.bin IN (SELECT p_partkey FROM part) THEN 'EXISTS' WHEN
  (pairs = 0 OR pairs <> colocated) AND NOT non_monotonic AND NOT too_long THEN 'ADDED' ELSE 'FAILED' END AS status
  FROM pairs JOIN roi USING (bin)) """


def _statuses(t):
    lid = F.concat(F.lit("O"), F.col("bin").cast("string"))
    checks = ingest.integrity(t.targets, _roi_files(t)).select(lid.alias("lid"), "ok")
    known = t.part.select(F.concat(F.lit("O"), F.col("p_partkey").cast("string")).alias("lid"))
    return ingest.accession_status(t.targets.select(lid.alias("lid")).distinct(), known, checks)


@query("accession_status", STATUS + "SELECT * FROM st")
def _(t):
    return _statuses(t)


@query("accession_summary", STATUS + "SELECT status, count(*) AS n FROM st GROUP BY 1")
def _(t):
    return ingest.accession_summary(_statuses(t))


@query("new_filesets", "SELECT 'O' || o_orderkey AS lid FROM orders WHERE o_orderkey NOT IN (SELECT p_partkey FROM part) "
       "AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def _(t):
    known = t.part.select(F.concat(F.lit("O"), F.col("p_partkey").cast("string")).alias("lid"))
    there = t.files.select(F.concat(F.lit("O"), F.col("bin_id").cast("string")).alias("lid"))
    return ingest.new_filesets(t.obins.select("lid"), known, there)


def _lid_products(t):
    kind = F.when(F.col("p_size") % 2 == 0, "blobs").otherwise("features")
    a = t.part.select(F.concat(F.lit("E"), F.col("p_partkey").cast("string")).alias("lid"), F.lit("blobs").alias("product"))
    return a.unionByName(t.part.select(F.concat(F.lit("E"), F.col("p_partkey").cast("string")).alias("lid"), kind.alias("product")))


@query("missing_blobs", "SELECT lid FROM bins WHERE id NOT IN (SELECT p_partkey FROM part)")
def _(t):
    return ingest.missing_blobs(t.bins, _lid_products(t)).select("lid")


@query("missing_features", "SELECT lid FROM bins JOIN part ON id = p_partkey WHERE p_size % 2 = 0")
def _(t):
    return ingest.missing_features(t.bins, _lid_products(t)).select("lid")


@query("copy_plan", """, dirs AS (SELECT n_regionkey, n_name FROM nation WHERE n_nationkey % 2 = 0)
SELECT lid, unnest(['/i/' || lid || '.hdr', '/i/' || lid || '.adc', '/i/' || lid || '.roi']) AS source,
  '/' || n_name || '/' || lid || unnest(['.hdr', '.adc', '.roi']) AS destination FROM obins JOIN dirs ON owner % 5 = n_regionkey
  WHERE id NOT IN (SELECT p_partkey FROM part)""")
def _(t):
    paths = {f"{e}_path": F.concat(F.lit("/i/"), F.col("lid"), F.lit(f".{e}")) for e in files.EXTENSIONS}
    sets = t.obins.withColumn("instrument", (F.col("owner") % 5).cast("string")).withColumns(paths)
    known = t.part.select(F.concat(F.lit("O"), F.col("p_partkey").cast("string")).alias("lid"))
    instruments = t.region.select(F.col("r_regionkey").cast("string").alias("name"), F.col("r_regionkey").alias("time_series_id"))
    return ingest.copy_plan(sets, known, instruments, _data_dirs(t).withColumn("product_type", F.lit("raw")))


def _data_dirs(t):
    kinds = F.element_at(F.array(F.lit("raw"), F.lit("blobs"), F.lit("features")), F.col("n_nationkey") % 3 + 1)
    return t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("time_series_id"),
                           kinds.alias("product_type"), F.concat(F.lit("/"), F.col("n_name")).alias("path"),
                           (F.col("n_nationkey") % 2 == 0).alias("destination"), F.col("n_nationkey").alias("priority"))


def _series(t):
    return t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("label"),
                           (F.col("r_regionkey") > 0).alias("enabled"))


@query("data_roots", """SELECT '/' || n_name AS path, n_nationkey AS priority FROM nation JOIN region ON n_regionkey = r_regionkey
  WHERE r_name = 'ASIA' AND n_nationkey % 3 = 0""")
def _(t):
    return files.data_roots(_series(t), _data_dirs(t), "ASIA")


@query("accepts_products", "SELECT count(*) > 0 AS accepts FROM nation WHERE n_regionkey > 0 AND n_nationkey % 3 = 1")
def _(t):
    return files.accepts_products(_series(t), _data_dirs(t), "blobs")


def _parsed(t):
    base = t.orders.select("o_orderkey", F.concat(
        F.lit("http://x.org/"), F.element_at(F.array(*[F.lit(r) for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")]),
                                             (F.col("o_custkey") % 5 + 1).cast("int")), F.lit("/D"),
        F.date_format("o_orderdate", "yyyyMMdd"), F.lit("T075913_IFCB"), F.lpad((F.col("o_orderkey") % 900).cast("string"), 3, "0"),
        F.lit("_features.csv")).alias("pid"))
    return ids.parse_pid(base)


PARSED = """, parsed AS (SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y%m%d') AS yearday,
  'D' || strftime(o_orderdate, '%Y%m%d') || 'T075913_IFCB' || lpad((o_orderkey % 900)::VARCHAR, 3, '0') AS bin_lid,
  ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'][o_custkey % 5 + 1] AS label FROM orders),
cand AS (SELECT o_orderkey, unnest(range(9)) AS prio, unnest(['/r/' || year || '/D' || yearday || '/' || f, '/r/' || f, '/r/D' || yearday || '/' || f,
  '/r/' || year || '/D' || year || '/D' || yearday || '/' || f, '/r/' || f, '/r/D' || year || '/D' || yearday || '/' || f,
  '/r/' || year || '/' || year || '/' || yearday || '/' || f, '/r/' || f, '/r/' || year || '/' || yearday || '/' || f]) AS file_path
  FROM (SELECT *, bin_lid || '.csv' AS f FROM parsed)) """


@query("file_path_candidates", PARSED + "SELECT o_orderkey, CAST(prio AS INTEGER) AS prio, file_path FROM cand")
def _(t):
    rows = _parsed(t).withColumn("root", F.lit("/r"))
    return files.file_path_candidates(rows).select("o_orderkey", "prio", "file_path")


@query("raw_destination", PARSED + "SELECT o_orderkey, file_path FROM cand WHERE prio = 0")
def _(t):
    rows = _parsed(t).withColumn("root", F.lit("/r"))
    return files.raw_destination(rows).select("o_orderkey", "file_path")


LISTED = PARSED + """, listing AS (SELECT DISTINCT file_path AS path FROM cand WHERE o_orderkey % 4 = prio % 4 AND prio NOT IN (1, 4, 7)) """


def _cand_listing(t):
    """Existing files: some candidates of the orders themselves."""
    rows = _parsed(t).withColumn("root", F.lit("/r"))
    there = F.filter(files.raw_paths(), lambda p, i: (F.col("o_orderkey") % 4 == i % 4) & ~i.isin(1, 4, 7))
    return rows.select(F.explode(there).alias("path")).distinct()


@query("raw_file_find", LISTED + """SELECT o_orderkey, arg_min(file_path, prio) AS file_path FROM cand WHERE file_path IN
  (SELECT path FROM listing) GROUP BY 1""")
def _(t):
    return files.raw_file_find(_parsed(t).withColumn("root", F.lit("/r")), _cand_listing(t), ["o_orderkey"])


def _fileset_files(t, roots=("/r",)):
    """Raw files of orders below the roots; the line number picks type and root."""
    ext = F.element_at(F.array(F.lit("hdr"), F.lit("adc"), F.lit("roi")), F.col("l_linenumber") % 3 + 1)
    root = F.element_at(F.array(*[F.lit(r) for r in roots]), (F.col("l_partkey") % len(roots) + 1).cast("int"))
    rows = _parsed(t).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.concat(root, F.lit("/"), F.col("year"), F.lit("/D"), F.col("yearday"), F.lit("/"), F.col("bin_lid"),
                                F.lit("."), ext).alias("path")).distinct()


SETS = PARSED + """, have AS (SELECT o_orderkey, bin_lid, year, yearday, ['/a', '/b'][l_partkey % 2 + 1] AS root, l_linenumber % 3 AS e
  FROM parsed JOIN lineitem ON l_orderkey = o_orderkey),
paths AS (SELECT DISTINCT bin_lid, root, e, root || '/' || year || '/D' || yearday || '/' || bin_lid AS base FROM have),
complete AS (SELECT bin_lid, root, any_value(base) AS base FROM paths GROUP BY 1, 2 HAVING count(DISTINCT e) = 3) """


@query("fileset_multi_root", SETS + """SELECT o_orderkey, min(base) || '.hdr' AS hdr_path, min(base) || '.adc' AS adc_path,
  min(base) || '.roi' AS roi_path FROM parsed JOIN complete USING (bin_lid) GROUP BY 1""")
def _(t):
    roots = F.explode(F.array(F.struct(F.lit("/a").alias("root"), F.lit(0).alias("root_order")),
                              F.struct(F.lit("/b").alias("root"), F.lit(1).alias("root_order"))))
    rows = _parsed(t).withColumn("_r", roots).select("*", "_r.*").drop("_r")
    return files.fileset_multi_root(rows, _fileset_files(t, ("/a", "/b")), ["o_orderkey"])


@query("raw_fileset_find", SETS + """, one AS (SELECT bin_lid, min(yearday) AS yearday, min(year) AS year FROM have GROUP BY bin_lid HAVING count(DISTINCT e) = 3)
SELECT o_orderkey, base || '.hdr' AS hdr_path, base || '.adc' AS adc_path, base || '.roi' AS roi_path FROM
  (SELECT o_orderkey, '/r/' || p.year || '/D' || p.yearday || '/' || p.bin_lid AS base FROM parsed p JOIN one USING (bin_lid))""")
def _(t):
    rows = _parsed(t).withColumn("root", F.lit("/r"))
    return files.raw_fileset_find(rows, _fileset_files(t), ["o_orderkey"])


@query("list_raw_filesets", SETS + """SELECT bin_lid AS lid, base || '.hdr' AS hdr_path, base || '.adc' AS adc_path, base || '.roi' AS roi_path
  FROM complete WHERE root = '/a'""")
def _(t):
    return files.list_raw_filesets(_fileset_files(t, ("/a", "/b")), "/a")


@query("union_roots", SETS + "SELECT bin_lid AS lid, base || '.hdr' AS hdr_path, base || '.adc' AS adc_path, base || '.roi' AS roi_path FROM complete")
def _(t):
    return files.union_roots(_fileset_files(t, ("/a", "/b")), ["/a", "/b"])


@query("validate_data_dir", "SELECT '/a' AS root UNION ALL SELECT '/b'")
def _(t):
    listing = _fileset_files(t, ("/a", "/b"))
    roots = listing.select(F.substring_index("path", "/", 2).alias("root"))
    return files.validate_data_dir(listing, roots, "raw")


@query("find_data_dirs", SETS + ", dirs AS (SELECT DISTINCT root FROM paths) SELECT root AS directory, 'raw' AS product FROM dirs "
       "UNION ALL SELECT root, 'blobs' FROM dirs")
def _(t):
    raw = _fileset_files(t, ("/a", "/b"))
    blob = raw.select(F.regexp_replace("path", r"^(/\w+/\d+)/D(\d+)/([^/.]+)\..*$", "$1/$2/$3_blobs_v2.zip").alias("path"))
    return files.find_data_dirs(raw.union(blob))


@query("product_path_candidates", PARSED + """SELECT o_orderkey, count(*) AS n, '/r/features' || any_value(p.year) || '_v2/' || any_value(p.bin_lid) ||
  '_fea_v2.csv' AS best FROM parsed p, range(22) GROUP BY 1""")
def _(t):
    # Candidates of a key stay in the task that makes them: the minimum of a text needs them sorted, a bounded number at a time.
    parsed = ordered.spread(_parsed(t), ["o_orderkey"], t.orders.count() * 22)
    rows = files.product_path_candidates(parsed.withColumn("root", F.lit("/r")))
    return rows.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.min_by("file_path", "prio").alias("best"))


PRODUCTS = PARSED + """, store AS (SELECT DISTINCT bin_lid, o_orderkey % 2 AS v, '/r/' || bin_lid || CASE WHEN o_orderkey % 2 = 0 THEN '_fea_v2.csv'
  ELSE '_fea_v4.csv' END AS path FROM parsed WHERE o_orderkey % 3 = 0) """


def _product_listing(t, root="/r/"):
    name = F.when(F.col("o_orderkey") % 2 == 0, "_fea_v2.csv").otherwise("_fea_v4.csv")
    return _parsed(t).where("o_orderkey % 3 = 0").select(F.concat(F.lit(root), F.col("bin_lid"), name).alias("path")).distinct()


@query("product_find", PRODUCTS + "SELECT o_orderkey, arg_min(path, v) AS product_path FROM parsed JOIN store USING (bin_lid) GROUP BY 1")
def _(t):
    return files.product_find(_parsed(t).withColumn("root", F.lit("/r")), _product_listing(t), ["o_orderkey"])


@query("product_find_multi_root", PRODUCTS + "SELECT o_orderkey, replace(arg_min(path, v), '/r/', '/b/') AS product_path FROM parsed JOIN store "
       "USING (bin_lid) GROUP BY 1")
def _(t):
    roots = F.explode(F.array(F.struct(F.lit("/a").alias("root"), F.lit(0).alias("root_order")),
                              F.struct(F.lit("/b").alias("root"), F.lit(1).alias("root_order"))))
    rows = _parsed(t).withColumn("_r", roots).select("*", "_r.*").drop("_r")
    return files.product_find_multi_root(rows, _product_listing(t, "/b/"), ["o_orderkey"])


@query("product_destination", PARSED + """, roots AS (SELECT r_name AS label, '/' || arg_min(n_name, n_nationkey) AS root FROM nation JOIN region
  ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 2 GROUP BY 1)
SELECT o_orderkey, root || '/features' || year || '_v2/' || bin_lid || '_fea_v2.csv' AS destination FROM parsed JOIN roots USING (label)""")
def _(t):
    return files.product_destination(_parsed(t), _series(t), _data_dirs(t)).select("o_orderkey", "destination")


@query("check_roots", "SELECT '/' || n_name AS path, n_nationkey < 9 AS found FROM nation WHERE n_nationkey % 3 = 0")
def _(t):
    listing = t.nation.where("n_nationkey < 9").join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("/"), F.col("n_name"), F.lit("/"), F.col("c_name"), F.lit(".hdr")).alias("path"))
    return files.check_roots(_data_dirs(t), listing)


# -- fixity -----------------------------------------------------------------------------------------------------------

def _recorded(t):
    return t.documents.select(F.col("doc_id").alias("path"), F.col("n_chars").alias("length"), F.sha1("text").alias("sha1"),
                              F.lit("2020-01-01").cast("timestamp_ntz").alias("fix_time"))


def _observed(t):
    """Some files are gone, some have another length or content, some were touched."""
    k = F.col("doc_id") % 7
    later = F.when(k.isin(3, 4), F.lit("2021-01-01")).otherwise(F.lit("2019-01-01")).cast("timestamp_ntz")
    return t.documents.where(k != 1).select(
        F.col("doc_id").alias("path"), (F.col("n_chars") + F.when(k == 2, 5).otherwise(0)).alias("length"),
        F.when(k == 3, F.lit("changed")).otherwise(F.sha1("text")).alias("sha1"), later.alias("mtime"))


@query("fixity_check", """SELECT doc_id AS path, doc_id % 7 <> 1 AS exists, doc_id % 7 NOT IN (1, 2) AS length_ok,
  doc_id % 7 NOT IN (1, 3) AS checksum_ok FROM documents""")
def _(t):
    return files.fixity_check(_recorded(t), _observed(t)).select("path", "exists", "length_ok", "checksum_ok")


@query("fixity_compare", """SELECT doc_id AS path, CASE doc_id % 7 WHEN 1 THEN 'file is missing' WHEN 2 THEN 'file was ' || n_chars ||
  ' bytes at fix time of 2020-01-01T00:00:00Z, but is ' || (n_chars + 5) || ' bytes as of 2019-01-01T00:00:00Z'
  WHEN 3 THEN 'file modified at 2021-01-01T00:00:00Z, after fix date of 2020-01-01T00:00:00Z'
  WHEN 4 THEN 'file touched at 2021-01-01T00:00:00Z, after fix date of 2020-01-01T00:00:00Z, but checksums match' END AS reason
  FROM documents""")
def _(t):
    return files.fixity_compare(_recorded(t), _observed(t)).select("path", "reason")


@query("fixity_status", """SELECT doc_id AS path, CASE doc_id % 7 WHEN 1 THEN 'existence' WHEN 2 THEN 'size' WHEN 3 THEN 'checksum' ELSE 'ok' END
  AS status FROM documents""")
def _(t):
    return files.fixity_status(_recorded(t), _observed(t)).select("path", "status")


@query("compare_files", "SELECT doc_id AS id, doc_id % 7 NOT IN (1, 2, 3) AS same FROM documents")
def _(t):
    def side(d):
        return d.withColumn("id", F.col("path")).withColumn("path", F.concat(F.lit("/x/"), F.col("path").cast("string")))
    asked = t.documents.select(F.col("doc_id").alias("id"))
    return files.compare_files(asked, side(_recorded(t)), side(_observed(t)), "id", size=True, checksum=True)


@query("filename_signature_count", r""", names AS (SELECT regexp_extract(url, '[^/]*$') AS name, regexp_extract(name, '\.[a-zA-Z][a-zA-Z0-9]*$') AS ext,
  CASE WHEN ext <> '' THEN regexp_replace(name, '\.[a-zA-Z][a-zA-Z0-9]*', '', 'g') ELSE name END AS stem FROM pages),
shapes AS (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(stem, '[a-z]+', 'a', 'g'), '[A-Z]+', 'A', 'g'),
  '[a-zA-Z]{2,}', 'B', 'g'), '[0-9]+', '9', 'g') || ext AS shape FROM names)
SELECT shape, count(*) AS n FROM shapes GROUP BY 1 HAVING count(*) > (SELECT count(*) FROM shapes) / 500.0""")
def _(t):
    return files.filename_signature_count(t.pages, "url")


SIM = """, cut AS (SELECT substr(path, 2) AS s FROM (SELECT 'p' || p_size || 'abcd' || p_size || 'abcd' || p_type || '----------' AS path FROM part)),
whole AS (SELECT substr(s, 1 + (SELECT max(k) FROM range(40) r(k) WHERE (SELECT count(DISTINCT substr(s, 1, k)) FROM cut) = 1)) AS s FROM cut),
sim AS (SELECT length(s) AS n, i, j, avg((substr(s, i + 1, 1) = substr(s, j + 1, 1))::INT) AS share FROM whole, range(40) a(i), range(40) b(j)
  WHERE i < length(s) AND j < length(s) GROUP BY ALL) """


def _similarity(t):
    size = F.col("p_size").cast("string")
    paths = t.part.select(F.concat(F.lit("p"), size, F.lit("abcd"), size, F.lit("abcd"), F.col("p_type"), F.lit("-" * 10)).alias("path"))
    return files.path_self_similarity(paths)


@query("path_self_similarity", SIM + "SELECT n, i, j, share FROM sim")
def _(t):
    return _similarity(t)


RUNS = SIM + """, cells AS (SELECT n, j - i AS d, j, (share {test})::INT AS good FROM sim WHERE j > i AND j >= j - i AND i >= 0 AND j < n - (j - i)),
isl AS (SELECT *, sum(1 - good) OVER (PARTITION BY n, d ORDER BY j) AS island FROM cells),
runs AS (SELECT n, d, island, sum(good) AS run, min(j) FILTER (good = 1) AS start FROM isl GROUP BY 1, 2, 3),
lasts AS (SELECT n, d, max(island) AS m FROM runs GROUP BY 1, 2)
SELECT n, CAST(run AS BIGINT) AS run, start - d AS a, start AS b FROM runs JOIN lasts USING (n, d) WHERE island < m AND run > {longer}"""


@query("diagonal_runs", RUNS.format(test=">= 1", longer=2))
def _(t):
    return files.diagonal_runs(_similarity(t))


@query("diagonal_runs_tol", RUNS.format(test="> 0.15", longer=2))
def _(t):
    return files.diagonal_runs(_similarity(t), 0.15, strict=True)


# -- targets ----------------------------------------------------------------------------------------------------------

@query("tiles_by_area", f"SELECT {TS}, width * height AS area FROM targets")
def _(t):
    return ingest.tiles_by_area(t.targets).select(*TC, "area")


@query("targets_features_join", 'SELECT bin, "targetNumber", f_size, f_price FROM targets JOIN features ON roi_number = "targetNumber"')
def _(t):
    return ingest.targets_features_join(t.targets, t.features).select("bin", "targetNumber", "f_size", "f_price")


@query("scatter_points", 'SELECT bin, "targetNumber", "left" AS x, f_price AS y FROM targets JOIN features ON roi_number = "targetNumber"')
def _(t):
    return ingest.scatter_points(t.targets, t.features, "left", "f_price")


@query("roi_feature_row", """SELECT '{"roi_number":7,"f_size":' || p_size || ',"f_price":' || p_retailprice || '}' AS json FROM part WHERE p_partkey = 7""")
def _(t):
    return ingest.roi_feature_row(t.features, 7)


@query("rois_columnar", """, p AS (SELECT *, 'O' || bin || '_' || lpad("targetNumber"::VARCHAR, 5, '0') AS pid FROM targets)
SELECT bin, unnest(['targetNumber', 'pid', 'height', 'width']) AS name, "targetNumber" AS at,
  unnest(["targetNumber"::VARCHAR, pid, height::VARCHAR, width::VARCHAR]) AS value FROM p""")
def _(t):
    return ingest.rois_columnar(ids.add_pids(t.targets, F.concat(F.lit("O"), F.col("bin").cast("string"))))


@query("bad_stitch_audit", PAIRS + """, raw AS (SELECT bin, count(*) AS n_raw FROM targets GROUP BY 1), kept AS (SELECT bin, count(*) AS n_kept FROM stitched
  GROUP BY 1), prod AS (SELECT bin, CASE WHEN bin % 3 = 0 THEN n_kept END AS z, CASE WHEN bin % 2 = 0 THEN n_kept END AS b FROM kept)
SELECT bin, product IS NOT NULL AS stitched, product FROM (SELECT bin, CASE WHEN bin % 5 <> 0 AND n_kept < n_raw THEN
  CASE WHEN z < n_raw THEN 'binzip' WHEN b < n_raw THEN 'blobs' END END AS product FROM raw JOIN kept USING (bin) JOIN prod USING (bin))""")
def _(t):
    kept = stitching.list_stitched_targets(t.targets).groupBy("bin").agg(F.count("*").alias("rows"))
    rows = kept.where("bin % 3 = 0").withColumn("product", F.lit("binzip")).unionByName(
        kept.where("bin % 2 = 0").withColumn("product", F.lit("blobs")))
    versions = t.targets.select("bin").distinct().withColumn("schema_version", F.when(F.col("bin") % 5 == 0, "v1").otherwise("v2"))
    return ingest.bad_stitch_audit(t.targets, rows, versions)


@query("resume_anti_join", "SELECT p_name || p_partkey AS imagename, CASE WHEN p_partkey % 2 = 0 THEN 1.6 ELSE p_retailprice END AS alt FROM part")
def _(t):
    named = t.part.withColumn("imagename", F.concat("p_name", F.col("p_partkey").cast("string")))
    done = named.where("p_partkey % 2 = 0").select("imagename", F.lit(1.6).alias("alt"))
    return ingest.resume_anti_join(named, done, lambda d: d.select("imagename", F.col("p_retailprice").alias("alt")))


@query("insert_if_absent", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT p_partkey FROM part)")
def _(t):
    table = t.part.select(F.col("p_partkey").alias("o_orderkey"))
    return ingest.insert_if_absent(table, t.orders.select("o_orderkey"), ["o_orderkey"])


# -- sinks ------------------------------------------------------------------------------------------------------------

CSVN = r"regexp_replace(regexp_replace(printf('%.12f', {}::DOUBLE), '0+$', ''), '\.$', '')"


@query("csv_sink", f""", b AS (SELECT *, 'O' || bin AS bid, bid || '_' || lpad("targetNumber"::VARCHAR, 5, '0') AS pid FROM targets)
SELECT bin AS doc, 0 AS section, 0::BIGINT AS n, 'left,width,price,binID,pid,stitched,targetNumber' AS text FROM targets GROUP BY bin
UNION ALL SELECT bin, 1, "targetNumber", {CSVN.format('"left"')} || ',' || {CSVN.format('width')} || ',' || {CSVN.format('price')} ||
  ',"' || bid || '","' || pid || '",0,' || {CSVN.format('"targetNumber"')} FROM b""")
def _(t):
    rows = ingest.bin_targets(t.targets, F.concat(F.lit("O"), F.col("bin").cast("string")))
    return sinks.csv_rows(rows, ["left", "width", "price"])


def _documents(t):
    """Bins, context lines, properties and targets for the document sinks."""
    pid = F.concat(F.lit("http://x.org/O"), F.col("o_orderkey").cast("string"))
    bins = t.orders.select(pid.alias("pid"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    context = t.orders.select(pid.alias("pid"), F.lit(1).alias("n"), F.col("o_orderpriority").alias("text"))
    props = t.orders.select(pid.alias("pid"), F.lit(2).alias("n"), F.lit("air temp").alias("key"),
                            F.col("o_totalprice").cast("bigint").cast("string").alias("value"))
    bin_pid = F.concat(F.lit("http://x.org/O"), F.col("bin").cast("string"))
    targets = ids.add_pids(t.targets, bin_pid).select(F.col("binID").alias("bin_pid"), F.col("targetNumber").alias("n"), "pid", "width")
    return bins, context, props, targets


DOCS = """, d AS (SELECT 'http://x.org/O' || o_orderkey AS doc, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS date, o_orderpriority AS ctx,
  CAST(trunc(o_totalprice) AS BIGINT)::VARCHAR AS price FROM orders),
tt AS (SELECT 'http://x.org/O' || bin AS doc, "targetNumber" AS n, 'http://x.org/O' || bin || '_' || lpad("targetNumber"::VARCHAR, 5, '0') AS pid,
  width FROM targets) """
X = ('xmlns:dcterms="http://purl.org/dc/terms/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns="urn:sample-bins:terms#"')


@query("xml_sink_bin", DOCS + f"""SELECT doc, 0 AS section, 0::BIGINT AS n, '<Bin {X}>' || chr(10) || '  <dc:identifier>' || doc || '</dc:identifier>' || chr(10)
  || '  <dc:date>' || date || '</dc:date>' AS text FROM d UNION ALL SELECT doc, 1, 1, '  <context>' || ctx || '</context>' FROM d
UNION ALL SELECT doc, 2, 2, '  <air_temp>' || price || '</air_temp>' FROM d
UNION ALL SELECT doc, 3, n, '  <Target dc:identifier="' || pid || '"/>' FROM tt UNION ALL SELECT doc, 4, 0, '</Bin>' FROM d""")
def _(t):
    return sinks.xml_bin_lines(*_documents(t))


@query("rdf_sink_bin", DOCS + f"""SELECT doc, 1 AS section, 1::BIGINT AS n, '    <context>' || ctx || '</context>' AS text FROM d
UNION ALL SELECT doc, 0, 0, '<rdf:RDF {sinks.RDF_TERMS} xmlns="{sinks.DEFAULT_TERMS}">' || chr(10) || '  <Bin rdf:about="' || doc || '">' || chr(10) ||
  '    <dc:date>' || date || '</dc:date>' FROM d
UNION ALL SELECT doc, 3, 0, '    <dcterms:hasPart>' || chr(10) || '      <rdf:Seq rdf:about="' || doc || '/targets">' FROM d
UNION ALL SELECT doc, 5, 0, '      </rdf:Seq>' || chr(10) || '    </dcterms:hasPart>' || chr(10) || '  </Bin>' || chr(10) || '</rdf:RDF>' FROM d
UNION ALL SELECT doc, 2, 2, '    <air_temp>' || price || '</air_temp>' FROM d
UNION ALL SELECT doc, 4, n, '        <rdf:li>' || chr(10) || '          <Target rdf:about="' || pid || '"/>' || chr(10) || '        </rdf:li>' FROM tt""")
def _(t):
    return sinks.rdf_bin_lines(*_documents(t))


JS = """SELECT doc, 0 AS section, 0::BIGINT AS n, '{"pid":"' || doc || '","date":"' || date || '"' AS text FROM d UNION ALL
SELECT doc, 1, 2, ',"air temp":"' || price || '"' FROM d UNION ALL SELECT doc, 2, 0, ',"context":[' FROM d UNION ALL
SELECT doc, 3, 1, '"' || ctx || '"' FROM d UNION ALL """


@query("json_sink_short", DOCS + JS + "SELECT doc, 4, 0, ']}' FROM d")
def _(t):
    b, c, p, _x = _documents(t)
    return sinks.json_bin_lines(b, c, p)


JT = """SELECT doc, 4, 0, '],"targets":[' FROM d UNION ALL SELECT doc, 6, 0, ']}' FROM d UNION ALL
SELECT doc, 5, n, CASE WHEN n > 1 THEN ',' ELSE '' END || """


@query("json_sink_medium", DOCS + JS + JT + """'"' || pid || '"' FROM tt""")
def _(t):
    return sinks.json_bin_lines(*_documents(t))


@query("json_sink_full", DOCS + JS + JT + """'{"pid":"' || pid || '","width":' || width || '}' FROM tt""")
def _(t):
    return sinks.json_bin_lines(*_documents(t), full=True)


@query("xml_sink_target", DOCS + f"""SELECT pid, '<Target {X} number="' || n || '">' || chr(10) || '  <dc:identifier>' || pid || '</dc:identifier>' || chr(10) ||
  '  <dc:date>2020</dc:date>' || chr(10) || '  <width>' || width || '</width>' || chr(10) || '  <dcterms:hasFormat>' || pid ||
  '.png</dcterms:hasFormat>' || chr(10) || '  <dcterms:isPartOf>' || doc || '</dcterms:isPartOf>' || chr(10) || '</Target>' AS text FROM tt""")
def _(t):
    rows = ids.add_pids(t.targets, F.concat(F.lit("http://x.org/O"), F.col("bin").cast("string")))
    return sinks.xml_target(rows, ["width"], F.lit("2020"), F.col("binID"))


@query("scores_csv_sink", """SELECT img AS roi, 'B_' || lpad(img::VARCHAR, 5, '0') || ',' || replace(string_agg(printf('%.6f', e), ',' ORDER BY i),
  '0.000000', '0.0') AS text FROM elements GROUP BY 1
UNION ALL SELECT NULL, 'pid,' || (SELECT string_agg('c' || i, ',' ORDER BY i) FROM range(64) c(i))""")
def _(t):
    return sinks.scores_csv_rows(t.scores, F.lit("B"), [f"c{i}" for i in range(64)] + ["unclassified"])


@query("scores_csv_sink_slow", """SELECT img AS roi, '"B_' || lpad(img::VARCHAR, 5, '0') || '",' || string_agg(regexp_replace(printf('%.4f', e), '000$', ''), ','
  ORDER BY i) AS text FROM elements GROUP BY 1
UNION ALL SELECT NULL, 'pid,' || (SELECT string_agg('c' || i, ',' ORDER BY i) FROM range(64) c(i))""")
def _(t):
    return sinks.scores_csv_rows_short(t.scores, F.lit("B"), [f"c{i}" for i in range(64)])


@query("scores_export_sharded", """SELECT 'B' || img || ',c' || arg_max(i, e) || ',' || img || ',' || printf('%.2f', max(e)) AS value FROM elements GROUP BY img""")
def _(t):
    path = scratch_path(t.spark, "shards")
    lid = F.concat(F.lit("B"), F.col("roi").cast("string"))
    sinks.write_shards(sinks.score_export_lines(t.scores, lid, [f"c{i}" for i in range(64)]), path)
    return t.spark.read.text(path)


KML = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"'


@query("kml_track_sink", f"""SELECT 'track' AS doc, 0 AS section, 0::BIGINT AS n, '{KML}
 xmlns:gx="http://www.google.com/kml/ext/2.2">
<Document>
  <name>Vehicle track</name>
  <Placemark>
    <gx:Track>' AS text WHERE EXISTS (FROM fixes)
UNION ALL SELECT 'track', 3, 0, '    </gx:Track>
  </Placemark>
</Document>
</kml>' WHERE EXISTS (FROM fixes)
UNION ALL SELECT 'track', 2, epoch_us(ts), '      <gx:coord>' || longitude || ' ' || latitude || ' 0</gx:coord>' FROM fixes
UNION ALL SELECT 'track' AS doc, 1 AS section, epoch_us(ts) AS n, '      <when>' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '</when>' AS text FROM fixes""")
def _(t):
    return sinks.kml_track_lines(t.fixes.withColumn("doc", F.lit("track")), "doc")


@query("kml_bins_sink", f"""SELECT DISTINCT ts_label AS doc, 0 AS section, 0::BIGINT AS n, '{KML}>
<Document>
  <name>Sample runs</name>
  <Style id="redstyle">
    <IconStyle>
      <color>ff0000ff</color>
      <scale>0.5</scale>
      <Icon><href>http://www.gstatic.com/mapspro/images/stock/962-wht-diamond-blank.png</href></Icon>
    </IconStyle>
  </Style>' AS text FROM bins
UNION ALL SELECT DISTINCT ts_label, 2, 0, '</Document>
</kml>' FROM bins
UNION ALL SELECT ts_label AS doc, 1 AS section, epoch_us(sample_time) AS n, '  <Placemark>' || chr(10) || '    <name>' || lid || '</name>' || chr(10) ||
  '    <styleUrl>#redstyle</styleUrl>' || chr(10) || '    <TimeStamp><when>' || strftime(sample_time, '%Y-%m-%dT%H:%M:%SZ') || '</when></TimeStamp>' ||
  chr(10) || '    <Point><coordinates>' || -triggers || ',' || triggers || ',0</coordinates></Point>' || chr(10) ||
  '    <description><![CDATA[<a href="http://x.org/' || lid || '.html">' || lid || '</a>]]></description>' || chr(10) || '  </Placemark>' AS text FROM bins""")
def _(t):
    rows = t.bins.select("ts_label", F.concat(F.lit("http://x.org/"), "lid").alias("pid"), F.col("sample_time").alias("ts"),
                         F.col("triggers").alias("latitude"), (-F.col("triggers")).alias("longitude"))
    return sinks.kml_bin_lines(rows, "ts_label")


@query("eic_sink", """SELECT p_name || p_partkey AS imagename, p_name || p_partkey || ' ' || p_size || ' 0.0 0.0' AS text FROM part WHERE p_partkey NOT IN
  (SELECT s_suppkey FROM supplier)""")
def _(t):
    name = F.concat("p_name", F.col("p_partkey").cast("string"))
    meta = t.part.select(F.concat(name, F.lit(".tif")).alias("imagename"), F.col("p_size").alias("alt"),
                         F.lit(0.0).alias("pitch"), F.lit(0.0).alias("roll"))
    skip = t.part.join(t.supplier, F.col("p_partkey") == F.col("s_suppkey"), "left_semi").select(name.alias("imagename"))
    return sinks.eic_lines(meta, skip)


@query("deposit_product", "SELECT p_partkey, p_name FROM part")
def _(t):
    path = scratch_path(t.spark, "deposit")
    sinks.deposit_product(t.part.select("p_partkey", "p_name"), path)
    return t.spark.read.parquet(path)
