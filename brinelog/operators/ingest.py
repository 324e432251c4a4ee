"""Integrity and accession of filesets, bin metrics, and work still to be done."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelog.functions.ids import add_pids
from brinelog.operators import ordered
from brinelog.operators.stitching import list_stitched_targets

# Product edges of a new bin as (product, upstream product, role).
BIN_PRODUCTS = [("binzip", "raw", "raw2binzip"), ("webcache", "binzip", "binzip2webcache"),
                ("blobs", "binzip", "binzip2blobs"), ("features", "blobs", "blobs2features")]


def bin_targets(targets: DataFrame, bin_pid: Column, stitched: bool = False) -> DataFrame:
    rows = list_stitched_targets(targets) if stitched else targets.withColumn("stitched", F.lit(0))
    return add_pids(rows, bin_pid)


def _with_previous(targets: DataFrame, names: Sequence[str]) -> DataFrame:
    return ordered.neighbours(targets, ["bin"], ["targetNumber"], ordered.block_slice("targetNumber"),
                              prev={c: f"p_{c}" for c in names})


PREVIOUS = ["trigger", "bottom", "left", "byteOffset", "width", "height"]


def _pair_counts() -> list[Column]:
    same = F.col("trigger") == F.col("p_trigger")
    there = same & (F.col("bottom") == F.col("p_bottom")) & (F.col("left") == F.col("p_left"))
    return [F.count_if(same).alias("pairs"), F.count_if(there).alias("colocated")]


def _offset_facts() -> list[Column]:
    behind = F.col("p_byteOffset") + F.col("p_width") * F.col("p_height")
    back = F.coalesce(F.col("byteOffset") < behind, F.lit(False))
    end = F.max(F.col("byteOffset") + F.col("width") * F.col("height"))
    return [F.max(back).alias("non_monotonic"), end.alias("end")]


def _adc_ok() -> Column:
    return ~((F.col("pairs") > 0) & (F.col("pairs") == F.col("colocated")))


def _with_length(facts: DataFrame, roi_files: DataFrame) -> DataFrame:
    out = facts.join(roi_files.select("bin", "length"), "bin", "left")
    out = out.withColumn("too_long", F.col("end") > F.coalesce("length", F.lit(0)))
    return out.withColumn("roi_ok", ~F.col("non_monotonic") & ~F.col("too_long")).drop("end", "length")


def pair_integrity(targets: DataFrame) -> DataFrame:
    """Per bin the consecutive rows with one trigger and those also at one place; all at one place is a failure."""
    counts = _with_previous(targets, PREVIOUS[:3]).groupBy("bin").agg(*_pair_counts())
    return counts.withColumn("adc_ok", _adc_ok())


def byte_offset_check(targets: DataFrame, roi_files: DataFrame) -> DataFrame:
    """Per bin: offsets never go back into the previous image, and no image ends behind the file (``bin, length``)."""
    return _with_length(_with_previous(targets, PREVIOUS[3:]).groupBy("bin").agg(*_offset_facts()), roi_files)


def integrity(targets: DataFrame, roi_files: DataFrame) -> DataFrame:
    """Both checks in one pass over the targets."""
    facts = _with_previous(targets, PREVIOUS).groupBy("bin").agg(*_pair_counts(), *_offset_facts())
    checked = _with_length(facts, roi_files).withColumn("adc_ok", _adc_ok())
    return checked.select("bin", "adc_ok", "roi_ok", (F.col("adc_ok") & F.col("roi_ok")).alias("ok"))


def last_line_metrics(lines: DataFrame, hdr: DataFrame) -> DataFrame:
    """triggers and duration are the first two fields of the last target line; the rest is in the header."""
    last = lines.groupBy("path").agg(F.max_by("line", "n").alias("line"))
    parts = F.split("line", ",")
    metrics = last.select("path", F.get(parts, F.lit(0)).try_cast("int").alias("triggers"),
                          F.get(parts, F.lit(1)).try_cast("double").alias("duration"))
    return metrics.join(hdr.select("path", "temperature", "humidity"), "path", "left")


def accession_status(filesets: DataFrame, bins: DataFrame, checks: DataFrame) -> DataFrame:
    """EXISTS when the bin is known, FAILED when a check fails, else ADDED. ``checks`` has ``lid, ok``."""
    known = bins.select("lid").distinct().withColumn("_known", F.lit(True))
    rows = filesets.join(known, "lid", "left").join(checks.select("lid", "ok"), "lid", "left")
    status = F.when(F.col("_known"), "EXISTS").when(~F.coalesce("ok", F.lit(False)), "FAILED").otherwise("ADDED")
    return rows.withColumn("status", status).drop("_known", "ok")


def accession_summary(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("n"))


def new_filesets(filesets: DataFrame, bins: DataFrame, resolvable: DataFrame) -> DataFrame:
    return filesets.join(bins.select("lid"), "lid", "left_anti").join(resolvable.select("lid"), "lid", "left_semi")


def _newest(bins: DataFrame, newest: int | None) -> DataFrame:
    return bins if newest is None else bins.orderBy(F.desc("sample_time"), "lid").limit(newest)


def missing_blobs(bins: DataFrame, products: DataFrame, newest: int | None = None) -> DataFrame:
    """Bins without a blob product, of all bins or of the newest ones; ``products`` has ``lid, product``."""
    return _newest(bins, newest).join(products.where("product = 'blobs'").select("lid"), "lid", "left_anti")


def missing_features(bins: DataFrame, products: DataFrame, newest: int | None = None) -> DataFrame:
    """Bins with a blob product and without features, of all bins or of the newest ones."""
    with_blobs = _newest(bins, newest).join(products.where("product = 'blobs'").select("lid"), "lid", "left_semi")
    return with_blobs.join(products.where("product = 'features'").select("lid"), "lid", "left_anti")


def copy_plan(filesets: DataFrame, bins: DataFrame, instruments: DataFrame, data_dirs: DataFrame) -> DataFrame:
    """(lid, source, destination) of three files for each raw destination folder of the instrument's series."""
    fresh = filesets.join(bins.select("lid"), "lid", "left_anti")
    series = instruments.select(F.col("name").alias("instrument"), "time_series_id")
    dirs = data_dirs.where("destination AND product_type = 'raw'").select("time_series_id", F.col("path").alias("_dir"))
    three = F.explode(F.array("hdr_path", "adc_path", "roi_path")).alias("source")
    placed = fresh.join(series, "instrument").join(dirs, "time_series_id").select("lid", "_dir", three)
    return placed.select("lid", "source", F.concat_ws("/", "_dir", F.substring_index("source", "/", -1)).alias("destination"))


def schedule_products(bins: DataFrame, pid: str = "pid") -> DataFrame:
    """The four product edges of each bin."""
    def name(product: str) -> Column:
        return F.concat(F.col(pid), F.lit(f"_{product}"))
    edges = F.array(*[F.struct(name(d).alias("downstream"), name(u).alias("upstream"), F.lit(r).alias("role"))
                      for d, u, r in BIN_PRODUCTS])
    return bins.select(F.explode(edges).alias("e")).select("e.*")


def batch_schedule(filesets: DataFrame, bins: DataFrame, namespace: str) -> DataFrame:
    """raw <- wild edges of filesets that are no bins yet."""
    fresh = filesets.join(bins.select("lid"), "lid", "left_anti")
    pid = F.concat(F.lit(namespace), F.col("lid"))
    return fresh.select(F.concat(pid, F.lit("_raw")).alias("downstream"), F.concat(pid, F.lit("_wild")).alias("upstream"),
                        F.lit("wild2raw").alias("role"))


def bad_stitch_audit(targets: DataFrame, product_rows: DataFrame, versions: DataFrame) -> DataFrame:
    """Bins of the second layout that stitching would shrink and whose product has fewer rows than raw targets.

    ``product_rows`` has ``bin, product, rows``; the first short product in the order binzip, blobs, features is named.
    """
    raw = targets.groupBy("bin").agg(F.count("*").alias("n_raw"))
    kept = list_stitched_targets(targets).groupBy("bin").agg(F.count("*").alias("n_kept"))
    names = ["binzip", "blobs", "features"]
    counts = product_rows.groupBy("bin").agg(
        *[F.min(F.when(F.col("product") == p, F.col("rows"))).alias(f"_{p}") for p in names])
    rows = raw.join(kept, "bin").join(versions.select("bin", "schema_version"), "bin").join(counts, "bin", "left")
    product = F.coalesce(*[F.when(F.col(f"_{p}") < F.col("n_raw"), F.lit(p)) for p in names])
    suspect = (F.col("schema_version") != "v1") & (F.col("n_kept") < F.col("n_raw"))
    out = rows.withColumn("product", F.when(suspect, product))
    return out.select("bin", F.col("product").isNotNull().alias("stitched"), "product")


def prev_next_pid(targets: DataFrame, pid: str = "pid") -> DataFrame:
    return ordered.neighbours(targets, ["bin"], ["targetNumber"], ordered.block_slice("targetNumber"),
                              prev={pid: "prev_pid"}, next={pid: "next_pid"})


def resume_anti_join(wanted: DataFrame, done: DataFrame, compute, key: str = "imagename") -> DataFrame:
    """Compute only what the output lacks, add it, sort by name."""
    todo = wanted.join(done.select(key), key, "left_anti")
    return done.unionByName(compute(todo)).orderBy(key)


def insert_if_absent(table: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``new`` (one per key) that the table does not have."""
    return new.dropDuplicates(list(key)).join(table.select(*key), list(key), "left_anti")


def tiles_by_area(targets: DataFrame) -> DataFrame:
    return targets.withColumn("area", F.col("width") * F.col("height")).orderBy(F.desc("area"), "bin", "targetNumber")


def targets_features_join(targets: DataFrame, features: DataFrame, key: str = "roi_number") -> DataFrame:
    """``features`` has ``bin, roi_number, ...`` or only ``roi_number``."""
    f = features.withColumnRenamed(key, "targetNumber")
    return targets.join(f, [c for c in ("bin", "targetNumber") if c in f.columns])


def scatter_points(targets: DataFrame, features: DataFrame | None, x: str, y: str) -> DataFrame:
    """x and y from the target row, else from its feature row; features are joined only when an axis asks for it."""
    rows = targets
    if x not in targets.columns or y not in targets.columns:
        rows = targets_features_join(targets, features)
    return rows.select("bin", "targetNumber", F.col(x).alias("x"), F.col(y).alias("y"))


def roi_feature_row(features: DataFrame, roi: int, key: str = "roi_number") -> DataFrame:
    found = features.where(F.col(key) == roi)
    return found.select(F.to_json(F.struct(*found.columns)).alias("json"))


def rois_columnar(targets: DataFrame) -> DataFrame:
    """Target number, pid, height and width by name and position, ready to be read as parallel columns of a bin.

    The columnar file format keeps the four as columns; rows carry their place so that no bin is gathered in one cell.
    """
    cols = {"targetNumber": F.col("targetNumber").cast("string"), "pid": F.col("pid"),
            "height": F.col("height").cast("string"), "width": F.col("width").cast("string")}
    cells = F.array(*[F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in cols.items()])
    return targets.select("bin", F.col("targetNumber").alias("at"), F.explode(cells).alias("c")).select(
        "bin", "c.name", "at", "c.value")
