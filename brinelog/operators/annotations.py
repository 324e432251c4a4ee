"""Annotations, assignments, categories and class scores."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelog.functions.ids import target_pid
from brinelog.functions.text import remove_extension
from brinelog.functions.times import instant
from brinelog.operators import ordered

# Columns of a stored annotation, and roi numbers per stored array.
ANNOTATION_COLUMNS = ["image_id", "scope_id", "category_id", "geometry_text", "annotator_id", "timestamp", "assignment_id",
                      "annotation_id", "deprecated"]
ROIS_PER_ARRAY = 4096


# -- annotations ------------------------------------------------------------------------------------------------------

def image_prefix_lookup(images: DataFrame, name: str, col: str = "imagename") -> DataFrame:
    """First image whose name starts with ``name`` without its extension."""
    import re
    prefix = re.sub(r"\.[a-zA-Z][a-zA-Z0-9]*$", "", name)
    return images.where(F.col(col).startswith(prefix)).orderBy(col).limit(1)


def image_bin_prefix(images: DataFrame, bin_lid: str, col: str = "imagename") -> DataFrame:
    """Images of a ten-minute bin: the last digit of the bin name is dropped."""
    return images.where(F.col(col).startswith(bin_lid[:-1]))


def pending_nulls(images: DataFrame, value: str, name: str = "imagename") -> DataFrame:
    return images.where(F.col(value).isNull()).select(F.concat(name, F.lit(".tif")).alias(name))


def fetch_by_key(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The row with the key; of several the first in order of all columns."""
    return rows.where(F.col(key) == value).orderBy(*rows.columns).limit(1)


def deprecate(rows: DataFrame, key: str, value: object) -> DataFrame:
    return rows.withColumn("deprecated", F.when(F.col(key) == value, F.lit(True)).otherwise(F.col("deprecated")))


def annotation_rows(new: DataFrame, annotator: str | None = None) -> DataFrame:
    """Rows ready for the store: absent columns null, geometry as JSON without its outer braces."""
    def col(name: str) -> Column:
        if name == "annotator_id" and annotator is not None:
            return F.lit(annotator)
        if name == "geometry_text" and "geometry" in new.columns:
            return F.regexp_replace(F.to_json("geometry"), r"^\{|\}$", "")
        return F.col(name) if name in new.columns else F.lit(None).cast("string")
    return new.select(*[col(c).alias(c) for c in ANNOTATION_COLUMNS])


def annotation_insert(new: DataFrame, path: str, annotator: str | None = None) -> None:
    annotation_rows(new, annotator).write.mode("append").parquet(path)


def geometry_json(text: Column) -> Column:
    return F.parse_json(F.concat(F.lit("{"), text, F.lit("}")))


# -- categories and assignments ---------------------------------------------------------------------------------------

def categories_join(facets: DataFrame, scopes: DataFrame, classes: DataFrame, idmodes: DataFrame, mode: object,
                    scope: object = None) -> DataFrame:
    """Distinct categories of a mode, deprecated ones left out, by facet and name."""
    used = idmodes.where(F.col("idmode_id") == mode).select("class_id", "idmode_id", "idmode_name").distinct()
    kept = scopes if scope is None else scopes.where(F.col("scope_id") == scope)
    rows = classes.where(~F.col("deprecated")).join(used, "class_id").join(facets, "facet_id").join(kept, "scope_id")
    return rows.select("class_id", "class_name", "facet_id", "facet_name", "scope_id", "scope_name", "idmode_id",
                       "idmode_name").distinct().orderBy("facet_id", "class_name")


def categories_by_mode(categories: DataFrame, mode: str) -> DataFrame:
    return categories.where(F.array_contains("modes", mode))


def distinct_idmodes(idmodes: DataFrame) -> DataFrame:
    return idmodes.where(F.col("idmode_name").isNotNull()).select("idmode_id", "idmode_name").distinct().orderBy("idmode_id")


def list_assignments(assignments: DataFrame) -> DataFrame:
    label = F.format_string("%s: %s @ %s", F.col("assignment_id").cast("string"), "project_name", "site_description")
    return assignments.withColumn("label", label).orderBy(F.desc("assignment_id"))


def list_images(imagelist: DataFrame, assignment: object, limit: int | None = None, offset: int = 0,
                status: str | None = None) -> DataFrame:
    rows = imagelist.where(F.col("assignment_id") == assignment)
    rows = rows if status is None else rows.where(F.col("status") == status)
    rows = rows.orderBy("imagename").offset(offset)
    return rows if limit is None else rows.limit(limit)


def find_image(imagelist: DataFrame, assignment: object, offset: int, status: str, slice_by: Column | None = None) -> DataFrame:
    """1-based place in name order of the first row after ``offset`` with the status; none gives ``offset``."""
    rows = imagelist.where(F.col("assignment_id") == assignment)
    placed = ordered.number_rows(rows, [], ["imagename"], slice_by, out="place")
    hit = F.min(F.when((F.col("place") > offset) & (F.col("status") == status), F.col("place")))
    return placed.agg(F.coalesce(hit, F.lit(offset).cast("bigint")).alias("place"))


def set_status(imagelist: DataFrame, assignment: object, image: str, status: str) -> DataFrame:
    hit = (F.col("assignment_id") == assignment) & (F.col("imagename") == image)
    return imagelist.withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status")))


def image_list_struct(images: Column) -> Column:
    return F.transform(images, lambda p: F.struct(p.alias("pid"), F.concat(p, F.lit(".jpg")).alias("image")))


def image_list_text(structs: Column) -> Column:
    return F.transform(structs, lambda s: s["pid"])


def altitude_metadata_join(altitudes: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """With metadata: inner join on the image name for pitch and roll; without: both 0."""
    rows = altitudes.withColumn("imagename", remove_extension(F.col("imagename")))
    if metadata is None:
        return rows.withColumns({"pitch": F.lit(0.0), "roll": F.lit(0.0)})
    meta = metadata.select(remove_extension(F.col("imagename")).alias("imagename"), "pitch", "roll")
    return rows.join(meta, "imagename")


def every_nth(rows: DataFrame, keys: Sequence[str], order: Sequence[str], step: int, limit: int | None = None,
              slice_by: Column | None = None) -> DataFrame:
    """Every ``step``-th row of each key from the first on, at most ``limit`` of them (the strided choice of the batch)."""
    numbered = ordered.number_rows(rows, keys, order, slice_by, out="_rn")
    kept = numbered.where((F.col("_rn") - 1) % step == 0)
    kept = kept if limit is None else kept.where(F.col("_rn") <= (limit - 1) * step + 1)
    return kept.drop("_rn")


# -- class scores -----------------------------------------------------------------------------------------------------

def max_class(scores: Column, threshold: float = 0.0) -> Column:
    """0-based place of the first largest score when it is above the threshold, else -1."""
    best = F.array_max(scores)
    return F.when(best > threshold, F.array_position(scores, best) - 1).otherwise(-1).cast("int")


def class_labels(scores: Column, labels: Sequence[str], threshold: float = 0.0) -> Column:
    k = max_class(scores, threshold)
    return F.when(k < 0, "unclassified").otherwise(F.get(F.array(*[F.lit(x) for x in labels]), k))


def class_label_score(scores: Column, labels: Sequence[str]) -> Column:
    """Label and score of the largest score, whatever it is."""
    best = F.array_max(scores)
    label = F.get(F.array(*[F.lit(x) for x in labels]), (F.array_position(scores, best) - 1).cast("int"))
    return F.struct(label.alias("label"), best.alias("score"))


def class_numbers(rows: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Class number of every roi from 0 to the largest: -1 below the threshold, 0 for a roi without scores."""
    found = rows.select("roi", max_class(F.col("scores"), threshold).alias("_k"))
    top = rows.agg(F.max("roi").cast("bigint").alias("m"))
    step = F.lit(ROIS_PER_ARRAY).cast("bigint")
    # Blocks of numbers are dealt out first, so that no cell and no task holds the whole range.
    blocks = top.select("m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m"), step)).alias("_b")).repartition("_b")
    spine = blocks.select(F.explode(F.sequence("_b", F.least(F.col("_b") + step - 1, "m"))).alias("roi"))
    return spine.join(found, "roi", "left").select("roi", F.coalesce("_k", F.lit(0)).alias("class_number"))


def scores_to_arrays(long: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Parallel arrays of roi numbers and scores per (bin_lid, class_label), only for bins not stored yet.

    A label of a bin is stored in chunks of ``ROIS_PER_ARRAY`` roi numbers, so no array grows with the bin.
    """
    fresh = long if done is None else long.join(done.select("bin_lid"), "bin_lid", "left_anti")
    chunk = F.floor(F.col("roi") / ROIS_PER_ARRAY).alias("chunk")
    sizes = ordered.key_sizes(fresh, ["bin_lid"])
    if sizes[1] <= ordered.HOT_ROWS:  # rows of a bin go to one task once, before they are gathered, and stay there for a join by bin
        fresh = ordered.spread(fresh, ["bin_lid"], sizes[0])
    rows = F.array_sort(F.collect_list(F.struct("roi", "score"))).alias("_r")
    stored = fresh.groupBy("bin_lid", "class_label", chunk).agg(rows)
    return stored.select("bin_lid", "class_label", "chunk", F.col("_r.roi").alias("roinums"), F.col("_r.score").alias("scores"))


def distinct_classes(autoclass: DataFrame) -> DataFrame:
    return autoclass.select("class_label").distinct().orderBy("class_label")


def rois_of_class(autoclass: DataFrame, bins: DataFrame, label: str, start: datetime, end: datetime,
                  threshold: float = 0.0, page: int = 1, page_size: int = 10) -> DataFrame:
    """Target ids of a class above a threshold for one page of bins, paged by sample time."""
    inside = bins.where(F.col("sample_time").between(instant(start), instant(end)))
    paged = inside.orderBy("sample_time", "lid").offset((page - 1) * page_size).limit(page_size)
    rows = autoclass.where(F.col("class_label") == label).join(
        paged.select(F.col("lid").alias("bin_lid")), "bin_lid", "left_semi")
    pairs = rows.select("bin_lid", F.explode(F.arrays_zip("roinums", "scores")).alias("z"))
    return pairs.where(F.col("z.scores") > threshold).select(target_pid(F.col("bin_lid"), F.col("z.roinums")).alias("pid"))


def class_count_by_day(autoclass: DataFrame, bins: DataFrame, label: str, start: datetime, end: datetime) -> DataFrame:
    """Rough daily count of a class: sizes are added per bin before the join."""
    sizes = autoclass.where(F.col("class_label") == label).groupBy(F.col("bin_lid").alias("lid")).agg(
        F.sum(F.size("roinums")).alias("_n"))
    inside = bins.where(F.col("sample_time").between(instant(start), instant(end))).select("lid", "sample_time")
    return inside.join(sizes, "lid").groupBy(F.to_date("sample_time").alias("day")).agg(F.sum("_n").alias("count")).orderBy("day")


# -- altitude ---------------------------------------------------------------------------------------------------------

# Fixed values in metres: camera separation, focal length, water factor, pixel separation; and the stand-in altitude.
CAMERA_SEPARATION, FOCAL_LENGTH, H2O_ADJUSTMENT, PIXEL_SEPARATION = 0.235, 0.012, 1.25, 0.00000645
DEFAULT_ALTITUDE = 1.6


def parallax_altitude(offset: Column, separation: float = CAMERA_SEPARATION, focal: float = FOCAL_LENGTH,
                      water: float = H2O_ADJUSTMENT, pixel: float = PIXEL_SEPARATION) -> Column:
    return F.lit(separation * focal * water) / (offset * F.lit(pixel))


def altitude_or_default(offset: Column) -> Column:
    """(x, y, altitude); an offset that is not positive gives (-1, -1, 1.6)."""
    good = F.coalesce(offset > 0, F.lit(False))
    return F.struct(F.when(good, offset).otherwise(-1).alias("x"), F.when(good, 0).otherwise(-1).alias("y"),
                    F.when(good, parallax_altitude(offset)).otherwise(F.lit(DEFAULT_ALTITUDE)).alias("altitude"))


def median_offset(offsets: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Column-wise median, truncated to whole pixels. Offsets are whole pixels of a frame, so a histogram bounds the state."""
    return offsets.groupBy(*keys).agg(*[F.percentile(c, F.lit(0.5)).cast("int").alias(c) for c in cols])
