"""Text, CSV, target, header and image-byte sources.

Line based sources work on *numbered lines*: ``path, n, line`` with ``n`` from 1. ``numbered_lines`` makes them from files
of any size: a file is read in splits, lines are numbered inside a split and a small table of split sizes shifts them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinelog.functions.text import remove_extension
from brinelog.functions.times import instant
from brinelog.operators import ordered

# Columns and types of the two target file layouts.
ADC_V1_COLUMNS = ("trigger processingEndTime fluorescenceLow fluoresenceHigh scatteringLow scatteringHigh "
                  "comparatorPulse triggerOpenTime frameGrabTime bottom left height width byteOffset valveStatus").split()
ADC_V1_TYPES = "int double double double double double double double double int int int int int double".split()
ADC_V2_COLUMNS = ("trigger processingEndTime pmtA pmtB pmtC pmtD peakA peakB peakC peakD timeOfFlight grabTimeStart "
                  "frameGrabTime bottom left height width byteOffset comparatorOut startPoint signalStrength "
                  "valveStatus").split()
ADC_V2_TYPES = ("int double double double double double double double double double double double double int int int int "
                "int double int int int").split()

# Known header keys with their types, and the first line of the fixed header layout.
HDR_KEYS = {
    "temperature": "double",
    "humidity": "double",
    "binarizeThreshold": "int",
    "scatteringPhotomultiplierSetting": "double",
    "fluorescencePhotomultiplierSetting": "double",
    "blobSizeThreshold": "int",
}
FIXED_HDR_LINE = "Imaging FlowCytobot Acquisition Software version 2.0; May 2010"

# Reads of image bytes: the most that neighbours may be in one read, and the gap that is read along.
AT_ONCE = 1 << 22
NEAR = 1 << 12


def adc_columns(version: str) -> list[str]:
    return ADC_V1_COLUMNS if version == "v1" else ADC_V2_COLUMNS


def adc_schema(version: str) -> str:
    types = ADC_V1_TYPES if version == "v1" else ADC_V2_TYPES
    return ", ".join(f"`{c}` {t}" for c, t in zip(adc_columns(version), types))


# -- files ------------------------------------------------------------------------------------------------------------

def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, n, line`` of text files, split reads included."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    # The id only orders lines inside one split; a split never holds more than spark.sql.files.maxPartitionBytes.
    return ordered.number_rows(raw, ["path"], ["_block", "_at"], F.col("_block"), out="n").select("path", "n", "line")


def lines_scan(spark: SparkSession, path: str, var: str = "_") -> DataFrame:
    return spark.read.text(path).select(F.rtrim("value").alias(var))


def csv_scan(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """Records as text columns; names from ``names``, else from the header row."""
    if names is None:
        return spark.read.option("header", True).csv(path)
    return spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(path)


def json_file_scan(spark: SparkSession, path: str, var: str = "doc") -> DataFrame:
    """One row per JSON document file, as text for ``json_select``."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", var)


def path_scan(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """Sorted file listing; the bytes are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    reader = reader.option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).select("path", "length", "modificationTime").orderBy("path")


def _open(path: str):
    """Any path Spark lists, opened for reading inside a task."""
    from pyarrow import fs
    uri = path.replace("file:/", "/", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    system, where = fs.FileSystem.from_uri(uri)
    return system.open_input_file(where)


def file_fixity(spark: SparkSession, folder: str, fast: bool = False, block: int = 1 << 22, recursive: bool = False) -> DataFrame:
    """Name, length, SHA-1 and time of files; ``fast`` leaves the bytes unread.

    With ``recursive`` the files of subfolders count too, as those of tables kept as folders. Files are dealt out to tasks by name; each is hashed block by block, so its size does not matter.
    """
    listing = path_scan(spark, folder, recursive=recursive).select("path", "length")
    named = listing.select("path", F.substring_index("path", "/", -1).alias("filename"), "length")
    if fast:
        return named.select("path", "filename", "length", F.lit("(no checksum)").alias("sha1"), F.current_timestamp().alias("fix_time"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        for pdf in batches:
            sums = []
            for path in pdf["path"]:
                h = hashlib.sha1()
                with _open(path) as handle:
                    while data := handle.read(block):
                        h.update(data)
                sums.append(h.hexdigest())
            yield pdf.assign(sha1=sums)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = named.repartition(parts, "path").mapInPandas(digest, "path string, filename string, length long, sha1 string")
    return hashed.withColumn("fix_time", F.current_timestamp())


def _read_into(out: memoryview, handle, path: str, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> None:
    """Copy ranges of one file to their places ``at``; neighbours are read in one go."""
    order = np.argsort(starts, kind="stable")
    starts, sizes, at = starts[order], sizes[order], at[order]
    ends = starts + sizes
    apart = (starts[1:] > np.maximum.accumulate(ends)[:-1] + NEAR) | (starts[1:] // AT_ONCE != starts[:-1] // AT_ONCE)
    cuts = [0, *(np.flatnonzero(apart) + 1).tolist(), len(starts)]
    for lo, hi in zip(cuts, cuts[1:]):
        first, last = int(starts[lo]), int(ends[lo:hi].max())
        view = memoryview(handle.read_at(last - first, first))
        if len(view) < last - first:
            raise EOFError(f"{path} ends at byte {first + len(view)}, before the end of an image at byte {last}")
        for to, size, begin in zip(at[lo:hi].tolist(), sizes[lo:hi].tolist(), (starts[lo:hi] - first).tolist()):
            out[to:to + size] = view[begin:begin + size]


def _end_to_end(files: Sequence[tuple[str, int]], starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
    """Ranges of files laid end to end, again and again, as ranges of each file."""
    lengths = np.array([n for _, n in files], np.int64)
    ends = np.cumsum(lengths)
    parts = []
    while len(starts):  # once more for those that go on in the next file
        starts = starts % ends[-1]
        k = np.searchsorted(ends, starts, "right")
        take = np.minimum(sizes, ends[k] - starts)
        parts.append((k, starts - ends[k] + lengths[k], take, at))
        more = take < sizes
        starts, sizes, at = (starts + take)[more], (sizes - take)[more], (at + take)[more]
    k, *found = (np.concatenate(c) for c in zip(*parts))
    for i in np.unique(k).tolist():
        yield files[i][0], *(c[k == i] for c in found)


def read_ranges(rows: DataFrame, path: str = "path", offset: str = "byteOffset", length: str = "size",
                files: dict[str, Sequence[tuple[str, int]]] | None = None) -> DataFrame:
    """Attach ``data``: the bytes ``[offset, offset + length)`` of ``path``; null where one of these is. Only the asked ranges are read, with gaps of
    up to ``NEAR`` bytes between them. A range that goes beyond the end of its file is an error.

    A name that is a key of ``files`` stands for these files ``(path, length)``, laid end to end; after the last byte the first follows, so no range is beyond the end.
    """
    files = files or {}

    def fetch(paths: pa.Array, starts: pa.Array, sizes: pa.Array) -> pa.Array:
        given = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in (paths, starts, sizes)])
        starts, sizes = (np.where(given, c.fill_null(0).to_numpy(), 0) for c in (starts, sizes))
        at = np.concatenate(([0], np.cumsum(sizes)))
        if at[-1] >= 1 << 31:
            raise ValueError("images of 2 GB or more in a batch: lower spark.sql.execution.arrow.maxRecordsPerBatch")
        content = bytearray(int(at[-1]))
        names = paths.dictionary_encode()
        which = names.indices.fill_null(0).to_numpy()
        order = np.argsort(which, kind="stable")
        order = order[sizes[order] > 0]
        for k in np.unique(which[order]).tolist():
            name = names.dictionary[k].as_py()
            asked = order[np.searchsorted(which[order], k, "left"):np.searchsorted(which[order], k, "right")]
            ranges = starts[asked], sizes[asked], at[asked]
            for part, *found in _end_to_end(files[name], *ranges) if name in files else [(name, *ranges)]:
                with _open(part) as handle:
                    _read_into(memoryview(content), handle, part, *found)
        return pa.Array.from_buffers(pa.binary(), len(given), [pa.array(given).buffers()[1], pa.py_buffer(at.astype(np.int32)), pa.py_buffer(content)])

    return rows.withColumn("data", F.arrow_udf(fetch, "binary")(F.col(path), F.col(offset).cast("bigint"), F.col(length).cast("bigint")))


def bytes_to_pixels(rows: DataFrame, keys: Sequence[str], width: str = "width", height: str = "height") -> DataFrame:
    """Pixel rows ``keys, y, x, v`` of unsigned bytes. Stored images are turned by 90 degrees: ``width`` rows."""
    def values(data: pa.Array) -> pa.Array:
        """The bytes of each cell as (signed) numbers, not copied."""
        plain = data.cast(pa.binary())
        valid, offsets, content = plain.buffers()
        levels = pa.Array.from_buffers(pa.int8(), content.size if content else 0, [None, content or pa.py_buffer(b"")])
        return pa.Array.from_buffers(pa.list_(pa.field("element", pa.int8(), False)), len(plain), [valid, offsets], offset=plain.offset, children=[levels])

    # Made before the rows are multiplied, so reading and this are one Python step; else a filter that Spark infers for the rows would be pushed
    # below and take a step of its own: nothing is pushed below what is not deterministic.
    levels = F.arrow_udf(values, T.ArrayType(T.ByteType(), False)).asNondeterministic()("data")
    flat = rows.select(*keys, height, levels.alias("_levels")).select(*keys, height, F.posexplode("_levels").alias("_i", "_v"))
    return flat.select(*keys, F.floor(F.col("_i") / F.col(height)).alias("y"),
                       (F.col("_i") % F.col(height)).cast("bigint").alias("x"), F.col("_v").cast("int").bitwiseAND(255).alias("v"))


def roi_pixels_scan(targets: DataFrame, keys: Sequence[str], files: dict[str, Sequence[tuple[str, int]]] | None = None) -> DataFrame:
    """Pixels of targets whose ``path`` names the image file (or ``files``) and whose ``byteOffset`` locates them in it."""
    sized = targets.withColumn("size", F.col("width") * F.col("height")).where("size > 0")
    return bytes_to_pixels(read_ranges(sized, files=files), keys)


# -- numbered lines ---------------------------------------------------------------------------------------------------

def line_slice(lines: DataFrame, start: int, count: int | None = None) -> DataFrame:
    """Lines ``[start, start + count)``, counted from 0."""
    kept = lines.where(F.col("n") > start)
    return kept if count is None else kept.where(F.col("n") <= start + count)


def byte_slice(content: Column, offset: int, length: int) -> Column:
    return F.substring(content.cast("binary"), offset + 1, length)


def csv_scan_positional(lines: DataFrame, schema: str, offset: int = 0, limit: int = -1) -> DataFrame:
    """Skip ``offset`` raw rows, then take ``limit`` rows; extra fields are ignored, values are cast by ``schema``."""
    picked = line_slice(lines, offset, None if limit < 0 else limit)
    return picked.select("path", "n", F.from_csv("line", schema).alias("r")).select("path", "n", "r.*")


def cast_truncate(lines: DataFrame, schema: str) -> DataFrame:
    return csv_scan_positional(lines, schema)


def adc_scan(lines: DataFrame, version: str = "v2") -> DataFrame:
    """Typed targets; the number is the raw line number, empty targets go after numbering."""
    # A generator keeps the filter above the parse; below it each line would be parsed once more.
    parsed = F.inline(F.array(F.from_csv("line", adc_schema(version))))
    return lines.select("path", F.col("n").alias("targetNumber"), parsed).where("width * height <> 0")


def adc_rule_targets(lines: DataFrame, version: str = "v2") -> DataFrame:
    return adc_scan(lines, version).where("height > 0 AND width > 0")


def adc_slice(lines: DataFrame, offset: int, limit: int, version: str = "v2") -> DataFrame:
    """Targets from raw lines ``offset`` to ``offset + limit - 1``; empty ones make the result shorter."""
    return adc_scan(lines.where(F.col("n").between(offset, offset + limit - 1)), version)


def adc_target(lines: DataFrame, path: str, number: int, version: str = "v2") -> DataFrame:
    return adc_scan(lines.where((F.col("path") == path) & (F.col("n") == number)), version)


def hdr_scan(lines: DataFrame) -> DataFrame:
    """Header entries ``path, kind, n, key, value``; ``kind`` is ``context`` or ``prop``. Three layouts are told apart
    by the first line and the line count of the file. A header is a short file: its lines meet in one window, in one pass."""
    clean = lines.withColumn("line", F.rtrim("line"))
    layout = F.when(F.col("line") == FIXED_HDR_LINE, 1).when(F.col("line").startswith("softwareVersion:"), 2).otherwise(3)
    header = Window.partitionBy("path")
    known = clean.withColumns({"layout": F.max(F.when(F.col("n") == 1, layout)).over(header), "total": F.max("n").over(header)})
    fixed, keyed = F.col("layout") == 1, F.col("layout") == 2
    none = F.lit(None).cast("string")

    def entry(kind: str, key: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"))

    pair = F.split("line", ": ")
    values = F.split(F.trim(F.regexp_replace("line", '[",]', " ")), " +")
    names = F.array(*[F.lit(k) for k in HDR_KEYS])
    columnar = F.transform(F.filter(F.arrays_zip(names.alias("k"), values.alias("v")),
                                    lambda z: z["k"].isNotNull() & z["v"].isNotNull()),
                           lambda z: entry("prop", z["k"], z["v"]))
    entries = (
        F.when((fixed | keyed) & (F.col("n") == 1), F.array(entry("context", none, F.col("line"))))
        .when(keyed & (F.size(pair) == 2), F.array(entry("prop", pair[0], pair[1])))
        .when(~fixed & ~keyed & (F.col("n") <= F.col("total") - 2),
              F.array(entry("context", none, F.regexp_replace("line", '^"+|"+$', ""))))
        .when(~fixed & ~keyed & (F.col("n") == F.col("total")) & (F.col("total") >= 6), columnar))
    return known.select("path", "n", F.explode(entries).alias("e")).select("path", "n", "e.kind", "e.key", "e.value")


def split_hdr(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(context lines, properties)."""
    return (entries.where("kind = 'context'").select("path", "n", F.col("value").alias("text")),
            entries.where("kind = 'prop'").select("path", "n", "key", "value"))


def hdr_typed(entries: DataFrame) -> DataFrame:
    """One row per header with the known keys as typed columns; the last entry of a key counts."""
    cols = [F.max_by(F.when(F.col("key") == k, F.col("value")).try_cast(t), F.when(F.col("key") == k, F.col("n"))).alias(k)
            for k, t in HDR_KEYS.items()]
    return entries.groupBy("path").agg(*cols)


def image_line_lookup(lines: DataFrame, name: str) -> DataFrame:
    """CSV lines whose first field, without extension, is the image name."""
    return lines.where(remove_extension(F.split("line", ",")[0]) == name)


# -- tables -----------------------------------------------------------------------------------------------------------

def bulk_load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with the literal ``NULL`` for null."""
    return spark.read.schema(schema).option("nullValue", "NULL").csv(path)


def manual_annotations(rows: DataFrame, namespace: str) -> DataFrame:
    """Annotations from rows ``bin, roi, category, annotator``."""
    from brinelog.functions.text import gen_id
    image = F.concat(F.lit(namespace), F.replace("bin", F.lit(".mat"), F.lit("_")), F.col("roi").cast("string"))
    return rows.select(gen_id(namespace).alias("pid"), image.alias("image"), "category", "annotator",
                       F.current_timestamp().alias("timestamp"))


MANUAL_SCHEMA = "bin string, roi string, category string, annotator string"
MANUAL_LIST_SCHEMA = "lid string, category string, annotator string"


def import_manual(spark: SparkSession, path: str, namespace: str) -> DataFrame:
    return manual_annotations(spark.read.schema(MANUAL_SCHEMA).csv(path), namespace)


def import_manual_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANUAL_LIST_SCHEMA).csv(path)


def scores_long(rows: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """Score arrays to ``roi, class, score`` rows."""
    long = rows.select("roi", F.posexplode("scores").alias("class", "score"))
    if labels is None:
        return long
    named = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("class") + 1)
    return long.withColumn("class", named)


def cruise_track_scan(rows: DataFrame) -> DataFrame:
    """(ts, latitude, longitude) from a track table with split time columns."""
    from brinelog.functions.times import make_time
    ts = make_time(*[F.col(c) for c in ("year", "month", "day", "hour", "minute", "second")])
    return rows.select(ts.alias("ts"), "latitude", "longitude")


def vehicle_table_scan(rows: DataFrame, labels: Sequence[str], index: str = "LineNo") -> DataFrame:
    """Positional columns to labelled ones, in index order."""
    return rows.toDF(*labels).orderBy(index)


def since(rows: DataFrame, ts: str, start: str) -> DataFrame:
    return rows.where(F.col(ts) >= instant(start))
