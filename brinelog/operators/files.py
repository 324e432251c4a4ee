"""File paths, filesets, fixity and data folders on listings (a listing has one row per file with ``path``)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelog.operators import ordered

# The three files of a fileset, file names and folders of products, and folder layouts as patterns.
EXTENSIONS = ("hdr", "adc", "roi")
PRODUCT_FILES = {
    "blobs": ["{lid}_blobs_v2.zip", "{lid}_blobs_v4.zip", "{lid}.zip"],
    "features": ["{lid}_fea_v2.csv", "{lid}_fea_v4.csv"],
    "multiblob": ["multiblob/{lid}_multiblob_v2.csv", "multiblob/{lid}_multiblob_v4.csv"],
    "class_scores": ["{lid}_class_v1.mat"],
    "binzip": ["{lid}_binzip_v1.zip"],
    "mosaic": ["{lid}_mosaic.jpg"],
}
PRODUCT_FOLDERS = {
    "blobs": ["{root}/{year}/{yearday}/{filename}", "{root}/{year}/D{yearday}/{filename}"],
    "features": ["{root}/features{year}_v2/{lid}_fea_v2.csv", "{root}/features{year}_v2/{lid}_fea_v4.csv"],
    "class_scores": ["{root}/class{year}_v1/{lid}_class_v1.mat"],
}
DAY_FOLDERS = {"v1": ["IFCB{instrument}_{yearday}"], "v2": ["D{yearday}", "D{year}/D{yearday}", "{year}/{yearday}"]}
STANDARD_FOLDERS = ["{root}/{year}/{day}/{filename}", "{root}/{filename}", "{root}/{day}/{filename}"]
# A layout is a pattern of the folders below the root and one of the file name.
RAW_LAYOUT = (r"(|IFCB[^/]*/|[0-9][^/]*/(D|IFCB)[^/]*/|D[0-9][^/]*/D[^/]*/)", r"[^/]+\.(hdr|adc|roi)$")
RAW_LAYOUTS = "".join(RAW_LAYOUT)
DATA_DIR_LAYOUTS = {
    "raw": (r"(|[0-9][^/]*/IFCB[0-9]_[0-9][^/]*_[0-9][^/]*/|[0-9][^/]*/D[0-9][^/]*/|IFCB[0-9]_[0-9][^/]*_[0-9][^/]*/"
            r"|D[0-9][^/]*/D[0-9][^/]*/)", r"[^/]*\.(adc|hdr|roi)$"),
    "blobs": (r"[0-9][^/]*/[0-9][^/]*/", r"[^/]*_blobs_v[^/]*\.zip$"),
    "features": (r"features[0-9][^/]*_v[0-9][^/]*/", r"[^/]*_fea_v[^/]*\.csv$"),
}


def _fill(template: str, **values: Column) -> Column:
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(head), values[name]]
    return F.concat(*parts, F.lit(rest))


PLACED_BY = ("root", "year", "yearday", "instrument", "schema_version")  # columns that decide where a raw file lies


def _row_values() -> dict[str, Column]:
    return {"root": F.col("root"), "lid": F.col("bin_lid"), "year": F.col("year"), "yearday": F.col("yearday"),
            "instrument": F.col("instrument")}


def _standard(filename: Column, version: str) -> list[Column]:
    v = _row_values() | {"filename": filename}
    return [_fill(f, day=_fill(d, **v), **v) for d in DAY_FOLDERS[version] for f in STANDARD_FOLDERS]


def _by_version(v1: Column, v2: Column) -> Column:
    return F.when(F.col("schema_version") == "v1", v1).otherwise(v2)


def raw_paths(filename: Column | None = None) -> Column:
    """Where a file of a parsed identifier may lie under ``root``, best place first."""
    name = F.concat_ws(".", "bin_lid", "extension") if filename is None else filename
    return _by_version(*[F.array(*_standard(name, v)) for v in ("v1", "v2")])


def file_path_candidates(parsed: DataFrame, filename: Column | None = None) -> DataFrame:
    """``prio, file_path``: every place of ``raw_paths``."""
    return parsed.select("*", F.posexplode(raw_paths(filename)).alias("prio", "file_path"))


def raw_destination(parsed: DataFrame) -> DataFrame:
    name = F.concat_ws(".", "bin_lid", "extension")
    return parsed.withColumn("file_path", _by_version(*[_standard(name, v)[0] for v in ("v1", "v2")]))


def _product_options(product: str, version: str) -> list[Column]:
    """Paths of a product below ``root``, best first."""
    v, options = _row_values(), []
    for name in (_fill(f, **v) for f in PRODUCT_FILES[product]):
        options += [_fill(folder, filename=name, **v) for folder in PRODUCT_FOLDERS.get(product, [])]
        options += _standard(name, version)
    return options


def _per_product(value, otherwise: Column) -> Column:
    """``value(options)`` for the options of the row's product and version."""
    out = otherwise
    for product in PRODUCT_FILES:
        for version in ("v1", "v2"):
            hit = (F.col("product") == product) & (F.col("schema_version") == version)
            out = F.when(hit, value(_product_options(product, version))).otherwise(out)
    return out


def product_paths() -> Column:
    """As ``raw_paths`` for the file names and folders of the row's ``product``."""
    return _per_product(lambda options: F.array(*options), F.array().cast("array<string>"))


def product_path_candidates(parsed: DataFrame) -> DataFrame:
    return parsed.select("*", F.posexplode(product_paths()).alias("prio", "file_path"))


def _file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _rank(path: Column, options: Sequence[Column]) -> Column:
    """Place of a path among its options, null for none; later options are only built if the earlier ones differ."""
    return F.coalesce(*[F.when(path == o, F.lit(i)) for i, o in enumerate(options)])


def _raw_rank(path: Column, name: Column) -> Column:
    return _by_version(*[_rank(path, _standard(name, v)) for v in ("v1", "v2")])


def raw_file_find(parsed: DataFrame, listing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Best listed place of each identifier's file: joined by file name, then ranked by folder."""
    named = parsed.withColumn("_name", F.concat_ws(".", "bin_lid", "extension"))
    listed = listing.select(F.col("path").alias("file_path"), _file_name(F.col("path")).alias("_name"))
    found = named.join(listed, "_name").withColumn("_prio", _raw_rank(F.col("file_path"), F.col("_name"))).where("_prio IS NOT NULL")
    return found.groupBy(*key).agg(F.min_by("file_path", "_prio").alias("file_path"))


def fileset_multi_root(parsed: DataFrame, listing: DataFrame, key: Sequence[str]) -> DataFrame:
    """First root (by ``root_order``) that holds all three files of a bin."""
    name = _file_name(F.col("path"))
    listed = listing.select(F.col("path").alias("file_path"), name.alias("_name"), F.substring_index(name, ".", -1).alias("_ext")).where(
        F.col("_ext").isin(*EXTENSIONS)).withColumn("bin_lid", F.expr("substring(_name, 1, length(_name) - 4)"))
    wanted = parsed.select(*dict.fromkeys([*key, "root_order", "bin_lid", *PLACED_BY]))
    rows = wanted.count()
    found = ordered.spread(wanted, ["bin_lid"], 4 * rows).join(ordered.spread(listed, ["bin_lid"], 4 * rows), "bin_lid").withColumn(
        "_prio", _raw_rank(F.col("file_path"), F.col("_name"))).where("_prio IS NOT NULL").select(*key, "root_order", "_ext", "_prio", "file_path")
    # Dealt by key once, for both groupings below; only then are the texts of a key sorted.
    found = ordered.spread(found, key, 4 * rows)
    best = [F.min_by(F.when(F.col("_ext") == e, F.col("file_path")), F.when(F.col("_ext") == e, F.col("_prio"))).alias(f"{e}_path") for e in EXTENSIONS]
    per_root = found.groupBy(*key, "root_order").agg(*best).na.drop(subset=[f"{e}_path" for e in EXTENSIONS])
    paths = F.struct(*[f"{e}_path" for e in EXTENSIONS])
    return per_root.groupBy(*key).agg(F.min_by(paths, "root_order").alias("p")).select(*key, "p.*")


def raw_fileset_find(parsed: DataFrame, listing: DataFrame, key: Sequence[str]) -> DataFrame:
    return fileset_multi_root(parsed.withColumn("root_order", F.lit(0)), listing, key)


def product_files(listing: DataFrame) -> DataFrame:
    """``file_path, product, bin_lid`` of listed files whose name ends like a file of a product; a name may be read in several ways."""
    endings = {(p, f.rsplit("/", 1)[-1].removeprefix("{lid}")) for p, fs in (PRODUCT_FILES | {p: PRODUCT_FILES[p] + [
        f for f in PRODUCT_FOLDERS[p] if not f.endswith("{filename}")] for p in PRODUCT_FOLDERS}).items() for f in fs}
    rows = listing.select(F.col("path").alias("file_path"), _file_name(F.col("path")).alias("_name"))
    read = [F.when(F.col("_name").endswith(e), F.struct(F.lit(p).alias("product"), F.expr(f"substring(_name, 1, length(_name) - {len(e)})").alias("bin_lid")))
            for p, e in sorted(endings)]
    return rows.select("file_path", F.explode(F.array_compact(F.array(*read))).alias("_as")).select("file_path", "_as.*")


def product_find_multi_root(parsed: DataFrame, listing: DataFrame, key: Sequence[str], rank: Sequence[str] = ("root_order", "_prio")) -> DataFrame:
    """Best listed file of each identifier's product over several roots: joined by what the file names say, then ranked by folder."""
    found = parsed.join(product_files(listing), ["product", "bin_lid"])
    # behind an explode the long expression is evaluated once, not in the filter and again in the aggregate
    ranked = found.withColumn("_prio", F.explode(F.array(F.array_position(product_paths(), F.col("file_path"))))).where("_prio > 0")
    return ranked.groupBy(*key).agg(F.min_by("file_path", F.struct(*rank)).alias("product_path"))


def product_find(parsed: DataFrame, listing: DataFrame, key: Sequence[str]) -> DataFrame:
    return product_find_multi_root(parsed, listing, key, ["_prio"])


def _three_of(files: DataFrame, key: Sequence[str]) -> DataFrame:
    paths = [F.max(F.when(F.col("ext") == e, F.col("path"))).alias(f"{e}_path") for e in EXTENSIONS]
    return files.groupBy(*key).agg(*paths).na.drop(subset=[f"{e}_path" for e in EXTENSIONS])


def fileset_listing(listing: DataFrame) -> DataFrame:
    """Complete filesets by stem, newest name first."""
    named = listing.select("path", F.regexp_extract("path", r"([^/]*)\.([^./]+)$", 1).alias("lid"),
                           F.substring_index("path", ".", -1).alias("ext"))
    return _three_of(named.where(F.col("ext").isin(*EXTENSIONS)), ["lid"]).orderBy(F.desc("lid"))


def fileset_complete(files: DataFrame, key: str = "lid", ext: str = "ext") -> DataFrame:
    """Has each group all three files? A bit mask, combined before the shuffle."""
    bits = reduce(lambda a, e: F.when(F.col(ext) == e[1], 1 << e[0]).otherwise(a), enumerate(EXTENSIONS), F.lit(0))
    return files.groupBy(key).agg((F.bit_or(bits) == 7).alias("complete"))



def list_raw_filesets(listing: DataFrame, root: str) -> DataFrame:
    """Filesets in any of the five folder layouts below ``root``, siblings in the same folder."""
    root = root.rstrip("/")
    inside = listing.where(F.col("path").startswith(root + "/"))
    kept = inside.where(F.substr("path", F.lit(len(root) + 2)).rlike("^" + RAW_LAYOUTS))
    named = kept.select("path", F.regexp_extract("path", r"(.*/(.*))\.\w+$", 1).alias("basename"),
                        F.regexp_extract("path", r"(.*/(.*))\.\w+$", 2).alias("lid"),
                        F.substring_index("path", ".", -1).alias("ext"))
    return _three_of(named, ["basename", "lid"]).drop("basename")


def union_roots(listing: DataFrame, roots: Sequence[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [list_raw_filesets(listing, r) for r in roots])


def validate_data_dir(listing: DataFrame, roots: DataFrame, product: str) -> DataFrame:
    """Roots (``root``) that look like a folder of the product: the root must be one of a file's parent folders."""
    return _dir_hits(listing, {product: DATA_DIR_LAYOUTS[product]}).select(F.col("directory").alias("root")).join(
        roots.select("root").distinct(), "root").distinct()


def _parents(path: Column) -> Column:
    """All parent folders of a path, shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                       lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _dir_hits(listing: DataFrame, layouts: dict[str, tuple[str, str]]) -> DataFrame:
    """(directory, product): folders that have files of a product in its layout below them.

    File names are told apart first; what remains, each folder once with the products of its files, is matched against the folders above.
    """
    def told(text: Column, part: int) -> Column:
        return F.array_compact(F.array(*[F.when(text.rlike("^" + p[part]), F.lit(n)) for n, p in layouts.items()]))

    path, name = F.col("path"), _file_name(F.col("path"))
    folder = F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)))")  # ends in a slash
    folders = listing.where(F.contains(path, F.lit("/"))).select(folder.alias("_folder"), F.explode(told(name, 1)).alias("product")).distinct()
    rows = folders.select("_folder", "product", F.explode(_parents(F.col("_folder"))).alias("directory"))
    below = F.substr("_folder", F.length("directory") + 2)
    inside = reduce(lambda a, n: F.when(F.col("product") == n, below.rlike(f"^{layouts[n][0]}$")).otherwise(a), layouts, F.lit(False))
    return rows.where(inside).select("directory", "product").distinct()


def find_data_dirs(listing: DataFrame) -> DataFrame:
    """(directory, product) down the tree; nothing below a folder that is a hit itself."""
    hits = _dir_hits(listing, DATA_DIR_LAYOUTS)
    dirs = hits.select(F.col("directory").alias("_up")).distinct()
    above = hits.select("directory", F.explode(_parents(F.col("directory"))).alias("_up")).where("_up <> directory")
    covered = above.join(dirs, "_up", "left_semi").select("directory").distinct()
    return hits.join(covered, "directory", "left_anti")


# -- folders of a series ----------------------------------------------------------------------------------------------

def data_roots(series: DataFrame, data_dirs: DataFrame, label: str, product_type: str = "raw") -> DataFrame:
    wanted = series.where(F.col("label") == label).select(F.col("id").alias("time_series_id"))
    return data_dirs.where(F.col("product_type") == product_type).join(wanted, "time_series_id", "left_semi").select(
        "path", "priority").orderBy("priority")


def accepts_products(series: DataFrame, data_dirs: DataFrame, product_type: str) -> DataFrame:
    enabled = series.where("enabled").select(F.col("id").alias("time_series_id"))
    dirs = data_dirs.where(F.col("product_type") == product_type).join(enabled, "time_series_id", "left_semi")
    return dirs.limit(1).agg((F.count("*") > 0).alias("accepts"))


def product_destination(parsed: DataFrame, series: DataFrame, data_dirs: DataFrame) -> DataFrame:
    """Preferred path below the first root for the product; multiblob lies with the features."""
    dirs = data_dirs.join(series.select(F.col("id").alias("time_series_id"), F.col("label").alias("ts_label")),
                          "time_series_id")
    first = dirs.groupBy("ts_label", F.col("product_type").alias("_type")).agg(
        F.min_by("path", F.struct("priority", "path")).alias("root"))
    typed = parsed.withColumn("_type", F.when(F.col("product") == "multiblob", "features").otherwise(F.col("product")))
    placed = typed.join(first, ["ts_label", "_type"]).drop("_type")
    best = _per_product(lambda options: options[0], F.lit(None).cast("string"))
    return placed.withColumn("destination", best).where("destination IS NOT NULL")


def check_roots(data_dirs: DataFrame, listing: DataFrame) -> DataFrame:
    """Per raw root: is there any fileset? Filesets are found once per parent folder, not once per root."""
    hits = _dir_hits(listing, {"raw": RAW_LAYOUT}).select(F.col("directory").alias("path")).distinct()
    raw = data_dirs.where("product_type = 'raw'").select("path").distinct()
    return raw.join(hits.withColumn("_hit", F.lit(True)), "path", "left").select(
        "path", F.coalesce("_hit", F.lit(False)).alias("found"))


def after_year(bins: DataFrame, year: int) -> DataFrame:
    """Later years only, as a range on the time so that it is pushed down."""
    return bins.where(F.col("sample_time") >= F.lit(f"{year + 1}-01-01").cast("timestamp_ntz"))


# -- fixity -----------------------------------------------------------------------------------------------------------

def fixity_check(recorded: DataFrame, observed: DataFrame, fast: bool = False, key: str = "path") -> DataFrame:
    """Flags exists / length / checksum of each recorded file."""
    seen = observed.select(key, F.col("length").alias("_length"), F.col("sha1").alias("_sha1"), F.lit(True).alias("_seen"))
    rows = recorded.join(seen, key, "left")
    flags = {"exists": F.coalesce("_seen", F.lit(False)),
             "length_ok": F.coalesce(F.col("length") == F.col("_length"), F.lit(False))}
    if not fast:
        flags["checksum_ok"] = F.coalesce(F.col("sha1") == F.col("_sha1"), F.lit(False))
    return rows.withColumns(flags).drop("_length", "_sha1", "_seen")


def fixity_compare(recorded: DataFrame, observed: DataFrame, threshold: float = 0, key: str = "path") -> DataFrame:
    """``reason`` a file fails, null when it passes."""
    from brinelog.functions.times import iso8601, seconds_between
    seen = observed.select(key, F.col("length").alias("_length"), F.col("sha1").alias("_sha1"), F.col("mtime").alias("_mtime"))
    rows = recorded.join(seen, key, "left")
    fix, now = iso8601(F.col("fix_time")), iso8601(F.col("_mtime"))
    later = seconds_between(F.col("_mtime"), F.col("fix_time")) > threshold
    reason = (
        F.when(F.col("_length").isNull(), F.lit("file is missing"))
        .when(F.col("length") != F.col("_length"),
              F.format_string("file was %d bytes at fix time of %s, but is %d bytes as of %s", "length", fix, "_length", now))
        .when(later & (F.col("sha1") != F.col("_sha1")), F.format_string("file modified at %s, after fix date of %s", now, fix))
        .when(later, F.format_string("file touched at %s, after fix date of %s, but checksums match", now, fix)))
    return rows.withColumn("reason", reason).drop("_length", "_sha1", "_mtime")


def fixity_status(recorded: DataFrame, observed: DataFrame, key: str = "path") -> DataFrame:
    """First failing test of each file: existence, size, checksum; else ``ok``."""
    checked = fixity_check(recorded, observed, key=key)
    status = F.when(~F.col("exists"), "existence").when(~F.col("length_ok"), "size").when(
        ~F.col("checksum_ok"), "checksum").otherwise("ok")
    return checked.withColumn("status", status).drop("exists", "length_ok", "checksum_ok")


def compare_files(asked: DataFrame, one: DataFrame, two: DataFrame, key: str, name: bool = True, size: bool = False,
                  checksum: bool = False) -> DataFrame:
    """Are two files the same by base name, size and SHA-1, as asked?"""
    a = one.select(key, F.col("path").alias("_pa"), F.col("length").alias("_la"), F.col("sha1").alias("_sa"))
    b = two.select(key, F.col("path").alias("_pb"), F.col("length").alias("_lb"), F.col("sha1").alias("_sb"))
    same = F.lit(True)
    if name:
        same = same & (F.substring_index("_pa", "/", -1) == F.substring_index("_pb", "/", -1))
    if size:
        same = same & (F.col("_la") == F.col("_lb"))
    if checksum:
        same = same & (F.col("_sa") == F.col("_sb"))
    joined = asked.join(a, key, "left").join(b, key, "left")
    return joined.withColumn("same", F.coalesce(same, F.lit(False))).drop("_pa", "_pb", "_la", "_lb", "_sa", "_sb")


# -- names ------------------------------------------------------------------------------------------------------------

def filename_signature_count(paths: DataFrame, col: str = "path", share: float = 1 / 500) -> DataFrame:
    """Shapes of file names that make up more than ``share`` of all, most frequent first."""
    from brinelog.functions.text import filename_shape
    counts = paths.select(filename_shape(F.col(col)).alias("shape")).groupBy("shape").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).select("t").scalar()
    return counts.where(F.col("n") > total * share).orderBy(F.desc("n"), "shape")


def path_self_similarity(paths: DataFrame, col: str = "path") -> DataFrame:
    """Per path length n and places (i, j): share of paths with equal characters there, the common prefix stripped."""
    # The common prefix of all paths is that of the smallest and the largest one.
    ends = paths.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    at = F.sequence(F.lit(1), F.greatest(F.length("lo"), F.lit(1)))
    shared = F.aggregate(at, F.lit(0), lambda n, i: F.when(
        (n == i - 1) & (F.substr("lo", F.lit(1), i) == F.substr("hi", F.lit(1), i)) & (i <= F.length("hi")), i).otherwise(n))
    prefix = ends.select(shared.alias("p")).scalar()
    rest = paths.select(F.substr(F.col(col), prefix + 1).alias("s")).where(F.length("s") > 0)
    return equal_places(rest).groupBy("n", "i", "j").agg((F.sum("hits") / F.sum("paths")).alias("share"))


def equal_places(strings: DataFrame, cells: int = 8_000_000) -> DataFrame:
    """Per task, length n and places (i, j) of the strings ``s``: how many have equal characters there, of how many.

    A task holds one matrix per length and gives it out at its end, so its rows depend on the lengths it meets, not on its strings. Once the
    matrices have more than ``cells`` places together, they are given out and started anew.
    """
    def run(batches):
        import numpy as np
        import pandas as pd
        sums, count, block = {}, {}, 500_000

        def flushed():
            for n, equal in sums.items():
                step = max(1, block // n)
                for a in range(0, n, step):
                    i, j = np.indices(equal[a:a + step].shape)
                    yield pd.DataFrame({"n": n, "i": (i + a).ravel(), "j": j.ravel(), "hits": equal[a:a + step].ravel(), "paths": count[n]})
            sums.clear()
            count.clear()

        for pdf in batches:
            for n, group in pdf["s"].groupby(pdf["s"].str.len()):
                n = int(n)
                if n not in sums:
                    if sums and sum(k * k for k in sums) + n * n > cells:
                        yield from flushed()
                    sums[n], count[n] = np.zeros((n, n), dtype=np.int64), 0
                chars = np.frombuffer("".join(group).encode("utf-32-le"), dtype=np.uint32).reshape(-1, n)
                for j in range(n):
                    sums[n][:, j] += (chars == chars[:, j:j + 1]).sum(axis=0)
                count[n] += len(group)
        yield from flushed()

    return strings.select("s").mapInPandas(run, "n long, i long, j long, hits long, paths long")


def diagonal_runs(similarity: DataFrame, at_least: float = 1.0, strict: bool = False, longer_than: int = 2) -> DataFrame:
    """Runs of high similarity along the diagonals ``j - i = d``; a run must be closed by a lower value.

    Diagonal d is scanned from place d up to n - d. ``strict`` asks for more than ``at_least``.
    """
    from brinelog.operators import ordered
    good = F.col("share") > at_least if strict else F.col("share") >= at_least
    cells = similarity.withColumn("d", F.col("j") - F.col("i")).where("d >= 1 AND j >= d AND j < n - d")
    cells = cells.withColumn("good", good.cast("int"))
    ranked = ordered.running_sum(cells.withColumn("bad", 1 - F.col("good")), ["n", "d"], ["j"],
                                 ordered.block_slice("j"), "bad", "island")
    runs = ranked.groupBy("n", "d", "island").agg(
        F.sum("good").alias("run"), F.min(F.when(F.col("good") == 1, F.col("j"))).alias("start"))
    last = F.max("island")
    closed = ordered.with_group_stats(runs, ["n", "d"], _last=last).where("island < _last")
    return closed.where(F.col("run") > longer_than).select("n", "run", (F.col("start") - F.col("d")).alias("a"),
                                                           F.col("start").alias("b"))
