"""Lookups against a listing give what trying every candidate path gives."""

import random

import pytest
from pyspark.sql import functions as F

from brinelog.operators import files

PARSED = "k int, bin_lid string, extension string, schema_version string, product string, year string, yearday string, instrument string, root string, root_order int"


@pytest.fixture(scope="module")
def parsed(spark):
    rng, rows = random.Random(1), []
    for k in range(150):
        year, day, version = rng.choice(["2019", "2020"]), rng.randrange(100, 104), rng.choice(["v1", "v2"])
        lid = f"L{rng.randrange(40)}" + rng.choice(["", "", "_blobs_v2", "_multiblob_v2"])
        product = rng.choice([*files.PRODUCT_FILES, "none"])
        for order, root in enumerate(("/a", "/b/c")):
            rows.append((k, lid, rng.choice(["hdr", "adc", "roi", "csv"]), version, product, year, f"{year}{day}", "IFCB5", root, order))
    return spark.createDataFrame(rows, PARSED)


def some_of(candidates, part):
    return candidates.where(F.pmod(F.xxhash64("file_path"), F.lit(part)) == 0).select(F.col("file_path").alias("path")).distinct()


def best(candidates, listing, rank, name):
    found = candidates.join(listing.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    return sorted(map(tuple, found.groupBy("k").agg(F.min_by("file_path", F.struct(*rank)).alias(name)).collect()))


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_raw_files(parsed):
    one = parsed.where("root_order = 0")
    candidates = files.file_path_candidates(one)
    listing = some_of(candidates, 4)
    got = rows_of(files.raw_file_find(one, listing, ["k"]))
    assert got == best(candidates, listing, ["prio"], "file_path") and len(got) > 50
    assert rows_of(files.raw_destination(one).select("k", "file_path")) == rows_of(candidates.where("prio = 0").select("k", "file_path"))


def test_products(parsed):
    candidates = files.product_path_candidates(parsed)
    listing = some_of(candidates, 6)
    got = rows_of(files.product_find_multi_root(parsed, listing, ["k"]))
    assert got == best(candidates, listing, ["root_order", "prio"], "product_path") and len(got) > 50
    one, first = parsed.where("root_order = 1"), candidates.where("root_order = 1")
    assert rows_of(files.product_find(one, listing, ["k"])) == best(first, listing, ["prio"], "product_path")


def test_filesets(parsed):
    three = parsed.drop("extension").withColumn("extension", F.explode(F.array(*map(F.lit, files.EXTENSIONS))))
    candidates = files.file_path_candidates(three)
    listing = some_of(candidates, 2)
    found = candidates.join(listing.select(F.col("path").alias("file_path")), "file_path", "left_semi").collect()
    want = {}
    for r in found:
        own = want.setdefault((r.k, r.root_order), {})
        own[r.extension] = min(own.get(r.extension, (99, "")), (r.prio, r.file_path))
    whole = sorted((k, o, *(own[e][1] for e in files.EXTENSIONS)) for (k, o), own in want.items() if len(own) == 3)
    expected = {}
    for k, _, *paths in whole:
        expected.setdefault(k, (k, *paths))
    assert rows_of(files.fileset_multi_root(parsed, listing, ["k"])) == sorted(expected.values()) and len(expected) > 50


def test_odd_listings(spark, parsed):
    odd = spark.createDataFrame([(None,), ("",), ("/",), (".hdr",), ("/a/x/L1.hdr",), ("_fea_v2.csv",)], "path string")
    assert files.raw_file_find(parsed, odd, ["k"]).collect() == []
    assert files.product_find(parsed, odd.limit(0), ["k"]).collect() == []
    assert files.fileset_multi_root(parsed, odd, ["k"]).collect() == []


def test_places_are_summed_per_length_not_per_batch(spark):
    words = ["".join(chr(97 + (i * j) % 3) for j in range(1 + i % 6)) for i in range(500)] + ["ü€", "x" * 50]
    strings = spark.createDataFrame([(w,) for w in words], "s string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        whole, split = (files.equal_places(strings, cells).collect() for cells in (8_000_000, 30))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(whole) == sum(n * n for n in {len(w) for w in words})
    want = {(n, i, j): (sum(w[i] == w[j] for w in words if len(w) == n), sum(len(w) == n for w in words))
            for n in {len(w) for w in words} for i in range(n) for j in range(n)}
    assert {(r.n, r.i, r.j): (r.hits, r.paths) for r in whole} == want
    again = {}
    for r in split:
        a, b = again.get((r.n, r.i, r.j), (0, 0))
        again[r.n, r.i, r.j] = (a + r.hits, b + r.paths)
    assert again == want and len(split) > len(whole)


def test_folders_of_a_listing_are_matched_once(spark):
    """Hits equal those of matching every path below every parent; rows are made from folders, not from files."""
    import itertools
    import re
    folders = ["", "/", "/a/", "/a/2013/D2013/", "a/", "/a/IFCB1_2013_001/", "/a/2013/IFCB1_2013_001/", "/b/D2013/D1/", "/b/2013/20130101/", "/c/features2013_v2/", "//"]
    names = ["x.hdr", "x.roi", ".adc", "x_blobs_v2.zip", "y_fea_v4.csv", "x.txt", "", "x.hdr\n"]
    paths = [f + n for f, n in itertools.product(folders, names)] + [None]
    want = set()
    for path in filter(None, paths):
        parts = path.split("/")
        for n in range(1, len(parts)):
            up, rest = "/".join(parts[:n]), "/".join(parts[n:])
            want |= {(up, p) for p, (below, name) in files.DATA_DIR_LAYOUTS.items() if re.search(f"^{below}{name}", rest)}
    listing = spark.createDataFrame([(p,) for p in paths], "path string")
    hits = files._dir_hits(listing, files.DATA_DIR_LAYOUTS)
    assert {tuple(r) for r in hits.collect()} == want and hits.count() == len(want) > 12


def test_filesets_of_many_rows_are_dealt_by_their_number(spark, parsed, monkeypatch):
    three = parsed.drop("extension").withColumn("extension", F.explode(F.array(*map(F.lit, files.EXTENSIONS))))
    listing = some_of(files.file_path_candidates(three), 2)
    few = rows_of(files.fileset_multi_root(parsed, listing, ["k"]))
    monkeypatch.setattr(files.ordered, "RANGE_ROWS", 40)
    many = files.fileset_multi_root(parsed, listing, ["k"])
    assert many._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 3
    assert rows_of(many) == few and few
