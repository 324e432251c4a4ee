import hashlib
import os

import pytest
from pyspark.sql import functions as F

from brinelog.operators import files, ingest, stitching
from brinelog.sources import readers, sinks


def test_line_numbers_of_a_file_read_in_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 40) for i in range(1, 5001)]
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = readers.numbered_lines(spark, str(tmp_path))
        got = sorted((os.path.basename(r.path), r.n, r.line) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted((n, i, t) for n in ("a.txt", "b.txt") for i, t in enumerate(lines, 1))
    assert [r.n for r in readers.line_slice(df, 2, 2).where(F.col("path").endswith("a.txt")).orderBy("n").collect()] == [3, 4]


def lines(spark, path, rows):
    return spark.createDataFrame([(path, i, t) for i, t in enumerate(rows, 1)], "path string, n long, line string")


def test_adc_numbers_stay_when_empty_targets_go(spark):
    def row(w, h):
        cells = dict(trigger=1, width=w, height=h, byteOffset=0)
        return ",".join(str(cells.get(c, 2)) for c in readers.ADC_V2_COLUMNS)
    df = lines(spark, "p", [row(3, 4), row(0, 0), row(5, 6)])
    assert [(r.targetNumber, r.width) for r in readers.adc_scan(df).orderBy("targetNumber").collect()] == [(1, 3), (3, 5)]
    assert readers.adc_slice(df, 2, 2).count() == 1
    assert readers.adc_target(df, "p", 2).count() == 0
    assert readers.adc_scan(df.where("n > 9")).count() == 0


@pytest.mark.parametrize("rows, context, typed", [
    (["softwareVersion: 2", "temperature: 11.5", "a: b: c", "junk"], ["softwareVersion: 2"], (11.5, None, None)),
    ([readers.FIXED_HDR_LINE, "temperature: 3"], [readers.FIXED_HDR_LINE], (None, None, None)),
    (['"a"', '"b"', '"c"', '"d"', '"Temp Humidity"', '"12.5 40.25 17"'], ["a", "b", "c", "d"], (12.5, 40.25, 17)),
    (['"a"', '"b"', '"c"', '"1 2 3"'], ["a", "b"], (None, None, None))])
def test_header_layouts(spark, rows, context, typed):
    entries = readers.hdr_scan(lines(spark, "h", rows))
    texts, _ = readers.split_hdr(entries)
    assert [r.text for r in texts.orderBy("n").collect()] == context
    r = readers.hdr_typed(entries).first()
    assert (r.temperature, r.humidity, r.binarizeThreshold) == typed


def test_ranges_and_fixity(spark, tmp_path):
    data = bytes(range(256)) * 40
    (tmp_path / "x.roi").write_bytes(data)
    path = "file:" + str(tmp_path / "x.roi")
    t = spark.createDataFrame([(1, path, 5, 3, 2), (2, path, 300, 4, 4), (3, path, 0, 0, 7)], "bin int, path string, byteOffset long, width long, height long")
    px = readers.roi_pixels_scan(t, ["bin"]).collect()
    assert {(r.bin, r.y, r.x): r.v for r in px} == {
        **{(1, i // 2, i % 2): data[5 + i] for i in range(6)}, **{(2, i // 4, i % 4): data[300 + i] for i in range(16)}}
    r = readers.file_fixity(spark, str(tmp_path)).first()
    assert (r.filename, r.length, r.sha1) == ("x.roi", len(data), hashlib.sha1(data).hexdigest())
    assert readers.file_fixity(spark, str(tmp_path), fast=True).first().sha1 == "(no checksum)"


def test_fixity_of_a_table_that_is_a_folder(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one")
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    parts = {p.name: p.read_bytes() for p in (tmp_path / "t.parquet").glob("part-*")} | {"a.bin": b"one"}
    got = {r.filename: (r.length, r.sha1) for r in readers.file_fixity(spark, str(tmp_path), block=16, recursive=True).collect()}
    assert got == {name: (len(data), hashlib.sha1(data).hexdigest()) for name, data in parts.items()}
    assert [r.filename for r in readers.file_fixity(spark, str(tmp_path)).collect()] == ["a.bin"]


TARGETS = "bin int, targetNumber long, trigger int, `left` int, bottom int, width int, height int, byteOffset long"


def test_chain_of_three_is_stitched_once(spark):
    t = spark.createDataFrame([(1, 1, 7, 0, 0, 10, 10, 0), (1, 2, 7, 5, 5, 10, 10, 100), (1, 3, 7, 12, 12, 10, 10, 200),
                               (1, 4, 8, 12, 12, 10, 10, 300), (1, 5, 8, 22, 12, 10, 10, 400)], TARGETS)
    got = stitching.list_stitched_targets(t).orderBy("targetNumber").collect()
    assert [(r.targetNumber, r.left, r.bottom, r.width, r.height, r.stitched) for r in got] == [
        (1, 0, 0, 15, 15, 1), (4, 12, 12, 10, 10, 0), (5, 22, 12, 10, 10, 0)]


def test_integrity(spark):
    good = [(1, 1, 7, 0, 0, 10, 10, 0), (1, 2, 7, 5, 5, 10, 10, 100)]
    twin = [(2, 1, 7, 0, 0, 10, 10, 0), (2, 2, 7, 0, 0, 10, 10, 100)]
    back = [(3, 1, 7, 0, 0, 10, 10, 50), (3, 2, 8, 0, 0, 10, 10, 20)]
    late = [(4, 1, 7, 0, 0, 10, 10, 950)]
    t = spark.createDataFrame(good + twin + back + late, TARGETS)
    roi = spark.createDataFrame([(b, 1000) for b in (1, 2, 3, 4)], "bin int, length long")
    got = {r.bin: (r.adc_ok, r.roi_ok, r.ok) for r in ingest.integrity(t, roi).collect()}
    assert got == {1: (True, True, True), 2: (False, True, False), 3: (True, False, False), 4: (True, False, False)}


def test_data_dirs_stop_at_a_hit(spark):
    paths = ["/top/a/2013/D20130101/x.hdr", "/top/a/2013/D20130101/x.adc", "/top/b/2013/20130101/x_blobs_v2.zip", "/top/c/readme.txt"]
    got = {(r.directory, r["product"]) for r in files.find_data_dirs(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {("/top/a", "raw"), ("/top/b", "blobs")}


def test_documents_are_written_in_order(spark, tmp_path):
    bins = spark.createDataFrame([("b1", "2020"), ("b2", "2021")], "pid string, date string")
    ctx = spark.createDataFrame([("b1", 1, 'say "hi"'), ("b1", 2, "two")], "pid string, n int, text string")
    props = spark.createDataFrame([("b1", 1, "t x", "5")], "pid string, n int, key string, value string")
    targets = spark.createDataFrame([("b1", i, f"b1_{i:05d}") for i in range(3, 400)], "bin_pid string, n int, pid string")
    import json
    sinks.write_document(sinks.json_bin_lines(bins, ctx, props, targets), str(tmp_path / "j"))
    whole = "".join(open(p).read() for p in sorted(str(x) for x in (tmp_path / "j").glob("part-*")))
    one, two = [json.loads(d) for d in whole.replace("\n", "").replace("]}{", "]}\n{").split("\n")]
    assert one["targets"] == [f"b1_{i:05d}" for i in range(3, 400)] and one["context"] == ['say "hi"', "two"] and one["t x"] == "5"
    assert two == {"pid": "b2", "date": "2021", "context": [], "targets": []}
    import xml.etree.ElementTree as et
    for name, make in (("x", sinks.xml_bin_lines), ("r", sinks.rdf_bin_lines)):
        sinks.write_document(make(bins.where("pid = 'b1'"), ctx, props, targets), str(tmp_path / name))
        et.fromstring("".join(open(p).read() for p in sorted(str(x) for x in (tmp_path / name).glob("part-*"))))


def test_pixels_of_every_target(spark, sf_dir):
    import __spark_entry__ as entry
    from brinelog.plans.bindings import Tables
    got = {(r.bin, r.targetNumber): (r.n, r.total) for r in entry.queries()["roi_pixels_scan"](spark, sf_dir).collect()}
    data = open(f"{sf_dir}/orders.parquet", "rb").read()
    want = {}
    for r in Tables(spark, sf_dir).targets.where("width * height > 0").collect():
        part = data[r.byteOffset + r.bin:][:r.width * r.height]
        want[r.bin, r.targetNumber] = (len(part), sum(part))
    assert max(k for _, k in want) > 1 and got == want
    assert all(n for n, _ in want.values())


def test_bytes_to_pixels_without_text_per_pixel(spark):
    """Bytes become numbers an image at a time; empty and null cells have no pixels."""
    rows = spark.createDataFrame([(1, 3, bytearray([0, 127, 128, 255, 7, 9])), (2, 2, bytearray()), (3, 2, None), (4, 1, bytearray([200]))],
                                 "bin long, height long, data binary")
    px = readers.bytes_to_pixels(rows, ["bin"])
    assert dict(px.dtypes) == {"bin": "bigint", "y": "bigint", "x": "bigint", "v": "int"}
    assert sorted(map(tuple, px.collect())) == [(1, 0, 0, 0), (1, 0, 1, 127), (1, 0, 2, 128), (1, 1, 0, 255), (1, 1, 1, 7), (1, 1, 2, 9), (4, 0, 0, 200)]
    assert "conv(" not in px._jdf.queryExecution().optimizedPlan().toString()


def test_text_files_lie_in_one_folder(spark, tmp_path):
    """A file per key and no folder per key; rows without a key share a file, keys may hold any character."""
    rows = spark.createDataFrame([("a/b", "1"), ("c", "2"), ("c", "2"), (None, "3"), (None, "4")], "k string, v string")
    sinks.write_text_files(rows, "k", "v", f"{tmp_path}/files")
    sinks.write_text_files(rows.limit(0), "k", "v", f"{tmp_path}/none")
    found = readers.json_file_scan(spark, f"{tmp_path}/files")
    assert sorted(r.doc for r in found.collect()) == ["1\n", "2\n2\n", "3\n4\n"]
    assert len(found.inputFiles()) == len([p for p in (tmp_path / "files").iterdir() if p.is_file()]) == 3
    assert readers.json_file_scan(spark, f"{tmp_path}/none").count() == 0


def test_ranges_of_files_laid_end_to_end(spark, tmp_path):
    """Ranges go from file to file and from the last byte to the first; without that, a range beyond the end of its file is an error."""
    parts = [bytes(range(10)), b"", bytes(range(100, 107))]
    files = []
    for i, data in enumerate(parts):
        (tmp_path / f"{i}.roi").write_bytes(data)
        files.append(("file:" + str(tmp_path / f"{i}.roi"), len(data)))
    whole = b"".join(parts)
    asked = [(1, 0, 4), (2, 8, 5), (3, 15, 40), (4, 1000, 3), (5, -2, 3), (6, None, 3), (7, 3, None), (8, 5, 0), (9, 2, 6)]
    rows = spark.createDataFrame([(k, "all", o, n) for k, o, n in asked] + [(10, None, 1, 1), (11, files[2][0], 2, 5)],
                                 "k int, path string, byteOffset long, size long").coalesce(1)
    got = {r.k: r.data for r in readers.read_ranges(rows, files={"all": files}).collect()}
    want = {k: None if o is None or n is None else bytes(whole[(o + i) % len(whole)] for i in range(n)) for k, o, n in asked}
    assert got == want | {10: None, 11: parts[2][2:7]}
    beyond = rows.where("k = 11").withColumn("size", F.lit(6).cast("long"))
    with pytest.raises(Exception, match="ends at byte 7"):
        readers.read_ranges(beyond).collect()


def test_pixels_of_targets_beyond_the_largest_file(spark, tmp_path):
    """Every target has all its pixels where the table is a folder of files, each shorter than the numbers of the bins."""
    import __spark_entry__ as entry
    from brinelog.plans.bindings import Tables
    spark.range(60).selectExpr("id AS o_orderkey").repartition(5).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, 1 + i % 50) for i in range(9)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(b, i % 9, 1, i, 7.0 + i, float(i)) for i, b in enumerate((0, 0, 0, 900, 900, 50_000, 9_000_000, 10**15, -3))],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").withColumn(
        "l_shipdate", F.lit("2020-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "orders.parquet").glob("part-*")))
    want = {(r.bin, r.targetNumber): (r.width * r.height, sum(data[(r.byteOffset + r.bin + i) % len(data)] for i in range(r.width * r.height)))
            for r in Tables(spark, str(tmp_path)).targets.collect()}
    got = {(r.bin, r.targetNumber): (r.n, r.total) for r in entry.queries()["roi_pixels_scan"](spark, str(tmp_path)).collect()}
    assert len(want) == 9 and got == want


def test_pixels_are_read_in_one_python_step(spark, sf_dir, monkeypatch):
    """One Python step below the pixel rows, on targets dealt by number."""
    import __spark_entry__ as entry
    from brinelog.plans import ingest_queries
    monkeypatch.setattr(ingest_queries, "SCANNED_TARGETS", 200)
    df = entry.queries()["roi_pixels_scan"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInPandas" not in plan and "REPARTITION_BY_NUM" in plan
    assert df.count() == 6000
