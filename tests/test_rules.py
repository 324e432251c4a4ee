"""Golden cases of templates, matches, selectors, times and identifiers."""

import json

import pytest
from pyspark.sql import functions as F

from brinelog.functions import ids, nested, text, times
from brinelog.operators import rules


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([("7", "quux", None)], "x string, blaz string, none string")


def value(df, col):
    return df.select(col.alias("v")).first().v


def test_interpolate(one):
    assert value(one, rules.interpolate("${x}_${blaz}", one.columns)) == "7_quux"
    assert value(one, rules.interpolate("${x}_${gone}", one.columns)) is None
    assert value(one, rules.interpolate("${x}_${gone}${none}", one.columns, fail_fast=False)) == "7_"
    assert value(one, rules.substitute_lenient("${x}_${gone}", one.columns)) == "7_${gone}"


def test_any_then_all(one):
    out = rules.conjunction_all(
        one, lambda d: rules.union_any(d, lambda b: b.withColumns({"a": F.lit("A"), "b": F.lit("B")}),
                                       lambda b: b.withColumns({"a": F.lit("a"), "b": F.lit("b")})),
        lambda d: rules.assign(d, "ab", "${a}${b}"))
    assert [r.ab for r in out.collect()] == ["AB", "ab"]


def test_match_groups(spark):
    df = spark.createDataFrame([("yes,no,123 and more",), ("no match",)], "s string")
    got = rules.filter_match(df, "s", r"([a-z]+),(?P<two>[a-z]+),(\d+)( never)?", ["one", "three", "four"]).collect()
    assert [(r.one, r.two, r.three, r.four) for r in got] == [("yes", "no", "123", None)]
    kept = rules.filter_match(df, "s", r"(yes)", ["y"], optional=True).orderBy("s").collect()
    assert [r.y for r in kept] == [None, "yes"]
    assert rules.filter_match(df, "s", r"yes", full=True).count() == 0


def test_compare_numbers_else_text(spark):
    df = spark.createDataFrame([("10",), ("9",), ("abc",)], "s string")
    assert [r.s for r in rules.filter_test(df, F.col("s"), gt="9.5").collect()] == ["10", "abc"]
    assert rules.filter_test(df, F.col("s"), eq="9.0", gt="0").collect()[0].s == "9"


def test_first_branch_and_commit(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    branches = [lambda d: d.where("id = 1").withColumn("b", F.lit("one")), lambda d: d.where("id < 3").withColumn("b", F.lit("two")),
                lambda d: d.withColumn("b", F.lit("rest"))]
    got = {r.id: r.b for r in rules.first_branch(df, branches, ["id"]).collect()}
    assert got == {1: "one", 2: "two", 3: "rest"}
    rest = rules.first_branch(df, branches, ["id"], commit=lambda d: d.where("b <> 'one'"))
    assert {r.id: r.b for r in rest.collect()} == {1: "two", 2: "two", 3: "rest"}
    assert [r.id for r in rules.negation_none(df, lambda d: d.where("id > 1"), ["id"]).collect()] == [1]
    assert rules.hit(df, lambda d: d.where("id = 1")).count() == 4


def test_split_and_nth(spark):
    df = spark.createDataFrame([("foo bar baz",)], "s string")
    r = rules.split_cols(df, "s", ["a", "b", "c", "d"]).first()
    assert (r.a, r.b, r.c, r.d) == ("foo", "bar", "baz", None)
    words = rules.split_rows(df, "s", "w").select("w")
    assert rules.post_block(words, order=["w"], count="n", nth=2).first().asDict() == {"w": "baz", "n": 2}
    assert rules.post_block(words, order=["w"], nth=9).count() == 0


def test_slices(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert rules.slice_default(df, "x,y").first().asDict() == {"x": "a", "y": None}
    assert rules.slice_default(df, ["x", "y", "z"], default="d").first().asDict() == {"x": "a", "y": "d", "z": "d"}
    assert rules.slice_default(df, {"x": F.upper}).first().asDict() == {"x": "A"}
    with pytest.raises(KeyError):
        rules.slice_default(df, ["q"], required=True)


@pytest.mark.parametrize("expr, want", [
    ("targets pid", ["p1", "p2", "p3"]), ("targets:first pid", ["p1"]), ("targets:last pid", ["p3"]),
    ("targets stitched=1 pid", ["p1", "p3"]), ("context", ["one", "two"]), ("context:first", ["one"]), ("depth", ["5"]),
    ("depth more", ["5"]), ("inner a b", ["9"])])
def test_json_selectors(spark, expr, want):
    doc = {"targets": [{"pid": "p1", "stitched": 1}, {"pid": "p2", "stitched": 0}, {"pid": "p3", "stitched": 1}],
           "context": ["one", "two"], "depth": 5, "inner": {"a": {"b": 9}}}
    df = spark.createDataFrame([(json.dumps(doc),)], "j string")
    assert [r.v for r in nested.json_select(df, "j", expr, "v").collect()] == want


def test_json_objects_bind_their_keys(spark):
    docs = [{"rows": [{"a": 1, "it's": [1, 2]}, {"b": {"c": None}, "a": None}, 7, "text", [{"a": 9}]]}, {"rows": []}, {"other": {"a": "x"}}, 5, None]
    df = spark.createDataFrame([(k, "outer", None if d is None else json.dumps(d)) for k, d in enumerate(docs)], "k int, b string, j string")
    got = nested.json_bind(df, "j", "rows").drop("j")
    assert got.columns == ["k", "b", "a", "it's", "other"]
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == [(0, "outer", "1", "[1,2]", None), (0, '{"c":null}', None, None, None), (2, "outer", None, None, '{"a":"x"}')]
    assert [tuple(r) for r in nested.json_bind(df.where("k = 0"), "j", "rows:first", ["a", "none"]).select("k", "a", "none").collect()] == [(0, "1", None)]
    assert nested.json_bind(df.limit(0), "j").columns == ["k", "b", "j"]


def test_json_object_without_the_key_is_a_hit(spark):
    df = spark.createDataFrame([('{"a":1}',)], "j string")
    assert json.loads(nested.json_select(df, "j", "zzz", "v").first().v) == {"a": 1}


def test_times(spark):
    df = spark.createDataFrame([(0,), (1328203363,)], "s long").select(times.epoch_to_utc(F.col("s")).alias("t")).orderBy("t")
    iso = [r.v for r in df.select(times.iso8601(F.col("t")).alias("v")).collect()]
    rfc = [r.v for r in df.select(times.rfc822(F.col("t")).alias("v")).collect()]
    assert iso == ["1970-01-01T00:00:00Z", "2012-02-02T17:22:43Z"]
    assert rfc == ["Thu, 01 Jan 1970 00:00:00 +0000", "Thu, 02 Feb 2012 17:22:43 +0000"]


def test_path_params(spark):
    df = spark.createDataFrame([("a/3/b/5",), ("/a/3/b/5",), ("",)], "p string")
    got = [r.m for r in df.select(ids.path_params(F.col("p"), {"c": "1"}).alias("m")).collect()]
    assert got == [{"c": "1", "a": "3", "b": "5"}, {"c": "1", "a": "3", "b": "5"}, {"c": "1"}]


@pytest.mark.parametrize("pid, want", [
    ("http://x.org/bay1/IFCB1_2009_216_075913_00042_blobs.zip",
     dict(namespace="http://x.org/bay1/", ts_label="bay1", bin_lid="IFCB1_2009_216_075913", lid="IFCB1_2009_216_075913_00042", timestamp="2009_216_075913",
          schema_version="v1", instrument="1", year="2009", yearday="2009_216", target="00042", product="blobs", extension="zip")),
    ("D20130101T123456_IFCB010.hdr",
     dict(namespace=None, ts_label=None, bin_lid="D20130101T123456_IFCB010", lid="D20130101T123456_IFCB010", timestamp="20130101T123456",
          schema_version="v2", instrument="010", year="2013", yearday="20130101", target=None, product="raw", extension="hdr"))])
def test_parse_pid(spark, pid, want):
    got = ids.parse_pid(spark.createDataFrame([(pid,), ("nothing",)], "pid string")).collect()
    assert len(got) == 1 and {k: got[0][k] for k in want} == want


def test_text(spark):
    df = spark.createDataFrame([(56712.15, "camelCaseName.tar.gz", "3.5"), (100.0, "ab", "x")], "d double, s string, q string").orderBy("d")
    assert [r.v for r in df.select(text.csv_number(F.col("d")).alias("v")).collect()] == ["100", "56712.150000000001"]
    assert [r.v for r in df.select(text.decamel(F.col("s")).alias("v")).collect()] == ["Ab", "Camel Case Name.tar.gz"]
    assert [r.v for r in df.select(text.remove_extension(F.col("s")).alias("v")).collect()] == ["ab", "camelCaseName.tar"]
    assert [r.v for r in df.select(text.csv_quote(F.col("q")).alias("v")).collect()] == ['"x"', "3.5"]
    ns = spark.range(5000).select(text.gen_id("n/").alias("v"))
    assert ns.distinct().count() == 5000
