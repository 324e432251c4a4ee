import random

from pyspark.sql import functions as F

from brinelog.llm import line_dedup as ld
from tests.llm.cases import awkward, empty


def plain(rows, least):
    """A line goes if it is in a run of ``least`` words or more whose lines stood, as a run, at an earlier place."""
    own = [(d, [x.strip() for x in t.split("\n")]) for d, t in rows]
    seen, gone = {}, {}
    for n, (_, lines) in enumerate(own):
        for a in range(len(lines)):
            words = 0
            for z in range(a, len(lines)):
                words += len(lines[z].split())
                if words >= least:
                    run = tuple(lines[a:z + 1])
                    if seen.setdefault(run, (n, a)) < (n, a):
                        gone.setdefault(n, set()).update(range(a, z + 1))
    return {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(n, ())) for n, (d, t) in enumerate(rows)}


def made(seed, n=40):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.choice([0, 1, 3, 6, 12, 30]))) for _ in range(25)]
    runs = [rng.choices(pool, k=rng.randrange(2, 7)) for _ in range(6)]
    rows = []
    for d in range(n):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            lines += rng.choice(runs) if rng.random() < .5 else [" ".join(rng.choices("abcdefghijkl", k=rng.randrange(9))) + " "]
        rows.append((d, "\n".join(lines)))
    return rows


def test_same_as_all_runs(spark):
    for seed, least, gram in ((1, 12, 5), (2, 8, 8), (3, 20, 3), (4, 50, 20)):
        rows = made(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert {r.doc_id: r.text for r in ld.dedup(df, least, gram).collect()} == plain(rows, least)


def test_passages_in_documents(spark, docs):
    rng = random.Random(8)
    passage = "\n".join(" ".join(rng.choices("lorem ipsum dolor sit amet elit".split(), k=9)) for _ in range(6))
    rows = [(10_000 + i, f"own words {i}\n{passage}\nmore own words {i}", None, None, 0) for i in range(300)]
    df = docs.union(spark.createDataFrame(rows, docs.schema))
    left = {r.doc_id: r for r in ld.dedup(df).where("doc_id >= 10000").collect()}
    assert left[10_000].text == rows[0][1]
    assert all(left[d].text == f"own words {d - 10_000}\nmore own words {d - 10_000}" and left[d].n_chars == len(left[d].text)
               for d in range(10_001, 10_300))


def test_short_repeats_stay(spark):
    rows = [(i, f"A licence line that stands everywhere.\nown text number {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ld.dedup(df).collect())) == rows


def test_awkward_documents(spark):
    df = awkward(spark)
    got = ld.dedup(df)
    assert got.columns == df.columns and got.count() == df.count()
    assert sorted((repr(r.doc_id), repr(r.text)) for r in got.collect()) == sorted((repr(r.doc_id), repr(r.text)) for r in df.collect())
    same = spark.createDataFrame([(1, "w " * 60)] * 2 + [(None, "v " * 60), (2, "v " * 60), (3, ("u " * 60 + "\n") * 3)], "doc_id long, text string")
    texts = sorted((repr(r.doc_id), len(r.text.split())) for r in ld.dedup(same).collect())
    assert texts == [("1", 60), ("1", 60), ("2", 0), ("3", 60), ("None", 60)]
    assert ld.dedup(empty(spark)).collect() == [] and ld.report(empty(spark)).collect() == []


def test_report(spark, docs):
    got = {r.doc_id: r for r in ld.report(docs).collect()}
    assert all(got[r.doc_id].n_lines == r.n and got[r.doc_id].n_deleted <= r.n
               for r in docs.select("doc_id", F.size(F.split("text", "\n")).alias("n")).collect())
