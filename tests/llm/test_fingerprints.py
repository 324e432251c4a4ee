import hashlib
import random

import pytest

from brinelog.llm import fingerprints as fp
from brinelog.llm.common import materialize
from tests.llm.cases import awkward, empty, texts_of


def plain(rows):
    """Edited texts in descending order of the id, ties and nulls as documented."""
    out = []
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[:len(t) - half] + following[:half]
        p, q, n = (fp.fingerprint(x) for x in (t, e, following))
        out.append((repr(d), len(t), hashlib.sha256(e.encode()).hexdigest(), p.hex(), q.hex(), round(fp.likeness(p, q), 9), round(fp.likeness(p, n), 9)))
    return sorted(out)


def rows(df):
    return sorted((repr(r.doc_id), *r[1:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect())


@pytest.mark.parametrize("parts", [None, 1, 3, 50])
def test_documents(spark, docs, parts):
    got = rows(fp.compare_with_edits(docs, parts=parts))
    assert got == plain(sorted(texts_of(docs), key=lambda r: -r[0]))


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_awkward_documents(spark, parts):
    df = awkward(spark)
    got = rows(fp.compare_with_edits(df, parts=parts))
    assert [g[:2] for g in got] == sorted((repr(d), len(t)) for d, t in texts_of(df))
    whole = df.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).repartition(3)
    assert rows(fp.compare_with_edits(whole, parts=parts)) == plain(sorted(texts_of(whole), key=lambda r: -r[0]))
    assert fp.compare_with_edits(empty(spark)).collect() == []
    one = df.where("doc_id = 1")
    assert rows(fp.compare_with_edits(one, parts=parts)) == plain(texts_of(one))
    only_null = df.where("doc_id IS NULL AND text IS NULL")
    assert rows(fp.compare_with_edits(only_null, parts=parts)) == plain(texts_of(only_null))


def test_likeness_tells_edits_from_strangers(docs):
    got = fp.compare_with_edits(docs.where("length(text) > 400")).collect()
    edited = sorted(r.near_edited for r in got)
    following = sorted(r.near_next for r in got)
    assert edited[len(got) // 10] > 0.2 > following[len(got) // 2]


def test_search_is_exact(spark):
    rng = random.Random(2)
    values = set()
    for _ in range(20):
        v = rng.getrandbits(128)
        for _ in range(10):
            values.add(v)
            for b in rng.sample(range(128), rng.randrange(8)):
                v ^= 1 << b
    values = sorted(values)
    asked = values[::7]
    frame = lambda vs: spark.createDataFrame([(f"{v:032x}", 3) for v in vs], "fingerprint string, copies long").repartition(4)
    want = sorted((f"{q:032x}", f"{v:032x}", (q ^ v).bit_count()) for q in asked for v in values if (q ^ v).bit_count() <= 6)
    assert sorted(map(tuple, fp.search(frame(values), frame(asked), 6).collect())) == want
    counts = {}
    for r in fp.search(frame(values), frame(asked), 6, count=True).collect():
        counts[r[0]] = counts.get(r[0], 0) + r.n
    assert counts == {q: 3 * sum(w[0] == q for w in want) for q in {w[0] for w in want}}


def test_search_of_a_prefix_over_many_batches(spark, monkeypatch):
    rng = random.Random(5)
    values = sorted({rng.getrandbits(20) for _ in range(700)})  # all share most blocks
    asked = values[::3]
    frame = lambda vs: spark.createDataFrame([(f"{v:032x}", v % 3 + 1) for v in vs], "fingerprint string, copies long")
    want = sorted((f"{q:032x}", f"{v:032x}", (q ^ v).bit_count()) for q in asked for v in values if (q ^ v).bit_count() <= 6)
    monkeypatch.setattr(fp, "PAIRS", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = sorted(map(tuple, fp.search(frame(values), frame(asked), 6).collect()))
        counts = fp.search(frame(values), frame(asked), 6, count=True).groupBy("query").sum("n").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    copies = {f"{v:032x}": v % 3 + 1 for v in values}
    assert {q: n for q, n in counts} == {f"{q:032x}": sum(copies[v] for a, v, _ in want if a == f"{q:032x}") for q in asked}


def test_report_counts_neighbours(spark, docs):
    got = fp.report(docs, every=10).collect()
    prints = [int(r.fingerprint, 16) for r in got]
    assert all((r.n_near is not None) == (r.doc_id % 10 == 0) for r in got)
    for r in got:
        if r.n_near is not None:
            assert r.n_near == sum((int(r.fingerprint, 16) ^ p).bit_count() <= 6 for p in prints)
    assert len(fp.report(awkward(spark)).collect()) == awkward(spark).count()


def test_shuffle_of_a_written_table_goes(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    rows = spark.range(1000).repartition(4, "id")
    written = materialize(rows, "tidy", drop_shuffles=True)
    assert spark.conf.get(key, None) == before
    assert written.count() == rows.count() == 1000
    assert sorted(r.id for r in materialize(rows, "tidy", drop_shuffles=True).collect()) == list(range(1000))
