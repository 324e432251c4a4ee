import hashlib
import random
import re

import duckdb
import pyarrow as pa
import pytest

from brinelog.llm import decontamination as dc
from brinelog.llm.common import table
from brinelog.llm.queries import ORACLES
from tests.llm.cases import awkward, empty

RULE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return RULE.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items):
    out = []
    for d, text in docs:
        ws, hit, found = words(text), set(), set()
        for i, it in items:
            iw = words(it)
            n = min(10, len(iw))
            runs = {tuple(iw[k:k + n]) for k in range(len(iw) - n + 1)} if iw else set()
            for k in range(len(ws) - n + 1):
                if iw and tuple(ws[k:k + n]) in runs:
                    hit.update(range(k, k + n))
                    found.add(str(i))
        out.append((repr(d), len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def rows(df):
    return sorted((repr(r[0]), *r[1:]) for r in df.collect())


def made(spark):
    rng = random.Random(9)
    vocabulary = ["la", "de", "un", "ÉT", "x1", "Foo", "bär", "q"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 10, 13, 30])))) for i in range(1, 9)]
    items += [(9, None), (10, "..."), (100, "rare-word"), (20, items[0][1]), (None, "la")]
    docs = []
    for d in range(1000, 1060):
        t = rng.choices(vocabulary + ["zz", "-"] * 3, k=rng.randrange(40))
        if rng.random() < .5:
            t[3:3] = (rng.choice(items)[1] or "").split()
        docs.append((d, rng.choice([" ", "\n", ", "]).join(t), "en"))
    return awkward(spark, docs), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 60])
def test_same_as_plain(spark, block):
    docs, items = made(spark)
    got = rows(dc.report(dc.scan(docs, items, block_bytes=block)))
    held = [(r.item_id, r.text) for r in items.collect() if r.item_id is not None]
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], held)


def test_removal(spark, sf_dir):
    docs, items = made(spark)
    clean = {d for d, *_, bad in rows(dc.report(dc.scan(docs, items))) if not bad}
    left = dc.decontaminate(docs, items)
    assert left.columns == docs.columns and {repr(r.doc_id) for r in left.collect()} == clean
    cut = dc.decontaminate(docs, items, remove="spans")
    assert cut.columns == docs.columns and cut.count() == docs.count()
    before = {repr(r.doc_id): r.text for r in docs.where("doc_id <> 9 AND doc_id <> 10").collect()}
    reported = {r[0]: r for r in rows(dc.report(dc.scan(docs, items)))}
    for r in cut.collect():
        if repr(r.doc_id) in before and r.text is not None:
            assert len(words(r.text)) == reported[repr(r.doc_id)][1] - reported[repr(r.doc_id)][2]
    with pytest.raises(ValueError):
        dc.decontaminate(docs, items, remove="?")


def test_empty_tables(spark, sf_dir):
    docs, items = made(spark)
    assert dc.report(dc.scan(empty(spark), items)).collect() == []
    assert not any(r.contaminated for r in dc.report(dc.scan(docs, items.where("false"))).collect())
    assert dc.decontaminate(docs, items.where("false")).count() == docs.count()
    assert table(spark, sf_dir, "benchmark").count() > 0


@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 60])
def test_items_without_an_id_hit_as_in_sql(spark, block):
    docs, items = made(spark)
    docs = docs.where("doc_id > 100").dropDuplicates(["doc_id"])
    items = items.union(spark.createDataFrame([(None, "zz zz", 2), (None, None, 3)], items.schema))
    got = sorted(map(tuple, dc.report(dc.scan(docs, items, block_bytes=block, nameless=True)).collect()))
    held = duckdb.connect()
    held.register("documents", docs.select("doc_id", "text").toPandas())
    held.register("benchmark", pa.table({"item_id": pa.array([r.item_id for r in items.collect()], pa.int64()),
                                         "text": pa.array([r.text for r in items.collect()])}))
    assert got == sorted(held.execute(ORACLES["op8_decontamination"]).fetchall())
    without = sorted(map(tuple, dc.report(dc.scan(docs, items, block_bytes=block)).collect()))
    assert sum(r[2] for r in got) > sum(r[2] for r in without)
    left = {r.doc_id for r in dc.decontaminate(docs, items, nameless=True).collect()}
    assert left == {r[0] for r in got if not r[5]}
    cut = dc.decontaminate(docs, items, remove="spans", nameless=True).collect()
    assert sum(len(words(r.text)) for r in cut) == sum(r[1] - r[2] for r in got)
