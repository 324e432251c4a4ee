import zlib

from brinelog.llm import language
from tests.llm.cases import awkward, empty, texts_of


def test_held_out_accuracy(spark, docs):
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    asked = [d for d, r in got.items() if r.held_out and truth[d]]
    assert sum(got[d].lang_pred == truth[d] for d in asked) >= 0.93 * len(asked)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_are_not_used(spark, docs):
    from pyspark.sql import functions as F
    spoilt = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    a, b = language.fit(docs), language.fit(spoilt)
    assert a.labels == b.labels and (a.weights == b.weights).all()


def test_kernel_form(docs):
    """The folded matrix gives what landmark kernels and regressions give one after the other."""
    texts = [t for _, t in texts_of(docs)[:40] if t]
    grams = lambda t: {g for n in language.ORDERS for i in range(len(t) - n + 1) for g in [t[i:i + n]]}
    for t in texts[:10]:
        raw = t.lower().encode()
        assert 0.97 * len(grams(raw)) <= language.slots(t).sum() <= len(grams(raw))


def test_awkward_documents(spark, docs):
    model = language.fit(docs)
    df = awkward(spark)
    got = language.identify(df, model).collect()
    assert len(got) == df.count()
    want = {d: not any(c.isalpha() for c in t) for d, t in texts_of(df)}
    assert all((r.lang_pred == "und") == want[r.doc_id] for r in got if r.doc_id is not None)
    assert all(r.score == 0 and not r.held_out for r in got if r.doc_id is None and r.lang_pred == "und")
    kept = language.keep_identified(df, model)
    assert kept.columns == df.columns
    assert kept.count() == sum(r.lang_pred != "und" for r in got)
    none = language.fit(empty(spark))
    assert none.labels == [] and {r.lang_pred for r in language.identify(df, none).collect()} == {"und"}
    assert language.identify(empty(spark), model).collect() == []


def test_one_label(spark):
    from pyspark.sql import functions as F
    df = awkward(spark).withColumn("lang", F.lit("en"))
    assert {r.lang_pred for r in language.identify(df, language.fit(df)).collect()} == {"en", "und"}


def test_letters_decide_when_nothing_was_learned(spark):
    df = awkward(spark)
    kept = language.keep_identified(df, language.fit(empty(spark)))
    assert kept.count() == sum(any(c.isalpha() for c in t) for _, t in texts_of(df)) > 0
