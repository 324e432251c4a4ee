import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brinelog.llm import packing as pk
from tests.llm.cases import awkward, empty, texts_of

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "A", " a ", "a  b", "it's we'll I'm 'S o'clock 'tis", "foo,bar. (baz)! ...", "a\x1cb c\x1fd", "a\x85b\xa0c d　e",
       "é É ́x x ́", "ÀÉß×÷ÿ Àé, ẞ", "你好 世界 123 4.5 १२", "<|endoftext|> b<|startoftext|>c", "\0 a\0b", "ΟΔΟΣ Σ", "a'", "x' s", "İstanbul ǅ",
       "word" * 3000, "don't,", "<|ENDOFTEXT|> <|EndOfText|>x", "ÀB, ß. ÷x ×y", "naïve café!?", "a_b-c", "\U0001F600 ok\U0001F600"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def check(df, plain, length=2048, **more):
    out = pk.pack(df, PATH, length=length, **more)
    got = out.collect()
    digests = sorted(tuple(r) for r in pk.report(out).select("doc_id", "start", "ids_crc32").collect()) if not df.where("doc_id IS NULL").count() else None
    if digests is not None:
        assert digests == sorted((r.doc_id, r.start, zlib.crc32(r.ids)) for r in got)
    # sequences: gapless, full or a power of two
    rows = {}
    for r in got:
        assert r.length > 0 and len(r.ids) == 4 * r.length
        rows.setdefault(r.sequence_id, []).append(r)
    assert sorted(rows) == list(range(len(rows)))
    padding = 0
    for k in rows.values():
        k.sort(key=lambda r: r.offset)
        size = sum(r.length for r in k)
        assert [r.offset for r in k] == np.cumsum([0, *(r.length for r in k)])[:-1].tolist()
        assert size <= length and (size == length or size & (size - 1) == 0)
        padding += 0 if size & (size - 1) == 0 else length - size
    assert padding == 0
    # documents: read back along the sequences
    stream = [r for k in sorted(rows) for r in rows[k]]
    read, open_ = [], {}
    for r in stream:
        held = open_.setdefault(r.doc_id, [])
        assert r.start == sum(len(x) // 4 for x in held)
        held.append(r.ids)
        if r.start + r.length == r.doc_tokens:
            read.append((repr(r.doc_id), np.frombuffer(b"".join(open_.pop(r.doc_id)), "<u4").tolist()))
    assert not open_
    assert sorted(read) == sorted((repr(d), [*plain(t), 1]) for d, t in texts_of(df))
    return stream


def test_same_as_the_library(plain):
    encoder = pk.WordEncoder(PATH, cached=5)
    for texts in ([x] for x in [*ODD, " ".join(ODD), *ODD]), [ODD, ODD * 2]:
        for own in texts:
            for text, ids in zip(own, encoder.encode(own), strict=True):
                assert np.frombuffer(ids, encoder.dtype).tolist() == plain(text), repr(text)
    ordinary = pk.WordEncoder(PATH, special=False)
    assert 49407 not in np.frombuffer(ordinary.encode(["a <|endoftext|>"])[0], ordinary.dtype)
    assert [(s.start, s.stop) for s in pk.in_groups(["a" * 5, "b", "", "c" * 9, ""], 6)] == [(0, 2), (2, 4), (4, 5)]


def test_documents(spark, docs, plain):
    first = check(docs, plain)
    again = pk.pack(docs.repartition(5), PATH, ranges=3)
    assert again.agg(F.sum("length")).first()[0] == sum(r.length for r in first)
    check(docs, plain, length=100, ranges=5)


def test_awkward(spark, plain):
    check(awkward(spark, [(100 + i, t, "en") for i, t in enumerate(ODD)]), plain, length=64)
    check(awkward(spark).limit(1), plain)
    assert pk.pack(empty(spark), PATH).collect() == []


def test_neighbours_along_the_curve_are_alike(spark, docs, plain):
    """Documents that share a sequence are of one language far more often than by chance."""
    stream = check(docs, plain, length=512)
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    pairs = [(lang[a.doc_id], lang[b.doc_id]) for a, b in zip(stream, stream[1:]) if a.doc_id != b.doc_id and lang[a.doc_id] and lang[b.doc_id]]
    shares = np.unique([a for a, _ in pairs], return_counts=True)[1] / len(pairs)
    assert np.mean([a == b for a, b in pairs]) > float(shares @ shares) + 0.25


def test_a_group_of_copies_fills_several_ranges(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("one and the same text " * 20))
                                  .otherwise(F.concat(F.lit("word number "), F.col("id"))).alias("text"))
    rows = pk.along_curve(pk.encode(df, PATH, 1))
    total = rows.agg(F.sum("n")).first()[0]
    placed = rows.withColumn("range", pk.range_number(pk.splitters(rows, total, 16))("key", "tie"))
    sizes = [r.n for r in placed.groupBy("range").agg(F.sum("n").alias("n")).collect()]
    assert placed.where("doc_id % 3 = 0").select("range").distinct().count() > 8
    assert max(sizes) < 0.2 * total


@pytest.mark.parametrize("dimensions,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve(dimensions, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions), -1).reshape(-1, dimensions)
    key = pk.hilbert_key(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_layout():
    for total in (0, 1, 2047, 2048, 2049, 5000, 6143):
        layout, at, seen = pk.Layout(total, 2048), 0, []
        while at < total:
            sequence, offset, room = layout.place(at)
            assert offset == 0
            seen.append((sequence, room))
            at += room
        assert [s for s, _ in seen] == list(range(len(seen))) and at == total
        assert all(n == 2048 or n & (n - 1) == 0 for _, n in seen)


def test_learning_does_not_walk_over_known_words(plain):
    class Known(dict):
        def __iter__(self):
            raise AssertionError("all known words were read")

    encoder = pk.WordEncoder(PATH)
    encoder.new = Known()
    for text in ("abc def, né x9 né!", "abc, def né?! (x) neu ß...", "neu, ß abc"):
        assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == plain(text)
