import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinelog.llm import lexical_search as ls
from brinelog.llm.common import table
from tests.llm.cases import awkward, empty

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, score double"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """Every document scored for every item."""
    held = [(d, Counter(t)) for d, t in ((d, terms(t)) for d, t in docs) if t]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in {(i, t or "") for i, t in items}:
        found = []
        for doc, own in held:
            m = 100 - 25 + (25 * sum(own.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * own[t]) // (1000 * own[t] + 12 * m))
                    for t in terms(text) if t in own)
            if s > 0:
                found.append((-s, doc is None, doc or 0, doc))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(found, key=lambda r: r[:3])[:k], 1)]
    return sorted(out, key=repr)


def check(docs, items, k=20, **more):
    got = sorted(map(tuple, ls.search(docs, items, k, **more).collect()), key=repr)
    assert got == plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()],
                        [(r.item_id, r.text) for r in items.select("item_id", "text").collect()], k)
    return got


def test_documents(spark, docs, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    first = check(docs, items)
    assert len(first) > 400
    assert first == sorted(map(tuple, ls.search(docs.repartition(5), items).collect()), key=repr)
    check(docs, items, k=3, block_bytes=2000)


def test_awkward(spark):
    items = spark.createDataFrame([
        (1, "the quick BROWN fox the", 1.0), (1, "the quick BROWN fox the", 2.0), (1, "same row", 0.0), (2, None, 0.0), (3, "", 0.0), (4, "nowhere found", 0.0),
        (None, "alpha no id", 0.0), (5, "é" * 500 + " 12345 a b c", 0.0), (6, "the " * 5000, 0.0), (7, "¿qué? Àé ÀÉ", 0.0)], ITEMS)
    df = awkward(spark, [(200 + i, "the same fox", "en") for i in range(40)])
    check(df, items)
    check(df, items, k=1)
    assert ls.search(empty(spark), items).collect() == []
    assert ls.search(df, items.limit(0)).collect() == []
    assert ls.search(df, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_ties_take_the_smallest_ids(spark):
    df = spark.range(3000).select((F.lit(5000) - F.col("id")).alias("doc_id"),
                                  F.when(F.col("id") % 3 == 0, F.lit("one copy of this text")).otherwise(F.concat(F.lit("word"), F.col("id") % 700)).alias("text"))
    items = spark.createDataFrame([(1, "copy of", 0.0), (2, "word5 text", 0.0)], ITEMS)
    got = check(df.repartition(9), items)
    assert [r[2] for r in sorted(got) if r[0] == 1] == list(range(2003, 2063, 3))


def test_scores_beyond_the_range_of_doubles(spark):
    block = ls.Items([(1, "word " * 1000)])
    block.repeats[0][:] = 10**9

    class Fixed:
        weight, df = np.array([9000]), np.array([1])

    tree = ls.ItemTree(block, [0], Fixed)
    assert tree.dtype is np.int64 and tree.items[0, 0] == 9000 * 10**9


@pytest.mark.parametrize("seed", [1, 2])
def test_pruned_search_is_exact(seed):
    """One chunk, many items: same best as all scores, with fewer leaf pairs than there are."""
    rng = np.random.default_rng(seed)
    vocabulary, n_docs, n_items = 400, 3000, 120

    class Fixed:
        weight, df = np.floor(9000 * rng.random(vocabulary)).astype(np.int64) + 1, np.arange(vocabulary)

    block = ls.Items([])
    block.ids = list(range(n_items))
    topics = rng.integers(0, 20, n_docs)
    topics.sort()
    block.terms = [np.unique(rng.integers(0, 20) * 20 + rng.integers(0, 20, 8)) for _ in range(n_items)]
    block.repeats = [rng.integers(1, 3, len(t)) for t in block.terms]
    dense = np.zeros((n_docs, vocabulary), np.int64)
    for d in range(n_docs):
        dense[d, topics[d] * 20 + rng.integers(0, 20, 10)] = rng.integers(1, 900_000, 10)
    row, term = np.nonzero(dense)
    chunk = ls.Chunk(np.arange(n_docs), np.zeros(n_docs, bool), np.bincount(row, minlength=n_docs), term, dense[row, term])
    best, leaf_pairs = ls.Best(n_items, 20), 0
    trees = ls.item_trees(block, Fixed)
    for tree in trees:
        leaf_pairs += ls.search_chunk(chunk, tree, best)
    for i in range(n_items):
        scores = dense[:, block.terms[i]] @ (block.repeats[i] * Fixed.weight[block.terms[i]])
        want = np.lexsort((np.arange(n_docs), -scores))[:20]
        assert best.score[i].tolist() == scores[want].tolist()
        assert best.doc[i][scores[want] > 0].tolist() == want[scores[want] > 0].tolist()
    assert leaf_pairs < 0.5 * -(-n_docs // ls.LEAF) * -(-n_items // ls.GROUP)
