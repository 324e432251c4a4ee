import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from brinelog.llm import spelling as sp
from tests.llm.cases import awkward, empty


def words_of(rows):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return out


def plain(counts, least_length=5, least_count=3):
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    letters = sorted({c for w in words for c in w})
    near = defaultdict(set)
    for w in words:
        around = {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        around |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
        near[w] = {x for x in around if x in words and x != w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]]))
    return sorted(out)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def check(df, **more):
    got = sp.variants(df, **more)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted(map(tuple, got.collect()))
    assert got == plain(words_of(rows_of(df)))
    return got


def test_documents(spark, docs):
    got = check(docs)
    assert sum(r[4] > 0 for r in got) > 1000
    assert check(docs, hot=20) == got  # blocks are split down to regions of one letter


def test_awkward(spark):
    check(awkward(spark))
    assert sp.variants(empty(spark)).collect() == []
    letters = "a" * 3000
    df = awkward(spark, [(300 + i, t, "en") for i, t in enumerate(
        [letters + " " + letters + "a ", letters + " b" + letters + " "] * 3 + ["straße STRASSE straßen ÀÉÎÕÜ àéîõü"] * 4)])
    got = check(df)
    assert sum(r[4] for r in got if len(r[0]) >= 3000) >= 2


def test_chains_of_forms(spark):
    counts = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "bbbbbb": 95, "zzzzz": 5}
    df = spark.createDataFrame([(1, " ".join(w for w, n in counts.items() for _ in range(n)))], "doc_id long, text string")
    got = {r.word: r for r in sp.variants(df, every=10**9 + 7).collect()}
    assert got["aaaaa"].root == "bbbbb" and got["aaaaa"].form == "aaaab" and got["aaaaa"].form_n == 6
    assert got["bbbbbb"].form is None and got["bbbbbb"].root == "bbbbbb" and got["bbbbbb"].n_near == 1
    assert (got["zzzzz"].n_near, got["zzzzz"].form, got["zzzzz"].form_n) == (0, None, None)


@pytest.mark.parametrize("seed,hot", [(1, 16_384), (2, 10), (3, 2)])
def test_dense_vocabulary(spark, seed, hot):
    """Words over three letters, so that nearly every word has near words of each kind, insertions beside equal letters included."""
    rng = np.random.default_rng(seed)
    words = {"".join(rng.choice(list("abé"), rng.integers(5, 9))) for _ in range(1500)}
    counts = {w: int(rng.integers(3, 40)) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n_near, r.form, r.form_n) for r in sp.near_words(sp.blocks(df, hot=hot)).collect()}
    want = {r[0]: r[4] for r in plain(counts)}
    assert {w: n for w, n in want.items() if n} == {w: r[0] for w, r in got.items()}
    for w, (_, form, form_n) in got.items():
        assert counts[form] == form_n
