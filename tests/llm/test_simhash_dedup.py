import random
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brinelog.llm import simhash_dedup as sd
from tests.llm.cases import awkward, empty, texts_of


def plain_print(text, words):
    parts = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()]
    runs = [parts[i:i + words] for i in range(len(parts) - words + 1)] if len(parts) >= words else [parts] * bool(parts)
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    """Smallest id by repeated minimum over all pairs."""
    prints = [(d, p) for d, p in prints]
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted((repr(d), f"{p:016x}", repr(low.get(find(i)))) for i, (d, p) in enumerate(prints))


def rows(df):
    return sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in df.collect())


def test_same_as_all_pairs(spark, docs):
    assert rows(sd.near_duplicates(docs)) == plain_components([(d, plain_print(t, 4)) for d, t in texts_of(docs)], 4)


def test_awkward_documents(spark):
    df = awkward(spark)
    assert rows(sd.near_duplicates(df)) == plain_components([(d, plain_print(t, 4)) for d, t in texts_of(df)], 4)
    assert sd.near_duplicates(empty(spark)).collect() == []


def test_spark_hashes_alike(spark):
    text = "ünï code four words"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] == sd.signed(xxhash.xxh64_intdigest(text.encode(), 42))


@pytest.mark.parametrize("radius, blocks", [(4, 8), (3, 7), (1, 2)])
def test_chains_and_dense_groups(spark, radius, blocks):
    rng = random.Random(radius)
    prints = []
    for _ in range(25):
        p = rng.getrandbits(64)
        for _ in range(12):
            prints.append(p)
            for b in rng.sample(range(64), rng.randrange(radius + 3)):
                p ^= 1 << b
    seed = rng.getrandbits(64)
    prints += [seed ^ 1 << i ^ 1 << j for i in range(12) for j in range(i)]
    given = list(enumerate(prints))
    df = spark.createDataFrame([(d, sd.signed(p)) for d, p in given], "doc_id long, fp long").repartition(5)
    got = sd.group(df, radius, blocks).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    assert rows(got) == plain_components(given, radius)


def test_no_pair_misses_every_cell():
    rng = random.Random(1)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        names, n = sd.cells(np.array([a, b], np.uint64), 4, 8)
        assert n == 70 and (names[:, 0] == names[:, 1]).any()


def test_one_document_of_each_group_stays(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(3000)]
    bases = [[rng.choice(words) for _ in range(300)] for _ in range(12)]
    given = [(100 + i, " ".join(b)) for i, b in enumerate(bases)]
    for i, base in enumerate(bases[:8]):
        for k in range(4):
            copy = list(base)
            for at in rng.sample(range(300), k):  # none: an exact copy
                copy[at] = rng.choice(words)
            given.append((1000 + 10 * i + k, " ".join(copy)))
    given += [(5000, " ".join(bases[0]).upper()), (5001, None), (5002, ""), (5003, "  "), (100, given[0][1]), (None, "alone and without id")]
    df = spark.createDataFrame([(d, t, "x", 7) for d, t in given], "doc_id long, text string, node string, root long").repartition(3)
    left = sd.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [*range(100, 112), 5001]
    assert left.where("doc_id IS NULL").count() == 1 and left.where("doc_id = 100").count() == 1
    assert sd.drop_near_duplicates(empty(spark)).collect() == []


def test_copies_with_one_long_edit_go(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(3000)]
    given, linked = [], 0
    for i in range(60):
        base = [rng.choice(words) for _ in range(240)]
        at = rng.randrange(200)
        copy = base[:200 + i % 40] if i % 2 else base[:at] + [rng.choice(words) for _ in range(18)] + base[at + 18:]
        given += [(i, " ".join(base)), (1000 + i, " ".join(copy))]
        linked += sd.jaccard(given[-2][1], given[-1][1], 5) >= 0.8
    left = [r.doc_id for r in sd.drop_near_duplicates(spark.createDataFrame(given, "doc_id long, text string").repartition(3)).collect()]
    assert linked == 60 and set(range(60)) <= set(left)
    assert len(left) <= 60 + 3


def test_steps_leave_no_shuffle_files(spark):
    """The shuffles of a step go when it has been written; until then all rounds of a run lay on disk together."""
    def files():
        held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (held.apply(i).getName() for i in range(held.size())) if n.startswith("shuffle_")}

    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(3000)]
    bases = [[rng.choice(words) for _ in range(200)] for _ in range(20)]
    given = [(10 * i + k, " ".join(base[:200 - 5 * k])) for i, base in enumerate(bases) for k in range(4)]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    before = files()
    left = sd.drop_near_duplicates(docs, radius=4)
    for _ in range(40):  # files go in the background
        if not (after := files() - before):
            break
        time.sleep(0.25)
    assert not after
    assert sorted(r.doc_id for r in left.collect()) == list(range(0, 200, 10))


def test_parts_that_are_equal_link_nothing_unlike(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(3000)]
    shared = [rng.choice(words) for _ in range(100)]
    given = [(i, " ".join(shared + [rng.choice(words) for _ in range(100)])) for i in range(40)]
    assert sd.drop_near_duplicates(spark.createDataFrame(given, "doc_id long, text string")).count() == 40


def test_awkward_documents_stay_whole(spark):
    df = awkward(spark)
    left = [r.doc_id for r in sd.drop_near_duplicates(df).collect()]
    assert sorted(map(repr, left)) == sorted(map(repr, [1, None, None, 6, 7, 9, 9, 10, 11, 12, 13, 14]))


def test_links_do_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(12)
    prints = []
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(8):
            prints.append(p)
            for b in rng.sample(range(64), 5):
                p ^= 1 << b
    given = [(sd.signed(p), i) for i, p in enumerate(prints)]
    found = []
    for parts in (1, 3, 7):
        rng.shuffle(given)
        df = spark.createDataFrame(given, "fp long, node long").repartition(parts)
        found.append({tuple(r) for r in sd.links(df, 12, blocks=7, differing=4).collect()})
    assert found[0] and found[0] == found[1] == found[2]


def left_by_all_pairs(given):
    """Smallest id of each component of all pairs of similar texts."""
    sets = [set(sd.shingles(t, 5)) for _, t in given]
    root = list(range(len(given)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(given)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and shared / (len(sets[i]) + len(sets[j]) - shared) >= 0.8:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(given):
        low[find(i)] = min(d, low.get(find(i), d))
    return sorted(low.values())


@pytest.mark.parametrize("copies", [50, 300, 1000])
def test_copies_that_are_near_the_original_only(spark, copies):
    rng = random.Random(copies)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(3000)]
    base = [rng.choice(words) for _ in range(300)]
    given = [(0, " ".join(base))]
    for i in range(1, copies + 1):
        copy = list(base)
        for at in rng.sample(range(300), 6 + i % 2):
            copy[at] = rng.choice(words)
        given.append((i, " ".join(copy)))
    want = left_by_all_pairs(given)
    left = sd.drop_near_duplicates(spark.createDataFrame(given, "doc_id long, text string").repartition(4)).collect()
    assert sorted(r.doc_id for r in left) == want


@pytest.mark.parametrize("share", [100, 200])
def test_true_pairs_among_many_that_share_a_passage(spark, share):
    rng = random.Random(share)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(3000)]
    shared = [rng.choice(words) for _ in range(share)]
    given = []
    for i in range(150):
        own = shared + [rng.choice(words) for _ in range(300 - share)]
        at = rng.randrange(share, 280)
        given += [(i, " ".join(own)), (1000 + i, " ".join(own[:at] + [rng.choice(words) for _ in range(20)] + own[at + 20:]))]
    want = left_by_all_pairs(given)
    left = sd.drop_near_duplicates(spark.createDataFrame(given, "doc_id long, text string").repartition(4)).collect()
    assert sorted(r.doc_id for r in left) == want == list(range(150))


def test_manhattan_distance_of_counts_is_a_lower_bound():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 300, dtype=np.uint64)
    fps = np.concatenate([fps, fps ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)), np.zeros(1, np.uint64), ~np.zeros(1, np.uint64)])
    counts = np.stack([np.bitwise_count((fps >> np.uint64(i)) & np.uint64(3)) for i in range(0, 64, 2)], 1).astype(int)
    for i in range(0, len(fps), 7):
        manhattan = np.abs(counts - counts[i]).sum(1)
        assert (np.bitwise_count(sd.unary(fps) ^ sd.unary(fps)[i]) == manhattan).all()
        assert (manhattan <= np.bitwise_count(fps ^ fps[i])).all()


def test_forest_connects_as_all_pairs_do():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 62, 40, dtype=np.uint64)) for _ in range(12)] + [base]))
    links = sd.forest(fps, 3)
    assert len(links) < len(fps) and all((int(fps[a]) ^ int(fps[b])).bit_count() <= 3 for a, b in links)

    def groups(pairs):
        root = list(range(len(fps)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(len(fps))]

    every = [(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3]
    assert groups(links) == groups(every)
    assert sd.forest(fps[:1], 3) == [] and sd.forest(fps[:0], 3) == []
