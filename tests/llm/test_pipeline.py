import random

import public_tokenizers
import sentencepiece

import corpus_pipeline as cp
from brinelog.llm import line_dedup, queries, simhash_dedup
from tests.llm.cases import awkward, empty
from tests.llm.test_decontamination import plain as plain_windows
from tests.llm.test_line_dedup import plain as plain_lines


def test_stages_in_order(spark, sf_dir, tmp_path):
    """Each stage on what the one before it kept; the decisions of the exact stages are checked against plain versions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns = docs.columns
    kept = []
    for name, stage in cp.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != cp.STAGES[-1][0]:
            assert after.columns == columns
        before_rows = {r.doc_id: r.text for r in docs.collect()}
        if name == "language_id":
            assert {r.doc_id for r in after.collect()} == {d for d, t in before_rows.items() if any(c.isalpha() for c in t or "")}
        elif name == "line_dedup":
            assert {r.doc_id: r.text for r in after.collect()} == plain_lines(sorted(before_rows.items()), 50)
        elif name == "decontamination":
            clean = {d for d, *_, bad in plain_windows(list(before_rows.items()), items) if not bad}
            assert {repr(r.doc_id) for r in after.collect()} == clean
        elif name == "sentencepiece":
            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert {r.doc_id: r.n_tokens for r in after.collect()} == {d: len(library.encode(t)) for d, t in before_rows.items()}
        kept.append(after.count())
        docs = after
    assert kept == sorted(kept, reverse=True) and kept[2] < kept[0] and kept[-1] > 0.5 * kept[0]


def test_run_and_awkward_documents(spark, sf_dir):
    assert cp.run(spark, sf_dir).count() > 0
    for docs in (awkward(spark), empty(spark)):
        for _, stage in cp.STAGES:
            stage(spark, docs, sf_dir).collect()


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert line_dedup.report


def test_near_duplicates_are_linked_by_fingerprints(spark):
    """Texts of which the fingerprints differ by 4 bits or fewer are one group, also where few of their five-word shingles are shared."""
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(3000)]
    base = [rng.choice(words) for _ in range(300)]
    given = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(1000, 1020)]
    for i in range(400):
        copy = list(base)
        for at in rng.sample(range(300), 8):
            copy[at] = rng.choice(words)
        given.append((i, " ".join(copy)))
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    lowest = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(docs).collect()}
    left = {r.doc_id for r in cp.near_duplicates(spark, docs, "").collect()}
    by_shingles = {r.doc_id for r in simhash_dedup.drop_near_duplicates(docs).collect()}
    assert left <= set(lowest.values()) and left <= by_shingles and set(range(1000, 1020)) <= left
    assert not by_shingles <= set(lowest.values())
