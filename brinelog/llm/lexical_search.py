"""Ranked lexical search: the best documents for every item, exactly, by a dual tree.

Terms are ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A score is a scalar product: an item's coordinate for a
term is its weight times its repeats, a document's is its saturated, length-adjusted frequency. Both are integers of 64 bits.

1. Every document is read once; what is kept of it are its length and the frequencies of terms that some item has.
2. Documents are sorted in ranges by their two strongest terms (ties by ``doc_id``, so that a common term is parted among tasks).
3. A task cuts its range into chunks and builds a hierarchy over each: leaves of ``LEAF`` neighbours, ``FAN`` nodes to a parent; a node holds the largest
   coordinate of its documents for every term. Items have such a hierarchy too, over items that share frequent terms.
4. Pairs of nodes are visited from the roots, highest bound first. The bound of a pair is the scalar product of its maxima; a pair goes with all
   it holds if its bound is below the weakest k-th score of the node's items so far. Leaf pairs are scored exactly.
5. The k best of each task are merged by item in two steps.

Items are taken in blocks of about ``BLOCK_BYTES`` of text, measured first; the table of a block is broadcast, and a larger benchmark takes more
scans of the documents. Counts (documents, terms, document frequencies) cover all documents.

Defined results: a null or empty text has no terms; an item without terms, or whose terms no document has, gives no rows; a repeated row of
the benchmark (equal id and text) is one item, other rows with the same id are items of their own; repeated rows of documents count and rank
each; a null ``doc_id`` comes last among equal scores; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinelog.llm.common import arrow_schema, materialize
from brinelog.llm.decontamination import words

BLOCK_BYTES = 1 << 20
LEAF, FAN, GROUP = 32, 8, 8  # documents in a leaf, nodes below a node, items in a lowest node
TREE_ITEMS, CHUNK_DOCS, CHUNK_ENTRIES = 256, 8192, 1 << 20
EXACT = 1 << 53  # integers up to here are exact as doubles

POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"


class Items:
    """A block of items: ids, vocabulary, and (term, repeats) of each item."""

    def __init__(self, rows: list[tuple]):
        self.ids: list = []
        self.vocabulary: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.repeats: list[np.ndarray] = []
        for item, text in rows:
            counted = Counter(words(text))
            if counted:
                self.ids.append(item)
                self.terms.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in counted], np.int64))
                self.repeats.append(np.fromiter(counted.values(), np.int64, len(counted)))


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES):
    """``Items`` of about ``block_bytes`` bytes of text each."""
    rows = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        block = Items(sorted(map(tuple, part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
        if block.ids:
            yield block


def postings(docs: DataFrame, block: Items) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document with a term; ``terms`` are those of the block, in ascending order."""
    known = docs.sparkSession.sparkContext.broadcast(block.vocabulary)
    schema = arrow_schema(POSTINGS)

    def run(batches):
        vocabulary = known.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, sizes, terms, tfs, ends = [], [], [], [], [0]
                for doc, text in zip(*(c.to_pylist() for c in part.columns)):
                    found = words(text) if text else ()
                    if not found:
                        continue
                    place = np.array(list(map(vocabulary.get, found, repeat(-1))), np.int32)
                    own, tf = np.unique(place[place >= 0], return_counts=True)
                    ids.append(doc)
                    sizes.append(len(found))
                    terms.append(own)
                    tfs.append(tf.astype(np.int32))
                    ends.append(ends[-1] + len(own))
                if ids:
                    offsets = pa.array(ends, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                         *(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int32())) for x in (terms, tfs))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, POSTINGS)


class Facts:
    """Counts over all documents, and the weight of every term of a block."""

    def __init__(self, held: DataFrame, terms: int):
        row = held.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        self.docs, self.length = row.docs, row.length
        self.df = np.zeros(terms, np.int64)
        counts = held.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # one row per term of the block
        for r in counts:
            self.df[r.term] = r["count"]
        self.weight = np.array([math.floor(1000 * math.log((2 * self.docs + 2) / (2 * d + 1))) for d in self.df.tolist()], np.int64)

    def impact(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - 25 + (25 * n * self.docs) // self.length
        return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def entries(batch: pa.RecordBatch, facts: Facts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flat postings of a batch: number of entries per row, row, term and impact of each entry."""
    column = batch.column("terms")
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    row = np.repeat(np.arange(batch.num_rows), sizes)
    term = column.flatten().to_numpy().astype(np.int64)
    tf = batch.column("tfs").flatten().to_numpy().astype(np.int64)
    return sizes, row, term, facts.impact(tf, batch.column("n").to_numpy()[row])


def by_strongest_terms(held: DataFrame, facts: Facts) -> DataFrame:
    """Postings in ranges of their two strongest terms, sorted inside a range."""
    ddl = POSTINGS + ", first int, second int"

    def run(batches):
        for batch in batches:
            _, row, term, impact = entries(batch, facts)
            order = np.lexsort((term, -impact * facts.weight[term], row))
            row, term = row[order], term[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            strongest = np.full((2, batch.num_rows), -1, np.int32)
            for k in (0, 1):
                strongest[k, row[nth == k]] = term[nth == k]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(s) for s in strongest)], names=[*batch.schema.names, "first", "second"])

    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = held.where(F.size("terms") > 0).mapInArrow(run, ddl)
    return (keyed.repartitionByRange(parts, "first", "second", "doc_id", "n").sortWithinPartitions("first", "second", "doc_id")
            .drop("first", "second"))


class Best:
    """The k best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = np.zeros((items, k), np.int64)
        self.doc = np.zeros((items, k), np.int64)
        self.null = np.zeros((items, k), bool)
        self.kth = np.ones(items, np.int64)  # a score below this can't enter

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = (np.concatenate((own[item], new)) for own, new in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score))[:self.k]
        self.score[item], self.doc[item], self.null[item] = score[order], doc[order], null[order]
        self.kth[item] = max(1, self.score[item, -1])


def maxima(level: np.ndarray, fan: int) -> np.ndarray:
    """Coordinate maxima of every ``fan`` rows."""
    return np.maximum.reduceat(level, np.arange(0, len(level), fan), axis=0) if len(level) > 1 else level


class ItemTree:
    """Hierarchy over some items of a block. ``levels[0]`` are nodes of ``GROUP`` items."""

    def __init__(self, block: Items, members: list[int], facts: Facts):
        self.members = np.array(members)
        self.terms = np.unique(np.concatenate([block.terms[i] for i in members]))
        longest = max(int(block.repeats[i].sum()) for i in members)
        # products of whole numbers are exact as doubles up to 2^53, beyond it they are taken as integers
        self.dtype = np.float64 if longest * int(facts.weight.max()) * 1_000_000 < EXACT else np.int64
        self.items = np.zeros((len(members), len(self.terms)), self.dtype)
        for row, i in enumerate(members):
            self.items[row, np.searchsorted(self.terms, block.terms[i])] = block.repeats[i] * facts.weight[block.terms[i]]
        self.levels = [maxima(self.items, GROUP)]
        while len(self.levels[-1]) > 1:
            self.levels.append(maxima(self.levels[-1], FAN))

    def span(self, level: int, node: int) -> slice:
        width = GROUP * FAN ** level
        return slice(node * width, min(len(self.members), (node + 1) * width))


class Chunk:
    """Documents in order, as flat postings."""

    def __init__(self, docs, nulls, sizes, terms, impacts):
        self.docs, self.nulls, self.terms, self.impacts = docs, nulls, terms, impacts
        self.row = np.repeat(np.arange(len(docs)), sizes)


def search_chunk(chunk: Chunk, tree: ItemTree, best: Best) -> int:
    """Visit all pairs of nodes that may hold a better document; returns the number of leaf pairs that were scored."""
    place = np.minimum(np.searchsorted(tree.terms, chunk.terms), len(tree.terms) - 1)
    own = tree.terms[place] == chunk.terms
    row, col, value = chunk.row[own], place[own], chunk.impacts[own].astype(tree.dtype)
    leaves = -(-len(chunk.docs) // LEAF)
    levels = [np.zeros((leaves, len(tree.terms)), tree.dtype)]
    np.maximum.at(levels[0], (row // LEAF, col), value)
    while len(levels[-1]) > 1:
        levels.append(maxima(levels[-1], FAN))
    first = np.searchsorted(row, np.arange(0, (leaves + 1) * LEAF, LEAF))  # entries of each leaf
    scored = 0

    def score(group: int, leaf: int) -> None:
        items = tree.span(0, group)
        a, b = first[leaf], first[leaf + 1]
        used, at = np.unique(col[a:b], return_inverse=True)
        coordinates = np.zeros((len(used), min(LEAF, len(chunk.docs) - leaf * LEAF)), tree.dtype)
        coordinates[at, row[a:b] - leaf * LEAF] = value[a:b]
        scores = (tree.items[items][:, used] @ coordinates).astype(np.int64)
        members = tree.members[items]
        for i in np.flatnonzero(scores.max(1) >= best.kth[members]).tolist():
            good = np.flatnonzero(scores[i] >= best.kth[members[i]])
            best.add(members[i], scores[i][good], chunk.docs[leaf * LEAF + good], chunk.nulls[leaf * LEAF + good])

    def children(level: int, node: int, nodes: int) -> tuple[int, range]:
        return (level, range(node, node + 1)) if level == 0 else (level - 1, range(node * FAN, min(nodes, (node + 1) * FAN)))

    def visit(ti: int, i: int, td: int, d: int) -> None:
        nonlocal scored
        if ti == td == 0:
            scored += 1
            score(i, d)
            return
        ni, items = children(ti, i, len(tree.levels[ti - 1]))
        nd, docs = children(td, d, len(levels[td - 1]))
        bounds = tree.levels[ni][items.start:items.stop] @ levels[nd][docs.start:docs.stop].T
        for flat in np.argsort(-bounds, axis=None, kind="stable").tolist():
            x, y = divmod(flat, len(docs))
            if bounds[x, y] >= best.kth[tree.members[tree.span(ni, items[x])]].min():
                visit(ni, items[x], nd, docs[y])

    visit(len(tree.levels) - 1, 0, len(levels) - 1, 0)
    return scored


def item_trees(block: Items, facts: Facts) -> list[ItemTree]:
    """Trees over at most ``TREE_ITEMS`` items; neighbours share frequent terms."""
    order = sorted(range(len(block.ids)), key=lambda i: sorted((-facts.df[block.terms[i]]).tolist())[:1]
                   + block.terms[i][np.lexsort((block.terms[i], -facts.df[block.terms[i]]))][:4].tolist())
    return [ItemTree(block, order[i:i + TREE_ITEMS], facts) for i in range(0, len(order), TREE_ITEMS)]


FOUND = "item int, doc_id long, score long"


def best_of_tasks(ordered: DataFrame, block: Items, facts: Facts, k: int) -> DataFrame:
    """``item, doc_id, score``: for every item the k best documents of each task."""
    held = ordered.sparkSession.sparkContext.broadcast((block.terms, block.repeats))
    n_items, schema = len(block.ids), arrow_schema(FOUND)

    def run(batches):
        mine = Items([])
        mine.ids, (mine.terms, mine.repeats) = list(range(n_items)), held.value
        best, trees, waiting, rows, size = Best(n_items, k), None, [], 0, 0

        def search():
            nonlocal trees
            trees = trees or item_trees(mine, facts)
            chunk = Chunk(*(np.concatenate(x) for x in zip(*waiting)))
            for tree in trees:
                search_chunk(chunk, tree, best)

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                sizes, _, term, impact = entries(batch, facts)
                doc = batch.column("doc_id")
                waiting.append((doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), sizes, term, impact))
                rows, size = rows + len(sizes), size + len(term)
                if rows >= CHUNK_DOCS or size >= CHUNK_ENTRIES:
                    search()
                    waiting, rows, size = [], 0, 0
        if waiting:
            search()
        item, nth = np.nonzero(best.score)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(best.doc[item, nth], mask=best.null[item, nth]),
                                          pa.array(best.score[item, nth])], schema=schema)

    return ordered.mapInArrow(run, FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of each item with the highest scores above 0."""
    spark = docs.sparkSession
    id_type = items.schema["item_id"].dataType
    out = spark.createDataFrame([], T.StructType([
        T.StructField("item_id", id_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()),
        T.StructField("score", T.LongType())]))
    highest = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for n, block in enumerate(item_blocks(items, block_bytes)):
        held = materialize(postings(docs, block), "postings")
        facts = Facts(held, len(block.vocabulary))
        if not facts.df.any():
            continue
        found = best_of_tasks(by_strongest_terms(held, facts), block, facts, k)
        deal = F.pmod(F.xxhash64("doc_id", "score"), F.lit(16))
        some = found.withColumn("nth", F.row_number().over(Window.partitionBy("item", deal).orderBy(*highest))).where(F.col("nth") <= k)
        best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*highest))).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.ids)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", id_type)]))
        part = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if n == 0 else out.union(part)
    return out
