"""Near duplicates by SimHash, joined on a grid of bit counts.

A fingerprint has 64 bits; bit i is set if more than half of a document's shingle hashes have it. It is mapped to the bit counts of its
short segments. The Manhattan distance of two count vectors never exceeds the number of differing bits, so two fingerprints within
the radius agree in the counts of most segments: of ``blocks`` equal stretches at most ``radius`` can differ, and at least
``blocks - radius`` are equal. A grid cell is one choice of that many stretches with their counts. Members of a cell whose
vectors lie within the radius by Manhattan distance are candidates, and the full distance decides on these alone.

Scale: equal fingerprints are one before anything is joined. A cell is a stretch of a sorted partition that streams through a task as
8 bytes per different fingerprint, and gives a spanning forest of its links (at most one link fewer than members), never all pairs; a
search step from one fingerprint removes everything it reaches, so dense groups take time in proportion to their size. Every link shows
in at least one cell, hence the forests connect exactly what the links connect. Components are found by Spark joins.

Defined results: a null text is empty; a text without words has fingerprint zero and is linked like any other; a null ``doc_id`` takes
part and gets the id of its group; groups of only null ids have a null id; repeated rows stay; other columns pass through or are ignored.
"""

from __future__ import annotations

import math
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinelog.llm.common import arrow_schema, components, discard, materialize, nothing_kept, per_batch, shuffles_dropped, texts_of

SEGMENT_BITS = 2


def shingles(text: str, words: int) -> list[bytes]:
    """Runs of ``words`` words of a text in lower case (A-Z), joined by a space; all words if there are fewer; none for no words."""
    parts = text.encode().lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    n = max(1, len(parts) - words + 1)
    starts = np.concatenate(([0], ends[:n - 1] + 1)).tolist()
    return [joined[a:b] for a, b in zip(starts, ends[min(words, len(parts)) - 1:].tolist())]


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the 64-bit hashes."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        votes += np.unpackbits(hashes[i:i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str, words: int, seed: int = 42) -> int:
    parts = shingles(text, words)
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in parts), np.uint64, len(parts)))


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` of every document; ``fp`` is the fingerprint as a signed long."""
    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "fp": [signed(fingerprint(t, words, seed)) for t in texts_of(batch)]}

    ddl = "doc_id long, fp long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(per_batch(run, ddl), ddl)


def cells(fps: np.ndarray, radius: int, blocks: int) -> tuple[np.ndarray, int]:
    """Grid cells of fingerprints, one row per choice of stretches: a 64-bit name of the choice and its counts."""
    segments = 64 // SEGMENT_BITS
    counts = np.bitwise_count((fps[:, None] >> np.arange(0, 64, SEGMENT_BITS, dtype=np.uint64)) & np.uint64((1 << SEGMENT_BITS) - 1))
    bounds = [segments * i // blocks for i in range(blocks + 1)]
    names = np.empty((blocks, len(fps)), np.uint64)
    for k in range(blocks):
        value = np.zeros(len(fps), np.uint64)
        for s in range(bounds[k], bounds[k + 1]):
            value = value * np.uint64(SEGMENT_BITS + 1) + counts[:, s].astype(np.uint64)
        names[k] = value
    choices = list(combinations(range(blocks), blocks - radius))
    out = np.empty((len(choices), len(fps)), np.uint64)
    for c, chosen in enumerate(choices):
        value = np.full(len(fps), c, np.uint64)
        for k in chosen:
            value = value * np.uint64((SEGMENT_BITS + 1) ** (bounds[k + 1] - bounds[k])) + names[k]
        out[c] = value
    return out, len(choices)


_LOW = np.uint64(0x5555555555555555)  # the lower bit of each two


def unary(fps: np.ndarray) -> np.ndarray:
    """Counts of the segments of two bits as runs of ones (0, 01, 11), so that differing bits add up to the Manhattan distance."""
    upper = (fps >> np.uint64(1)) & _LOW
    return ((fps & _LOW) | upper) | ((fps & upper) << np.uint64(1))


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (as places) that connect exactly the fingerprints connected by differences of at most ``radius`` bits.

    Only those within the radius by the Manhattan distance of their counts, which is never larger, are compared in full.
    """
    counts = unary(fps)
    left = np.arange(len(fps))
    links, frontier = [], []
    while len(left):
        if not frontier:
            frontier.append(left[0])
            left = left[1:]
            continue
        at = frontier.pop()
        maybe = np.flatnonzero(np.bitwise_count(counts[left] ^ counts[at]) <= radius)
        near = maybe[np.bitwise_count(fps[left[maybe]] ^ fps[at]) <= radius]
        if len(near):
            found = left[near].tolist()
            links += [(int(at), x) for x in found]
            frontier += found
            left = np.delete(left, near)
    return links


def links(rows: DataFrame, radius: int = 4, blocks: int = 8, differing: int | None = None) -> DataFrame:
    """``a, b``: links among different fingerprints, as many as connect the members of each cell.

    The members of a cell are taken in order, so the links don't depend on how rows arrive. ``rows`` holds ``fp`` and, if fingerprints
    are not nodes themselves, ``node``. Cells are made for ``differing`` bits (the radius unless given): a smaller number makes fewer and
    larger cells that show wider links only mostly.
    """
    differing = radius if differing is None else differing
    if not 0 < differing < blocks <= 64 // SEGMENT_BITS:
        raise ValueError("blocks must exceed the differing bits and not the number of segments")
    kinds = ["fp"] + ["node"] * ("node" in rows.columns)

    def spread(batches):
        nothing_kept()
        for batch in batches:
            columns = [np.asarray(c) for c in batch.columns]
            for i in range(0, batch.num_rows, 2000):
                part = [c[i:i + 2000] for c in columns]
                names, n = cells(part[0].view(np.uint64), differing, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(names.ravel().view(np.int64)), *(pa.array(np.tile(c, n)) for c in part)],
                                                 names=["cell", *kinds])

    def solve(cell: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
        fp, node = columns[0].view(np.uint64), columns[-1]
        edge = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
        size = np.diff(edge)
        twos = edge[:-1][size == 2]
        near = twos[np.bitwise_count(fp[twos] ^ fp[twos + 1]) <= radius]
        found = [np.stack([node[near], node[near + 1]], 1)]
        for a, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist()):
            if pairs := forest(fp[a:a + n], radius):
                found.append(node[a:a + n][np.array(pairs)])
        return np.concatenate(found)

    def connect(batches):
        nothing_kept()
        held: list[list[np.ndarray]] = []  # stretches of the cell that may go on
        seen: set[tuple[int, int]] = set()

        def new(pairs: np.ndarray):
            fresh = set(map(tuple, np.sort(pairs, axis=1).tolist())) - seen
            if len(seen) > 200_000:
                seen.clear()  # only costs repeats
            seen.update(fresh)
            if fresh:
                low, high = zip(*fresh)
                yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [np.asarray(c) for c in batch.columns]
            if not len(columns[0]):
                continue
            held.append(columns)
            if columns[0][-1] == held[0][0][0]:
                continue
            columns = [np.concatenate(c) for c in zip(*held)]
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            held = [[c[last:].copy() for c in columns]]
            yield from new(solve(columns[0][:last], [c[:last] for c in columns[1:]]))
        if held:
            columns = [np.concatenate(c) for c in zip(*held)]
            yield from new(solve(columns[0], columns[1:]))

    ddl = ", ".join(f"{k} long" for k in ["cell", *kinds])
    return (rows.select(*kinds).mapInArrow(spread, ddl).repartition("cell").sortWithinPartitions("cell", *kinds)
            .mapInArrow(connect, "a long, b long"))


def group(prints: DataFrame, radius: int = 4, blocks: int = 8) -> DataFrame:
    """``doc_id, fp, component_id`` for ``prints`` (``doc_id, fp``); the id is the smallest ``doc_id`` reachable."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(distinct.select("fp"), radius, blocks)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, blocks: int = 8) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id`` of every document."""
    prints = materialize(fingerprints(docs, words), "simhash")
    return group(prints, radius, blocks).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def jaccard(a: str, b: str, words: int) -> float:
    """Shared shingles over all shingles; 1 for two texts without words."""
    x, y = set(shingles(a, words)), set(shingles(b, words))
    return len(x & y) / len(x | y) if x or y else 1.0


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SLOTS = 20  # bits of a shingle hash that name its slot in the table of counts
TOKENS = "token long, node long, size int, place int"


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted different 64-bit hashes of the shingles of a text, computed from the hashes of its words."""
    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(p) for p in parts), np.uint64, len(parts))
    k = min(words, len(parts))
    out = np.full(len(parts) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _MIX[0] + hashes[i:i + len(out)]
    out = (out ^ (out >> np.uint64(31))) * _MIX[1]
    return np.unique(out ^ (out >> np.uint64(29)))


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two ``shingle_set`` is at least ``similarity``; two empty sets are alike."""
    shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    whole = len(x) + len(y) - shared
    return not whole or shared / whole >= similarity


def node_of(text: str) -> int:
    """Hash of the words of a text: texts of the same words are one node."""
    return signed(xxhash.xxh3_64_intdigest(b" ".join(text.encode().lower().split())))


def shingle_counts(docs: DataFrame, words: int) -> np.ndarray:
    """How many documents have a shingle in each slot. Only the order of ``prefixes`` depends on it, never the pairs that are found."""
    ddl, blocks = "block int, counts binary", 16

    def parts(counts: np.ndarray):
        raw = [zlib.compress(c.tobytes(), 1) for c in np.split(counts, blocks)]
        return pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array(raw, pa.binary())], schema=arrow_schema(ddl))

    def count(batches):
        nothing_kept()
        counts = np.zeros(1 << _SLOTS, np.uint32)
        for batch in batches:
            for text in texts_of(batch):
                np.add.at(counts, shingle_set(text, words) >> np.uint64(64 - _SLOTS), 1)
        yield parts(counts)

    def add(batches):
        nothing_kept()
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[k] = held.get(k, 0) + np.frombuffer(zlib.decompress(raw), np.uint32)
        raw = [zlib.compress(c.tobytes(), 1) for c in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(raw, pa.binary())], schema=arrow_schema(ddl))

    out = np.zeros((blocks, (1 << _SLOTS) // blocks), np.uint32)
    with shuffles_dropped(docs.sparkSession):
        added = docs.select("text").mapInArrow(count, ddl).repartition(blocks, "block").mapInArrow(add, ddl).collect()
    for r in added:
        out[r.block] = np.frombuffer(zlib.decompress(r.counts), np.uint32)
    return out.ravel()


def prefixes(docs: DataFrame, counts: np.ndarray, words: int, similarity: float) -> DataFrame:
    """``token, node, size, place``: the first shingles of each text in one order for all texts, seldom ones first.

    Of ``size`` shingles as many come first as two sets can't both do without: sets of a Jaccard similarity of ``similarity`` or more
    have one of these in common.
    """
    held = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        nothing_kept()
        schema = arrow_schema(TOKENS)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                tokens, sizes, nodes = [np.zeros(0, np.uint64)], [], []
                for text in texts_of(part):
                    own = shingle_set(text, words)
                    order = np.lexsort((own, held.value[own >> np.uint64(64 - _SLOTS)]))
                    sizes.append(len(own))
                    tokens.append(own[order[:len(own) - math.ceil(similarity * len(own) - 1e-9) + 1]])
                    nodes.append(node_of(text))
                taken = np.array([len(t) for t in tokens[1:]], np.int64)
                rows = np.repeat(np.arange(part.num_rows), taken)
                place = np.arange(len(rows)) - np.repeat(np.cumsum(taken) - taken, taken)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.array(nodes, np.int64)[rows]),
                    pa.array(np.array(sizes, np.int32)[rows]), pa.array(place.astype(np.int32))], schema=schema)

    return docs.select("text").mapInArrow(run, TOKENS)


def per_token(rows: DataFrame, solve, ddl: str) -> DataFrame:
    """``solve`` of the columns of each run of equal tokens; ``rows`` has ``token`` first, a run is in the order of place and node.

    ``solve`` takes the edges of the runs of a stretch and its columns as arrays and yields lists of columns.
    """
    names, schema = rows.columns, arrow_schema(ddl)

    def run(batches):
        nothing_kept()
        held: list[list[np.ndarray]] = []  # stretches of the token that may go on

        def give(columns):
            token = columns[0]
            edges = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
            for out in solve(edges, columns):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

        for batch in batches:
            columns = [np.asarray(c) for c in batch.columns]
            if not len(columns[0]):
                continue
            held.append(columns)
            if columns[0][-1] == held[0][0][0]:
                continue
            columns = [np.concatenate(c) for c in zip(*held)]
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            held = [[c[last:].copy() for c in columns]]
            yield from give([c[:last] for c in columns])
        if held:
            yield from give([np.concatenate(c) for c in zip(*held)])

    return rows.repartition("token").sortWithinPartitions("token", "place", *names[1:]).mapInArrow(run, ddl)


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """``tokens`` without repeated rows and without those that only one node has."""
    def solve(edges, columns):
        token, node = columns[0], columns[1]
        order = np.lexsort((node, token))
        first = np.ones(len(token), bool)
        first[order[1:]] = (token[order[1:]] != token[order[:-1]]) | (node[order[1:]] != node[order[:-1]])
        keep = first & np.repeat(np.add.reduceat(first.astype(np.int64), edges[:-1]) > 1, np.diff(edges))
        yield [c[keep] for c in columns]

    return per_token(tokens, solve, TOKENS)


def unjoined(tokens: DataFrame, roots: DataFrame, used: int) -> DataFrame:
    """Rows of ``tokens``, with ``root``, of the tokens whose nodes are not all joined and of which over ``used`` have one."""
    def solve(edges, columns):
        root, sizes = columns[-1], np.diff(edges)
        several = np.maximum.reduceat(root, edges[:-1]) != np.minimum.reduceat(root, edges[:-1])
        keep = np.repeat(several & (sizes > used), sizes)
        yield [c[keep] for c in columns]

    joined = tokens.select("token", "node", "size", "place").join(roots.withColumnRenamed("root", "_root"), "node", "left")
    return per_token(joined.select("token", "node", "size", "place", F.coalesce("_root", "node").alias("root")), solve, TOKENS + ", root long")


def star_pairs(tokens: DataFrame, first: int, end: int, similarity: float) -> DataFrame:
    """``a, b``: of each token the members ``first`` to ``end`` with all later ones that are not joined to them.

    Members where the token comes early have few shingles of their own: the text that others were made from comes before its copies.
    Pairs that can't be similar by their sizes, or by the number of shingles from the token on, are left out.
    """
    def solve(edges, columns):
        _, node, size, place, root = columns
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
            for at in range(a + first, min(a + end, z - 1)):
                rest = slice(at + 1, z)
                other = size[rest].astype(np.int64)
                own = int(size[at])
                most = np.minimum(own - int(place[at]), other - place[rest])
                near = ((root[rest] != root[at]) & (np.minimum(own, other) >= similarity * np.maximum(own, other) - 1e-6)
                        & (most >= similarity / (1 + similarity) * (own + other) - 1e-6))
                b = node[rest][near]
                if len(b):
                    yield [np.minimum(b, node[at]), np.maximum(b, node[at])]

    return per_token(tokens, solve, "a long, b long").distinct()


def verified(candidates: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs of ``candidates`` (``a, b``) whose texts are similar."""
    pairs = (candidates.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
             .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"))

    def run(batches):
        nothing_kept()
        known: dict[int, np.ndarray] = {}

        def own(node: int, text: str | None) -> np.ndarray:
            if node not in known:
                if len(known) >= 256:
                    known.pop(next(iter(known)))
                known[node] = shingle_set(text or "", words)
            return known[node]

        for whole, i in ((b, i) for b in batches for i in range(0, b.num_rows, 200)):
            batch = whole.slice(i, 200)
            keep = [similar(own(a, x), own(b, y), similarity) for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def fingerprint_links(nodes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """``a, b``: links that connect the nodes (``node, fp``) whose fingerprints differ by at most ``radius`` bits."""
    distinct = materialize(nodes.groupBy("fp").agg(F.min("node").alias("low")), "prints", drop_shuffles=True)
    equal = nodes.join(distinct, "fp").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    return links(distinct.select("fp", F.col("low").alias("node")), radius, blocks).union(equal)


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, growth: int = 8, radius: int | None = None,
                         blocks: int = 8, print_words: int = 4) -> DataFrame:
    """``docs`` with one document of each group: the one of the smallest ``doc_id``.

    With ``radius`` two texts are linked by SimHash, as in ``near_duplicates``: if their fingerprints of ``print_words`` words differ by
    at most ``radius`` bits. These links come first, and what they join needs no comparison of shingles. The further links are exact:
    two texts are linked if the Jaccard similarity of their sets of shingles of ``words`` words is at least ``similarity``; a group is what
    links connect. All links count: sets that similar have one of their first shingles in common (``prefixes``), so all
    pairs are found among the nodes of a token. Pairs are verified first and joined afterwards, in rounds: the first member of each
    token with all others, then ``growth`` times as many members, until the members of each token are joined or every pair of them is
    refuted. Texts of the same words are one before anything is joined. Shingles are compared by 64-bit hashes.
    """
    keyed = docs.withColumn("_llm_text_key", F.xxhash64("text"))
    schema = "doc_id long, _llm_text_key long, node long, fp long"

    def run(batch: pa.RecordBatch) -> dict:
        nodes = [(node_of(t), None if radius is None else signed(fingerprint(t, print_words))) for t in texts_of(batch)]
        return {"doc_id": batch.column(0), "_llm_text_key": batch.column(1), "node": [n for n, _ in nodes], "fp": [p for _, p in nodes]}

    rows = materialize(keyed.select(F.col("doc_id").cast("long"), "_llm_text_key", "text").mapInArrow(per_batch(run, schema), schema), "words")
    nodes = materialize(rows.groupBy("node").agg(F.min(F.struct("doc_id", "_llm_text_key")).alias("first"), F.min("fp").alias("fp")),
                        "nodes", drop_shuffles=True)
    counts = shingle_counts(docs, words)
    tokens = materialize(shared_tokens(prefixes(docs, counts, words, similarity)), "tokens", drop_shuffles=True)
    texts = _texts_of_nodes(keyed, tokens.select("node").distinct().join(nodes, "node"))
    tried, roots = None, nodes.select("node", F.col("node").alias("root")).limit(0)
    if radius is not None:
        roots = components(materialize(fingerprint_links(nodes.select("node", "fp"), radius, blocks), "print-links", drop_shuffles=True))
    first, end = 0, 1
    while True:
        before, tokens = tokens, materialize(unjoined(tokens, roots, first + 1), "tokens", drop_shuffles=True)
        discard(before)
        if tokens.isEmpty():
            break
        pairs = star_pairs(tokens, first, end, similarity)
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "candidates", drop_shuffles=True)
        new = materialize(verified(pairs, texts, words, similarity), "links", drop_shuffles=True)
        tried = pairs if tried is None else tried.union(pairs)
        if not new.isEmpty():  # earlier links are in the roots
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(new))
        first, end = end, end * growth
    kept = (nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
            .agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_llm_id"), F.col("first._llm_text_key").alias("_llm_key")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_llm_id")) & F.col("_llm_text_key").eqNullSafe(F.col("_llm_key"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_llm_text_key"]).select(*docs.columns)


def _texts_of_nodes(keyed: DataFrame, ends: DataFrame) -> DataFrame:
    """``node, text``: one text for every node of ``ends``."""
    wanted = ends.select("node", F.col("first.doc_id").alias("_llm_id"), F.col("first._llm_text_key").alias("_llm_key"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_llm_id")) & F.col("_llm_text_key").eqNullSafe(F.col("_llm_key"))
    return materialize(keyed.select("doc_id", "_llm_text_key", "text").join(wanted, same).dropDuplicates(["node"]).select("node", "text"),
                       "texts", drop_shuffles=True)
