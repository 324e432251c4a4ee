"""SimHash fingerprints of whole documents and exact search within a Hamming radius by permuted block tables.

Terms are runs of ``words`` words in lower case; a term votes with its frequency, for a bit that is set in its 128-bit hash
and against one that is not; the fingerprint has the bits with more votes for than against. Two fingerprints that differ in
a share d of their bits come from texts at an angle of pi * d; their likeness is the cosine of that angle, zero at least.

Search: the bits are cut into ``radius + 1 + spare`` blocks. Of fingerprints within the radius at least ``1 + spare`` blocks are equal, so one
table per choice of that many blocks, with these blocks in front, has the pair under one prefix. A pair is taken from the first
table that shows it, so no pair comes twice and none needs to be gathered to drop repeats.

Defined results: a null text is empty, its fingerprint is zero; equal texts have equal fingerprints; two documents without terms are
alike (1.0); rows with one ``doc_id`` are ordered by text; a null ``doc_id`` comes last; of a single document the next one is itself;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinelog.llm.common import arrow_schema, materialize

BITS = 128
PAIRS = 1 << 20  # fingerprints compared in one step


def terms(text: str, words: int) -> list[bytes]:
    parts = text.lower().encode().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    n = max(1, len(parts) - words + 1)
    starts = np.concatenate(([0], ends[:n - 1] + 1)).tolist()
    return [joined[a:b] for a, b in zip(starts, ends[min(words, len(parts)) - 1:].tolist())]


def fingerprint(text: str, words: int = 2) -> bytes:
    """16 bytes; a term that occurs n times votes n times."""
    found = terms(text, words)
    if not found:
        return bytes(BITS // 8)
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, found)), np.uint8).reshape(-1, BITS // 8)
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 4096):
        votes += np.unpackbits(hashes[i:i + 4096], axis=1).sum(0, dtype=np.int64)
    return np.packbits(votes * 2 > len(hashes)).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    differing = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return max(0.0, math.cos(math.pi * differing / (8 * len(a))))


EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def edited(text: str, following: str) -> str:
    """``text`` whose last half gives way to as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compare_with_edits(docs: DataFrame, words: int = 2, parts: int | None = None) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and both likenesses, in one shuffle of the texts.

    Documents are cut into ranges of ``doc_id``; a document that ends the range before is sent to both ranges, so each range
    can be read in order without its neighbours.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10000).alias("cuts"),
                   F.max("doc_id").alias("top"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    cuts = sorted(set(ids.cuts or []) - {ids.top})  # ids that end a range; range n holds ids above cuts[n - 1] up to cuts[n]
    cut = F.lit(cuts or [0]).cast("array<long>")
    own = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(cut, lambda c: c < F.col("doc_id"))) if cuts else F.lit(0))
    lowest = -1 if ids.nulls else 0
    guest = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.array_contains(cut, F.col("doc_id")) if cuts else F.lit(False), own + 1)
    # the last document is followed by the first, and the nulls follow the lowest id
    wrap = F.when(F.col("doc_id") == ids.top if ids.top is not None else F.lit(True), lowest)
    first_null = F.when(F.col("doc_id").isNull(), 0) if ids.nulls and ids.top is not None else F.lit(None).cast("int")
    places = F.array_compact(F.array(
        F.struct(own.cast("int").alias("range"), F.lit(0).alias("guest")),
        *[F.when(p.isNotNull(), F.struct(p.cast("int").alias("range"), F.lit(n).alias("guest")))
          for n, p in ((1, guest), (1, first_null), (1, wrap))]))
    spread = rows.select("doc_id", "text", F.explode(places).alias("p")).select("p.range", "p.guest", "doc_id", "text")
    ordered = (spread.repartitionById(len(cuts) + 2, F.col("range") + 1)
               .sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text"))

    def run(batches):
        schema = arrow_schema(EDITED)
        waiting = None  # range, doc_id, text, fingerprint
        ended = None  # range whose first guest has been met
        for batch in batches:
            out: list[tuple] = []
            for part, visitor, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if visitor and ended == part:
                    continue
                print_ = fingerprint(text, words)
                if waiting is not None:
                    _, d, t, p = waiting
                    e = edited(t, text)
                    q = fingerprint(e, words)
                    out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), p.hex(), q.hex(), likeness(p, q), likeness(p, print_)))
                if visitor:
                    waiting, ended = None, part
                else:
                    waiting = (part, doc, text, print_)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return ordered.mapInArrow(run, EDITED)


NEAR = "query string, fingerprint string, distance int"
NEAR_COUNTS = "query string, n long"


def search(held: DataFrame, queries: DataFrame, radius: int = 6, spare: int = 1, count: bool = False) -> DataFrame:
    """``query, fingerprint, distance``: every fingerprint within ``radius`` bits of a query, the query itself included.

    Both inputs hold different fingerprints as hex (column ``fingerprint``). Rows of one table and prefix stream through a task: its
    queries first, then all other fingerprints in passing, compared in blocks of ``PAIRS`` pairs. With ``count``, ``held`` also has ``copies`` and the result is
    ``query, n``: copies within the radius, summed in the tasks; a query has a row for each prefix that found some.
    """
    blocks = radius + 1 + spare
    bounds = [BITS * i // blocks for i in range(blocks + 1)]
    choices = list(combinations(range(blocks), 1 + spare))
    place = np.zeros((blocks, BITS), np.uint8)
    for k in range(blocks):
        place[k, bounds[k]:bounds[k + 1]] = 1
    masks = np.packbits(place, axis=1).view(np.uint64)

    def spread(batches):
        for batch in batches:
            raw = [bytes.fromhex(x) for x in batch.column(0).to_pylist()]
            bits = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, BITS // 8), axis=1)
            prefix = [np.packbits(bits[:, bounds[k]:bounds[k + 1]], axis=1) for k in range(blocks)]
            for n, chosen in enumerate(choices):
                keys = np.concatenate([np.full((len(raw), 1), n, np.uint8), *(prefix[k] for k in chosen)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(map(bytes, keys), pa.binary()), pa.array(raw, pa.binary()), *batch.columns[1:]],
                    names=["prefix", "fp", "asked", "copies"])

    ddl = NEAR_COUNTS if count else NEAR

    def compare(batches):
        schema = arrow_schema(ddl)
        none = np.empty((0, BITS // 64), np.uint64)
        here, asked, sums = None, none, np.zeros(0, np.int64)
        out: list[tuple] = []

        def close():
            out.extend((asked[i].tobytes().hex(), int(sums[i])) for i in np.flatnonzero(sums).tolist() if count)

        def look(held: np.ndarray, copies: np.ndarray) -> None:
            chosen = choices[here[0]]
            step = max(1, PAIRS // len(asked))
            for k in range(0, len(held), step):
                differs = asked[:, None, :] ^ held[None, k:k + step, :]
                distance = np.bitwise_count(differs).sum(2)
                q, h = np.nonzero(distance <= radius)
                # the first table of the pair: no other block up to its last one is equal
                equal = ((differs[q, h][:, None, :] & masks[:chosen[-1] + 1]) == 0).all(2).sum(1)
                q, h = q[equal == len(chosen)], h[equal == len(chosen)]
                np.add.at(sums, q, copies[k + h])
                if not count:
                    out.extend((asked[i].tobytes().hex(), held[k + j].tobytes().hex(), int(distance[i, j])) for i, j in zip(q.tolist(), h.tolist()))

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for batch in batches:
            if not len(batch):
                continue
            prefix = np.array([*batch.column(0).to_pylist(), None], dtype=object)[:-1]
            fps = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, BITS // 64)
            is_query, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            starts = np.concatenate(([0], np.flatnonzero(prefix[1:] != prefix[:-1]) + 1))
            ends = np.append(starts[1:], len(prefix))
            n_asked = np.add.reduceat(is_query.astype(np.int64), starts)
            # prefixes without a query are passed over, but for the first, which may go on, and the last, which may be gone on with
            busy = n_asked > 0
            busy[[0, -1]] = True
            for a, b, m in zip(starts[busy].tolist(), ends[busy].tolist(), n_asked[busy].tolist()):
                if prefix[a] != here:
                    close()
                    here, asked, sums = prefix[a], none, np.zeros(0, np.int64)
                if m:
                    asked, sums = np.concatenate([asked, fps[a:a + m]]), np.concatenate([sums, np.zeros(m, np.int64)])
                if len(asked) and a + m < b:
                    look(fps[a + m:b], copies[a + m:b])
                if len(out) >= 1000:
                    yield batch_of()
                    out.clear()
        close()
        if out:
            yield batch_of()

    copies = F.col("copies") if count else F.lit(1).cast("long")
    both = (held.select("fingerprint", F.lit(False).alias("asked"), copies.alias("copies"))
            .union(queries.select("fingerprint", F.lit(True), F.lit(0).cast("long"))))
    return (both.mapInArrow(spread, "prefix binary, fp binary, asked boolean, copies long").repartition("prefix")
            .sortWithinPartitions("prefix", F.desc("asked")).mapInArrow(compare, ddl))


def report(docs: DataFrame, words: int = 2, radius: int = 6, every: int = 100) -> DataFrame:
    """``compare_with_edits`` plus ``n_near``: for documents whose id is divisible by ``every``, how many documents lie within the radius."""
    prints = materialize(compare_with_edits(docs, words), "fingerprints", drop_shuffles=True)  # that of the texts, before the search
    held = prints.groupBy("fingerprint").agg(F.count("*").alias("copies"))
    asked = prints.where(F.col("doc_id") % every == 0).select("fingerprint").distinct()
    near = (search(held, asked, radius, count=True).groupBy("query").agg(F.sum("n").alias("n_near"))
            .select(F.col("query").alias("fingerprint"), "n_near"))
    return (prints.join(near, "fingerprint", "left")
            .withColumn("n_near", F.when(F.col("doc_id") % every == 0, F.col("n_near"))).select(*prints.columns, "n_near"))
