"""Spelling variants: words of a corpus within one inserted, deleted or replaced letter of each other.

Words are counted over all documents (counts are combined in tasks before the shuffle). Near words are then found in blocks:

1. A pair's error lies in the first or in the last half of its shorter word, so the pair agrees in all letters of the other half. A word of length m
   goes to the blocks of both halves for shorter length m (``short``) and for shorter length m - 1 (``long``).
2. A region (a, b] of the shorter word is where the error may be; the letters before and behind it name the block. Blocks of more than ``HOT`` words
   give way to the blocks of both halves of their region, until they are small or the region is one letter (then the alphabet bounds them).
3. A task takes blocks of one length and region in packs and builds the position index of a pack: for each position and letter the set of words
   with this letter there, as bits. All short words of a pack run over it at once, one letter after the other, and keep three sets of words each: no
   error so far (Z), one replaced letter (S), one letter inserted (I), the last read with positions shifted by one:
   ``S = S & B[i, q] | Z``, ``I = I & B[i + 1, q] | Z``, ``Z = Z & B[i, q]``. Deletions are insertions seen from the longer word.
4. A pair comes out of one region only: the one that holds its first differing position. Tasks return counts and best partners by word, not pairs.

The largest near word with at least ``ratio`` times the count is a word's form; roots follow forms by pointer doubling (forms at least double the
count, so the number of rounds grows with the logarithm of the logarithm of the largest count).

Defined results: a null or empty text has no words; a null ``doc_id`` counts as empty text in the hash of a run; repeated rows count each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelog.llm.common import arrow_schema, discard, materialize

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
KEPT_COUNTS = 300_000  # words that a task counts before it hands them on
HOT = 16_384  # words in a block
PACK, SLAB, QUERIES = 4096, 4096, 1024  # words in a pack, in an index, short words at once
PACK_LETTERS = 1 << 22


def runs(text: str, doc_id: int | None, every: int) -> Counter:
    """Counts of the words of one text. A run whose hash with the id is divisible by ``every`` loses a letter."""
    found = Counter(RUN.findall(text.encode().translate(FOLD).decode()))
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    crc = zlib.crc32
    for word in [w for w in found if crc(w.encode(), prefix) % every == 0]:
        at = crc(word.encode(), prefix) % len(word)
        found[(word, at)] = found.pop(word)
    out = Counter()
    for word, n in found.items():
        if isinstance(word, tuple):
            word, at = word
            word = word[:at] + word[at + 1:]
        out[word] += n
    return out


WORDS = "word string, n long"


def count_words(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97) -> DataFrame:
    """``word, n``: words of at least ``least_length`` letters that occur at least ``least_count`` times."""
    schema = arrow_schema(WORDS)

    def run(batches):
        held: dict[str, int] = {}

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for doc, text in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    for word, n in (runs(text, doc, every).items() if text else ()):
                        if len(word) >= least_length:
                            held[word] = held.get(word, 0) + n
                    if len(held) > KEPT_COUNTS:
                        yield batch_of()
                        held.clear()
        if held:
            yield batch_of()

    return (docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, WORDS).groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least_count))


def _member(short: bool, a: Column, b: Column) -> Column:
    """Place of a word in the block of a region: its letters outside of it (in a long word the region is one letter longer)."""
    s = F.length("word") if short else F.length("word") - 1
    tail = F.col("word").substr(b + (1 if short else 2), F.length("word"))
    return F.struct(s.cast("int").alias("s"), a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(short).alias("short"),
                    F.col("word").substr(F.lit(1), a).alias("head"), tail.alias("tail"))


def _halves(short: Column, s: Column, a: Column, b: Column) -> Column:
    """Both halves of the region (a, b] for a word."""
    middle = F.floor((a + b) / 2).cast("int")
    return F.when(short, F.array(_member(True, a, middle), _member(True, middle, b))).otherwise(
        F.array(_member(False, a, middle), _member(False, middle, b)))


BLOCK = ["s", "a", "b", "head", "tail"]


def blocks(words: DataFrame, least_length: int = 5, hot: int = HOT) -> DataFrame:
    """``word, n`` with the block (``s, a, b, head, tail``) and ``short``, one row for each block of a word."""
    length, zero = F.length("word").cast("int"), F.lit(0).cast("int")
    both = F.concat(_halves(F.lit(True), length, zero, length),
                    F.when(length > least_length, _halves(F.lit(False), length - 1, zero, length - 1)).otherwise(F.array()))
    rows = words.select("word", "n", F.explode(both).alias("m")).select("word", "n", "m.*")
    done = None
    while True:
        crowded = (rows.where(F.col("b") - F.col("a") > 1).groupBy(*BLOCK).agg(F.count("*").alias("members"))
                   .where(F.col("members") > hot).select(*BLOCK))
        crowded = materialize(crowded, "crowded-blocks")
        if crowded.isEmpty():
            return rows if done is None else done.union(rows)
        calm = rows.join(crowded, BLOCK, "left_anti").select(rows.columns)
        done = calm if done is None else done.union(calm)
        again = rows.join(crowded, BLOCK, "left_semi")
        rows = again.select("word", "n", F.explode(_halves(F.col("short"), F.col("s"), F.col("a"), F.col("b"))).alias("m")).select("word", "n", "m.*")


def near_in_region(codes: np.ndarray, short: np.ndarray, block: np.ndarray, s: int, a: int, b: int):
    """Pairs ``(q, v)`` of rows of one block, q short, that are one error apart with the first difference in the region (a, b].

    ``codes`` are letters (small numbers, 0 behind the end) at positions 0 to s; ``block`` numbers the blocks of the rows, in ascending order.
    Pairs of two short words come in both directions.
    """
    asked = np.flatnonzero(short)
    for q0 in range(0, len(asked), QUERIES):
        q = asked[q0:q0 + QUERIES]
        for v0 in range(np.searchsorted(block, block[q[0]]), np.searchsorted(block, block[q[-1]], "right"), SLAB):
            v = slice(v0, min(v0 + SLAB, np.searchsorted(block, block[q[-1]], "right")))
            yield from _run_queries(codes, short, block, q, v, s, a, b)


def _packed(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    width = -(-flags.shape[1] // 64) * 64
    if width != flags.shape[1]:
        flags = np.pad(flags, ((0, 0), (0, width - flags.shape[1])))
    return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)


def _run_queries(codes, short, block, q, v, s, a, b):
    letters = {}

    def having(position: int, of: int) -> np.ndarray:
        """Bit sets, one for each short word: words with its letter ``of`` at ``position``."""
        if position not in letters:
            present, at = np.unique(codes[q[:, None], [position - 1, position] if position else [position]], return_inverse=True)
            if len(letters) > 2:
                letters.clear()
            letters[position] = present, _packed(present[:, None] == codes[v, position][None, :])
        present, sets = letters[position]
        return sets[np.searchsorted(present, codes[q, of])]

    is_short, is_long = _packed(short[None, v]), _packed(~short[None, v])
    zero = _packed(block[q][:, None] == block[v][None, :])  # no error in the letters before the region
    replaced = np.zeros_like(zero)
    inserted = zero & is_long  # a letter inserted before the next one
    for i in range(a, b):
        same = having(i, i)
        replaced = (replaced & same) | zero
        following = zero & same
        inserted &= having(i + 1, i)
        zero = following
        if i + 1 < b:
            inserted |= zero & is_long
        replaced &= ~zero
    inserted = (inserted | (zero & is_long)) if b == s else (inserted & ~zero)
    for found in (replaced & is_short, inserted & is_long):
        row, word = np.nonzero(found)
        bits = found[row, word]
        while len(row):
            low = bits & (~bits + np.uint64(1))
            yield q[row], v.start + word * 64 + np.bitwise_count(low - np.uint64(1)).astype(np.int64)
            bits = bits ^ low
            more = bits != 0
            row, word, bits = row[more], word[more], bits[more]


NEAR = "word string, n_near long, form_n long, form string"


def near_words(members: DataFrame) -> DataFrame:
    """``word, n_near, form_n, form``: number of near words and the largest of them (ties: the smallest), for words that have any."""
    schema = arrow_schema(NEAR)

    def solve(words: np.ndarray, counts: np.ndarray, short: np.ndarray, block: np.ndarray, s: int, a: int, b: int):
        text = np.char.encode(words.astype(f"U{s + 1}"), "latin-1")
        codes = np.frombuffer(text.astype(f"S{s + 1}").tobytes(), np.uint8).reshape(len(words), s + 1)
        n_near = np.zeros(len(words), np.int64)
        best, best_n = np.full(len(words), -1), np.zeros(len(words), np.int64)
        rank = np.empty(len(words), np.int64)  # letters are Latin-1, whose order of bytes is that of code points
        rank[np.argsort(text, kind="stable")] = np.arange(len(words))
        for x, y in near_in_region(codes, short, block, s, a, b):
            longer = ~short[y]
            x, y = np.concatenate((x, y[longer])), np.concatenate((y, x[longer]))
            np.add.at(n_near, x, 1)
            order = np.lexsort((rank[y], -counts[y], x))
            first = order[np.flatnonzero(np.diff(x[order], prepend=-1))]
            x, y = x[first], y[first]
            better = (counts[y] > best_n[x]) | ((counts[y] == best_n[x]) & (best[x] >= 0) & (rank[y] < rank[best[x]]))
            best[x[better]], best_n[x[better]] = y[better], counts[y[better]]
        some = np.flatnonzero(n_near)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(words[some], pa.string()), pa.array(n_near[some]), pa.array(best_n[some]),
                                              pa.array(words[best[some]], pa.string())], schema=schema)

    def run(batches):
        waiting: list[tuple] = []  # rows of the open pack
        place = None

        def close():
            if any(r[2] for r in waiting) and len(waiting) > 1:
                number, numbers, before = -1, [], None
                for r in waiting:
                    if r[3] != before:
                        number, before = number + 1, r[3]
                    numbers.append(number)
                words = np.array([r[0] for r in waiting], object)
                yield from solve(words, np.array([r[1] for r in waiting], np.int64), np.array([r[2] for r in waiting], bool), np.array(numbers), *place)
            waiting.clear()

        for batch in batches:
            for word, n, s, a, b, short, head, tail in zip(*(c.to_pylist() for c in batch.columns)):
                block = (head, tail)
                if place != (s, a, b) or (len(waiting) >= min(PACK, max(64, PACK_LETTERS // s)) and waiting[-1][3] != block):
                    yield from close()
                    place = (s, a, b)
                waiting.append((word, n, short, block))
        yield from close()

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (members.select("word", "n", "s", "a", "b", "short", "head", "tail").repartition(parts, *BLOCK)
             .sortWithinPartitions("s", "a", "b", "head", "tail"))
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), "form"))
    return (dealt.mapInArrow(run, NEAR).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("word", "n_near", (-F.col("best.minus")).alias("form_n"), F.col("best.form").alias("form")))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a form (columns ``word, form``): the end of the chain, by pointer doubling."""
    links = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = links.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        before, after = links, materialize(longer, "spelling-roots")
        more = not after.where("moved").isEmpty()
        discard(before)
        links = after.select("word", "root")
        if not more:
            return links


def variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2, every: int = 97, hot: int = HOT) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    words = materialize(count_words(docs, least_length, least_count, every), "spelling-words")
    near = near_words(blocks(words, least_length, hot))
    known = words.join(near, "word", "left")
    large = F.col("form_n") >= ratio * F.col("n")
    held = materialize(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(large, F.col("form")).alias("form"),
                                    F.when(large, F.col("form_n")).alias("form_n")), "spelling-forms")
    ends = roots(held.where("form IS NOT NULL"))
    return held.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
