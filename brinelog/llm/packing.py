"""Packing of documents into token sequences along a space-filling curve.

1. Every text becomes token ids (tokenizers library, closed by an end id) and a vector: counts of hashed ids, as square roots with signs, of length 1,
   projected to ``DIMENSIONS`` coordinates by a fixed random matrix.
2. Coordinates are put on a grid by their mean and deviation over all documents; a document's place on the Hilbert curve through the grid is its key,
   so documents with similar words are neighbours along the curve.
3. Documents are sorted by key in ranges of about equal tokens. The splitters are quantiles of a sample drawn by size, of at most a few thousand rows; equal keys
   are parted by a hash of the row, so a group of copies fills several ranges.
4. The totals of the ranges (one row each) give every range its first position. A task then writes its documents one behind the other and cuts at the
   ends of sequences. All sequences but the last few are full; what is left over at the end of all fills sequences whose lengths are powers of two, which need no
   padding.

Texts are read once, ids are written once and shuffled once. A worker keeps the ids of words it has met (bounded, two generations).

Defined results: a null or empty text is the end id alone; its vector is zero; repeated rows and null ids are documents like others; equal texts lie together
on the curve, in an order given by a hash of their rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinelog.llm.common import arrow_schema, kept, materialize

DIMENSIONS, BITS = 4, 15  # 60 bits of key
BUCKETS = 4096
SAMPLES_PER_RANGE = 32
TOKENS_PER_RANGE = 1 << 24
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
_WORD = re.compile(r"[a-zß-öø-ÿ]+")


class WordEncoder:
    """Ids of texts by a file of the tokenizers library whose words never reach across white space and whose letters are lower-cased.

    Texts are lower-cased in A-Z and parted at ASCII white space; texts with ``<|`` are encoded whole, as special tokens are told by case. Parts
    of letters with marks behind them are learned as word and marks, many words in one call without the steps that do not change them, cut behind the
    tokens that end a word; other parts are encoded whole.
    """

    def __init__(self, path: str, special: bool = True, cached: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for every core
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.bare.normalizer = None
        self.parted = pre_tokenizers.WhitespaceSplit()  # enough for ASCII letters, which are their own byte symbols
        self.bytewise = pre_tokenizers.Sequence([self.parted, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.cached, self.new, self.old = cached, {}, {}

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers of ``dtype``. Texts are learned from together: give a megabyte or so at once."""
        parts = [None if "<|" in t else t.encode().translate(_LOWER).split() for t in texts]
        ids = [None if own is None else list(map(self.new.get, own)) for own in parts]
        gaps = [(own, got, [i for i, g in enumerate(got) if g is None]) for own, got in zip(parts, ids) if got and None in got]
        self._learn({own[i] for own, _, at in gaps for i in at})
        for own, got, at in gaps:
            for i in at:
                got[i] = self.new[own[i]]
        out = [self.plain([t])[0] if got is None else b"".join(got) for t, got in zip(texts, ids)]
        if len(self.new) > self.cached:
            self.old, self.new = self.new, {}
        return out

    def _new(self, parts: Iterable[bytes]) -> list[bytes]:
        """Those of ``parts``, not known lately, without ids; what the older generation knows is taken over."""
        left, known, older = [], self.new, self.old.get
        for part in parts:
            ids = older(part)
            if ids is None:
                left.append(part)
            else:
                known[part] = ids
        return left

    def _learn(self, missing: set[bytes]) -> None:
        known, ascii, other, split, whole = self.new, [], [], [], []
        halves = set()
        for part in self._new(missing):
            if part.isalpha():  # ASCII letters only, by far the most
                ascii.append(part)
                continue
            word = part.rstrip(_MARKS)
            if word.isalpha() or _WORD.fullmatch(word.decode()):
                if len(word) < len(part):
                    marks = part[len(word):]
                    split.append((part, word, marks))
                    halves.add(word)
                    halves.add(marks)
                else:
                    other.append(part)
            else:
                whole.append(part)
        halves.difference_update(ascii, other)
        other += self._new([x for x in halves if x not in known])
        self._learn_words(ascii, self.parted)
        self._learn_words(other, self.bytewise)
        known.update((part, known[word] + known[marks]) for part, word, marks in split)
        if whole:
            known.update(zip(whole, self.plain([p.decode() for p in whole])))

    def _learn_words(self, words: list[bytes], parting) -> None:
        if words:
            self.bare.pre_tokenizer = parting
            ids = np.array(self.bare.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, self.dtype)
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) == len(words):
                raw, width = ids.tobytes(), self.dtype.itemsize
                self.new.update((w, raw[a * width:b * width]) for w, a, b in zip(words, [0, *ends], ends))
            else:
                self.new.update(zip(words, self.plain([w.decode() for w in words])))


def in_groups(texts: list[str], size: int = 1 << 20):
    """Ranges of texts of about ``size`` characters."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= size or i + 1 == len(texts):
            yield slice(start, i + 1)
            start, held = i + 1, 0


def encoder_of(path: str, special: bool) -> WordEncoder:
    """One encoder for a Python worker and file."""
    return kept(("packing", path, special), lambda: WordEncoder(path, special))


class Projection:
    """Coordinates of a document from its ids; the same in every task."""

    def __init__(self, ids: int):
        mixed = np.arange(ids, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        self.bucket = (mixed >> np.uint64(52)).astype(np.int64) % BUCKETS
        self.matrix = np.random.default_rng(42).standard_normal((BUCKETS, DIMENSIONS))

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        counts = np.sqrt(np.bincount(self.bucket[ids], minlength=BUCKETS))
        length = math.sqrt(float(counts @ counts))
        return counts @ self.matrix / length if length else np.zeros(DIMENSIONS)


def hilbert_key(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits`` bits in each of their coordinates (columns)."""
    x = grid.astype(np.int64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of each level, highest first
        low = q - 1
        for axis in x:
            turned = (axis & q) != 0
            swap = np.where(turned, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(turned, low, swap)
            axis ^= swap
        q >>= 1
    for i in range(1, len(x)):  # Gray code
        x[i] ^= x[i - 1]
    carry, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        carry ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= carry
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | ((axis >> bit) & 1)
    return key


COORDINATES = [f"x{i}" for i in range(DIMENSIONS)]
ENCODED = "doc_id long, ids binary, n long, " + ", ".join(f"{c} double" for c in COORDINATES)


def encode(docs: DataFrame, tokenizer: str, end_id: int, special: bool = True) -> DataFrame:
    """``doc_id, ids, n`` and coordinates of every document, written; ``row`` tells repeated rows apart."""
    schema = arrow_schema(ENCODED)

    def run(batches):
        encoder = encoder_of(tokenizer, special)
        project = Projection(len(encoder.ends))
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                texts = [t or "" for t in texts]
                raw = [r for own in in_groups(texts) for r in encoder.encode(texts[own])]
                places = np.array([project(np.frombuffer(r, encoder.dtype)) for r in raw])
                raw = [r + end for r in raw]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array([len(r) // encoder.dtype.itemsize for r in raw], pa.int64()),
                     *(pa.array(c) for c in places.T)], schema=schema)

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED)
    return materialize(out.withColumn("row", F.monotonically_increasing_id()), "packing-ids")


def along_curve(rows: DataFrame) -> DataFrame:
    """``rows`` with ``key``, the place on the curve, and ``tie``, a hash of the row."""
    facts = rows.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in COORDINATES for f in (F.avg, F.stddev_pop)]).first().asDict()
    mean = np.array([facts[f"avg_{c}"] or 0.0 for c in COORDINATES])
    deviation = np.array([facts[f"stddev_pop_{c}"] or 1.0 for c in COORDINATES])

    @F.pandas_udf("long")
    def key(x0: pd.Series, x1: pd.Series, x2: pd.Series, x3: pd.Series) -> pd.Series:
        z = (np.stack([x0, x1, x2, x3], axis=1) - mean) / deviation
        share = 1 / (1 + np.exp(-np.clip(1.702 * z, -30, 30)))  # close to the normal distribution function
        return pd.Series(hilbert_key(np.minimum(share * (1 << BITS), (1 << BITS) - 1).astype(np.int64), BITS))

    return rows.withColumns({"key": key(*COORDINATES), "tie": F.xxhash64("doc_id", "row")})


def splitters(rows: DataFrame, total: int, ranges: int) -> list[tuple[int, int]]:
    """Bounds ``(key, tie)`` of ranges of about equal tokens, from a sample drawn by size of about ``SAMPLES_PER_RANGE * ranges`` rows."""
    chance = F.col("n") * F.lit(SAMPLES_PER_RANGE * ranges / total)
    draw = F.pmod(F.xxhash64(F.lit("splitter"), "tie"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = sorted(map(tuple, rows.where(draw < chance).select("key", "tie", F.greatest(F.lit(1.0), chance)).collect()))
    ends = np.cumsum([w for _, _, w in drawn])
    at = np.searchsorted(ends, ends[-1] * np.arange(1, ranges) / ranges) if len(drawn) else []
    return sorted({drawn[i][:2] for i in np.minimum(at, len(drawn) - 1)})


def range_number(bounds: list[tuple[int, int]]):
    """Number of bounds at or below ``(key, tie)``."""
    keys, ties = (np.array([b[i] for b in bounds], np.int64) for i in (0, 1))

    @F.pandas_udf("int")
    def number(key: pd.Series, tie: pd.Series) -> pd.Series:
        own, second = key.to_numpy(), tie.to_numpy()
        low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        for first in np.unique(low[low < high]):  # keys that are bounds themselves
            rows = (low == first) & (low < high)
            stop = np.searchsorted(keys, keys[first], "right")
            low[rows] = first + np.searchsorted(ties[first:stop], second[rows], "right")
        return pd.Series(low.astype(np.int32))

    return number


class Layout:
    """Where a position of the whole stream lies: full sequences, then one for each power of two in what is left over."""

    def __init__(self, total: int, length: int):
        self.length, self.full = length, total // length
        rest, self.tail = total % length, []  # first position and number of each sequence of the tail
        at = self.full * length
        for n, bit in enumerate(b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1):
            self.tail.append((at, self.full + n, 1 << bit))
            at += 1 << bit

    def place(self, position: int) -> tuple[int, int, int]:
        """Sequence, offset in it, and ids that still fit."""
        sequence, offset = divmod(position, self.length)
        if sequence < self.full:
            return sequence, offset, self.length - offset
        first, number, size = next(t for t in reversed(self.tail) if t[0] <= position)
        return number, position - first, size - (position - first)


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, ranges: int | None = None, special: bool = True) -> DataFrame:
    """Pieces of all documents: ``doc_id``, ``start`` in its document, ``length``, ``ids`` (little-endian unsigned 32-bit integers), ``doc_tokens``, and the place:
    ``sequence_id``, ``offset``. Sequences shorter than ``length`` have a power of two of ids. ``special``: strings of special tokens in a text are these tokens.
    """
    spark = docs.sparkSession
    rows = encode(docs, tokenizer, end_id, special)
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TOKENS_PER_RANGE)
    placed = along_curve(rows)
    number = range_number(splitters(placed, total, ranges) if total else [])
    placed = placed.withColumn("range", number("key", "tie"))
    starts, at = {}, 0
    for r in placed.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect():  # one row per range
        starts[r.range], at = at, at + r.n
    layout, schema = Layout(total, length), arrow_schema(PIECES)

    def run(batches):
        here, position = None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                for part, doc, raw, n in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    if part != here:
                        here, position = part, starts[part]
                    ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4").tobytes()
                    start = 0
                    while start < n:
                        sequence, offset, room = layout.place(position)
                        take = min(room, n - start)
                        out.append((doc, start, take, ids[4 * start:4 * (start + take)], n, sequence, offset))
                        start, position = start + take, position + take
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    ordered = (placed.select("range", "doc_id", "ids", "n", "key", "tie").repartitionById(max(1, len(starts)), "range")
               .sortWithinPartitions("range", "key", "tie").select("range", "doc_id", "ids", "n"))
    return ordered.mapInArrow(run, PIECES)


def report(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
