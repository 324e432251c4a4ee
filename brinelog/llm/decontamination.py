"""Benchmark decontamination by a broadcast set of test n-grams.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. The windows of an item are its runs of ``window`` words; an
item of fewer words is one window. Each task numbers the words of a document by the vocabulary of the windows, looks at runs of known words
only, compares rolling hashes with the sorted hashes of the windows and verifies every hit word by word.

The windows are broadcast in blocks of at most ``BLOCK_BYTES`` bytes of items, whose size is measured first; with more blocks, the
documents are scanned once per block and the hits are carried along. Items and documents are never joined.

Defined results: a null or empty text has no words and is clean; items without words hit nothing; a repeated item is one item; with an
empty benchmark all documents are clean; an empty table gives no rows; other columns pass through. Items without an id hit nothing unless
``nameless``: then their windows count as those of one item, which hits words and is counted, but is not in the list of ids.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinelog.llm.common import arrow_schema, materialize, nothing_kept, texts_of

BLOCK_BYTES = 32 << 20
_FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
_FACTOR = 0x9E3779B97F4A7C15


def words(text: str) -> list[bytes]:
    """Words of a text: everything that is not a digit, a letter a-z or beyond ASCII parts them."""
    return text.encode().translate(_FOLD).split()


class Windows:
    """Windows of a block of items: the items' words as numbers, and per window length sorted hashes with place and item of each.

    24 bytes a word of the items and the vocabulary, whatever the items have in common.
    """

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [item for item, _ in items]  # null: without an id
        number, parts, starts = self.vocabulary.setdefault, [np.zeros(0, np.uint32)], 0
        by_length: dict[int, list[tuple[int, int, int]]] = {}  # first window, number of windows, item
        for k, (_, text) in enumerate(items):
            ids = np.array([number(w, len(self.vocabulary) + 1) for w in words(text)], np.uint32)
            if length := min(window, len(ids)):
                by_length.setdefault(length, []).append((starts, len(ids) - length + 1, k))
            parts.append(ids)
            starts += len(ids)
        self.words = np.concatenate(parts)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, runs in by_length.items():
            at = np.concatenate([np.arange(a, a + m) for a, m, _ in runs])
            item = np.repeat(np.array([k for *_, k in runs], np.int32), [m for _, m, _ in runs])
            h = self.rolled(self.words, at, n)
            order = np.argsort(h, kind="stable")
            self.tables[n] = h[order], at[order], item[order]

    @staticmethod
    def rolled(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the ``n`` numbers from each place."""
        out = np.zeros(len(at), np.uint64)
        for j in range(n):
            out = out * np.uint64(_FACTOR) + ids[at + j]
        return out ^ (out >> np.uint64(29))

    def _held(self, n: int, window: np.ndarray, first: int, end: int) -> set[str]:
        """Items that hold the window, among the places of its hash."""
        _, at, item = self.tables[n]
        return {self.names[item[k]] for k in range(first, end) if np.array_equal(self.words[at[k]:at[k] + n], window)}

    def hits(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit windows as (first word, end), items."""
        ws = words(text)
        ids = np.array(list(map(self.vocabulary.get, ws, repeat(0))), np.uint32)
        spans, found = [], set()
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for n, (known, _, _) in self.tables.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(unknown[n:] == unknown[:-n])
            h = self.rolled(ids, at, n)
            first, end = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
            met: dict[bytes, bool] = {}  # windows of this text
            for i, a, b in zip(*(x[first < end].tolist() for x in (at, first, end))):
                key = ids[i:i + n].tobytes()
                if key not in met:
                    held = self._held(n, ids[i:i + n], a, b)
                    found |= held
                    met[key] = bool(held)
                if met[key]:
                    spans.append((i, i + n))
        return len(ws), spans, found


def _by_name(item: tuple) -> tuple:
    return tuple((part is not None, part or "") for part in item)


def blocks(benchmark: DataFrame, window: int, block_bytes: int = BLOCK_BYTES, nameless: bool = False):
    """Window tables of the benchmark, each from items of about ``block_bytes`` bytes; without an id only if ``nameless``."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    rows = benchmark.select(F.col("item_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    if not nameless:
        rows = rows.where("item_id IS NOT NULL")
    for i in range(n):  # items without an id are many, so the text takes part
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", F.when(F.col("item_id").isNull(), F.col("text"))), F.lit(n)) == i)
        yield Windows(sorted(map(tuple, part.collect()), key=_by_name), window)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, nameless: bool = False) -> DataFrame:
    """``docs`` with ``_llm_words``, ``_llm_spans`` (first and end word of each hit window, in turn) and ``_llm_items`` (sorted strings,
    a null first if windows of ``nameless`` items occur)."""
    spark = docs.sparkSession
    out = docs.withColumns({"_llm_words": F.lit(0).cast("long"), "_llm_spans": F.array().cast("array<int>"),
                            "_llm_items": F.slice(F.array(F.lit(None).cast("string")), 1, 0)})
    schema = out.schema
    for n, block in enumerate(blocks(benchmark, window, block_bytes, nameless)):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held, columns=len(docs.columns)):
            nothing_kept()
            for batch in batches:
                table: Windows = held.value
                n_words, spans, items = [], [], []
                for text, old_spans, old_items in zip(texts_of(batch), batch.column("_llm_spans").to_pylist(), batch.column("_llm_items").to_pylist()):
                    k, s, found = table.hits(text)
                    n_words.append(k)
                    spans.append(old_spans + [x for span in s for x in span])
                    items.append(sorted(found.union(old_items), key=lambda x: (x is not None, x or "")))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:columns], pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())),
                     pa.array(items, pa.list_(pa.string()))], names=batch.schema.names)

        if n:
            out = materialize(out, "decontamination")
        out = out.mapInArrow(run, schema)
    return out


def _covered(n_words: int, spans: list[int]) -> np.ndarray:
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, spans[::2], 1)
    np.add.at(change, spans[1::2], -1)
    return np.cumsum(change[:-1]) > 0


REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def report(scanned: DataFrame) -> DataFrame:
    """One row per document: words, hit words, items and whether it is contaminated."""
    schema = arrow_schema(REPORT)

    def run(batches):
        nothing_kept()
        for batch in batches:
            ids, n_words, spans, items = (c.to_pylist() for c in batch.columns)
            hit = [int(_covered(n, s).sum()) if s else 0 for n, s in zip(n_words, spans)]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()),
                pa.array(map(len, items), pa.int64()),
                pa.array([hashlib.sha256(",".join(x for x in i if x is not None).encode()).hexdigest() for i in items]), pa.array([h > 0 for h in hit])], schema=schema)

    return scanned.select(F.col("doc_id").cast("long"), "_llm_words", "_llm_spans", "_llm_items").mapInArrow(run, REPORT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, remove: str = "documents",
                  block_bytes: int = BLOCK_BYTES, nameless: bool = False) -> DataFrame:
    """``docs`` without contaminated documents (``remove="documents"``) or without their hit words (``"spans"``).

    Removing spans takes the text from the first to the last byte of each run of hit words and leaves the rest as it is.
    """
    scanned = scan(docs, benchmark, window, block_bytes, nameless)
    if remove == "documents":
        return scanned.where(F.size("_llm_spans") == 0).select(*docs.columns)
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    at, schema = docs.columns.index("text"), docs.schema

    def cut(batches):
        nothing_kept()
        for batch in batches:
            texts = [t if t is None or not s else _without(t, n, s) for t, n, s in zip(
                batch.column(at).to_pylist(), batch.column("_llm_words").to_pylist(), batch.column("_llm_spans").to_pylist())]
            columns = batch.columns[:len(schema)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return scanned.mapInArrow(cut, schema)


def _without(text: str, n_words: int, spans: list[int]) -> str:
    raw = text.encode()
    hit = _covered(n_words, spans)
    letter = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], letter, [0]))))
    starts, ends = edge[::2], edge[1::2]
    keep = np.ones(len(raw), bool)
    runs = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0]))))
    for a, b in zip(runs[::2], runs[1::2]):
        keep[starts[a]:ends[b - 1]] = False
    return np.frombuffer(raw, np.uint8)[keep].tobytes().decode()
