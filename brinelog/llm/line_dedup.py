"""Line deduplication by winnowing.

A run of lines with at least ``min_words`` words that stood earlier, in this document or one before it (order of ``doc_id``, then
line), is deleted from every later place. Lines are compared without white space at their ends.

1. A gram is the shortest run of lines from a line on with at least ``gram_words`` words; a window the shortest with at least ``min_words``.
   Of the grams inside each window the one of the smallest hash is its fingerprint, so two equal runs of ``min_words`` words have
   a fingerprint in common, wherever they stand.
2. Fingerprints are counted over all documents; only windows of those that occur twice go on.
3. A match is extended both ways by whole windows: besides the window that starts at a line there is the one that ends at it, and a line is
   in an equal run of ``min_words`` words exactly if one of the windows over it is equal. The first place of each window stays,
   the lines of all later ones are deleted.

Counts and first places are aggregated before the shuffle and joined back, so that Spark splits a hot passage; positions are never
paired with one another.

Defined results: a null text stays null; an empty text stays; the order of documents with a null ``doc_id`` is before all others; rows equal
in ``doc_id`` and text count as one document and stay alike; a line that repeats itself keeps its first place; other columns
pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinelog.llm.common import arrow_schema, materialize, nothing_kept

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
WINDOWS = "anchor long, doc_id long, text_key long, windows binary"
_WINDOW = np.dtype([("hash", "<i8"), ("start", "<i4"), ("end", "<i4")])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Lines:
    """Lines of many texts in one row: hashes, words, and the runs that grams and windows span."""

    def __init__(self, texts: list[str], min_words: int, gram_words: int):
        lines, counts = [], []
        for t in texts:
            own = t.split("\n")
            counts.append(len(own))
            lines += own
        n = len(lines)
        self.counts = np.array(counts, np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(x.strip()) for x in lines), np.uint64, n)
        self.words = np.concatenate(([0], np.cumsum(np.fromiter((len(x.split()) for x in lines), np.int64, n))))
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * _powers(_P, n), dtype=np.uint64)))
        self.back = _powers(_INVERSE, n + 1)
        self.n, limit, start = n, self.first[self.doc + 1], self.first[self.doc]
        at = np.arange(n)
        self.gram_end = np.searchsorted(self.words, self.words[:-1] + gram_words)
        self.end = np.searchsorted(self.words, self.words[:-1] + min_words)  # window [i, end)
        self.has_gram, self.has_end = self.gram_end <= limit, self.end <= limit
        self.begin = np.searchsorted(self.words, self.words[1:] - min_words, side="right") - 1  # window [begin, i + 1)
        self.has_begin = (self.words[1:] - min_words >= self.words[start]) & (self.begin >= start)
        self.begin = np.minimum(self.begin, at)
        gram = np.where(self.has_gram, self._mix(self.run_hash(at, np.minimum(self.gram_end, n))), np.uint64(2**64 - 1))
        self.anchor, self.anchor_at = self._smallest(gram)

    @staticmethod
    def _mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def run_hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the lines [a, b), the same wherever they stand."""
        return (self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)

    def _smallest(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest gram hash inside the window from each line, and its line: grams that start in it and end in it."""
        out, place = gram.copy(), np.arange(self.n)
        last = np.where(self.has_end, self.end, 0)
        step, todo = 1, np.flatnonzero(self.has_end)
        while len(todo):
            todo = todo[todo + step < last[todo]]
            todo = todo[self.gram_end[todo + step] <= last[todo]]
            less = todo[gram[todo + step] < out[todo]]
            out[less], place[less] = gram[less + step], less + step
            step += 1
        return out, place

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and fingerprints of all windows, from and up to each line, every one once."""
        a = np.flatnonzero(self.has_end)
        z = np.flatnonzero(self.has_begin)
        spans = np.concatenate([a * (self.n + 1) + self.end[a], self.begin[z] * (self.n + 1) + z + 1])
        spans = np.unique(spans)
        start, end = spans // (self.n + 1), spans % (self.n + 1)
        return start, end, self.anchor[start]


def _rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").where("text IS NOT NULL")


def fingerprints(docs: DataFrame, min_words: int, gram_words: int) -> DataFrame:
    """``anchor``: fingerprints of every document, each once per place."""
    def run(batches):
        nothing_kept()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                lines = Lines(batch.column(0).slice(i, 500).to_pylist(), min_words, gram_words)
                a = np.flatnonzero(lines.has_end)
                a = a[np.unique(lines.anchor_at[a], return_index=True)[1]]  # windows that share a gram give it once
                yield pa.RecordBatch.from_arrays([pa.array(lines.anchor[a].view(np.int64))], names=["anchor"])

    return docs.select("text").where("text IS NOT NULL").mapInArrow(run, "anchor long")


def windows(docs: DataFrame, min_words: int, gram_words: int) -> DataFrame:
    """Windows of every document by fingerprint, packed: hash, first line, end."""
    def run(batches):
        nothing_kept()
        schema = arrow_schema(WINDOWS)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                lines = Lines(part.column(2).to_pylist(), min_words, gram_words)
                start, end, anchor = lines.windows()
                if not len(start):
                    continue
                doc = lines.doc[start]
                packed = np.empty(len(start), _WINDOW)
                packed["hash"] = lines.run_hash(start, end).view(np.int64)
                packed["start"], packed["end"] = start - lines.first[doc], end - lines.first[doc]
                order = np.lexsort((anchor, doc))
                doc, anchor, raw = doc[order], anchor[order], packed[order].tobytes()
                edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]))))
                bounds = np.concatenate([edge, [len(doc)]]).astype(np.int64) * _WINDOW.itemsize
                values = pa.BinaryArray.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw)])
                rows = pa.array(doc[edge])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[edge].view(np.int64)), part.column(0).take(rows), part.column(1).take(rows), values], schema=schema)

    return _rows_of(docs).mapInArrow(run, WINDOWS)


def _unpack(batches):
    nothing_kept()
    schema = arrow_schema("anchor long, doc_id long, text_key long, hash long, start int, end int")
    for batch in batches:
        sizes = np.array([len(x) for x in batch.column(3).to_pylist()], np.int64) // _WINDOW.itemsize
        raw = np.frombuffer(b"".join(batch.column(3).to_pylist()), _WINDOW)
        rows = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(3)),
                                          *(pa.array(np.ascontiguousarray(raw[k])) for k in ("hash", "start", "end"))], schema=schema)


def repeated(docs: DataFrame, min_words: int = 50, gram_words: int = 20) -> DataFrame:
    """``doc_id, text_key, start, end``: lines [start, end) of a document that repeat an earlier place."""
    shared = fingerprints(docs, min_words, gram_words).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    found = materialize(windows(docs, min_words, gram_words).join(shared, "anchor", "left_semi")
                        .mapInArrow(_unpack, "anchor long, doc_id long, text_key long, hash long, start int, end int"), "windows")
    place = F.struct("doc_id", "text_key", "start")
    first = found.groupBy("anchor", "hash").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # windows that stand only once need no second look
    first = first.where("first < last").select("anchor", "hash", "first")
    return (found.join(first, ["anchor", "hash"]).where(F.col("first") < place)
            .select("doc_id", "text_key", "start", "end"))


def dedup(docs: DataFrame, min_words: int = 50, gram_words: int = 20) -> DataFrame:
    """``docs`` with the later places of repeated runs of lines deleted from ``text``; ``n_chars``, where there is one, follows."""
    return _apply(docs, min_words, gram_words).drop("_llm_lines", "_llm_deleted")


def _apply(docs: DataFrame, min_words: int, gram_words: int) -> DataFrame:
    gone = (repeated(docs, min_words, gram_words).groupBy("doc_id", "text_key")
            .agg(F.collect_set(F.struct("start", "end")).alias("_llm_gone"))
            .select(F.col("doc_id").alias("_llm_id"), F.col("text_key").alias("_llm_key"), "_llm_gone"))
    keyed = docs.withColumn("_llm_text_key", F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_llm_id")) & (F.col("_llm_text_key") == F.col("_llm_key"))
    joined = keyed.join(gone, same, "left").select(*docs.columns, F.col("_llm_gone.start").alias("_llm_starts"), F.col("_llm_gone.end").alias("_llm_ends"))
    at = docs.columns.index("text")
    size_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    out = docs.withColumns({"_llm_lines": F.lit(0).cast("long"), "_llm_deleted": F.lit(0).cast("long")}).schema

    def run(batches):
        nothing_kept()
        schema = None
        for batch in batches:
            texts = batch.column(at).to_pylist()
            n_lines, n_deleted, changed = [], [], False
            for i, (text, starts, ends) in enumerate(zip(texts, batch.column("_llm_starts").to_pylist(), batch.column("_llm_ends").to_pylist())):
                own = text.split("\n") if text is not None else []
                n_lines.append(len(own))
                drop: set[int] = set()
                for a, b in zip(starts or (), ends or ()):
                    drop.update(range(a, b))
                n_deleted.append(len(drop))
                if drop:
                    changed = True
                    texts[i] = "\n".join(x for k, x in enumerate(own) if k not in drop)
            columns = list(batch.columns[:-2])
            if changed:
                columns[at] = pa.array(texts, pa.string())
                if size_at is not None:
                    columns[size_at] = pa.array([s if not d else len(t) for s, d, t in zip(columns[size_at].to_pylist(), n_deleted, texts)],
                                                columns[size_at].type)
            schema = schema or [*batch.schema.names[:-2], "_llm_lines", "_llm_deleted"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_deleted, pa.int64())], names=schema)

    return joined.mapInArrow(run, out)


REPORT = "doc_id long, n_lines long, n_deleted long, kept_chars long, kept_sha256 string"


def report(docs: DataFrame, min_words: int = 50, gram_words: int = 20) -> DataFrame:
    """Per document: its lines, the deleted ones, and length and hash of the text that is left (null: empty)."""
    def run(batches):
        nothing_kept()
        schema = arrow_schema(REPORT)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), batch.column(3), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])], schema=schema)

    applied = _apply(docs.select(F.col("doc_id").cast("long"), "text"), min_words, gram_words)
    return applied.select("doc_id", "text", "_llm_lines", "_llm_deleted").mapInArrow(run, REPORT)
