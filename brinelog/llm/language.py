"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts counts the byte n-grams (n from ``ORDERS``, lower case) that occur in both, however
often, over the root of the product of their own counts. Nyström landmarks stand for all training texts: a text is described by its kernel
values with the landmarks, and one ridge regression per language (one versus rest) is solved on them. As the kernel is a product of
presence vectors, landmarks and regressions fold into one matrix with a column per language, and a batch of texts is scored by one
product of its presence matrix with it.

The model is fitted on a bounded sample of labelled rows: about ``per_language`` per label, drawn by a hash of the row, of texts of at most
``max_chars`` characters. Predictions read whole texts. N-grams are held in a table of ``SLOTS`` slots by their hash.

Defined results: ``und`` with score 0 for a null text, a text without letters, or when nothing could be learned; a null ``doc_id`` is never
a training row and not held out; ties go to the label that sorts first; other columns pass through or are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelog.llm.common import arrow_schema, nothing_kept

ORDERS = (2, 3, 4)
SLOTS = 1 << 18
_MIX = (0, 0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def slots(text: str) -> np.ndarray:
    """Table of the slots of a text's n-grams: true where present."""
    present = np.zeros(SLOTS, bool)
    codes = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint64)
    grams = codes
    for n in range(2, max(ORDERS) + 1):
        if len(grams) < 2:
            break
        grams = (grams[:-1] << np.uint64(8)) | codes[n - 1:]
        if n in ORDERS:
            present[((grams * np.uint64(_MIX[n])) >> np.uint64(64 - 18)).view(np.int64)] = True
    return present


@dataclass
class Model:
    labels: list[str]
    columns: np.ndarray  # slots that occur in a landmark
    weights: np.ndarray  # slot by label

    def scores(self, texts: list[str]) -> np.ndarray:
        """One row per text, one column per label."""
        out = np.zeros((len(texts), len(self.labels)), np.float32)
        for i in range(0, len(texts), 256):
            part = texts[i:i + 256]
            shared = np.zeros((len(part), len(self.columns)), np.float32)
            own = np.ones(len(part), np.float32)
            for k, text in enumerate(part):
                present = slots(text)
                shared[k] = present[self.columns]
                own[k] = max(1, np.count_nonzero(present))
            out[i:i + len(part)] = (shared @ self.weights) / np.sqrt(own)[:, None]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, scores = ["und"] * len(texts), [0.0] * len(texts)
        told = [i for i, t in enumerate(texts) if self.labels and t and any(c.isalpha() for c in t)]
        if told:
            values = self.scores([texts[i] for i in told])
            odds = np.exp(4 * (values - values.max(1, keepdims=True)))
            best = values.argmax(1)
            sure = odds[np.arange(len(told)), best] / odds.sum(1)
            for i, b, s in zip(told, best.tolist(), sure.tolist()):
                labels[i], scores[i] = self.labels[b], min(1.0, float(s))
        return labels, scores


def solve(texts: list[str], labels: list[str], landmarks: int = 160, ridge: float = 1e-3) -> Model:
    """Nyström kernel ridge regression, one versus rest. The first texts of each label, in turn, are the landmarks."""
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    by_label = {n: [i for i, x in enumerate(labels) if x == n] for n in names}
    chosen = [i for k in range(max(map(len, by_label.values()))) for n in names for i in by_label[n][k:k + 1]][:landmarks]
    marks = np.stack([slots(texts[i]) for i in chosen])
    columns = np.flatnonzero(marks.any(0))
    marks_own = np.maximum(1, marks.sum(1)).astype(np.float64)
    folded = (marks[:, columns] / np.sqrt(marks_own)[:, None]).astype(np.float32).T  # slot by landmark
    shared, own = np.empty((len(texts), len(columns)), np.float32), np.empty(len(texts))
    for i, text in enumerate(texts):
        present = slots(text)
        shared[i], own[i] = present[columns], max(1, np.count_nonzero(present))
    kernel = (shared @ folded).astype(np.float64) / np.sqrt(own)[:, None]
    among = kernel[chosen]
    target = np.array([[1.0 if x == n else -1.0 for n in names] for x in labels])
    weight = np.array([1 / len(by_label[x]) for x in labels])[:, None] * len(texts) / len(names)  # labels count alike
    left = kernel.T @ (weight * kernel) + ridge * len(texts) * among + 1e-8 * len(texts) * np.eye(len(chosen))
    alpha = np.linalg.solve(left, kernel.T @ (weight * target))
    return Model(names, columns, (folded @ alpha).astype(np.float32))


def held_out(doc_id: Column) -> Column:
    """True for the rows that are never learned from: checksum of the id, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = 400, max_chars: int = 20_000, landmarks: int = 160) -> Model:
    """Model from a bounded sample of the rows of ``docs`` that have a label and are not held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per label
    if not counts:
        return solve([], [])
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chance = F.coalesce(*[F.when(F.col("lang") == k, F.lit(2 * per_language / n)) for k, n in sorted(counts.items())])
    sample = (rows.where((F.char_length("text") <= max_chars) & F.rlike(F.col("text"), F.lit(r"\p{L}")) & (draw < chance))
              .select("lang", "text", draw.alias("draw")).orderBy("draw", "text").limit(3 * per_language * len(counts)).collect())
    kept: dict[str, list[str]] = {}
    for r in sample:
        if len(kept.setdefault(r.lang, [])) < per_language:
            kept[r.lang].append(r.text)
    pairs = [(t, k) for k in sorted(kept) for t in kept[k]]
    return solve([t for t, _ in pairs], [k for _, k in pairs], landmarks)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    ddl = "doc_id long, held_out boolean, lang_pred string, score double"
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        nothing_kept()
        schema = arrow_schema(ddl)
        for batch in batches:
            labels, scores = held.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(labels, pa.string()), pa.array(scores)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, ddl)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the documents whose language is undetermined (no text, or no letter in it), also when nothing was learned."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        nothing_kept()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            labels = held.value.predict(texts)[0] if held.value.labels else ["und" if not any(map(str.isalpha, t or "")) else "" for t in texts]
            yield batch.filter(pa.array([x != "und" for x in labels], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
