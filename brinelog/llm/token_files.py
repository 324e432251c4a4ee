"""Token ids in Arrow files of equal-length sequences.

Documents are dealt in ranges of ``doc_id`` (ascending). Each task encodes its range, ends every document with the end id, packs the ids
end to end into sequences of ``length`` and writes two Arrow IPC files: ``<name>.arrow`` with ``input_ids`` (fixed-size list of
the smallest unsigned type that holds the vocabulary) and ``mask`` (fixed-size list of booleans, false where the last sequence is filled
up), and ``<name>.index.arrow`` with ``doc_id, start, n_tokens``. Batches are not compressed: a reader maps the file and sees any
sequence without a copy. A task writes under a name of its own and the manifest, a Parquet table committed by Spark, lists only the
files of tasks that succeeded, so a repeated task or a lost executor leaves no doubtful file in the set.

Texts are encoded by the tokenizers library. Words repeat, so texts are parted, a few megabytes at once, into pieces that the tokenizer's own
pattern parts as well: before single spaces, around line breaks, and between a letter or digit and an ASCII mark behind it. Only different pieces
that the encoder has not met lately go to the library, many in one call; the ids of the texts are then put together from those of the
pieces. Splitting, telling pieces apart and gathering are Arrow and numpy operations on whole columns. The tests compare with the plain call. Texts with
two white-space characters in a row are encoded whole. A Python worker keeps its encoder, pieces included, from task to task. A special token's
string in a text is that token, as in the plain call; with ``special=False`` it is ordinary text.

Defined results: a null or empty text is the end id alone; a null ``doc_id`` comes first, equal ids in order of their text; an empty
table writes no file and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinelog.llm.common import arrow_schema, kept, materialize
from brinelog.session import scratch_path

MANIFEST = "part int, path string, n_ids long, n_docs long"
GROUP = 1 << 22  # bytes of text parted at once
KEPT_BYTES = 64  # longer pieces are not kept
AT_ONCE = 1 << 14  # pieces given to the library in one call, which takes a few hundred bytes for each
# white space as Python tells it, twice in a row; what special tokens begin with
_WHOLE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]{2}|<\|"
_WORD = re.compile(rb" (?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_SPACE_INSIDE = re.compile(r"^[^\S ]|.\s|^ $", re.DOTALL)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are ASCII letters and digits, and which are ASCII marks."""
    alnum = np.array([b < 0x80 and chr(b).isalnum() for b in range(256)])
    return alnum, np.array([0x20 < b < 0x7F for b in range(256)]) & ~alnum


def _symbols() -> dict[int, str]:
    """The letter that byte-level BPE takes for each byte; a space is parted from what is before it."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    table = {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return table | {0x20: " " + table[0x20]}


class Encoder:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library (pattern of GPT-2, no normalizer)."""

    def __init__(self, path: str, special: bool = True, cached: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for every core
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # for words given in symbols of bytes
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.starts = np.zeros(size, bool)  # ids of tokens that begin with a space
        for token, i in self.tokenizer.get_vocab().items():
            self.starts[i] = token.startswith("Ġ")
        self.line = self.tokenizer.token_to_id("Ċ")
        self.alnum, self.marks = _kinds()
        self.symbols = _symbols()
        self.cached, self.new, self.old = cached, {}, {}

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned integers of ``dtype``."""
        return bytes(self.encode_all(pa.array([text], pa.string()))[0])

    def encode_all(self, texts: pa.Array, end: bytes = b"") -> tuple[pa.Buffer, np.ndarray]:
        """Ids of all texts (null as empty) one behind the other, ``end`` behind each, and the number of ids of each."""
        texts = texts.cast(pa.string()).fill_null("")
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
        bounds = bounds - bounds[0]
        at = self._parts(texts, data, bounds)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, bounds[-1]).astype(np.int32)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        found = self._find(coded.dictionary)
        found.append(end)
        ends = np.searchsorted(at, bounds[1:])  # pieces up to the end of each text
        order = np.insert(coded.indices.to_numpy(), ends, len(found) - 1)
        offsets = np.zeros(len(found) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)), out=offsets[1:])
        ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(found))]).take(pa.array(order))
        offsets = np.frombuffer(ids.buffers()[1], np.int64)
        last = offsets[ends + np.arange(1, len(ends) + 1)]
        return (ids.buffers()[2] or pa.py_buffer(b"")).slice(0, int(last[-1])), np.diff(last, prepend=0) // self.dtype.itemsize

    def _parts(self, texts: pa.Array, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where pieces begin in the bytes of the texts."""
        line, mark = data == 0x0A, self.marks[data]
        part = line | (data == 0x20)
        # \xc3 and a second byte: letters, but for the signs of multiplication and division
        letter = self.alnum[data[:-1]]
        letter[1:] |= (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
        part[1:] |= line[:-1] | (letter & mark[1:])
        for i in np.flatnonzero(pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)).tolist():
            part[bounds[i]:bounds[i + 1]] = False
        part[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        return np.flatnonzero(part)

    def _find(self, pieces: pa.Array) -> list[bytes]:
        """Ids of each of the different ``pieces``."""
        raw, at = pieces.buffers()[2], np.frombuffer(pieces.buffers()[1], np.int32)[:len(pieces) + 1].tolist()
        raw = raw.to_pybytes() if raw else b""
        pieces = [raw[a:b] for a, b in zip(at, at[1:])]
        found = list(map(self.new.get, pieces))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        if gaps:
            older = self.old.get
            for i in gaps:
                found[i] = older(pieces[i])
            missing, learned = [p for p, ids in zip(pieces, found) if ids is None], {}
            for at in range(0, len(missing), AT_ONCE):
                learned.update(self._learn(missing[at:at + AT_ONCE]))
            for i in gaps:
                p, ids = pieces[i], found[i]
                if ids is None:
                    found[i] = ids = learned[p]
                if len(p) <= KEPT_BYTES:
                    self.new[p] = ids
            if len(self.new) > self.cached:
                self.old, self.new = self.new, {}
        return found

    def _learn(self, missing: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces by the library: words after a space in one call without the pattern, others between line breaks, the rest by themselves."""
        ascii, words, other, rest = [], [], [], []
        for p in missing:
            if p[1:].isalpha() and p[0] == 0x20:  # ASCII letters only, by far the most
                ascii.append(p)
            elif _WORD.fullmatch(p):
                words.append(p)
            elif b"<|" in p or _SPACE_INSIDE.search(p.decode()):
                rest.append(p)
            else:
                other.append(p)
        learned: dict[bytes, bytes] = {}
        for own, text in ((ascii, b"".join(ascii).decode().replace(" ", self.symbols[0x20])), (words, b"".join(words).decode("latin-1").translate(self.symbols))):
            if own:
                ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
                at = np.flatnonzero(self.starts[ids])
                if not self._cut(learned, own, ids, at, np.append(at[1:], len(ids))):
                    rest += own
        if other:
            ids = np.array(self.plain([b"\n".join(other).decode()])[0], self.dtype)
            at = np.flatnonzero(ids == self.line) if self.line is not None else np.empty(0, np.int64)
            if not self._cut(learned, other, ids, np.append(0, at + 1), np.append(at, len(ids))):
                rest += other
        if rest:
            learned.update((p, np.array(i, self.dtype).tobytes()) for p, i in zip(rest, self.plain([p.decode() for p in rest])))
        return learned

    def _cut(self, learned: dict[bytes, bytes], pieces: list[bytes], ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> bool:
        """Put the ids between ``first`` and ``last`` down for ``pieces``, if there are as many."""
        if len(first) != len(pieces) or first[0] != 0:
            return False
        raw, width = ids.tobytes(), self.dtype.itemsize
        learned.update((p, raw[a:b]) for p, a, b in zip(pieces, (first * width).tolist(), (last * width).tolist()))
        return True


def groups(texts: pa.Array):
    """The texts in order, about ``GROUP`` bytes at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // GROUP)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        yield texts.slice(a, b - a)


def encoder_of(path: str, special: bool) -> Encoder:
    """The encoder of this Python worker for a file."""
    return kept(("token files", path, special), lambda: Encoder(path, special))


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:/") else f"file://{folder}")


def write_files(docs: DataFrame, tokenizer: str, folder: str | None = None, length: int = 2048, end_id: int = 0,
                parts: int | None = None, special: bool = True) -> DataFrame:
    """Encode ``docs`` into files below ``folder`` (a fresh one in the shared folder unless given); returns the manifest in file order."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = arrow_schema(MANIFEST)

    def write(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        encoder = encoder_of(tokenizer, special)
        name = f"{base}/part-{part:06d}-{uuid.uuid4().hex[:12]}"
        ids_type = pa.uint16() if encoder.dtype.itemsize == 2 else pa.uint32()
        layout = pa.schema([("input_ids", pa.list_(ids_type, length)), ("mask", pa.list_(pa.bool_(), length))])
        index_layout = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        end = np.array([end_id], encoder.dtype).tobytes()
        width, pending, waiting, n_ids, n_docs = encoder.dtype.itemsize, [], 0, 0, 0
        sink = writer = index = index_sink = None

        def put(raw: bytes, real: int):
            rows = len(raw) // (width * length)
            ids = pa.FixedSizeListArray.from_arrays(pa.Array.from_buffers(ids_type, rows * length, [None, pa.py_buffer(raw)]), length)
            mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(rows * length) < real), length)
            writer.write_batch(pa.RecordBatch.from_arrays([ids, mask], schema=layout))

        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                sink, index_sink = fs.open_output_stream(name + ".arrow"), fs.open_output_stream(name + ".index.arrow")
                writer, index = pa.ipc.new_file(sink, layout), pa.ipc.new_file(index_sink, index_layout)
            sizes = []
            for texts in groups(batch.column("text")):
                raw, own = encoder.encode_all(texts, end)
                sizes.append(own)
                pending.append(raw)
                waiting += len(raw)
                if waiting >= 1 << 22:
                    joined = b"".join(pending)
                    full = len(joined) // (width * length) * width * length
                    put(joined[:full], full // width)
                    pending, waiting = [joined[full:]], len(joined) - full
            sizes = np.concatenate(sizes)
            starts = n_ids + np.cumsum(sizes) - sizes
            n_ids += int(sizes.sum())
            n_docs += batch.num_rows
            index.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())],
                                                         schema=index_layout))
        if writer is None:
            return
        rest = b"".join(pending)
        if rest:
            put(rest + bytes(-len(rest) % (width * length)), len(rest) // width)
        for x in (writer, index, sink, index_sink):
            x.close()
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((part, name + ".arrow", n_ids, n_docs), schema)], schema=schema)

    ordered = (docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, "doc_id")
               .sortWithinPartitions("doc_id", "text"))
    return materialize(ordered.mapInArrow(write, MANIFEST), "token-manifest").orderBy("part").withColumn("folder", F.lit(folder))


class Reader:
    """Random access to one file: any ids without a copy where the file can be mapped."""

    def __init__(self, path: str, folder: str):
        fs, _ = _filesystem(folder)
        source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        index_path = path.removesuffix(".arrow") + ".index.arrow"
        self.index_file = pa.ipc.open_file(pa.memory_map(index_path) if fs.type_name == "local" else fs.open_input_file(index_path))
        self.length = self.file.schema.field("input_ids").type.list_size
        self.batches: list[tuple[int, int]] = []  # first id and end of each batch
        at = 0
        for i in range(self.file.num_record_batches):
            n = self.file.get_batch(i).num_rows * self.length
            self.batches.append((at, at + n))
            at += n

    def sequence(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of the n-th sequence."""
        i = bisect.bisect_right(self.batches, n * self.length, key=lambda b: b[0]) - 1
        if i < 0 or n * self.length >= self.batches[i][1]:
            raise IndexError(n)
        batch, row = self.file.get_batch(i), n - self.batches[i][0] // self.length
        ids, mask = (batch.column(c).values.slice(row * self.length, self.length) for c in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def documents(self):
        """``doc_id, start, ids`` in file order; start counts ids from the beginning of this file."""
        i, held, first = -1, np.empty(0, np.uint32), 0  # held: ids from ``first`` on
        for b in range(self.index_file.num_record_batches):
            index = self.index_file.get_batch(b)
            for doc, start, n in zip(*(c.to_pylist() for c in index.columns)):
                while first + len(held) < start + n:
                    i += 1
                    more = self.file.get_batch(i).column(0).values.to_numpy()
                    held, first = (np.concatenate([held[start - first:], more]) if start - first < len(held) else more), \
                        (start if start - first < len(held) else self.batches[i][0])
                yield doc, start, held[start - first:start - first + n]


DOCUMENTS = "doc_id long, part int, start long, n_tokens long, ids_crc32 long"


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document, read from the files: ``doc_id``, ``start`` over all files, ``n_tokens``, ``ids_crc32``."""
    schema = arrow_schema(DOCUMENTS)

    def read(batches):
        for batch in batches:
            for part, path, folder in zip(*(c.to_pylist() for c in batch.columns)):
                out: list[tuple] = []
                for doc, start, ids in Reader(path, folder).documents():
                    out.append((doc, part, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    # one row per file: the running sum sees as many rows as there are files
    totals, so_far = [], 0
    for r in manifest.select("part", "n_ids").orderBy("part").collect():
        totals.append((r.part, so_far))
        so_far += r.n_ids
    before = manifest.sparkSession.createDataFrame(totals, "part int, ids_before long")
    files = manifest.select("part", "path", "folder").repartition(max(1, len(totals)), "path")
    return (files.mapInArrow(read, DOCUMENTS).join(F.broadcast(before), "part")
            .select("doc_id", (F.col("start") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32"))
