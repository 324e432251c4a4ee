"""SentencePiece encoding and decoding by a weighted transducer.

The transducer is compiled from a model file: a normaliser (dummy prefix, spaces as U+2581), an arc for each piece, and byte arcs for
characters that no piece covers. The model ranks merges, so a path is right exactly if each two neighbouring pieces are what the
merges make of their own characters. That condition is the weight of the step from one piece to the next in the tropical semiring: zero
if it holds, infinite if not. Composing with an input gives a lattice of places; its shortest path is the only finite one, and at
each place one last piece has a finite distance. Step weights are compiled when first met and kept.

No piece holds U+2581 after another character (checked on loading), so a lattice falls apart at such places and equal words share
their paths; a task keeps the paths of the words that it has met, in two generations of bounded size.

Defined results: a null or empty text has no ids; U+2581 in a text is a space after decoding, everything else comes back; NUL and
unassigned characters go by bytes; repeated rows are encoded alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinelog.llm.common import arrow_schema, kept, texts_of

SPACE = "▁"
INFINITE = float("inf")


def _fields(raw: bytes):
    """Field number and value of a protobuf message: numbers for varints, bytes for the rest."""
    i = 0

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            b = raw[i]
            i += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while i < len(raw):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
        else:
            n = {1: 8, 5: 4}.get(wire) or varint()
            yield number, raw[i:i + n]
            i += n


class Transducer:
    # Fixed values of the model format: field numbers, kinds of models and pieces.
    TRAINER, NORMALIZER, MODEL_TYPE, BPE = 2, 3, 3, 2
    CHARS_MAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 2, 3, 4, 5

    def __init__(self, path: str, cached: int = 200_000, steps: int = 300_000):
        from sentencepiece import SentencePieceProcessor
        model = SentencePieceProcessor(model_file=path)
        parts = dict(_fields(model.serialized_model_proto()))
        normalizer, trainer = dict(_fields(parts[self.NORMALIZER])), dict(_fields(parts[self.TRAINER]))
        if trainer.get(self.MODEL_TYPE, 1) != self.BPE or normalizer.get(self.CHARS_MAP) or not normalizer.get(self.ESCAPE_SPACES, 1) \
                or normalizer.get(self.EXTRA_SPACES, 1):
            raise ValueError("only models of ranked merges that keep all characters and spaces are supported")
        self.prefix = SPACE if normalizer.get(self.DUMMY_PREFIX, 1) else ""
        size = model.vocab_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(size)]
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.ids = {self.text[i]: i for i in range(size) if not special[i]}
        self.rank = {p: -model.get_score(i) for p, i in self.ids.items()}
        self.size = size
        bare = sorted({c for p in self.ids for c in p} - self.ids.keys())  # characters that only longer pieces hold go by bytes
        self.symbol = [*self.text, *bare, ""]
        self.begin = len(self.symbol) - 1
        symbols = self.ids | {c: size + i for i, c in enumerate(bare)}
        # arcs: for each beginning of a piece the longest piece that it begins with; the next shorter one follows in a chain, -1 ends it
        self.length, self.shorter, self.arcs = [len(x) for x in self.symbol], [-1] * len(self.symbol), {}
        self.longest = max(map(len, symbols), default=0)
        for start in sorted({p[:i] for p in symbols for i in range(1, len(p) + 1)}, key=len):
            known = self.arcs.get(start[:-1], -1)
            self.arcs[start] = symbols.get(start, known)
            if start in symbols:
                self.shorter[symbols[start]] = known
        self.inside = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}  # neighbours that some piece covers
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: bytes([b]) for b, i in enumerate(self.byte)}
        self.control = {i for i in range(size) if model.is_control(i)}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece runs over the beginning of a word")
        self.weights: dict[int, float] = {}  # by both symbols, as one number
        self.cached, self.steps, self.new, self.old = cached, steps, {}, {}

    def merged(self, symbols: list[str]) -> list[str]:
        """What the merges make of a short run of characters: lowest rank first, leftmost of equal ones."""
        rank, never = self.rank.get, INFINITE
        ranks = [rank(a + b, never) for a, b in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(symbols[i - 1] + symbols[i], never)
            if i < len(ranks):
                ranks[i] = rank(symbols[i] + symbols[i + 1], never)
        return symbols

    def weight(self, before: int, piece: int) -> float:
        """Weight of the step from one piece to the next, by their symbols."""
        first, second = self.symbol[before], self.symbol[piece]
        found = 0.0 if self.merged(list(first + second)) == ([first, second] if first else [second]) else INFINITE
        if len(self.weights) >= self.steps:
            self.weights.clear()
        self.weights[before * len(self.symbol) + piece] = found
        return found

    def shortest(self, word: str) -> list[int]:
        """Ids along the shortest path over a run of characters.

        Steps weigh zero or infinity, so the first path of finite steps that gets to the end is the shortest. The search goes deep,
        long pieces first. A place is entered once: only one path of finite weight leads to it.
        """
        n, span = len(word), len(self.symbol)
        arcs, weights, length, shorter = self.arcs, self.weights, self.length, self.shorter
        if n == 1 and word not in arcs:
            return [self.byte[b] for b in word.encode()]
        entered = bytearray(n + 1)
        path: list[int] = []
        untried: list[int] = []  # per place of the path, the arc to try next
        before, start = self.begin, 0
        while start < n:
            if len(untried) == len(path):
                low, high = start + 1, min(n, start + self.longest)
                while low < high:  # the beginning of a piece that goes furthest; all shorter ones are beginnings, too
                    middle = (low + high + 1) >> 1
                    if word[start:middle] in arcs:
                        low = middle
                    else:
                        high = middle - 1
                untried.append(arcs[word[start:low]])
            piece = untried[-1]
            while piece >= 0:
                end = start + length[piece]
                if not entered[end]:
                    step = weights.get(before * span + piece)
                    if (self.weight(before, piece) if step is None else step) == 0.0:
                        break
                piece = shorter[piece]
            if piece >= 0:
                entered[end] = 1
                untried[-1] = shorter[piece]
                path.append(piece)
                before, start = piece, end
            else:
                untried.pop()
                start -= length[path.pop()]
                before = path[-1] if path else self.begin
        if max(path) < self.size:
            return path
        return [i for piece in path for i in ([piece] if piece < self.size else [self.byte[b] for b in self.symbol[piece].encode()])]

    def word(self, word: str) -> bytes:
        """Ids of a word as little-endian unsigned 32-bit integers, kept for the next time.

        Between two characters that stand side by side in no piece every path passes, so the word is cut there first.
        """
        found = self.old.get(word)
        if found is None:
            inside = self.inside
            cuts = [i for i in range(1, len(word)) if word[i - 1:i + 1] not in inside]
            if cuts:
                parts = [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]
                found = b"".join([self.new.get(p) or self.word(p) for p in parts])
            else:
                found = np.array(self.shortest(word), "<u4").tobytes()
        if len(word) <= 64:
            if len(self.new) >= self.cached:
                self.old, self.new = self.new, {}
            self.new[word] = found
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        spaced = self.prefix + text.replace(" ", SPACE)
        # a word begins at a space that no space precedes
        if SPACE * 2 in spaced:
            words, start = [], 0
            at = spaced.find(SPACE, 1)
            while at > 0:
                if spaced[at - 1] != SPACE:
                    words.append(spaced[start:at])
                    start = at
                at = spaced.find(SPACE, at + 1)
            words.append(spaced[start:])
        else:
            words = spaced.replace(SPACE, "\0" + SPACE).split("\0") if "\0" not in spaced else [spaced]
            if not words[0]:
                del words[0]
        known = self.new
        found = list(map(known.get, words))
        if None in found:
            found = [f if f is not None else self.new.get(w) or self.word(w) for w, f in zip(words, found)]
        return b"".join(found)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: bytes in a row are UTF-8, the dummy prefix goes, control ids are nothing."""
        out: list[bytes] = []
        for i in ids:
            if i in self.byte_of:
                out.append(self.byte_of[i])
            elif i not in self.control:
                out.append(self.text[i].replace(SPACE, " ").encode())
        text = b"".join(out).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


ENCODED = "doc_id long, ids array<int>"


def _transducer(path: str) -> Transducer:
    """One transducer per Python worker."""
    return kept(("pieces", path), lambda: Transducer(path))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids`` of every document."""
    def run(batches):
        t = _transducer(model)
        for batch in batches:
            ids = [np.frombuffer(t.encode(x), "<i4") for x in texts_of(batch)]
            lengths = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat, pa.int32()))],
                                             schema=arrow_schema(ENCODED))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` of encoded documents."""
    def run(batches):
        t = _transducer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())],
                                             schema=arrow_schema("doc_id long, text string"))

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


REPORT = "doc_id long, n_tokens long, n_bytes long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def report(docs: DataFrame, model: str) -> DataFrame:
    """Per document: ids, byte ids among them, checksum of the ids (unsigned 32-bit, little-endian), the decoded text's hash, and whether it is the text."""
    def run(batches):
        t = _transducer(model)
        schema = arrow_schema(REPORT)
        is_byte = np.zeros(len(t.text), bool)
        is_byte[t.byte] = True
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                raw = t.encode(text)
                ids = np.frombuffer(raw, "<u4")
                decoded = t.decode(ids.tolist())
                out.append((doc, len(ids), int(is_byte[ids].sum()), zlib.crc32(raw), hashlib.sha256(decoded.encode()).hexdigest(),
                            decoded == text.replace(SPACE, " ")))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, REPORT)
