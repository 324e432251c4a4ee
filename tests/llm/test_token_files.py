import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from brinelog.llm import token_files as tf
from tests.llm.cases import awkward, empty, texts_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "\n", " \n", "a \nb", "a\n b", "it's we'll I'm 'S", "x y z", "a b c", "a\x1cb c d",
       "a\x85b c", "tab\tb c", "\0a b", "é ü ß 你好 世界", "<|endoftext|> b", "1 2 3,4 .5", "a\r\nb c", "foo   bar", "ends here\n", " 　x", "Ġ Ġx Ċ"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def check(df, plain, **more):
    manifest = tf.write_files(df, PATH, **more)
    got = tf.read_documents(manifest).collect()
    start, want = 0, []
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    rows = df.select("doc_id", "text").collect()
    for d, t in sorted(((r.doc_id, r.text or "") for r in rows), key=key):
        ids = np.array([*plain(t), 0], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    return manifest


def test_same_as_the_library(plain):
    encoder = tf.Encoder(PATH, cached=5)
    for text in [*ODD, " ".join(ODD), *ODD]:
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == plain(text), repr(text)
    assert 50256 in plain("<|endoftext|> b")


def test_special_strings_as_ordinary_text():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    encoder = tf.Encoder(PATH, special=False)
    for text in ("<|endoftext|> b", "a <|endoftext|><|endoftext|>"):
        ids = np.frombuffer(encoder.encode(text), encoder.dtype).tolist()
        assert 50256 not in ids and ids == t.encode(text, add_special_tokens=False).ids


def test_documents(spark, docs, plain):
    encoder = tf.Encoder(PATH)
    for _, text in texts_of(docs):
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == plain(text)
    check(docs, plain, length=128)
    check(docs, plain, parts=1)


def test_awkward_documents(spark, plain):
    df = awkward(spark, [(100 + i, t, "en") for i, t in enumerate(ODD)])
    check(df, plain, length=16)
    assert tf.read_documents(tf.write_files(empty(spark), PATH)).collect() == []


def test_sequences_are_mapped_without_a_copy(spark, docs, plain, tmp_path):
    manifest = tf.write_files(docs, PATH, folder=f"file://{tmp_path}/set", length=64, parts=2)
    for r in manifest.collect():
        reader = tf.Reader(r.path, r.folder)
        stream = np.concatenate([ids for _, _, ids in reader.documents()])
        assert len(stream) == r.n_ids
        n = -(-len(stream) // 64)
        for k in (0, n // 2, n - 1):
            before = pa.total_allocated_bytes()
            ids, mask = reader.sequence(k)
            assert len(ids) == 64 and ids.dtype == np.uint16 and not ids.flags.owndata
            assert pa.total_allocated_bytes() - before < 4096
            assert ids[mask].tolist() == stream[k * 64:(k + 1) * 64].tolist()
        with pytest.raises(IndexError):
            reader.sequence(n)
    names = {f for f in os.listdir(tmp_path / "set")}
    assert len(names) == 2 * manifest.count()


def test_library_sees_a_word_once_whatever_marks_follow(plain):
    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.seen = tokenizer, 0

        def encode_batch_fast(self, texts, **more):
            self.seen += sum(map(len, texts))
            return self.tokenizer.encode_batch_fast(texts, **more)

    words = [f"{a}{b}e{c}" for a in ("th", "br", "ü", "Å") for b in "aeiouy" for c in ("st", "rd", "ñ")]
    text = " ".join(word + mark for mark in ("", ".", ",", "!?", ");", "'", "$$$", "\n-") for word in words)
    encoder = tf.Encoder(PATH)
    counted = {name: Counted(x) for name, x in vars(encoder).items() if isinstance(x, Tokenizer)}
    vars(encoder).update(counted)
    assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == plain(text)
    assert sum(x.seen for x in counted.values()) < 2 * sum(len(w) + 1 for w in words) < len(text) / 3


def test_many_texts_at_once(plain, monkeypatch):
    monkeypatch.setattr(tf, "GROUP", 300)
    monkeypatch.setattr(tf, "AT_ONCE", 7)
    rng = np.random.default_rng(6)
    some = [*"abXY  \n\t.,'-?$<|>09×÷ª½…\xa0　\x85\x1c\0é你", "'s", "'re", " and,", "ß.", "😀", "<|endoftext|>", "word", "x" * 70]
    for kind in (pa.string(), pa.large_string()):
        texts = [None, *("".join(rng.choice(some, rng.integers(0, 30))) for _ in range(600)), ""]
        encoder, got = tf.Encoder(PATH, cached=50), []
        for group in tf.groups(pa.array(["left out", *texts], kind).slice(1)):
            raw, sizes = encoder.encode_all(group, np.array([7], encoder.dtype).tobytes())
            assert len(raw) == sizes.sum() * encoder.dtype.itemsize
            got += [x.tolist() for x in np.split(np.frombuffer(raw, encoder.dtype), np.cumsum(sizes)[:-1])]
        assert got == [[*plain(t or ""), 7] for t in texts]
        assert max(map(len, [*encoder.new, *encoder.old])) <= tf.KEPT_BYTES
