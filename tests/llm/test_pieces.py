import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from brinelog.llm import pieces
from tests.llm.cases import awkward, empty, texts_of

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def transducer():
    return pieces.Transducer(PATH, cached=50)


def ids(t, text):
    return np.frombuffer(t.encode(text), "<u4").tolist()


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "\n\n x", "\t", "\0", "a\0 b", "▁", "a▁b", "▁▁a", "<s>", "</s><unk>", "<0x41>", "ﬁ Ⅷ", "\U0001F600 é",
       "aaaaaaaaaaaaaaaa", "ababababab", " " * 40, " " * 17 + "x", "don't", "HELLO WORLD", "日本語の文", "x" * 300, "\r\n", "ʼn ß ſ", "=" * 50, "0" * 33]


def test_same_as_the_library(transducer, library, docs):
    rng = random.Random(0)
    made = ["".join(rng.choices("abcdeilnorst ▁\n.,0", k=rng.randrange(60))) for _ in range(300)]
    made += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1500), rng.randrange(0x3000, 0x9000)])) for _ in range(30)) for _ in range(100)]
    for text in [*ODD, *made, *(t for _, t in texts_of(docs)[:60])]:
        assert ids(transducer, text) == library.encode(text), repr(text[:80])


def test_round_trip(transducer, library):
    for text in ODD:
        assert transducer.decode(ids(transducer, text)) == text.replace("▁", " ")
    assert transducer.decode([1, *ids(transducer, "hello"), 2]) == "hello"


def test_report_and_tables(spark, docs, library):
    df = awkward(spark, [(100 + i, t, "en") for i, t in enumerate(ODD)])
    for given in (df, docs):
        got = pieces.report(given, PATH).collect()
        want = sorted((repr(d), len(library.encode(t)), zlib.crc32(np.array(library.encode(t), "<u4").tobytes())) for d, t in texts_of(given))
        assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want and all(r.round_trip for r in got)
    back = pieces.decode(pieces.encode(df, PATH), PATH)
    assert sorted((repr(r.doc_id), r.text) for r in back.collect()) == sorted((repr(d), t.replace("▁", " ")) for d, t in texts_of(df))
    assert pieces.report(empty(spark), PATH).collect() == [] and pieces.encode(empty(spark), PATH).collect() == []


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        pieces.Transducer(str(tmp_path / "none.model"))
