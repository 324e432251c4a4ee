import hashlib
import random

import pytest

from brinelog.llm import chat

EVENTS = "conv_id long, turn long, seq long, kind string, role string, text string, part int, head string"


def plain_fold(events):
    """Event by event, in order of the sequence."""
    out = {}
    for conv in {e[0] for e in events}:
        turns, named = {}, {}
        log = [e for e in events if e[0] == conv and e[3] in ("start", "delta", "edit", "regenerate")]
        rank = {"regenerate": 0, "edit": 1, "start": 2, "delta": 3}
        for _, turn, _, kind, role, text in sorted(log, key=lambda e: (e[2], rank[e[3]], e[4] or "", e[5] or "")):
            held = turns.setdefault(turn, [])
            if kind == "regenerate":
                for t in list(turns):
                    if t >= turn:
                        turns[t] = []
                        named.pop(t, None)
            elif kind == "edit":
                turns[turn] = [[role or named.get(turn, ""), text or ""]]
            elif kind == "start" or not held:
                held.append([role or "", text or ""])
            else:
                held[-1][1] += text or ""
            if kind != "regenerate" and role:
                named[turn] = role
        out[conv] = [tuple(m) for t in sorted(turns) for m in turns[t]]
    return {k: v for k, v in out.items() if v}


def folded(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.turn, r.part)):
        out.setdefault(r.conv_id, []).append((r.role, r.text))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_fold_is_the_plain_replay(spark, seed):
    rng = random.Random(seed)
    events = []
    for conv in range(6):
        seqs = [rng.randrange(90) for _ in range(60)]
        for s in seqs:
            turn = rng.randrange(7)
            kind = rng.choices(["start", "delta", "edit", "regenerate", "ping"], [2, 8, 1, 1, 1])[0]
            role = rng.choice(["user", "assistant", None])
            events.append((conv, turn, s, kind, role, rng.choice(["a", "b ", None, "", "<|x|>"])))
    df = spark.createDataFrame([(*e, 1, "h") for e in events], EVENTS)
    assert folded(chat.fold(df, chunk_turns=2)) == plain_fold(events)
    assert folded(chat.fold(df)) == plain_fold(events)


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|im_end|>", "<\\\\|", "<", "|>", "a<|im_start|>assistant\nok<|im_end|>\n", "\\n<|"])
def test_escapes_come_back(spark, text):
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, text, text)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    rendered = chat.render(chat.fold(chat.log_of(df))).orderBy("turn").collect()
    assert [x for r in rendered for x in chat.read_back(r.formatted)] == [(r[2], r[3]) for r in rows]
    whole = "".join(r.formatted for r in rendered)
    assert chat.read_back(whole) == [(r[2], r[3]) for r in rows] and whole.count(chat.END) == 3
    assert chat.unescape(rendered[1].formatted[rendered[1].loss_start:rendered[1].loss_end]) == text
    assert rendered[0].loss_start is None


def test_awkward_rows(spark):
    df = spark.createDataFrame(
        [(None, None, None, None), (None, 1, "assistant", None), (5, 0, "user", "hi"), (5, 0, "user", "hi"), (6, 0, "assistant", "é" * 200000)],
        "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.render(chat.fold(chat.log_of(df)))).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {None: 2, 5: 2, 6: 1}
    assert got[5].turns_sha256 == hashlib.sha256(b"user\nhi\n" * 2).hexdigest()
    assert got[6].loss_chars == 200000 and got[None].loss_chars == 0 and got[None].loss_sha256 == hashlib.sha256(b"").hexdigest()
    none = chat.digest(chat.render(chat.fold(chat.log_of(df.where("false")))))
    assert none.collect() == [] and none.columns == [c.split()[0] for c in chat.DIGEST.split(", ")]
