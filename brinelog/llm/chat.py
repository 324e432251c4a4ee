"""Chat formatting from an event log.

A log holds one row per event: ``conv_id, turn, seq, kind, role, text``. Kinds:

- ``start`` opens a message of its turn with a role and a first piece of text,
- ``delta`` appends a streamed piece to the last message of its turn (and opens one if there is none),
- ``edit`` replaces whatever the turn held before it by one message; without a role it takes the last one that its turn named,
- ``regenerate`` clears its turn and all later turns of the conversation as they stood at that time.

Other kinds are ignored. ``seq`` orders the events of a conversation; ties go by kind (regenerate, edit, start, delta), role and text. The final messages follow from one
sorted pass: in turn order, the latest ``regenerate`` of this or an earlier turn is a running maximum, so the fold carries one
number, never a conversation. A long conversation is cut into chunks of turns that run in different tasks; the running maximum at the
start of each chunk comes from a table of one row per chunk.

Defined results: a null text or role is empty, a null ``conv_id`` is a conversation, a null turn comes first, equal ``start`` events are
separate messages in a fixed order, an empty log gives no rows, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinelog.llm.common import arrow_schema

START, END = "<|im_start|>", "<|im_end|>"
MESSAGES = "conv_id long, turn long, part long, role string, text string"
_RANK = {"regenerate": 0, "edit": 1, "start": 2, "delta": 3}


def log_of(conversations: DataFrame) -> DataFrame:
    """A table of whole messages as a log: every row is a ``start`` event."""
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("turn").cast("long").alias("seq"),
                                F.lit("start").alias("kind"), "role", "text")


def fold(events: DataFrame, chunk_turns: int = 4096) -> DataFrame:
    """Final messages ``conv_id, turn, part, role, text``; ``part`` numbers the messages of one turn from 0."""
    log = events.select(
        F.col("conv_id").cast("long"), F.floor(F.col("turn") / chunk_turns).alias("chunk"), F.col("turn").cast("long"),
        F.when(F.col("kind") == "regenerate", 0).when(F.col("kind") == "edit", 1)
        .when(F.col("kind").isin("start", "delta"), 2).otherwise(9).alias("rank"),
        F.col("seq").cast("long"), "kind", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")).where("rank < 9")
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (log.groupBy("conv_id", "chunk").agg(F.max(F.when(F.col("rank") == 0, F.col("seq"))).alias("top"))
             .select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), F.max("top").over(earlier).alias("cut"))
             .where("cut IS NOT NULL"))
    joined = log.join(carry, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("chunk").eqNullSafe(F.col("k")), "left")
    # starts before deltas at one seq; role and text break what ties remain
    ordered = (joined.drop("c", "k").repartition("conv_id", "chunk")
               .sortWithinPartitions("conv_id", "chunk", "turn", "rank", "seq", F.desc("kind"), "role", "text"))
    return ordered.mapInArrow(_fold_sorted, MESSAGES)


def _fold_sorted(batches):
    schema = arrow_schema(MESSAGES)
    out: list[tuple] = []
    here = turn_now = None
    cut = edit = None  # latest regenerate and edit that reach this turn: seq, and for the edit its role and text
    named, opened = (None, ""), []  # last role named before the edit, with its seq; messages of the turn as [role, pieces]

    def settle():
        """Put the edit in front once everything before it is known."""
        nonlocal edit
        if edit is not None:
            opened.append([edit[1] or named[1], [edit[2]]])
            edit = None

    def flush():
        if here is not None:
            settle()
            out.extend((here[0], turn_now, n, role, "".join(text)) for n, (role, text) in enumerate(opened))
        opened.clear()

    edited_at = None
    for batch in batches:
        for conv, chunk, turn, rank, seq, kind, role, text, carried in zip(*(c.to_pylist() for c in batch.columns)):
            if here != (conv, chunk):
                flush()
                here, cut = (conv, chunk), carried
                turn_now, edit, edited_at, named = turn, None, None, (None, "")
            elif turn != turn_now:
                flush()
                turn_now, edit, edited_at, named = turn, None, None, (None, "")
            at = -(1 << 63) if seq is None else seq
            if rank == 0:
                cut = at if cut is None else max(cut, at)
            elif cut is not None and at < cut:
                pass
            elif rank == 1:
                if edit is not None and edit[1]:
                    named = edit[:2]
                edit, edited_at = (at, role, text), at
            elif edited_at is not None and at < edited_at:
                if role and (named[0] is None or at >= named[0]):
                    named = (at, role)
            else:
                settle()
                if kind == "start" or not opened:
                    opened.append([role, [text]])
                else:
                    opened[-1][1].append(text)
        if len(out) >= 1000:
            yield _rows(out, schema)
            out.clear()
    flush()
    if out:
        yield _rows(out, schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def escape(text: Column) -> Column:
    r"""Add one backslash to every ``<``, backslashes, ``|``: no control string is left and ``unescape`` restores the text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: Column) -> Column:
    r"""Roles also end at a line break: ``\`` and line breaks are escaped by a backslash, then control strings as in texts."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(messages: DataFrame) -> DataFrame:
    """Adds ``formatted``, the marked turn, and ``loss_start, loss_end``, the code points of it that are trained on (assistant text).

    The formatted conversation is its turns in order of ``turn, part``; it is never gathered in one cell.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    trained = F.col("role") == "assistant"
    return (messages.withColumns({"head": head, "body": escape(F.col("text"))})
            .withColumns({
                "formatted": F.concat("head", "body", F.lit(END + "\n")),
                "loss_start": F.when(trained, F.char_length("head").cast("long")),
                "loss_end": F.when(trained, (F.char_length("head") + F.char_length("body")).cast("long"))})
            .select("conv_id", "turn", "part", "formatted", "loss_start", "loss_end"))


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def digest(rendered: DataFrame) -> DataFrame:
    """Per conversation, what can be read back from its formatted turns. The hashes run over the turns in order, in a stream."""
    return (rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part")
            .select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(_digest_sorted, DIGEST))


def _digest_sorted(batches):
    schema = arrow_schema(DIGEST)
    out: list[tuple] = []
    state = None  # conv_id, turns, hash of turns, loss characters, hash of them, formatted characters

    def close():
        if state is not None:
            conv, n, turns, chars, loss, size = state
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    for batch in batches:
        for conv, text, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            if state is None or state[0] != conv:
                close()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in read_back(text):
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
            if start is not None:
                said = unescape(text[start:end])
                state[3] += len(said)
                state[4].update(said.encode())
            state[5] += len(text)
        if len(out) >= 1000:
            yield _rows(out, schema)
            out.clear()
    close()
    if out:
        yield _rows(out, schema)
