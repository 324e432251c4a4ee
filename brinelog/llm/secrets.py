"""Secret scans: fixed rules plus formats inferred from labelled credentials.

Base spans come from three fixed patterns. What they match in a bounded sample of documents is the labelled data: values of assignments,
access keys and hexadecimal strings as credentials by kind. Ordinary tokens are those of words and short numbers (words, paths, hosts,
file names); other long tokens have no label and are not learned from, so any number of them may be spans. For every kind, however few its
tokens, a prefix tree of character classes is built and its states are merged as long as they are statistically compatible (red and blue
states): their continuations by the Hoeffding bound, and the lengths of what is left of their strings. Deep states see single strings, whose
continuations are compatible with anything; the lengths keep them apart, so a format of fixed length becomes a chain of layers and one of
varying length gets loops. A candidate is a long token with a digit and a letter outside the base spans; it is scored under every automaton.
It is a span if its characters and its end are as likely under one credential format as those of credentials of that kind held out from
learning (all but a hundredth of them), and it beats the ordinary automaton by the margin that parts held-out credentials and ordinary tokens.

Scanning reads whole texts and all documents; only the fit is on a sample, whose bound is a parameter.

Defined results: a null text is empty; positions are code points, ends exclusive; without labelled credentials no format is inferred and
the base spans remain; a kind whose labelled tokens are all shorter than a candidate has no format; repeated rows are scanned alike; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinelog.llm.common import arrow_schema, texts_of

# The base patterns and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # the pattern AKIA[A-Z0-9]+ with 18 characters at least
HEX = re.compile(r"[0-9a-f]{16,}")  # the pattern [0-9a-f]+ with 16 characters at least
ASSIGN_VALUE = 12
KINDS = ("assign", "access", "hex")
INFERRED = "inferred"
FOLDS = 4
CANDIDATE = 16  # characters a candidate has at least, as in TOKEN
SHARE = 0.9  # of the lengths left in the thinner of two states that the other has seen too

_WORDS = ("passw", "secret", "token", "api")  # each match of ASSIGN holds one of these
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
ORDINARY = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{10,}")
_WORDLIKE = re.compile(r"[+/_.=-]*(?:(?:[A-Z]?[a-z]{1,15}|[A-Z]{1,15})[0-9]{0,4}|[0-9]{1,4})"
                       r"(?:[+/_.=-]+(?:(?:[A-Z]?[a-z]{1,15}|[A-Z]{1,15})[0-9]{0,4}|[0-9]{1,4}))*[+/_.=-]*")
_CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
_CLASS_OF = {c: i for i, chars in enumerate(_CLASSES) for c in chars}
_WIDTH = [math.log(len(chars)) for chars in _CLASSES]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the base matches, by start, then in order of the kinds."""
    found: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Long tokens with a digit and a letter that touch no base span."""
    out, i = [], 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        token = m[0]
        if any(s < b and a < e for s, e, _ in taken[max(0, i - 2):i + 8]):
            continue
        if any(map(str.isdigit, token)) and any(map(str.isalpha, token)):
            out.append((a, b))
    return out


def ordinary(text: str, taken: list[tuple[int, int, str]]) -> list[str]:
    """Tokens that touch no base span and are made of words and short numbers, and long words."""
    clear, at = [], 0
    for a, b, _ in sorted(taken):
        clear.append(text[at:a])
        at = max(at, b)
    clear.append(text[at:])
    return [m for part in clear for m in ORDINARY.findall(part) if _WORDLIKE.fullmatch(m)]


class Automaton:
    """Probabilistic automaton over character classes."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.count: list[int] = [0]  # strings that reach a state
        self.ends: list[int] = [0]
        self.next: list[dict[int, int]] = [{}]
        self.passed: list[dict[int, int]] = [{}]  # strings that leave a state by a class
        self.left: list[dict[int, int]] = [{}]  # strings by the number of characters they have left in a state
        for s in strings:
            at = 0
            self.count[0] += 1
            self.left[0][len(s)] = self.left[0].get(len(s), 0) + 1
            for rest, c in zip(range(len(s) - 1, -1, -1), (_CLASS_OF[x] for x in s)):
                if c not in self.next[at]:
                    self.next[at][c] = len(self.count)
                    for column, value in ((self.count, 0), (self.ends, 0), (self.next, {}), (self.passed, {}), (self.left, {})):
                        column.append(value)
                self.passed[at][c] = self.passed[at].get(c, 0) + 1
                at = self.next[at][c]
                self.count[at] += 1
                self.left[at][rest] = self.left[at].get(rest, 0) + 1
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        return bool(n and m) and abs(x / n - y / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _same_lengths(self, a: int, b: int) -> bool:
        thin, thick = sorted((a, b), key=lambda x: self.count[x])
        x, y, n, m = self.left[thin], self.left[thick], self.count[thin], self.count[thick]
        if sum(k for length, k in x.items() if length in y) < SHARE * n:
            return False
        return not any(self._differ(x.get(length, 0), n, y.get(length, 0), m) for length in x.keys() | y.keys())

    def _compatible(self, a: int, b: int) -> bool:
        if not self._same_lengths(a, b):
            return False
        todo = [(a, b)]
        seen = set()
        while todo:
            a, b = todo.pop()
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            n, m = self.count[a], self.count[b]
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for c in self.passed[a].keys() | self.passed[b].keys():
                if self._differ(self.passed[a].get(c, 0), n, self.passed[b].get(c, 0), m):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            self.count[a] += self.count[b]
            self.ends[a] += self.ends[b]
            for length, n in self.left[b].items():
                self.left[a][length] = self.left[a].get(length, 0) + n
            for c, n in self.passed[b].items():
                self.passed[a][c] = self.passed[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge_states(self) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            parent, c = blue.pop(0)
            b = self.next[parent][c]
            if b in red:
                continue
            for r in red:
                if self._compatible(r, b):
                    self.next[parent][c] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
            blue = [(r, k) for r in red for k in sorted(self.next[r]) if self.next[r][k] not in red]
        self.states = len(red)

    def walk(self, token: str) -> tuple[float, float]:
        """Log likelihood of the characters and of ending where they end. A step never seen counts as a part of one string and goes where
        most strings go on, so that the place in the format is kept."""
        at, total = 0, 0.0
        for x in token:
            c = _CLASS_OF[x]
            n = self.count[at] if at is not None else 0
            seen = self.passed[at].get(c, 0) if at is not None else 0
            total += math.log((seen + 0.05) / (n + 0.05 * (len(_CLASSES) + 1))) - _WIDTH[c]
            if at is not None:
                steps = self.next[at]
                at = steps[c] if c in steps else steps[max(steps, key=lambda k: (self.passed[at][k], -k))] if steps else None
        n, seen = (self.count[at], self.ends[at]) if at is not None else (0, 0)
        return total, math.log((seen + 0.05) / (n + 0.05 * (len(_CLASSES) + 1)))

    def score(self, token: str) -> float:
        """Log likelihood per character, the end included."""
        return sum(self.walk(token)) / (len(token) + 1)


class Formats:
    """Automata of the kinds and of ordinary tokens; per kind, the likelihoods (characters, end) and the gain over ordinary tokens that a
    span needs."""

    def __init__(self, labelled: list[tuple[str, str]], ordinary: list[str]):
        by_kind: dict[str, list[str]] = defaultdict(list)
        for kind, token in sorted(set(labelled)):
            if all(c in _CLASS_OF for c in token):
                by_kind[kind].append(token)
        by_kind = {k: v for k, v in by_kind.items() if any(len(t) >= CANDIDATE for t in v)}
        words = sorted({t for t in ordinary if all(c in _CLASS_OF for c in t)})
        held: dict[str, list[tuple[float, float, float]]] = defaultdict(list)  # likelihoods and gain of labelled tokens
        others: list[float] = []
        for i in range(FOLDS):  # each token is judged by automata that have not seen it; a kind's only token by its own
            self._learn({k: [t for n, t in enumerate(v) if n % FOLDS != i or len(v) == 1] for k, v in by_kind.items()},
                        [t for n, t in enumerate(words) if n % FOLDS != i])
            for k, v in by_kind.items():
                held[k] += [self._judge(k, t, self.ordinary.score(t)) for t in v[i::FOLDS] if len(t) >= CANDIDATE]
            others += [self.gain(t) for t in words[i::FOLDS] if len(t) >= CANDIDATE]
        others = sorted(others)
        most = others[len(others) - 1 - len(others) // 100] + 1e-9 if others else 0.0  # no more than a hundredth of ordinary tokens pass
        # and all but a hundredth of the labelled credentials of a kind by each likelihood, all but a fiftieth by gain
        self.least = {k: (*(sorted(x)[len(v) // 100] for x in list(zip(*v))[:2]), max(sorted(g for _, _, g in v)[len(v) // 50], most, 0.0))
                      for k, v in held.items()}
        self._learn(by_kind, words)

    def _learn(self, by_kind: dict[str, list[str]], words: list[str]) -> None:
        self.kinds = {k: Automaton(v) for k, v in by_kind.items()}
        self.ordinary = Automaton(words)

    def gain(self, token: str) -> float:
        return max((a.score(token) for a in self.kinds.values()), default=-math.inf) - self.ordinary.score(token)

    def _judge(self, kind: str, token: str, plain: float) -> tuple[float, float, float]:
        chars, end = self.kinds[kind].walk(token)
        return chars / len(token), end, (chars + end) / (len(token) + 1) - plain

    def secret(self, token: str) -> bool:
        plain = self.ordinary.score(token)
        return any(all(x >= y for x, y in zip(self._judge(k, token, plain), self.least[k])) for k in self.kinds)


def fit(docs: DataFrame, rows: int = 20_000, each: int = 2000, max_chars: int = 20_000, max_token: int = 200) -> Formats:
    """Formats from at most ``rows`` documents of at most ``max_chars`` characters, drawn by a hash, and at most ``each`` tokens of a kind,
    of at most ``max_token`` characters; these bound what is learned from, not what is scanned."""
    ddl = "kind string, token string"

    def label(batches):
        schema = arrow_schema(ddl)
        for batch in batches:
            out: list[tuple[str, str]] = []
            for text in texts_of(batch):
                taken = base_spans(text)
                for a, b, kind in taken:
                    token = text[a:b]
                    out.append((kind, ASSIGN.match(token)[2] if kind == "assign" else token))
                out += [("ordinary", w) for w in ordinary(text, taken)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([t for _, t in out], pa.string())], schema=schema)

    n = docs.count()
    draw = F.pmod(F.xxhash64(F.lit("secrets"), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = docs.where((F.char_length("text") <= max_chars) & (draw < F.lit(rows / max(1, n)))).select("text")
    tokens = sample.mapInArrow(label, ddl).where(F.char_length("token") <= max_token).distinct()
    labelled: list[tuple[str, str]] = []
    for kind in (*KINDS, "ordinary"):
        labelled += [(kind, r.token) for r in tokens.where(F.col("kind") == kind).orderBy(F.xxhash64("token"), "token").limit(each).collect()]
    return Formats([x for x in labelled if x[0] != "ordinary"], [t for k, t in labelled if k == "ordinary"])


SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_inferred long"


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame, formats: Formats) -> DataFrame:
    """Base and inferred spans of every document."""
    held = docs.sparkSession.sparkContext.broadcast(formats)

    def run(batches):
        schema, order = arrow_schema(SPANS), (*KINDS, INFERRED)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                base = base_spans(text)
                more = [(a, b, INFERRED) for a, b in candidates(text, base) if held.value.secret(text[a:b])]
                kinds = [k for _, _, k in base]
                out.append((doc, *(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(),
                            joined(sorted(base + more, key=lambda s: (s[0], order.index(s[2])))), len(more)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SPANS)
