"""Secret scanning with inferred grammars.

Plain patterns find assignments, access keys and long hexadecimal runs.  What they find are labelled credentials: for each
kind a prefix tree of up to ``sample`` of them (those with the smallest hash, no longer than ``longest``) is turned
into a probabilistic automaton by merging states whose outgoing frequencies agree within Hoeffding's bound.  Another automaton
is learned from other tokens of the same make.  Every candidate token of every text is then scored by how
much likelier its format is under the best credential automaton than under the other one.

Texts are read once; what is kept of them is the spans and the candidates.  Null text counts as empty.  Without
labelled credentials nothing is added to the patterns' spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import each_batch, land

KINDS = ("assign", "access", "hex")
ADDED = "format"
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
MARKS = ("passw", "secret", "token", "api")
SHORTEST = 16


def base_spans(text: str, longest_word: int) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, credential) of the patterns' matches, in order."""
    found = []
    lower = text.lower()
    if any(mark in lower for mark in MARKS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if longest_word >= 20 and "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    if longest_word >= 24:
        found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, longest_word: int, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
    """Long tokens of letters and digits that no span touches."""
    if longest_word < SHORTEST:
        return []
    found = []
    for m in TOKEN.finditer(text):
        token = m[0]
        if any(map(str.isdigit, token)) and any(map(str.isalpha, token)) and all(e <= m.start() or s >= m.end() for s, _, e, _ in taken):
            found.append(m.span())
    return found


def symbols(token: str) -> str:
    """The token's format: digits, hexadecimal and other letters of either case become one symbol each."""
    return "".join("0" if c.isdigit() else ("a" if c in "abcdef" else "A" if c in "ABCDEF" else "g" if c.islower() else "G") if c.isalpha() else c
                   for c in token)


class Automaton:
    """States with how often they were entered and ended in, and counted steps to other states."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.entered, self.ended, self.to, self.taken = [], [], [], []
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._new()
        for string in strings:
            state = 0
            self.entered[0] += 1
            for symbol in string:
                if symbol not in self.to[state]:
                    self.to[state][symbol] = self._new()
                    self.taken[state][symbol] = 0
                self.taken[state][symbol] += 1
                state = self.to[state][symbol]
                self.entered[state] += 1
            self.ended[state] += 1
        self._merge_all()

    def _new(self) -> int:
        self.entered.append(0)
        self.ended.append(0)
        self.to.append({})
        self.taken.append({})
        return len(self.entered) - 1

    def _differs(self, x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        pending = [(a, b)]
        while pending:
            a, b = pending.pop()
            n, m = self.entered[a], self.entered[b]
            if self._differs(self.ended[a], n, self.ended[b], m):
                return False
            for symbol in self.to[a].keys() | self.to[b].keys():
                if self._differs(self.taken[a].get(symbol, 0), n, self.taken[b].get(symbol, 0), m):
                    return False
                if symbol in self.to[a] and symbol in self.to[b]:
                    pending.append((self.to[a][symbol], self.to[b][symbol]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        pending = [(into, tree)]
        while pending:
            into, tree = pending.pop()
            self.entered[into] += self.entered[tree]
            self.ended[into] += self.ended[tree]
            for symbol, child in self.to[tree].items():
                self.taken[into][symbol] = self.taken[into].get(symbol, 0) + self.taken[tree][symbol]
                if symbol in self.to[into]:
                    pending.append((self.to[into][symbol], child))
                else:
                    self.to[into][symbol] = child

    def _merge_all(self) -> None:
        settled = [0]
        while True:
            fringe = [(state, symbol, child) for state in settled for symbol, child in sorted(self.to[state].items()) if child not in settled]
            if not fringe:
                break
            state, symbol, child = max(fringe, key=lambda f: self.entered[f[2]])
            for other in settled:
                if self._compatible(other, child):
                    self.to[state][symbol] = other
                    self._fold(other, child)
                    break
            else:
                settled.append(child)
        self.states = settled

    def bits(self, string: str, smooth: float = 0.1, kinds: int = 12) -> float:
        """Mean bits of a symbol, the end included."""
        state, total = 0, 0.0
        for symbol in [*string, None]:
            n = self.entered[state] if state is not None else 0
            seen = (self.ended[state] if symbol is None else self.taken[state].get(symbol, 0)) if state is not None else 0
            total -= math.log2((seen + smooth) / (n + smooth * kinds))
            state = self.to[state].get(symbol) if state is not None else None
        return total / (len(string) + 1)


def learn(found: DataFrame, sample: int = 1_000, longest: int = 256) -> tuple[list[Automaton], Automaton | None]:
    """Automata of the kinds that have credentials, and the one of other tokens."""
    labelled = found.select(F.explode(F.arrays_zip("kinds", "values")).alias("v")).select(F.col("v.kinds").alias("kind"), F.col("v.values").alias("value"))
    others = found.select(F.lit(len(KINDS)).alias("kind"), F.explode("tokens").alias("value"))
    drawn = {}
    for kind in range(len(KINDS) + 1):
        rows = (labelled.union(others).filter((F.col("kind") == kind) & (F.length("value") <= longest)).distinct()
                .orderBy(F.xxhash64("value"), "value").limit(sample))
        drawn[kind] = [symbols(r["value"]) for r in rows.select("value").collect()]  # sample values of bounded length
    return [Automaton(drawn[k]) for k in range(len(KINDS)) if drawn[k]], Automaton(drawn[len(KINDS)]) if drawn[len(KINDS)] else None


def likelihood_gain(token: str, known: list[Automaton], other: Automaton | None) -> float:
    """Bits a symbol by which the best credential format is likelier than the others' format."""
    if not known:
        return -math.inf
    format_ = symbols(token)
    rival = other.bits(format_) if other else math.log2(12)
    return rival - min(a.bits(format_) for a in known)


def scan(docs: DataFrame, margin: float = 0.5, **bounds) -> DataFrame:
    """Counts and spans of every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, best_gain."""

    def find(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            columns = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                text = text or ""
                longest = max(map(len, text.split()), default=0)
                spans = base_spans(text, longest)
                places = candidates(text, longest, spans)
                for column, value in zip(columns, ([s[1] for s in spans], [s[0] for s in spans], [s[2] for s in spans], [s[3] for s in spans],
                                                   [p[0] for p in places], [p[1] for p in places], [text[a:b] for a, b in places])):
                    column.append(value)
            yield batch.column(0), *columns

    found = land(each_batch(docs.select(F.col("doc_id").cast("long"), "text"), find,
                            "doc_id long, kinds array<int>, starts array<bigint>, ends array<bigint>, values array<string>, "
                            "token_starts array<bigint>, token_ends array<bigint>, tokens array<string>"), "spans")
    known, other = learn(found, **bounds)

    def score(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows, columns = batch.to_pylist(), [[] for _ in range(7)]
            for row in rows:
                base = list(zip(row["starts"], row["kinds"], row["ends"]))
                gains = [likelihood_gain(t, known, other) for t in row["tokens"]]
                added = [(s, len(KINDS), e) for s, e, gain in zip(row["token_starts"], row["token_ends"], gains) if gain >= margin]
                name = lambda spans: ",".join(f"{(*KINDS, ADDED)[k]}:{s}:{e}" for s, k, e in sorted(spans))
                for column, value in zip(columns, (*[row["kinds"].count(k) for k in range(3)], hashlib.sha256(name(base).encode()).hexdigest(),
                                                   name(base + added), len(added), max(gains, default=None))):
                    column.append(value)
            yield batch.column(0), *columns

    return each_batch(found, score, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
                                    "n_added long, best_gain double")
