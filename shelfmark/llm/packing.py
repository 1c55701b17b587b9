"""Token sequences of equal width, packed so that their attention costs are near each other.

The cost of a piece of n tokens is ``linear * n + quadratic * n * n``.  Documents are cut into full sequences and
a rest; within a shard of about ``shard_tokens`` tokens the rests go, longest first, to the cheapest sequence
with room, and are cut where none has enough.  A shard opens as few sequences as its tokens need, so it wastes
less than one sequence.  Everything happens where the documents are read: nothing is shuffled.

Null text counts as empty (one token: the end id); rows with the same id are packed one by one; an empty table
gives no pieces.  Sequence ids join the partition and a counter, so they are unique and, for the same files,
the same in each run and each retry of a task.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import each_batch

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "cost double")
# Text that is split at once, so that the index arrays stay small.
SLICE_BYTES = 4 << 20
# A space between two characters that aren't white space always starts a token of its own.
WHITE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ODD = rf"(^|{WHITE}) | ({WHITE}|$)"
LEAD_ODD = rf"{WHITE} | ({WHITE}|$)"


@lru_cache(maxsize=2)
def encoder(path: str):
    """A byte-level BPE coder for a vocabulary file of the ``tokenizers`` library, and the ids of the file's added tokens.

    An added token stands for its string wherever a text holds it, as it does in that library.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    for token in held["added_tokens"]:
        if token["single_word"] or token["lstrip"] or token["rstrip"]:
            raise ValueError(f"added token {token['content']!r} takes in its surroundings")
    vocabulary, added = held["model"]["vocab"], {token["content"]: token["id"] for token in held["added_tokens"]}
    # Byte-level vocabularies write each byte as a printable character: the printable ones of Latin-1 as they are,
    # the others from 256 on.
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(map(byte_of.__getitem__, token)): rank for token, rank in vocabulary.items() if token not in added}
    return tiktoken.Encoding("documents", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), added


class Tokens:
    """Ids of many texts; a word that occurs often in a slice of texts is coded once.

    ``added=False`` takes the strings of added tokens as ordinary text.
    """

    def __init__(self, path: str, added: bool = True):
        self.coder, self.added = encoder(path)
        if not added:
            self.added = {}
        # Of added tokens that start at the same place the longest counts.
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        size = self.coder.max_token_value + 1
        self.bytes_of = np.zeros(size, np.int64)
        for token, rank in self.coder._mergeable_ranks.items():
            self.bytes_of[rank] = len(token)

    def _plain(self, text: str) -> np.ndarray:
        return self.coder.encode_to_numpy(text, disallowed_special=())

    def _ids(self, text: str) -> np.ndarray:
        """Ids of the parts between added tokens, each coded by itself, and the added tokens' own."""
        parts, at = [], 0
        for found in self.cut.finditer(text) if self.cut else ():
            parts += [self._plain(text[at:found.start()]), np.array([self.added[found[0]]], np.uint32)]
            at = found.end()
        return np.concatenate([*parts, self._plain(text[at:])]) if parts else self._plain(text)

    def of(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """Ids of each text (none null), each followed by ``end``."""
        ids, bounds = self.flat(texts, end)
        return np.split(ids, bounds[1:-1])

    def flat(self, texts: pa.Array, end: int | None = None, lead: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (none null) one after another, and where each text's begin and end.

        ``end`` is put after each text; with ``lead`` a space is put before it.
        """
        odd = pc.match_substring_regex(pc.binary_join_element_wise(" ", texts, "") if lead else texts, LEAD_ODD if lead else ODD)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        split = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        coded = split.flatten().dictionary_encode()
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        # Every distinct word in one text, each after a space: a token never crosses these spaces.
        words = pc.if_else(pc.equal(coded.dictionary, ""), "-", coded.dictionary)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        of_words = self._plain(" " + joined)
        reach = np.cumsum(self.bytes_of[of_words])
        word_ends = np.searchsorted(reach, np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1), side="left") + 1
        # What isn't coded by words: odd texts whole, and first words that have no space before them.
        alone = np.flatnonzero(odd.to_numpy(zero_copy_only=False)) if lead else np.arange(len(texts))
        whole = odd.to_numpy(zero_copy_only=False)
        firsts = []
        for i in alone.tolist():
            text = texts[i].as_py()
            firsts.append(self._ids((" " + text if lead else text) if whole[i] else text.partition(" ")[0]))
        n, count = len(words), len(firsts)
        last = [np.array([end], np.uint32)] if end is not None else []
        flat = np.concatenate([of_words, *firsts, *last])
        sizes = np.concatenate([np.diff(word_ends, prepend=0), np.fromiter(map(len, firsts), np.int64, count), np.ones(len(last), np.int64)])
        starts = np.cumsum(sizes) - sizes
        used = coded.indices.to_numpy().astype(np.int64)
        used[bounds[alone]] = n + np.arange(count)
        marks = bounds
        if last:
            used = np.insert(used, bounds[1:], n + count)
            marks = bounds + np.arange(len(bounds))
        lengths = sizes[used]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = flat[np.repeat(starts[used] - ends[:-1], lengths) + np.arange(int(ends[-1]))]
        return ids, ends[marks]


class Rooms:
    """The sequences of a shard by tokens of room, each room's in order of cost."""

    def __init__(self, bins: int, width: int):
        self.by_room: list[list[tuple[float, int]]] = [[] for _ in range(width + 1)]
        self.by_room[width] = [(0.0, b) for b in range(bins)]
        self.leaf = 1 << width.bit_length()
        # A tree over rooms: each node has the cheapest sequence below it.
        self.tree: list[tuple[float, int, int]] = [NONE] * (2 * self.leaf)
        self._refresh(width)

    def _refresh(self, room: int) -> None:
        heap, at = self.by_room[room], self.leaf + room
        self.tree[at] = (*heap[0], room) if heap else NONE
        while at > 1:
            at >>= 1
            self.tree[at] = min(self.tree[2 * at], self.tree[2 * at + 1])

    def put(self, cost: float, sequence: int, room: int) -> None:
        heapq.heappush(self.by_room[room], (cost, sequence))
        self._refresh(room)

    def take(self, least: int) -> tuple[float, int, int]:
        """The cheapest sequence with ``least`` tokens of room; where none has so much, the cheapest of those with the most room."""
        best, low, high = NONE, self.leaf + least, 2 * self.leaf
        while low < high:
            if low & 1:
                best, low = min(best, self.tree[low]), low + 1
            if high & 1:
                high -= 1
                best = min(best, self.tree[high])
            low, high = low >> 1, high >> 1
        if best is NONE:
            at = 1
            while at < self.leaf:
                at = 2 * at + (self.tree[2 * at + 1] is not NONE)
            best = self.tree[at]
        heapq.heappop(self.by_room[best[2]])
        self._refresh(best[2])
        return best


NONE = (float("inf"), -1, -1)


def assign(lengths: list[int], width: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; sequences count from 0."""
    pieces, rests, sequence = [], [], 0
    for document, n in enumerate(lengths):
        for start in range(0, n - width + 1, width):
            pieces.append((document, start, width, sequence, 0))
            sequence += 1
        if n % width:
            rests.append((n % width, document, n - n % width))
    rooms = Rooms(-(-sum(r[0] for r in rests) // width), width)
    for left, document, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        while left:
            cost, b, room = rooms.take(left)
            n = min(left, room)
            pieces.append((document, start, n, sequence + b, width - room))
            left, start = left - n, start + n
            if room > n:
                rooms.put(cost + linear * n + quadratic * n * n, b, room - n)
    return pieces


def pack(docs: DataFrame, vocabulary: str, *, id_column: str = "doc_id", text_column: str = "text", width: int = 1024,
         end_id: int = 0, linear: float = 1.0, quadratic: float = 1 / 1024, shard_tokens: int = 1 << 22) -> DataFrame:
    """One row per piece: ``PIECES``, with the piece's share of attention cost.

    ``vocabulary`` is the path of a byte-level BPE file, present on every executor.
    """

    def work(batches: Iterator[pa.RecordBatch]):
        tokens, base, made = Tokens(vocabulary), TaskContext.get().partitionId() << 40, 0
        held, size = [], 0

        def flush():
            nonlocal made
            rows = assign([len(ids) for _, ids in held], width, linear, quadratic)
            columns = [[] for _ in range(8)]
            for d, start, n, sequence, offset in rows:
                name, ids = held[d]
                for column, value in zip(columns, (name, start, n, zlib.crc32(ids[start:start + n]), len(ids),
                                                   base + made + sequence, offset, linear * n + quadratic * n * n)):
                    column.append(value)
            made += max((r[3] for r in rows), default=-1) + 1
            return columns

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            widths = pc.binary_length(texts).to_pylist()
            at = 0
            while at < len(names):
                to, taken = at, 0
                while to < len(names) and (to == at or taken + widths[to] <= SLICE_BYTES):
                    taken += widths[to]
                    to += 1
                for name, ids in zip(names[at:to], tokens.of(texts.slice(at, to - at), end_id)):
                    held.append((name, ids))
                    size += len(ids)
                at = to
                if size >= shard_tokens:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    pairs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return each_batch(pairs, work, PIECES)
