"""Near-duplicates: SimHash fingerprints that differ in few bits, found by fuzzy hashing with the Golay code.

A 64-bit fingerprint is cut into three segments.  Of two fingerprints that differ in at most two bits, one segment
is equal in both, and the segment after it differs in at most two bits.  The binary Golay code has 4096 words of
23 bits, at least 7 apart, and every vector is within 3 bits of one of them.  For two vectors at most two bits
apart there is a vector at most one bit from each; the code word nearest to it is within 4 bits of both.
So the key (which segment, its bits, index of a code word within 4 bits of the next segment) is shared by every linked
pair for one of the three segments.  A vector has one or six such code words, about 16 keys in all.

Rows that share a key are candidates.  A block of up to ``block_limit`` fingerprints is compared in full.  The
fingerprints of larger blocks are listed under themselves and their 64 neighbours at one bit instead: two of them are
within two bits exactly when they meet there, and at most 65 can meet, so work stays linear in any block.
Equal fingerprints are one node, so copies cost nothing here.

Null text counts as empty: no words, fingerprint zero.  Rows with a null id belong to a component but name none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import components, each_batch, land, raw_texts, unused

# Generator of the binary Golay code; lengths of the segments, from the top.
GENERATOR = 0b101011100011
SEGMENTS = (22, 21, 21)
LENGTH, CHECKS = 23, 11
AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles' XXH64; a bit is set if it is in over half of them."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    n, ones = len(words) - shingle + 1, np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        part = words[at:at + AT_ONCE + shingle - 1]
        hashes = np.array([xxh64_intdigest(b" ".join(s), seed) for s in zip(*(part[i:] for i in range(shingle)))], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def syndromes(vectors: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit vectors modulo the generator."""
    rest = vectors.astype(np.int64)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - CHECKS)), rest)
    return rest


def error_patterns(within: int = 4) -> np.ndarray:
    """For each syndrome the error patterns of up to ``within`` bits that have it; -1 fills the row."""
    patterns = np.array([sum(1 << b for b in bits) for weight in range(within + 1) for bits in combinations(range(LENGTH), weight)])
    found: list[list[int]] = [[] for _ in range(1 << CHECKS)]
    for pattern, syndrome in zip(patterns.tolist(), syndromes(patterns).tolist()):
        found[syndrome].append(pattern)
    widest = max(map(len, found))
    return np.array([row + [-1] * (widest - len(row)) for row in found], np.int64)


def keys_of(prints: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for unsigned 64-bit fingerprints."""
    shifts = np.cumsum((0,) + SEGMENTS[::-1])[:-1][::-1]
    parts = [(prints >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(shifts, SEGMENTS)]
    rows, keys = [], []
    for i, exact in enumerate(parts):
        fuzzy = parts[(i + 1) % len(parts)]
        errors = patterns[syndromes(fuzzy)]
        row, column = np.nonzero(errors >= 0)
        index = (fuzzy[row] ^ errors[row, column]) >> CHECKS
        rows.append(row)
        keys.append(i << 40 | exact[row] << 12 | index)
    return np.concatenate(rows), np.concatenate(keys)


def links_within(block: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a block that join the same fingerprints as all its links do."""
    group, links = list(range(len(block))), []

    def top(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i in range(len(block) - 1):
        for j in np.flatnonzero(np.bitwise_count(block[i] ^ block[i + 1:]) <= distance).tolist():
            a, b = top(i), top(i + 1 + j)
            if a != b:
                group[b] = a
                links.append((int(block[i].view(np.int64)), int(block[i + 1 + j].view(np.int64))))
    return links


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, print): the fingerprint as a signed 64-bit number."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in raw_texts(batch.column(1))], np.uint64)
            yield batch.column(0), pa.array(prints.view(np.int64))

    return each_batch(docs.select(F.col(id_column).cast("long"), text_column), work, "doc_id long, print long")


def links(nodes: DataFrame, distance: int = 2, block_limit: int = 256) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``nodes(print)`` that join all linked ones."""
    if distance != 2:
        raise ValueError("keys and neighbours hold for two bits")

    def key_rows(batches: Iterator[pa.RecordBatch]):
        patterns = error_patterns()
        for batch in batches:
            prints = batch.column(0).to_numpy()
            rows, keys = keys_of(prints.view(np.uint64), patterns)
            yield pa.array(keys), pa.array(prints[rows])

    def compare(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for block in batch.column(0):
                found = links_within(block.values.to_numpy().view(np.uint64), distance)
                yield [a for a, _ in found], [b for _, b in found]

    keyed = each_batch(nodes.select("print"), key_rows, "key long, print long")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = land(keyed.join(sizes, "key"), "candidates")
    blocks = shared.filter(F.col("n") <= block_limit).groupBy("key").agg(F.collect_list("print").alias("prints"))
    compared = each_batch(blocks.select("prints"), compare, "a long, b long")
    crowded = shared.filter(F.col("n") > block_limit).select("print").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    met = crowded.select("print", F.explode(flips).alias("flip")).select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("place"))
    stars = met.groupBy("place").agg(F.collect_list("print").alias("prints")).filter(F.size("prints") > 1)
    starred = stars.select(F.explode("prints").alias("a"), F.array_min("prints").alias("b"))
    return compared.union(starred).filter("a <> b")


def near_groups(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, print, component_id) of every document: the smallest id that can be reached over links."""
    prints = land(fingerprints(docs, **options), "prints")
    nodes = land(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes))
    rooted = nodes.join(roots, nodes["print"] == roots["node"]).select("print", "least", "root")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = rooted.join(smallest, "root").select(F.col("print").alias("_print"), "component_id")
    named = nodes.join(joined, F.col("print") == F.col("_print"), "left").select("print", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(named, "print").select("doc_id", "print", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest; rows without an id stay."""
    grouped, name = near_groups(docs), unused("_gone", docs)
    gone = (grouped.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
            .filter("not stays").select(F.col("doc_id").alias(name)))
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
