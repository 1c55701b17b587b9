"""Alignment of two tokenizers: which ids of the one cover the same bytes as which ids of the other, over a whole corpus.

Tasks work on slices of texts as Arrow arrays.  Lists of ids are flattened beside their parent indices; the tokens' byte lengths, summed
up within each document, give the places where tokens end; a hash join of both tokenizers' (document, end) keys finds
the common ends, which cut a document into groups.  All tokens of a group are linked with each other.  Counts of the
documents that hold a pair of ids linked are taken by ``Table.group_by`` in shards of documents and summed by Spark.

A shard keeps the ids' pairs once, with the numbers of its documents' pairs beside them.  Only these pairs are joined to the corpus-wide
counts, and each shard gets its own back, so nothing is broadcast and the join grows with the distinct pairs of shards, not with tokens.
A pair that all shards have is one row a shard.

A document is a row; rows with equal ids are documents of their own.  Null and empty texts, and texts that the second tokenizer doesn't give
back byte for byte, have no tokens: zeros and an empty digest.  They hold no pair.  A group of very many tokens is
condensed to its distinct ids before it is linked.  Very long texts make a slice and a shard of their own.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import each_batch, land
from shelfmark.llm.packing import Tokens

SLICE_BYTES, SHARD_BYTES = 2 << 20, 16 << 20
# Links that are written out at once, and from how many links on a group is condensed.
AT_ONCE, LARGE = 4 << 20, 4096
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
SHARDS = ("shard long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, held array<int>, "
          "times array<int>, pairs array<long>, documents array<int>")
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Coder:
    """Ids of texts as lists, and the bytes of each id."""

    bytes_of: pa.Array

    def __init__(self, bytes_of: list[bytes]):
        self.bytes_of = pa.array(bytes_of, pa.binary())
        self.length_of = pc.binary_length(self.bytes_of).to_numpy().astype(np.int64)
        self.decimals = pa.array([str(i) for i in range(len(bytes_of))])

    def lists(self, texts: pa.Array) -> pa.ListArray:
        raise NotImplementedError


class ByteLevel(Coder):
    """A byte-level vocabulary of the ``tokenizers`` library; added tokens in texts are plain text."""

    def __init__(self, path: str):
        self.tokens = Tokens(path, added=False)
        held = [b""] * (self.tokens.coder.max_token_value + 1)
        for token, rank in self.tokens.coder._mergeable_ranks.items():
            held[rank] = token
        super().__init__(held)

    def lists(self, texts: pa.Array) -> pa.ListArray:
        ids, bounds = self.tokens.flat(texts, lead=True)
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))


class Pieces(Coder):
    """A ``sentencepiece`` model, which puts the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        held = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            held.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        super().__init__(held)

    def lists(self, texts: pa.Array) -> pa.ListArray:
        return pa.array(self.model.encode(texts.to_pylist(), num_threads=1), pa.list_(pa.int32()))


@lru_cache(maxsize=2)
def coders(path_a: str, path_b: str) -> tuple[Coder, Coder]:
    return ByteLevel(path_a), Pieces(path_b)


def _same(coder: Coder, lists: pa.ListArray, texts: pa.Array) -> pa.Array:
    """Whether the tokens' bytes, joined, are the text's after a space."""
    pieces = pa.ListArray.from_arrays(lists.offsets, pc.take(coder.bytes_of, lists.flatten()))
    return pc.equal(pc.binary_join(pieces, b""), pc.binary_join_element_wise(b" ", texts.cast(pa.binary()), b""))


class Flat:
    """The tokens of a slice: ids, the document of each, and where each ends in it."""

    def __init__(self, coder: Coder, lists: pa.ListArray):
        self.coder, self.lists = coder, lists
        self.ids = pc.list_flatten(lists).to_numpy()
        self.parent = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        summed = pc.cumulative_sum(pa.array(coder.length_of[self.ids])).to_numpy()
        self.offsets = lists.offsets.to_numpy()
        before = np.concatenate([[0], summed])[self.offsets[:-1]]  # a segment of the sum for each document
        self.ends = summed - before[self.parent]

    def keys(self, name: str) -> pa.Table:
        return pa.table({"key": (self.parent << 32) + self.ends, name: np.arange(len(self.ids))})

    def cut(self, at: np.ndarray) -> None:
        """Number the groups that end with the tokens ``at``."""
        common = np.zeros(len(self.ids), np.int64)
        common[at] = 1
        self.group = np.cumsum(common) - common
        self.starts = np.concatenate([[0], np.flatnonzero(common) + 1])

    def group_texts(self) -> pa.Array:
        decimals = pc.take(self.coder.decimals, pa.array(self.ids))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(self.starts, pa.int32()), decimals), ",")


def _condensed(flat: Flat, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, times): each token once, but in large groups each id once with how often it occurs."""
    many = large[flat.group]
    if not many.any():
        return flat.group, flat.ids.astype(np.int64), np.ones(len(flat.ids), np.int64)
    keys, times = np.unique((flat.group[many] << 32) + flat.ids[many], return_counts=True)
    group = np.concatenate([flat.group[~many], keys >> 32])
    order = np.argsort(group, kind="stable")
    return (group[order], np.concatenate([flat.ids[~many].astype(np.int64), keys & 0xFFFFFFFF])[order],
            np.concatenate([np.ones(int((~many).sum()), np.int64), times])[order])


def _links(a: Flat, b: Flat, document_of_group: np.ndarray, size_b: int) -> Iterator[pa.Table]:
    """(document, pair, times) of the links; a pair is one number, a document's pairs may come more than once."""
    count = len(document_of_group)
    large = np.bincount(a.group, minlength=count) * np.bincount(b.group, minlength=count) > LARGE
    (group_a, id_a, times_a), (group_b, id_b, times_b) = _condensed(a, large), _condensed(b, large)
    width = np.bincount(group_b, minlength=count)
    start = np.cumsum(width) - width
    each = width[group_a]
    reach = np.cumsum(each)
    at = 0
    while at < len(group_a):
        to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + AT_ONCE, side="right")))
        n = each[at:to]
        row = np.repeat(np.arange(at, to), n)
        other = np.repeat(start[group_a[at:to]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        table = pa.table({"document": document_of_group[group_a[row]], "pair": id_a[row] * size_b + id_b[other], "times": times_a[row] * times_b[other]})
        yield table.group_by(["document", "pair"], use_threads=False).aggregate([("times", "sum")]).rename_columns(["document", "pair", "times"])
        at = to


def align_slice(texts: pa.Array, coder_a: Coder, coder_b: Coder) -> tuple[np.ndarray, list[str], pa.Table]:
    """For each text the four counts and the digest of its groups, and (document, pair, times) of all links."""
    size = len(texts)
    lists_a, lists_b = coder_a.lists(texts), coder_b.lists(texts)
    whole = pc.and_(pc.and_(_same(coder_a, lists_a, texts), _same(coder_b, lists_b, texts)), pc.greater(pc.binary_length(texts), 0))
    kept = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
    counts, digests = np.zeros((size, 4), np.int64), [""] * size
    none = pa.table({"document": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()), "times": pa.array([], pa.int64())})
    if not len(kept):
        return counts, digests, none
    a, b = (Flat(c, pc.take(x, pa.array(kept))) for c, x in ((coder_a, lists_a), (coder_b, lists_b)))
    common = a.keys("at_a").join(b.keys("at_b"), "key", join_type="inner", use_threads=False)
    a.cut(common.column("at_a").to_numpy())
    b.cut(common.column("at_b").to_numpy())
    document_of_group = a.parent[a.starts[:-1]]
    groups = np.bincount(document_of_group, minlength=len(kept))
    links = np.bincount(a.group) * np.bincount(b.group)
    counts[kept] = np.stack([np.diff(a.offsets), np.diff(b.offsets), groups,
                             np.add.reduceat(links, np.cumsum(groups) - groups)], axis=1)
    told = pc.binary_join_element_wise(a.group_texts(), b.group_texts(), "|")
    offsets = pa.array(np.concatenate([[0], np.cumsum(groups)]), pa.int32())
    for i, joined in zip(kept.tolist(), pc.binary_join(pa.ListArray.from_arrays(offsets, told), ";").cast(pa.binary())):
        digests[i] = hashlib.sha256(joined.as_buffer()).hexdigest()
    found = pa.concat_tables([none, *_links(a, b, kept[document_of_group], len(coder_b.bytes_of))])
    return counts, digests, found


def _shard(number: int, names: list, counts: list, digests: list, links: list[pa.Table]) -> Iterator[tuple]:
    """A row for each document, and one with the shard's pairs and how many of its documents hold each."""
    table = pa.concat_tables(links)
    if table.num_rows:  # a document's links may come in several parts
        table = table.group_by(["document", "pair"], use_threads=False).aggregate([("times", "sum")]).rename_columns(["document", "pair", "times"])
    coded = table.column("pair").combine_chunks().dictionary_encode()
    table = table.append_column("held", coded.indices)
    part = table.group_by("held", use_threads=False).aggregate([("held", "count")])
    documents = np.zeros(len(coded.dictionary), np.int32)
    documents[part.column("held").to_numpy()] = part.column("held_count").to_numpy()
    order = np.argsort(table.column("document").to_numpy(), kind="stable")
    size = len(names)
    bounds = pa.array(np.searchsorted(table.column("document").to_numpy()[order], np.arange(size + 1)), pa.int32())
    listed = lambda name: pa.ListArray.from_arrays(bounds, pa.array(table.column(name).to_numpy()[order].astype(np.int32)))
    total = np.concatenate(counts) if counts else np.zeros((0, 4), np.int64)
    yield ([number] * size, names, *(pa.array(total[:, k]) for k in range(4)), digests, listed("held"), listed("times"), [None] * size, [None] * size)
    if len(documents):
        yield ([number], [None], [None], [None], [None], [None], [None], [None], [None], [coded.dictionary.to_numpy()], [documents])


def shards(docs: DataFrame, path_a: str, path_b: str, *, id_column: str = "doc_id", text_column: str = "text",
           slice_bytes: int = SLICE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``SHARDS``: the rows of documents (``pairs`` null), and a row with the pairs of each shard."""

    def work(batches: Iterator[pa.RecordBatch]):
        coder_a, coder_b = coders(path_a, path_b)
        number, size = TaskContext.get().partitionId() << 32, 0
        names, counts, digests, links = [], [], [], []
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            widths = pc.binary_length(texts).to_pylist()
            at = 0
            while at < len(ids):
                to, taken = at, 0
                while to < len(ids) and (to == at or taken + widths[to] <= slice_bytes):
                    taken += widths[to]
                    to += 1
                own, told, found = align_slice(texts.slice(at, to - at), coder_a, coder_b)
                links.append(found.set_column(0, "document", pc.add(found.column("document"), len(names))))
                names += ids[at:to]
                counts.append(own)
                digests += told
                at, size = to, size + taken
                if size >= shard_bytes:
                    yield from _shard(number, names, counts, digests, links)
                    number, size = number + 1, 0
                    names, counts, digests, links = [], [], [], []
        if names:
            yield from _shard(number, names, counts, digests, links)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return each_batch(rows, work, SHARDS)


def pair_counts(landed: DataFrame) -> DataFrame:
    """(pair, n, best): the documents that hold each pair of ids, and whether no other pair of its first id has more."""
    pairs = landed.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "documents")).alias("p"))
    counts = pairs.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.documents").alias("n"))
    return counts


def aligned(docs: DataFrame, path_a: str, path_b: str, **options) -> DataFrame:
    """``RESULT``: a row for each document."""
    size_b = len(coders(path_a, path_b)[1].bytes_of)
    landed = land(shards(docs, path_a, path_b, **options), "aligned")
    counts = land(pair_counts(landed), "pairs").withColumn("a", F.floor(F.col("pair") / size_b))
    tops = counts.groupBy("a").agg(F.max("n").alias("top"))
    counts = counts.join(tops, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    wanted = landed.filter("pairs is not null").select("shard", F.posexplode("pairs").alias("held", "pair"))
    looked_up = wanted.join(counts, "pair").select(F.col("shard").alias("of_shard"), "held", "n", "best")
    rows = landed.filter("pairs is null").drop("pairs", "documents")

    def summed(own: pa.Table, looked: pa.Table) -> pa.Table:
        held = looked.column("held").to_numpy()
        n, best = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
        n[held], best[held] = looked.column("n").to_numpy(), looked.column("best").to_numpy().astype(np.int64)
        lists = own.column("held").combine_chunks()
        flat, times = lists.flatten().to_numpy(), own.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()

        def per_document(values):
            reach = np.concatenate([[0], np.cumsum(values)])
            return pa.array(reach[offsets[1:]] - reach[offsets[:-1]])

        return pa.table([own.column("doc_id"), *(own.column(c) for c in COUNTS), per_document(times * best[flat]), per_document(times * n[flat]),
                         own.column("groups_sha256")], names=[part.split()[0] for part in RESULT.split(", ")])

    return rows.groupBy("shard").cogroup(looked_up.groupBy("of_shard")).applyInArrow(summed, RESULT)
