"""Mixing and packing: targets, closeness, round trip of ids."""

import os
import sys
import zlib

import numpy as np
from public_tokenizers import path
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))
from corpus import frame, rows, texts  # noqa: E402

from shelfmark.llm import mixing, packing  # noqa: E402

VOCABULARY = path("byte_bpe_50k.json")


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        if not free:
            return {s: float(stopped[s]) for s in names}
        level = (total - sum(stopped.values())) / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not above:
            return {s: float(stopped[s]) if s in stopped else level * weight[s] for s in names}
        stopped |= {s: 3 * sizes[s] for s in above}


def check_mixture(spark, data):
    got = mixing.mixture(frame(spark, data)).collect()
    assert len(got) == len(data)
    sizes = {}
    for r in data:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    want = plain_targets(sizes)
    by_id = {r[0]: r[3] for r in data}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        source = by_id[r["doc_id"]]
        assert r["source_size"] == sizes[source] and abs(r["target"] - want[source]) < 1e-6 * max(1, want[source])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        taken[source] += r["taken"]
    for source in sizes:
        longest = max(len((r[1] or "").split()) for r in data if r[3] == source)
        assert abs(taken[source] - want[source]) <= longest
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixture(frame(spark, data)).collect()))


def test_mixture(spark):
    check_mixture(spark, [r for r in rows(400) if r[0] is not None and r[0] != 904])


def test_mixture_with_stopped_sources(spark):
    data = [(i, "w " * (i % 17), "en", s, 0, 0.0, 0, "", "", 0) for i, s in enumerate(["big"] * 300 + ["a"] * 3 + ["b"] * 5 + ["c"] + [None] * 2)]
    check_mixture(spark, data)


def test_mixture_odd_tables(spark):
    assert mixing.mixture(frame(spark, [])).count() == 0
    assert mixing.mixture(frame(spark)).count() == len(rows())
    assert [r["taken"] for r in mixing.mixture(texts(spark, ["", None])).collect()] == [0, 0]
    mixed = mixing.mixed(frame(spark))
    assert mixed.columns == frame(spark).columns


def check_pieces(pieces, data, width=1024):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = {}
    for r in data:
        want.setdefault(r[0], []).append(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0])
    of, sequences = {}, {}
    for p in pieces:
        of.setdefault(p["doc_id"], []).append(p)
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert of.keys() == want.keys()
    for doc, parts in of.items():
        if len(want[doc]) == 1:
            at, ids = 0, want[doc][0]
            for p in sorted(parts, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids)
                assert p["ids_crc32"] == zlib.crc32(np.array(ids[at:at + p["length"]], "<u4").tobytes())
                at += p["length"]
            assert at == len(ids)
        assert sum(p["length"] for p in parts) == sum(map(len, want[doc]))
    used = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= width
        used += at
    return used / (len(sequences) * width)


def test_pieces(spark):
    data = rows(600)
    pieces = packing.pack(frame(spark, data).coalesce(1), VOCABULARY).collect()
    assert check_pieces(pieces, data) > 0.98
    assert packing.pack(frame(spark, []), VOCABULARY).count() == 0


def test_small_shards_still_cover_every_id(spark):
    data = rows(80)
    check_pieces(packing.pack(frame(spark, data), VOCABULARY, shard_tokens=100).collect(), data)


def test_ids_equal_the_tokenizers(spark):
    odd = ["", " ", "  a  b ", "a b", "  x y", "don't we'll  it's\n\n x ", "1 2 3　 4", "日本 語 テキスト", "a\x0b b c", "a \x1c b", "x  y", "  z w",
           "tab\t and\ttab", "emoji 😀 👩‍👩‍👧 end", "<|endoftext", "a\r\n b",
           "hi <|endoftext|> there", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x  <|endoftext|>  y <|endoftext|>\n", "a <|<|endoftext|>|> b"]
    import pyarrow as pa

    tokenizer = Tokenizer.from_file(VOCABULARY)
    for group in (odd, odd[4:5], [r[1] or "" for r in rows(300)]):
        for text, ids in zip(group, packing.Tokens(VOCABULARY).of(pa.array(group), 0)):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [0]
        tokenizer.encode_special_tokens = True  # their strings are then ordinary text
        for text, ids in zip(group, packing.Tokens(VOCABULARY, added=False).of(pa.array(group), 0)):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [0]
        tokenizer.encode_special_tokens = False


def test_pieces_of_texts_with_added_tokens(spark):
    values = ["one <|endoftext|> two", "<|endoftext|>", "plain text", ("word <|endoftext|>" * 900)]
    data = [(i, t, "en", "a", len(t), 0.0, 0, "", "", 0) for i, t in enumerate(values)]
    check_pieces(packing.pack(texts(spark, values), VOCABULARY).collect(), data)


def test_costs_are_balanced():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 900, 3000).tolist()
    pieces = packing.assign(lengths, 1024, 1.0, 1 / 1024)
    cost = np.zeros(max(p[3] for p in pieces) + 1)
    for _, _, n, sequence, _ in pieces:
        cost[sequence] += n + n * n / 1024
    in_order, room, at = [0.0], 1024, 0  # the same documents one after another
    for n in lengths:
        while n:
            take = min(n, room)
            in_order[-1] += take + take * take / 1024
            n, room = n - take, room - take
            if not room:
                in_order.append(0.0)
                room = 1024
    assert cost.std() < 0.9 * np.std(in_order[:-1])


def plain_assign(lengths, width, linear, quadratic):
    pieces, rests, sequence = [], [], 0
    for document, n in enumerate(lengths):
        for start in range(0, n - width + 1, width):
            pieces.append((document, start, width, sequence, 0))
            sequence += 1
        if n % width:
            rests.append((n % width, document, n - n % width))
    bins = -(-sum(r[0] for r in rests) // width)
    room, cost = [width] * bins, [0.0] * bins
    for left, document, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        while left:
            fit = [b for b in range(bins) if room[b] >= left]
            b = min(fit, key=lambda b: (cost[b], b)) if fit else min(range(bins), key=lambda b: (-room[b], cost[b], b))
            n = min(left, room[b])
            pieces.append((document, start, n, sequence + b, width - room[b]))
            cost[b] += linear * n + quadratic * n * n
            room[b] -= n
            left, start = left - n, start + n
    return pieces


def test_every_sequence_is_searched():
    rng = np.random.default_rng(8)
    for width, count in ((1, 5), (2, 40), (7, 300), (100, 900), (1024, 900), (1024, 0)):
        lengths = rng.integers(0, 3 * width, count).tolist()
        assert packing.assign(lengths, width, 1.0, 1 / width) == plain_assign(lengths, width, 1.0, 1 / width)
