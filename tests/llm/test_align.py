"""Alignment of two tokenizers against plain loops over the libraries' own ids."""

import hashlib
import os
import random
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece
from public_tokenizers import path
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))
from corpus import frame, rows, texts  # noqa: E402

from shelfmark.llm import align  # noqa: E402

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
ODD = [None, "", " ", "  two  spaces ", "a▁b", "tab\t and\n\nlines \r\n", "<|endoftext|> in <|endoftext|>text", "</s> <s> <unk> <0x41>", "日本語テキスト と 漢字", "emoji 😀👩‍👩‍👧 ﬁ ½ ",
       "é̂ combining ü", "naïve façade", "nul\x00 x\x07", "\n", "the the the", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 30, "ﬁ" * 3000, "𝔘𝔫𝔦 " * 5, "x" * 5000, "0123456789 " * 40,
       " " * 400, "﻿bom", "a b c", "ﷺ" * 60]


def plain(values):
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    plain_bytes = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in plain_bytes} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain_bytes)}
    bytes_a = lambda i: bytes(byte_of[c] for c in tokenizer.id_to_token(i))
    bytes_b = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    documents, counts = [], Counter()
    for text in values:
        whole = " " + (text or "")
        a, b = tokenizer.encode(whole, add_special_tokens=False).ids, model.encode(text or "")
        if not text or b"".join(map(bytes_a, a)) != whole.encode() or b"".join(map(bytes_b, b)) != whole.encode():
            documents.append(None)
            continue
        ends = lambda ids, size: np.cumsum([len(size(i)) for i in ids]).tolist()
        ends_a, ends_b = ends(a, bytes_a), ends(b, bytes_b)
        common, groups = sorted(set(ends_a) & set(ends_b)), []
        at_a = at_b = 0
        for end in common:
            to_a, to_b = ends_a.index(end, at_a) + 1, ends_b.index(end, at_b) + 1
            groups.append((a[at_a:to_a], b[at_b:to_b]))
            at_a, at_b = to_a, to_b
        links = Counter()
        for x, y in groups:
            for i, n in Counter(x).items():
                for j, m in Counter(y).items():
                    links[i, j] += n * m
        counts.update(links.keys())
        documents.append((len(a), len(b), groups, links))
    top = {}
    for (i, _), n in counts.items():
        top[i] = max(n, top.get(i, 0))
    out = []
    for d in documents:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = d
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if counts[p] == top[p[0]]),
                    sum(n * counts[p] for p, n in links.items()), hashlib.sha256(told.encode()).hexdigest()))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def check(docs, values, ids=None, **options):
    got = align.aligned(docs, A, B, **options)
    assert [name for name, _ in got.dtypes] == ["doc_id", *COLUMNS[:6], "groups_sha256"]
    found = sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got.collect()), key=str)
    assert found == sorted(((i, *row) for i, row in zip(range(len(values)) if ids is None else ids, plain(values))), key=str)


def test_odd_texts(spark):
    check(texts(spark, ODD), ODD)
    check(texts(spark, ODD).coalesce(1), ODD, slice_bytes=100, shard_bytes=300)


def test_rows_with_nulls_repeats_and_long_texts(spark):
    data = rows(200)
    check(frame(spark, data), [r[1] for r in data], [r[0] for r in data])
    assert align.aligned(frame(spark, []), A, B).collect() == []
    check(texts(spark, [None, ""]), [None, ""])


def test_large_groups_are_condensed(spark, monkeypatch):
    rng = random.Random(2)
    values = ["".join(rng.choice("ab") for _ in range(400)) + " end" for _ in range(20)] + ODD
    coders = align.coders(A, B)
    _, _, want = align.align_slice(pa.array([v or "" for v in values]), *coders)
    monkeypatch.setattr(align, "LARGE", 2)
    monkeypatch.setattr(align, "AT_ONCE", 7)
    _, _, got = align.align_slice(pa.array([v or "" for v in values]), *coders)
    total = lambda t: sorted(zip(*t.group_by(["document", "pair"]).aggregate([("times", "sum")]).to_pydict().values()))
    assert total(got) == total(want)
