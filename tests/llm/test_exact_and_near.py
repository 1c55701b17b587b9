"""Exact and near duplicates against brute force."""

import hashlib
import os
import sys

import numpy as np
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from corpus import frame, rows, texts  # noqa: E402

from shelfmark.llm import exact, golay, mixing, toxicity, weak  # noqa: E402


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected_groups(data):
    groups = {}
    for r in data:
        groups.setdefault(lower(r[1]), []).append(r[0])
    out = []
    for text, ids in groups.items():
        best = max(ids, key=lambda i: (i is not None, i))
        kept = [False] * len(ids)
        kept[ids.index(best)] = True
        out += [(i, best, len(ids), k, hashlib.sha256(text.encode()).hexdigest()) for i, k in zip(ids, kept)]
    return sorted(out, key=repr)


def test_exact_groups(spark):
    got = sorted((tuple(r) for r in exact.exact_groups(frame(spark)).collect()), key=repr)
    assert got == expected_groups(rows())


def test_exact_empty(spark):
    assert exact.exact_groups(frame(spark, [])).count() == 0
    assert exact.distinct_texts(frame(spark, [])).count() == 0


def test_exact_bytes_decide_when_digests_collide(spark):
    got = exact.exact_groups(frame(spark), digest=lambda text: F.unhex(F.lpad(F.hex(F.crc32(text.cast("binary")) % 5), 2, "0")))
    want = sorted([r[:4] for r in expected_groups(rows())], key=repr)
    assert sorted([tuple(r)[:4] for r in got.collect()], key=repr) == want


def test_exact_state_goes_on_between_arrivals_and_batches(spark):
    data = rows()
    seen = exact.Seen(spark, files_per_batch=1)
    for part in (data[:50], data[50:90]):
        exact.decide(seen.located(frame(spark, part)), seen)
    last = exact.decide(seen.located(frame(spark, data[90:])), seen)
    assert sorted([(r["id"], r["keep_id"], r["group_size"]) for r in last.collect()], key=repr) == of_rows(data[90:], data)


def of_rows(part, data):
    """(id, keep_id, group_size) for each row of ``part`` among all of ``data``."""
    groups = {}
    for r in data:
        groups.setdefault(lower(r[1]), []).append(r[0])
    best = lambda ids: max(ids, key=lambda i: (i is not None, i))
    return sorted(((r[0], best(groups[lower(r[1])]), len(groups[lower(r[1])])) for r in part), key=repr)


def test_texts_of_earlier_calls_count_when_digests_collide(spark):
    one = lambda text: F.unhex(F.lit("00"))
    seen = exact.Seen(spark, digest=one)
    for first, values in ((0, ["x", "y", "x"]), (10, ["x", "z"]), (5, ["Z", "y", "w"])):
        part = [(first + i, v, "en", "a", 1, 0.0, 0, "", "", 0) for i, v in enumerate(values)]
        data = [*(data if first else []), *part]
        got = exact.decide(seen.located(frame(spark, part)), seen)
        assert sorted([(r["id"], r["keep_id"], r["group_size"]) for r in got.collect()], key=repr) == of_rows(part, data)


def test_a_named_arrival_counts_once(spark, tmp_path):
    frame(spark, rows()[:40]).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    options = {"folder": str(tmp_path / "seen"), "batch": "monday"}
    first = sorted(map(tuple, exact.exact_groups(docs, **options).collect()), key=repr)
    assert sorted(map(tuple, exact.exact_groups(docs, **options).collect()), key=repr) == first == expected_groups(rows()[:40])


CLASHES = ("_file", "_row", "_all", "body", "digest", "_gone", "__gone", "_size", "_copies", "_copy", "_position", "_at", "_part", "_source", "_target", "size",
           "row", "copies", "_drawn", "drawn", "labelled", "y", "_salt", "_hot", "position")


def clashing(spark):
    """Rows that have columns of all the names that operators use."""
    base = frame(spark).select("doc_id", "text", "lang", "source")
    return base.select("*", *[F.lit(70 + i).alias(name) for i, name in enumerate(CLASHES)])


def test_names_that_clash(spark):
    docs = clashing(spark)
    told = {name: 70 + i for i, name in enumerate(CLASHES)}
    for kept in (exact.distinct_texts(docs), golay.one_of_each(docs), mixing.mixed(docs)):
        assert kept.columns == docs.columns
        found = kept.collect()
        assert found and all(r[name] == value for r in found for name, value in told.items())
    got = sorted((tuple(r) for r in exact.exact_groups(docs).collect()), key=repr)
    assert got == expected_groups(rows())
    assert weak.label_and_score(docs).count() == toxicity.scores(docs, toxicity.train(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int"))).count() == len(rows())


def test_rows_with_one_id_are_learnt_from_once(spark, monkeypatch):
    many = frame(spark, [(7, f"word{i} other", "en", "a", 1, 0.0, 0, "", "", 0) for i in range(300)] + rows()[:60])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    sizes = []
    monkeypatch.setattr(toxicity, "_descend", lambda table, y, place, fit: sizes.append(len(table)) or toxicity.Machine(place, 0.0, np.zeros(fit.terms + 1), np.zeros((fit.terms + 1, fit.factors))))
    fits = []
    monkeypatch.setattr(weak, "fit", lambda table, y: fits.append([len(p) for p, _ in table]) or np.zeros((1 << weak.BITS) + weak.SHAPES * 10 + 1))
    toxicity.train(many, labels, toxicity.Fit(rows=20, least=0.0))
    weak.label_and_score(many, sample=20).count()
    assert sizes == [20] and [len(f) for f in fits] == [20]


def test_distinct_texts_keep_columns_and_one_row_a_text(spark):
    kept = exact.distinct_texts(frame(spark))
    assert kept.columns == frame(spark).columns
    found = [lower(r["text"]) for r in kept.collect()]
    assert len(found) == len(set(found)) == len({lower(r[1]) for r in rows()})


def plain_print(text):
    words = [w for w in lower(text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    least = list(range(len(prints)))

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = top(i), top(j)
                least[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(top(i), []).append(ids[i])
    names = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return [names[top(i)] for i in range(len(prints))]


def test_near_groups_match_brute_force(spark):
    data = rows(200)
    prints = [plain_print(r[1]) for r in data]
    roots = plain_components(prints, [r[0] for r in data])
    want = sorted([(r[0], p, c) for r, p, c in zip(data, prints, roots)], key=repr)
    got = golay.near_groups(frame(spark, data)).collect()
    assert sorted([(r["doc_id"], r["print"] % (1 << 64), r["component_id"]) for r in got], key=repr) == want
    assert golay.near_groups(frame(spark, [])).count() == 0
    kept = golay.one_of_each(frame(spark, data))
    assert kept.columns == frame(spark, data).columns
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == {c for (i, _, c) in want if i == c and i is not None}


def test_every_link_within_two_bits_is_found(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = set(centres.tolist())
    for c in centres[:20].tolist():  # chains and balls of neighbours
        at = c
        for _ in range(30):
            at ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
            prints.add(at)
            prints.add(c ^ (1 << int(rng.integers(64))))
    prints = sorted(prints)
    want = plain_components(prints, prints)
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "print long")
    for limit in (2, 256):  # all blocks crowded, and none
        groups = {r["node"] % (1 << 64): r["root"] for r in golay.components(golay.links(nodes, block_limit=limit)).collect()}
        got = {}
        for p in prints:
            got.setdefault(groups.get(p, ("alone", p)), set()).add(p)
        expected = {}
        for p, c in zip(prints, want):
            expected.setdefault(c, set()).add(p)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_golay_patterns():
    patterns = golay.error_patterns()
    counts = (patterns >= 0).sum(axis=1)
    assert set(counts.tolist()) == {1, 6}  # one code word within four bits, or six
    rng = np.random.default_rng(2)
    for _ in range(200):
        v = int(rng.integers(1 << 23))
        w = v ^ (1 << int(rng.integers(23))) ^ (1 << int(rng.integers(23)))
        words = [{(x ^ e) for e in patterns[golay.syndromes(np.array([x]))[0]].tolist() if e >= 0} for x in (v, w)]
        assert words[0] & words[1]


def test_near_copies_of_long_texts_link(spark):
    base = " ".join(f"token{i}" for i in range(3000))
    got = golay.near_groups(texts(spark, [base, base + " tail", base.replace("token7 ", "other ")])).collect()
    assert {r["component_id"] for r in got} == {0}
