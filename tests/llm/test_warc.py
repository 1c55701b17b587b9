"""Archives: an exact round trip through WARC files, the loser tree, and the order of the index."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import warc

SCHEMA = "page_id long, url string, html string, _file string, _row int, content string, again int"
LONG = "<p>payload</p>" * 100


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)


ROWS = [
    (1, "http://www.Example.com:80/A?b=1#top", LONG), (2, "http://example.com/a", LONG + "é"), (3, "https://example.com:8080/", LONG), (4, None, None),
    (5, "http://a.b.example.org", ""), (6, "http://x.org/", "short"), (7, "http://x.org/", "short"), (8, "odd\r\nurl x", "a\r\n\r\nb\r\n"),
    (9, "http://x.org/", "\r\n\r\n" * 400), (10, "http://x.org/", "\r\n\r\r\n\r\n\n\r\n" * 200), (11, "http://x.org/", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 50),
    (12, "http://x.org/", "\r\n\r\n" * 400), (12, "http://x.org/", "\r\n\r\n" * 400), (None, "http://x.org/", LONG), (None, "http://y.org/", "\n" * 1000 + "é😀"),
    (None, "http://y.org/", "\n" * 1000 + "é😀"), (13, "http://x.org/", "z" * 999), (14, "http://x.org/", "z" * 999), (15, "http://x.org/", "w" * 1_500_000), (16, "http://x.org/q", "w" * 1_500_000),
    (17, "http://x.org/\tt", "﻿bom\x00nul\x85" * 200),
]
def hour():
    return F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) * 3600)


def plain(rows):
    """(page_id, bytes, digest, type, refers_to) of every row, as a sorted list."""
    groups = {}
    for i, (page, _, html) in enumerate(rows):
        body = (html or "").encode()
        if len(body) >= 1000:
            groups.setdefault(body, []).append((page is not None, page or 0, i))
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), body))
    result = []
    for i, (page, size, digest, body) in enumerate(out):
        best = max(groups[body]) if body in groups else None
        again = best is not None and best[2] != i
        result.append((page, size, digest, "revisit" if again else "response", (best[1] if best[0] else None) if again else None))
    return sorted(result, key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip(spark):
    found = warc.archived(pages(spark, ROWS), hour())
    assert rows_of(found) == plain(ROWS)
    assert found.filter("not intact").isEmpty()
    assert rows_of(warc.archived(pages(spark, ROWS).repartition(5), hour())) == plain(ROWS)
    assert warc.archived(pages(spark, []), hour()).collect() == []


def test_files_are_plain_archives(spark, tmp_path):
    folder = str(tmp_path / "warc")
    warc.write_archive(pages(spark, ROWS).coalesce(2), hour(), folder)
    bodies = []
    for file in (tmp_path / "warc").glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
            assert rest[size:size + 4] == b"\r\n\r\n" and {b"WARC-Record-ID", b"WARC-Date", b"WARC-Type"} <= fields.keys()
            if fields[b"WARC-Type"] == b"response":
                bodies.append(rest[:size].partition(b"\r\n\r\n")[2])
            data = rest[size + 4:]
    kept = [(r[2] or "").encode() for r in ROWS]
    assert sorted(set(bodies)) == sorted(set(kept))
    # Members appended later, as other writers do, and records of other kinds are read over.
    more = tmp_path / "more"
    more.mkdir()
    other = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    for file in (tmp_path / "warc").glob("*.gz"):
        (more / file.name).write_bytes(gzip.compress(other) + file.read_bytes() + gzip.compress(other))
    assert rows_of(warc.read_archive(spark, str(more))) == plain(ROWS)


def test_a_cut_archive_is_an_error(spark, tmp_path):
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Date: x\r\nContent-Length: 99\r\n\r\nabc"))
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_archive(spark, str(tmp_path)).collect()


def test_url_keys(spark):
    want = {"http://www.Example.com:80/A?b=1#top": "com,example)/A?b=1", "https://u:p@a.b.org:8080/x y": "org,b,a:8080)/x%20y", "http://h": "h)", None: "-", "mailto:x": "mailto:x", "": ""}
    frame = spark.createDataFrame([(k,) for k in want], "uri string")
    assert {r[0]: r[1] for r in frame.select("uri", warc.url_key(F.col("uri"))).collect()} == want


def test_loser_tree():
    rng = random.Random(4)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        iterators = [iter(r) for r in runs]
        tree, out = warc.LoserTree([next(i, None) for i in iterators]), []
        while tree.heads[tree.winner] is not None:
            out.append(tree.heads[tree.winner])
            tree.replace(next(iterators[tree.winner], None))
        assert out == sorted(x for r in runs for x in r)


def test_merge_of_chunks_holds_few(spark):
    rng = random.Random(5)
    for size in (1, 2, 7):
        runs = [sorted(f"{rng.randint(0, 50):03d}" for _ in range(rng.randint(0, 40))) for _ in range(9)]
        chunks = sorted(((r, run[i:i + size]) for r, run in enumerate(runs) for i in range(0, len(run), size)), key=lambda c: (c[1][0], c[0]))
        assert list(warc.merge(iter(chunks))) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("fan_in,chunk,spans", [(256, 128, None), (2, 3, 7), (3, 1, 1)])
def test_histories_are_in_one_order(spark, fan_in, chunk, spans):
    rng = random.Random(spans)
    lines = [f"{rng.choice(['com,hot)/', 'com,hot)/', 'org,a)/', 'org,b)/x', 'ü)/'])} {rng.randint(0, 99):014d} {{\"n\": {rng.randint(0, 9)}}}" for _ in range(700)]
    found = warc.histories(spark.createDataFrame([(x,) for x in lines], "line string").repartition(11), fan_in=fan_in, chunk=chunk, spans=spans).orderBy("position").collect()
    assert [r["line"] for r in found] == sorted(lines) and [r["position"] for r in found] == list(range(700))
    counts = {}
    for r in found:
        key = r["line"].split(" ")[0]
        assert (r["url_key"], r["capture"]) == (key, counts.get(key, 0))
        counts[key] = counts.get(key, 0) + 1
