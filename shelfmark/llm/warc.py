"""Web archives: pages written as WARC records, read back, and indexed by an external merge.

**Writing.** Every page becomes a record of WARC 1.1.  Of the pages with equal payloads of at least ``least`` bytes the one with the
largest id (then the last place in the input) is a ``response``; the others are ``revisit`` records that name it and carry no
payload.  A record ends with two line ends, which is the line separator of Spark's text sink, so executors write the
archives through Spark to wherever the cluster keeps them, one gzip file a task.

**Reading.** A gzip file is read by one task from its start.  The pieces between double line ends are put together again by the lengths
that the headers state, so payloads may hold anything.  Digests are taken from the payloads read.

**Index.** Each record gives a line ``urlkey timestamp json`` (CDXJ).  Each task sorts its own lines, which makes a run; runs are
cut into chunks at splitters of the key order.  A range of keys is merged by a loser tree whose leaves are the runs.  Chunks arrive in
order of their first line, so a chunk is opened only when the merge gets there, and a task holds about a chunk a run;
where there are more than ``fan_in`` runs, groups of them are merged to longer runs first.  Splitters are whole lines
(key, time, record), so the captures of one address may lie in many ranges.  The result is the globally ordered history: each
capture's place in the order, and its number among the captures of its address.

A null payload is empty, a null address reads back as null and has the key ``-``; null ids are the smallest.  Line ends and blanks in an
address are written percent-encoded.  Equal rows are records of their own; one of them may be the response.  Other columns are ignored.
An empty table gives archives without records.  Very long payloads pass through a task one record at a time.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import each_batch, joined_to_one, land, located, shared_folder

BREAK = "\r\n"
RECORD_END = BREAK * 2
LEAST = 1000

RECORD = ("file string, offset long, length long, record_type string, page_id long, uri string, date string, payload_digest string, "
          "payload_bytes long, refers_to long, intact boolean")


# ---- writing ------------------------------------------------------------------------------------------------------


def write_archive(pages: DataFrame, captured: Column, folder: str, *, id_column: str = "page_id", url_column: str = "url",
                  payload_column: str = "html", least: int = LEAST) -> None:
    """Write ``pages`` as gzip WARC files to ``folder``; ``captured`` is the time of each capture."""
    payload = F.coalesce(F.col(payload_column).cast("string"), F.lit(""))
    moment = F.date_format(F.to_utc_timestamp(captured, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = located(pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), moment.alias("date"),
                                payload.alias("payload")))
    small = land(rows.select("page_id", "_file", "_row", F.octet_length("payload").alias("size"), F.unhex(F.sha2("payload", 256)).alias("content")),
                 "payloads").filter(F.col("size") >= least)
    place = F.struct("page_id", "_file", "_row")
    firsts = small.groupBy("content").agg(F.max(place).alias("best"), F.count("*").alias("copies")).filter("copies > 1")
    again = joined_to_one(small, firsts, "content", "copies", F.xxhash64("_file", "_row")).filter(
        (F.col("_file") != F.col("best._file")) | (F.col("_row") != F.col("best._row"))).select(
        "_file", "_row", F.lit(True).alias("again"), F.col("best.page_id").alias("refers_to"), F.md5(F.concat("best._file", F.lit(":"), "best._row")).alias("original"))
    marked = rows.join(again, ["_file", "_row"], "left")
    marked.select(_record().alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").text(folder)


def _urn(digits: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def _record() -> Column:
    """The whole record but for its last line ends."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    url = F.col("url")
    for char, code in ((" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        url = F.replace(url, F.lit(char), F.lit(code))
    again = F.coalesce("again", F.lit(False))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(RECORD_END))
    block = F.concat(http, F.when(again, "").otherwise(F.col("payload")))
    refers = F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                      line("WARC-Refers-To", _urn(F.col("original"))), optional("X-Refers-To-Page-ID", F.col("refers_to").cast("string")))
    return F.concat(
        F.lit(f"WARC/1.1{BREAK}"), line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(F.md5(F.concat("_file", F.lit(":"), "_row")))), line("WARC-Date", F.col("date")), optional("WARC-Target-URI", url),
        optional("X-Page-ID", F.col("page_id").cast("string")), F.when(again, refers).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("payload"))), line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(BREAK), block)


# ---- reading ------------------------------------------------------------------------------------------------------


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record below ``folder``: ``RECORD``.  ``offset`` counts the bytes of the file unpacked."""
    pieces = spark.read.option("lineSep", RECORD_END).text(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))

    def work(batches: Iterator[pa.RecordBatch]):
        file, stream = None, None
        for batch in batches:
            rows = []
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != file:
                    if stream:
                        stream.close()
                    file, stream = name, _Stream(name)
                rows += stream.feed(piece)
            yield list(zip(*rows)) or [[]] * 11
        if stream:
            stream.close()

    return each_batch(pieces, work, RECORD)


class _Stream:
    """One archive, piece by piece."""

    def __init__(self, file: str):
        self.file, self.held, self.offset = file, bytearray(), 0
        self.head = self.need = None

    def feed(self, piece: bytes) -> list[tuple]:
        self.held += piece + RECORD_END.encode()
        out = []
        while True:
            if self.head is None:
                lead = len(self.held) - len(self.held.lstrip(b"\r\n"))
                if lead:
                    del self.held[:lead]
                    self.offset += lead
                end = self.held.find(RECORD_END.encode())
                if end < 0:
                    return out
                self.head = _fields(bytes(self.held[:end]))
                self.start, self.need = end + 4, end + 4 + int(self.head["content-length"])
            if len(self.held) < self.need:
                return out
            row = _row(self.head, bytes(self.held[self.start:self.need]))
            if row:
                out.append((self.file, self.offset, self.need, *row))
            del self.held[:self.need]
            self.offset += self.need
            self.head = None

    def close(self) -> None:
        if self.head or self.held.strip(b"\r\n"):
            raise ValueError(f"{self.file} ends inside a record")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split(BREAK)
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record starts with {lines[0][:40]!r}")
    pairs = (line.partition(":") for line in lines[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _row(head: dict[str, str], block: bytes) -> tuple | None:
    """What is told of a response or revisit; other records have no row."""
    if head["warc-type"] not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(RECORD_END.encode())
    told = head.get("warc-payload-digest", "").removeprefix("sha1:")
    number = lambda name: int(head[name]) if name in head else None
    common = (head["warc-type"], number("x-page-id"), head.get("warc-target-uri"), head["warc-date"])
    if head["warc-type"] == "revisit":
        stated = [line.partition(b":")[2] for line in http.split(BREAK.encode()) if line.lower().startswith(b"content-length:")]
        return (*common, told, int(stated[0]) if stated else None, number("x-refers-to-page-id"), True)
    digest = hashlib.sha1(payload).hexdigest()
    return (*common, digest, len(payload), None, told in ("", digest))


# ---- index --------------------------------------------------------------------------------------------------------


def url_key(uri: Column) -> Column:
    """The address in sorting order: host parts from the last on, then port, path and query; scheme, user, ``www.`` and fragment go."""
    form = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]*)(?::(\d+))?([^#]*)"
    host = F.regexp_replace(F.lower(F.regexp_extract(uri, form, 1)), r"^www\.", "")
    port = F.regexp_extract(uri, form, 2)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)),
                   F.lit(")"), F.regexp_extract(uri, form, 3))
    return F.replace(F.coalesce(F.when(host != "", key).otherwise(uri), F.lit("-")), F.lit(" "), F.lit("%20"))


ENTRY = "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, intact boolean, file string, offset long, length long"


def index_lines(records: DataFrame) -> DataFrame:
    """The line of each record of ``read_archive``."""
    names = [part.split()[0] for part in ENTRY.split(", ")]
    moment = F.regexp_replace("date", "[^0-9]", "")
    return records.select(F.concat_ws(" ", url_key(F.col("uri")), moment, F.to_json(F.struct(*names))).alias("line"))


class LoserTree:
    """The smallest head of several runs.  Each inner node keeps the loser of the match there, the root the winner.

    An exhausted run's head is None and loses every match; of equal heads the earlier run's wins.
    """

    def __init__(self, heads: list[str | None]):
        self.heads, self.k = heads, len(heads)
        self.losers = [-1] * max(1, self.k)
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x < y or x == y and a < b)

    def replace(self, head: str | None) -> None:
        """Give the winner's run its next head and play its matches again."""
        leaf = self.winner
        self.heads[leaf] = head
        node = (leaf + self.k) >> 1
        while node:
            if self._before(self.losers[node], leaf):
                self.losers[node], leaf = leaf, self.losers[node]
            node >>= 1
        self.winner = leaf


def merge(chunks: Iterator[tuple[int, list[str]]]) -> Iterator[str]:
    """Merge the chunks (run, sorted lines) of sorted runs, given in order of their first lines."""
    leaf_of: dict[int, int] = {}
    waiting: list[deque] = []     # chunks of each run; the first is being read
    reading: list[Iterator] = []
    tree, coming = LoserTree([None]), next(chunks, None)
    while True:
        if coming and (tree.heads[tree.winner] is None or coming[1][0] <= tree.heads[tree.winner]):
            heads = tree.heads[:len(waiting)]
            while coming and ((low := min((h for h in heads if h is not None), default=None)) is None or coming[1][0] <= low):
                run, lines = coming
                leaf = leaf_of.setdefault(run, len(waiting))
                if leaf == len(waiting):
                    waiting.append(deque())
                    reading.append(iter(()))
                    heads.append(None)
                waiting[leaf].append(lines)
                if heads[leaf] is None:
                    reading[leaf] = iter(waiting[leaf].popleft())
                    heads[leaf] = next(reading[leaf])
                coming = next(chunks, None)
            tree = LoserTree(heads)
        if (line := tree.heads[tree.winner]) is None:
            return
        yield line
        leaf = tree.winner
        after = next(reading[leaf], None)
        if after is None and waiting[leaf]:
            reading[leaf] = iter(waiting[leaf].popleft())
            after = next(reading[leaf])
        tree.replace(after)


CHUNK = "span int, run long, first string, lines array<string>"
ORDERED = "span int, nth long, key string, nth_of_key long, line string"


def _chunked(span: int, run: int, lines: Iterator[str], size: int):
    """Columns of ``CHUNK`` rows, a few at a time."""
    held: list[str] = []
    for line in lines:
        held.append(line)
        if len(held) == size:
            yield [span], [run], [held[0]], [held]
            held = []
    if held:
        yield [span], [run], [held[0]], [held]


def _chunks_by(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]):
    """Consecutive groups of chunk rows with equal ``key``: (key, iterator of (run, lines)); each must be read to its end."""
    rows = ((tuple(batch.column(name)[i].as_py() for name in key), batch.column("run")[i].as_py(), batch.column("lines")[i].as_py())
            for batch in batches for i in range(batch.num_rows))
    ahead = [next(rows, None)]

    def own(now):
        while ahead[0] and ahead[0][0] == now:
            yield ahead[0][1:]
            ahead[0] = next(rows, None)

    while ahead[0]:
        now = ahead[0][0]
        yield now, own(now)


def ordered(lines: DataFrame, *, fan_in: int = 256, chunk: int = 128, span_lines: int = 250_000, spans: int | None = None) -> DataFrame:
    """``lines(line)`` in one global order: ``ORDERED``, the place ``nth`` in each span (a range of lines) and the number of
    each line among those of its span with the same first word."""
    spark = lines.sparkSession
    lines = land(lines.select("line"), "lines")
    count, parts = lines.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = spans or max(1, min(parts, count // 1000), count // span_lines)
    # About twenty sampled lines a span place the splitters; they only balance the work.
    drawn = sorted(r[0] for r in lines.sample(min(1.0, 20 * spans / max(1, count)), seed=11).collect()) if spans > 1 else []
    splitters = [drawn[len(drawn) * k // spans] for k in range(1, spans)] if drawn else []

    def runs(batches: Iterator[pa.RecordBatch]):
        def pairs():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

        held, now, run = [], 0, 0
        for run, line in pairs():
            span = bisect.bisect_right(splitters, line)
            if span != now or len(held) == chunk:
                if held:
                    yield [now], [run], [held[0]], [held]
                held, now = [], span
            held.append(line)
        if held:
            yield [now], [run], [held[0]], [held]

    local = lines.select(F.spark_partition_id().cast("long").alias("run"), "line").sortWithinPartitions("line")
    chunks = land(each_batch(local, runs, CHUNK), "runs")
    many = chunks.agg(F.max("run")).first()[0] or 0
    while many >= fan_in:
        group = F.floor(F.col("run") / fan_in)

        def longer(batches):
            for (span, run), own in _chunks_by(batches, ("span", "upper")):
                yield from _chunked(span, run, merge(own), chunk)

        grouped = chunks.withColumn("upper", group).repartition(parts, "span", "upper").sortWithinPartitions("span", "upper", "first", "run")
        chunks, many = land(each_batch(grouped, longer, CHUNK), "runs"), many // fan_in

    def last(batches):
        for (span,), own in _chunks_by(batches, ("span",)):
            rows, key, of_key = [], None, 0
            for nth, line in enumerate(merge(own)):
                first = line.partition(" ")[0]
                of_key = of_key + 1 if first == key else 0
                key = first
                rows.append((span, nth, key, of_key, line))
                if len(rows) == 4096:
                    yield list(zip(*rows))
                    rows = []
            if rows:
                yield list(zip(*rows))

    return land(each_batch(chunks.repartition(max(parts, spans), "span").sortWithinPartitions("span", "first", "run"), last, ORDERED), "ordered")


def histories(lines: DataFrame, **options) -> DataFrame:
    """Every line with ``position`` in the whole order and ``capture`` among the lines of its key, both from 0.

    A key may run over several spans.  What earlier spans hold is one row a span, so it passes through the driver.
    """
    merged = ordered(lines, **options)
    ends = F.struct("nth", "key", "nth_of_key")
    told = merged.groupBy("span").agg(F.count("*").alias("n"), F.min(ends).alias("low"), F.max(ends).alias("high")).orderBy("span").collect()
    before, total, open_key, open_count = [], 0, None, 0
    for span in told:
        carried = open_count if span["low"]["key"] == open_key else 0
        before.append((span["span"], total, span["low"]["key"], carried))
        total += span["n"]
        open_count = span["high"]["nth_of_key"] + 1 + (carried if span["high"]["key"] == span["low"]["key"] else 0)
        open_key = span["high"]["key"]
    starts = lines.sparkSession.createDataFrame(before, "span int, before long, low_key string, carried long")
    return merged.join(F.broadcast(starts), "span").select(
        (F.col("before") + F.col("nth")).alias("position"), F.col("key").alias("url_key"),
        (F.col("nth_of_key") + F.when(F.col("key") == F.col("low_key"), F.col("carried")).otherwise(0)).alias("capture"), "line")


def entries(lines: DataFrame) -> DataFrame:
    """The fields of index lines beside their other columns; ``timestamp`` has fourteen digits."""
    parts = F.split("line", " ", 3)
    found = F.from_json(parts[2], ENTRY)
    others = [c for c in lines.columns if c != "line"]
    return lines.select(*others, parts[1].alias("timestamp"), found.alias("_found")).select(*others, "timestamp", "_found.*")


def archived(pages: DataFrame, captured: Column, folder: str | None = None, **options) -> DataFrame:
    """Write ``pages`` to archives in ``folder``, read them back and return the ordered capture histories."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    write_archive(pages, captured, folder, **options)
    return entries(histories(index_lines(read_archive(spark, folder))))
