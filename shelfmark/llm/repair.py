"""Conversation repair: the cheapest edits that give a conversation the roles ``(s?(ua)+)?``, with an audit of the edits.

A path through a conversation is a path through a graph whose nodes are (row, what the result ends with).  Each edge has one
whole number as its weight: the high digits carry its cost, the low digits the letters of its edits.  Every row has
a slot of fixed width in the low digits, two letters wide (an edit, or an insertion before it and an edit), at the place of
the row, with zeros at the slot's end where it has one letter.  No slot's letters are the start of another slot's, so the order of
the low digits is that of the audits, and the ordinary minimum of the sums settles cost and ties at once.  The audit is
read from the digits of the smallest sum.  More than one insertion in a gap is never cheapest.

A conversation may be of any length.  Rows are numbered over the whole table and cut into blocks; a block is solved for each state
that it may start in, which gives at most sixteen weights.  Blocks are then joined in the same way, ``fan`` at a time: the letters
of a block are replaced by their rank among the block's own, again a slot of fixed width.  No task holds more
than a block of rows or ``fan`` blocks; the hash of a repaired conversation, which must read its text in order, is
taken while the sorted rows pass by.

Nulls count as one space in role and text; a null turn comes first and counts in no gap; a null conversation is a conversation.
Rows with the same turn are taken by role, then by text.  Repeated rows are duplicates.  A role's initial is its first character; an
empty role has none, so its row can't be kept as it is.  A blank text never counts as a duplicate.  Other columns are ignored.  A conversation
without rows, and an empty table, give zeros, an empty audit and the hash of the empty text, and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import SPACES, each_batch, land, numbered

COST = {"rerole": 3, "delete": 4, "insert": 3, "truncated": 3}
# Letters in ASCII order from 1; 0 fills a slot's end.
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER_BITS, SLOT_BITS, RANK_BITS = 3, 6, 5
# What the result ends with: nothing, a system row, a user row, an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ENDS = {NOTHING: 0, ASSISTANT: 0, USER: COST["insert"]}  # a last user row gets an empty answer
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
EMPTY_HASH = hashlib.sha256(b"").hexdigest()
LAST = 9223372036854775807


def kind_of(symbol: Column, truncated: Column, delete: Column) -> Column:
    """All that the edits of a row depend on, as one small number."""
    code = F.when(symbol == "s", 0).when(symbol == "u", 1).when(symbol == "a", 2).otherwise(3)
    return code * 4 + F.when(truncated, 2).otherwise(0) + F.when(delete, 1).otherwise(0)


@lru_cache(maxsize=16)
def edits(kind: int) -> list[tuple[int, int, int, int]]:
    """The edges (from, to, cost, slot) of a row."""
    symbol, truncated, delete = "sua-"[kind // 4], kind // 2 % 2, kind % 2
    late = COST["truncated"] * truncated
    out = []
    for q in STATES:
        for letters, at, cost in (("", q, 0), ("I", NEXT[q], COST["insert"])):
            out.append((q, at, cost + COST["delete"], slot(letters + "D")))
            if delete:
                continue
            if symbol == "s" and at == NOTHING:
                out.append((q, SYSTEM, cost + late, slot(letters + "K")))
            if symbol == "ua"[NEXT[at] == ASSISTANT]:
                out.append((q, NEXT[at], cost + late, slot(letters + "K")))
            out.append((q, NEXT[at], cost + COST["rerole"] + late, slot(letters + "R")))
    return out


def slot(letters: str) -> int:
    value = 0
    for letter in letters.ljust(SLOT_BITS // LETTER_BITS, "0"):
        value = value << LETTER_BITS | LETTERS.get(letter, 0)
    return value


def solve(steps: list[list[tuple[int, int, int, int]]], bits: int) -> list[list[int | None]]:
    """The smallest weight from each state (row) to each state (column) over all steps."""
    top = bits * len(steps)
    out = []
    for start in STATES:
        best: list[int | None] = [None] * len(STATES)
        best[start] = 0
        for k, edges in enumerate(steps):
            shift, after = top - bits * (k + 1), [None] * len(STATES)
            for q, to, cost, digit in edges:
                if best[q] is not None:
                    weight = best[q] + (cost << top) + (digit << shift)
                    if after[to] is None or weight < after[to]:
                        after[to] = weight
            best = after
        out.append(best)
    return out


def digits(weight: int, count: int, bits: int) -> list[int]:
    return [weight >> bits * (count - 1 - k) & (1 << bits) - 1 for k in range(count)]


def walk(start: int, steps: list[list[tuple[int, int, int, int]]], passed: list[int]) -> list[int]:
    """The states passed: before the first step, then after each.  A state and a slot's digits leave one edge."""
    states = [start]
    for edges, digit in zip(steps, passed):
        states.append(next(to for q, to, _, value in edges if q == states[-1] and value == digit))
    return states


def code_of(states: list[int], slots: list[int]) -> str:
    """Two characters a row: what is inserted before it (``-``, u, a), then K, D, or the new role (U, A)."""
    out = []
    for q, value in zip(states, slots):
        first, second = value >> LETTER_BITS, value & (1 << LETTER_BITS) - 1
        inserted, at, letter = ("ua"[NEXT[q] == ASSISTANT], NEXT[q], second) if second else ("-", q, first)
        out.append(inserted + ("UA"[NEXT[at] == ASSISTANT] if letter == LETTERS["R"] else "D" if letter == LETTERS["D"] else "K"))
    return "".join(out)


def squeeze(weights: list[list[int | None]], count: int, bits: int) -> tuple[list, list, list]:
    """Costs, ranks of the letters among the block's own (from 1), and letters, each with sixteen entries; none: null."""
    flat = [w for row in weights for w in row]
    lows = [None if w is None else w & (1 << bits * count) - 1 for w in flat]
    rank = {low: k + 1 for k, low in enumerate(sorted({low for low in lows if low is not None}))}
    return [None if w is None else w >> bits * count for w in flat], [None if x is None else rank[x] for x in lows], lows


def edges_of(costs: list, ranks: list) -> list[tuple[int, int, int, int]]:
    return [(k // 4, k % 4, cost, rank) for k, (cost, rank) in enumerate(zip(costs, ranks)) if cost is not None]


LEAF = "conv long, block long, first long, starts int, ends int, illegal long, costs array<long>, ranks array<int>, codes array<string>"
JOINED = "conv long, block long, blocks array<long>, costs array<long>, ranks array<int>, paths array<string>"
CHOSEN = "conv long, cost long, tail boolean, blocks array<long>, pairs array<int>"


def _leaf(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        rows = []
        for conv, block, members in zip(*(batch.column(k).to_pylist() for k in ("conv", "block", "members"))):
            kinds = [m["kind"] for m in members]
            steps = [edits(kind) for kind in kinds]
            costs, ranks, lows = squeeze(solve(steps, SLOT_BITS), len(steps), SLOT_BITS)
            codes = []
            for k, low in enumerate(lows):
                passed = None if low is None else digits(low, len(steps), SLOT_BITS)
                codes.append(None if low is None else code_of(walk(k // 4, steps, passed), passed))
            symbols = [kind // 4 for kind in kinds]
            wrong = sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(symbols, symbols[1:]))
            rows.append((conv, block, members[0]["position"], symbols[0], symbols[-1], wrong, costs, ranks, codes))
        yield list(zip(*rows)) or [[]] * 9


def _children(batch: pa.RecordBatch):
    for conv, children in zip(*(batch.column(k).to_pylist() for k in ("conv", "children"))):
        yield conv, [c["block"] for c in children], [edges_of(c["costs"], c["ranks"]) for c in children]


def _joined(fan: int):
    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for conv, blocks, steps in _children(batch):
                costs, ranks, lows = squeeze(solve(steps, RANK_BITS), len(steps), RANK_BITS)
                paths = [None if low is None else "".join(map(str, walk(k // 4, steps, digits(low, len(steps), RANK_BITS))))
                         for k, low in enumerate(lows)]
                rows.append((conv, blocks[0] // fan, blocks, costs, ranks, paths))
            yield list(zip(*rows)) or [[]] * 6

    return work


def _chosen(batches: Iterator[pa.RecordBatch]):
    """The whole conversation, from nothing to a state that may end it; the last insertion is a slot of its own."""
    for batch in batches:
        rows = []
        for conv, blocks, steps in _children(batch):
            last = [(q, NOTHING, cost, LETTERS["I"] if cost else 0) for q, cost in ENDS.items()]
            weight, count = solve([*steps, last], RANK_BITS)[NOTHING][NOTHING], len(steps) + 1
            passed = digits(weight, count, RANK_BITS)
            states = walk(NOTHING, steps, passed)
            rows.append((conv, weight >> RANK_BITS * count, passed[-1] > 0, blocks, [4 * a + b for a, b in zip(states, states[1:])]))
        yield list(zip(*rows)) or [[]] * 5


def _gathered(matrices: DataFrame, *keys) -> DataFrame:
    """Blocks in order, ``fan`` of them at most."""
    return matrices.groupBy("conv", *keys).agg(F.array_sort(F.collect_list(F.struct("block", "costs", "ranks"))).alias("children"))


def _codes(leaf: DataFrame, fan: int) -> tuple[DataFrame, DataFrame]:
    """(conv, cost, tail) of every conversation, and (conv, block, first, code) of every block of rows."""
    levels, level = [], leaf
    while (level.groupBy("conv").count().agg(F.max("count")).first()[0] or 0) > fan:
        joined = _gathered(level, F.floor(F.col("block") / fan).alias("upper"))
        level = land(each_batch(joined, _joined(fan), JOINED), "blocks")
        levels.append(level)
    chosen = land(each_batch(_gathered(level), _chosen, CHOSEN), "chosen")
    picked = chosen.select("conv", F.explode(F.arrays_zip("blocks", "pairs")).alias("p")).select("conv", "p.blocks", "p.pairs")
    for level in reversed(levels):
        path = F.element_at("paths", F.col("pairs") + 1)
        pair = lambda i: (F.substring(path, i, 1) * 4 + F.substring(path, i + 1, 1)).cast("int")
        inner = level.withColumnRenamed("blocks", "inner")
        picked = _of_block(picked, inner).select(
            "conv", F.explode(F.transform("inner", lambda b, i: F.struct(b.alias("blocks"), pair(i + 1).alias("pairs")))).alias("p")).select(
            "conv", "p.blocks", "p.pairs")
    coded = _of_block(picked, leaf).select("conv", "block", "first", F.element_at("codes", F.col("pairs") + 1).alias("code"))
    return chosen.select("conv", "cost", "tail"), coded


def _of_block(picked: DataFrame, blocks: DataFrame) -> DataFrame:
    own = blocks.withColumnRenamed("conv", "_conv")
    return picked.join(own, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("blocks") == F.col("block"))).drop("_conv")


def _hashes(lines: DataFrame) -> DataFrame:
    """sha256 of each conversation's ``piece`` texts in order, joined by newlines; the rows pass by one at a time."""

    def work(batches: Iterator[pa.RecordBatch]):
        now, running = None, None
        for batch in batches:
            done = []
            for conv, piece in zip(batch.column("conv").to_pylist(), batch.column("piece").cast(pa.binary()).to_pylist()):
                if running is None or conv != now:
                    if running is not None:
                        done.append((now, running.hexdigest()))
                    now, running = conv, hashlib.sha256(piece)
                else:
                    running.update(b"\n")
                    running.update(piece)
            yield list(zip(*done)) or [[], []]
        if running is not None:
            yield [now], [running.hexdigest()]

    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.repartition(parts, "conv").sortWithinPartitions("conv", "position")
    return each_batch(ordered, work, "conv long, digest string")


def repaired(turns: DataFrame, *, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
             text_column: str = "text", block: int = 256, fan: int = 256) -> tuple[DataFrame, DataFrame]:
    """The repair of every conversation of ``turns`` that has rows, and its repaired rows.

    The first frame has conv, gaps, blank, duplicate, truncated, illegal, cost, audit and digest; the second has conv, position and piece:
    lines ``role:text`` (two where a row is inserted before), to be read in order of position.
    """
    space = F.lit(" ")
    rows = turns.select(F.col(conv_column).cast("long").alias("conv"), F.col(turn_column).cast("long").alias("turn"),
                        F.coalesce(F.col(role_column), space).alias("role"), F.coalesce(F.col(text_column), space).alias("text"))
    placed = numbered(rows, [F.col(c) for c in ("conv", "turn", "role", "text")], name="turns")
    content = ("conv", "role", F.sha2("text", 256).alias("content"))
    repeated = placed.groupBy(*content).agg(F.min("position").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select(
        F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("content").alias("_content"), "_first")
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    seen = placed.join(repeated, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role"))
                       & (F.sha2("text", 256) == F.col("_content")), "left")
    blank = F.col("bare") == ""
    duplicate = ~blank & (F.col("position") > F.coalesce("_first", F.lit(LAST)))
    truncated = ~blank & ~duplicate & ~F.substring("bare", -1, 1).isin(".", "!", "?")
    judged = land(seen.withColumn("bare", bare).select(
        "conv", "turn", "position", F.substring("role", 1, 1).alias("symbol"), blank.alias("blank"), duplicate.alias("duplicate"),
        truncated.alias("truncated")), "judged")
    counts = judged.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        *[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")])

    kind = kind_of(F.col("symbol"), F.col("truncated"), F.col("blank") | F.col("duplicate"))
    members = judged.groupBy("conv", F.floor(F.col("position") / block).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("position", kind.alias("kind")))).alias("members"))
    leaf = land(each_batch(members, _leaf, LEAF), "blocks")
    after = leaf.select(F.col("conv").alias("_conv"), (F.col("block") - 1).alias("_block"), F.col("starts").alias("next"))
    pair = F.col("ends") * 4 + F.col("next")
    across = leaf.join(after, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")), "left")
    illegal = across.groupBy("conv").agg(F.sum(F.col("illegal") + F.when(pair.isNull() | pair.isin(1, 6, 9), 0).otherwise(1)).alias("illegal"))

    chosen, coded = _codes(leaf, fan)
    coded = land(coded, "codes")
    letters = F.translate("code", "uaUA-", "IIRR")
    audits = coded.groupBy("conv").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("block", letters.alias("letters")))), lambda x: x["letters"]), "").alias("letters"))
    at = 2 * (F.col("position") - F.col("first")) + 1
    inserted, act = F.substring(F.col("code"), at, F.lit(1)), F.substring(F.col("code"), at + 1, F.lit(1))
    named = lambda role: F.concat(F.lit(role + ":"), "text")
    line = F.when(act == "K", F.concat("role", F.lit(":"), "text")).when(act == "U", named("user")).when(act == "A", named("assistant"))
    lead = F.when(inserted == "u", "user:").when(inserted == "a", "assistant:")
    own = coded.withColumnRenamed("conv", "_conv")
    edited = placed.join(own, F.col("conv").eqNullSafe(F.col("_conv")) & (F.floor(F.col("position") / block) == F.col("block"))).filter(
        lead.isNotNull() | line.isNotNull()).select("conv", "position", F.concat_ws("\n", lead, line).alias("piece"))
    pieces = edited.unionByName(chosen.filter("tail").select("conv", F.lit(LAST).alias("position"), F.lit("assistant:").alias("piece")))

    out = counts
    for part in (illegal, chosen, audits, _hashes(pieces)):
        own = part.withColumnRenamed("conv", "_conv")
        out = out.join(own, F.col("conv").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    audit = F.concat("letters", F.when(F.col("tail"), "I").otherwise(""))
    return out.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", audit.alias("audit"),
                      F.coalesce("digest", F.lit(EMPTY_HASH)).alias("digest")), pieces


def damaged(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` with the faults of the trial: lost, emptied, cut, repeated rows and wrong roles."""
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    fault = F.crc32(F.encode(key, "utf-8")) % 20
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).filter("fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def report(turns: DataFrame, **options) -> DataFrame:
    """One row for each conversation of ``turns`` after the trial's damage; those that lost all their rows too."""
    found = repaired(damaged(turns), **options)[0]
    all_ids = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_ids.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.lit(EMPTY_HASH)).alias("repaired_sha256"))
