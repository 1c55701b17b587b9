"""Conversation repair against every possible edit of small conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from shelfmark.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, position int, code string, block int"
SPACE = " \t\n\x0b\f\r"


def damage(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        fault = zlib.crc32(key.encode()) % 20
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        kept += [(turn, role, text)] * (2 if fault == 3 else 1)
    return {conv: sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for conv, kept in out.items()}


def brute(rows, every_gap=("", "u", "a", "ua", "au", "uu", "aa")):
    """All columns for the rows (turn, role, text) of one conversation, by trying all edits."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    names = {"u": "user", "a": "assistant"}
    best = None
    options = []
    for (_, role, text), fault in zip(rows, faults):
        late = 3 * (fault == "truncated")
        ways = [(4, "D", None)]
        if fault not in ("blank", "duplicate"):
            ways += [(late, "K", (role, text))] + [(3 + late, "R", (names[x], text)) for x in "ua"]
        options.append(ways)
    for gap in itertools.product(every_gap, repeat=len(rows) + 1):
        inserted = 3 * sum(map(len, gap))
        if best and inserted > best[0]:
            continue
        for ways in itertools.product(*options):
            cost = inserted + sum(w[0] for w in ways)
            if best and cost > best[0]:
                continue
            lines, audit = [(names[x], "") for x in gap[0]], "I" * len(gap[0])
            for way, after in zip(ways, gap[1:]):
                audit += way[1]
                lines += [way[2]] if way[2] else []
                lines += [(names[x], "") for x in after]
                audit += "I" * len(after)
            if "" in (role for role, _ in lines) or not re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in lines)):
                continue
            found = (cost, audit, "\n".join(f"{a}:{b}" for a, b in lines))
            if best is None or found[:2] < best[:2]:
                best = found
    count = lambda name: sum(f == name for f in faults)
    return (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)


def random_rows(conversations, longest, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "ux"]
    texts = ["Yes.", "No!", "Why?  ", "cut", "", None, "  \n", "a\nb. \t", "ü x…", "same."]
    return [(conv, rng.choice([None, *range(6)]) if rng.random() < 0.3 else turn, rng.choice(roles[:5] if rng.random() < 0.8 else roles), rng.choice(texts))
            for conv in range(conversations) for turn in range(rng.randint(1, longest))]


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(frame):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in frame.collect()}


def test_small_conversations_against_all_edits(spark):
    rows = random_rows(150, 4, 5) + [(None, 1, "assistant", "Nobody's."), (None, None, "user", "cut"), (-7, 0, "system", "Alone.")]
    want = {conv: brute(kept, ("", "u", "a", "ua")) for conv, kept in damage(rows).items()}
    assert got(repair.report(table(spark, rows))) == want
    few = random_rows(12, 2, 6)
    assert got(repair.report(table(spark, few))) == {conv: brute(kept) for conv, kept in damage(few).items()}


def plain_repair(rows):
    """Cheapest edits of a longer conversation: the best (cost, audit, lines) for each state, row by row."""
    seen, step = set(), {0: 2, 1: 2, 2: 3, 3: 2}
    paths = {0: (0, "", ())}
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        delete = not bare or (role, text) in seen
        late = 0 if delete or bare[-1] in ".!?" else 3
        seen.add((role, text))
        after = {}
        for q, (cost, audit, lines) in paths.items():
            starts = [(q, cost, audit, lines), (step[q], cost + 3, audit + "I", (*lines, "user:" if step[q] == 2 else "assistant:"))]
            for at, c, letters, done in starts:
                ways = [(at, c + 4, letters + "D", done)]
                if not delete:
                    to = step[at]
                    ways.append((to, c + 3 + late, letters + "R", (*done, ("user:" if to == 2 else "assistant:") + text)))
                    if role[:1] == "s" and at == 0:
                        ways.append((1, c + late, letters + "K", (*done, f"{role}:{text}")))
                    if role[:1] == " ua"[to - 1]:
                        ways.append((to, c + late, letters + "K", (*done, f"{role}:{text}")))
                for to, *value in ways:
                    if to not in after or tuple(value[:2]) < after[to][:2]:
                        after[to] = tuple(value)
        paths = after
    ends = [paths[q] for q in (0, 3) if q in paths]
    if 2 in paths:
        cost, audit, lines = paths[2]
        ends.append((cost + 3, audit + "I", (*lines, "assistant:")))
    cost, audit, lines = min(ends)
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("block,fan", [(256, 256), (3, 2), (1, 2)])
def test_long_conversations_in_blocks(spark, block, fan):
    rng = random.Random(block)
    rows = [(conv, turn, rng.choice(["user", "assistant", "system"]), rng.choice(["Fine.", "cut", "", f"Row {turn}.", f"row {turn}"]))
            for conv, size in ((1, 61), (2, 3), (3, 300), (4, 1)) for turn in range(size)]
    want = {conv: plain_repair(kept) for conv, kept in damage(rows).items()}
    assert {k: v[5:] for k, v in got(repair.report(table(spark, rows), block=block, fan=fan)).items()} == want


def test_odd_tables(spark):
    assert repair.report(table(spark, [])).collect() == []
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert got(repair.report(table(spark, [(lost, 0, "user", "Hi.")]))) == {lost: (0, 0, 0, 0, 0, 0, "", repair.EMPTY_HASH)}
    twice = [(1, 5, "user", "Hi."), (1, 5, "user", "Hi."), (1, 5, "assistant", "So."), (1, 9, "user", "x " * 50_000)]
    assert got(repair.report(table(spark, twice)))[1] == brute(damage(twice)[1], ("", "u", "a"))


def test_a_slot_never_begins_another():
    slots = ["".join(p) for p in itertools.product(["", "I"], "DKR")]
    assert sorted(slots) == sorted(slots, key=repair.slot)
    assert not any(a != b and b.startswith(a) for a in slots for b in slots)
