"""Personal data replaced by surrogates of the same type.

Detected entities are e-mail addresses, telephone numbers, payment cards, IP addresses, social security numbers and
personal names.  A surrogate is the entity under a keyed permutation of everything that has its format: digits stay
digits, letters keep their script, case and whether they are vowels, separators stay; cards keep a right check digit right, octets stay below 256, a given name becomes one of the same script and gender, telephone numbers keep a leading 0, 00 or 1.  A family name found after a given
name is replaced wherever the document has it alone.  A permutation gives distinct entities
of one format distinct surrogates, and the same entity the same surrogate in every document (coreference), with no table and
no shuffle.  ``collisions`` checks this over a corpus, and that no surrogate is its own entity.

Null text counts as empty and stays empty.  Spelling variants of one entity (case of an address, separators of a
number) share one surrogate, written in the variant's own form.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import each_batch

KINDS = ("email", "phone", "card", "ip", "ssn", "name")
# Patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)|(?<![\w+])\+\d{8,15}(?!\w)")
# Telephone numbers of other shapes, looked for outside of cards, addresses and social security numbers: after + or 00, with the national
# length where that is fixed (1, 33, 34); after a trunk 0; nine digits in Spanish groups; seven in American ones.
GAP = r"[ \u00a0\u202f./()-]{0,3}"
SEP = r"[ \u00a0\u202f./-]"
PHONES = re.compile("|".join((
    rf"(?<![\w+])(?:\+|00)(?:1(?:{GAP}\d){{10}}|3[34](?:{GAP}\(0\))?(?:{GAP}\d){{9}}|[1-9](?:{GAP}\d){{7,14}})(?!\w)",
    rf"(?<![\w+.-])(?:\(0[1-9]\d{{0,4}}\){SEP}?|0[1-9]\d{{0,4}}{SEP})(?:\d{{2,8}}{SEP}){{0,4}}\d{{2,8}}(?![\w:]|{SEP}\d)",
    rf"(?<![\w+.-])0[1-9](?P<gap>{SEP})\d\d(?:(?P=gap)\d\d){{3}}(?!\w)|(?<![\w+.-])0[1-9]\d{{7,10}}(?!\w)",
    rf"(?<![\w+.-])[6-9]\d\d(?:{SEP}\d\d){{3}}(?!\w)|(?<![\w+.-])[6-9]\d{SEP}\d{{3}}(?:{SEP}\d\d){{2}}(?!\w)",
    r"(?<![\w+.-])[2-9]\d\d-\d{4}(?![\w-])")))
DATE = re.compile(rf"\d{{1,2}}{SEP}\d{{1,2}}{SEP}(?:\d{{2}}|\d{{4}})")
CARD = re.compile(r"(?<![\w.])\d(?:[ -]?\d){12,18}(?![\w])")
IP = re.compile(r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\w)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
# Given names by script and gender.
GIVEN = {
    ("latin", "f"): ("Anna", "Maria", "Emma", "Julia", "Laura", "Sarah", "Sophie", "Claire", "Lucia", "Carmen", "Helen", "Alice", "Ingrid",
                     "Monica", "Paula", "Elena", "Marie", "Camille", "Ursula", "Rosa"),
    ("latin", "m"): ("John", "Peter", "Thomas", "Michael", "David", "Paul", "Hans", "Karl", "Pierre", "Louis", "Carlos", "Pedro", "Miguel",
                     "George", "Robert", "James", "Stefan", "Henri", "Pablo", "Otto"),
    ("cyrillic", "f"): ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана", "Юлия", "Екатерина"),
    ("cyrillic", "m"): ("Иван", "Алексей", "Сергей", "Дмитрий", "Андрей", "Михаил", "Николай", "Павел", "Владимир", "Олег"),
}
# Letters that take each other's place.
GROUPS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ",
          "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "äöü", "ÄÖÜ", "àâéèêëîïôù", "ÀÂÉÈÊËÎÏÔÙ", "áíóú", "ÁÍÓÚ")
LEADS = (("0", "0"), ("0", "123456789"), ("1",), ("2345",), ("6789",))
GROUP_OF = {letter: group for group in reversed(GROUPS) for letter in group}
GENDER_OF = {name: key for key, names in GIVEN.items() for name in names}
NAME = re.compile(r"(?<!\w)(" + "|".join(sorted(GENDER_OF, key=lambda n: (-len(n), n))) + r")((?: [^\W\d_][^\W\d_'’-]*)?)(?!\w)")


def shuffled(value: int, size: int, key: bytes, about: str) -> int:
    """``value`` under a keyed permutation of range(size): Feistel rounds, repeated while outside the range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for turn in range(8):
            word = hmac.digest(key, f"{about}|{size}|{turn}|{right:x}".encode(), "sha256")
            left, right = right, left ^ int.from_bytes(word * (half // 256 + 1), "big") & mask
        value = left << half | right
        if value < size:
            return value


def displaced(value: int, size: int, key: bytes, about: str) -> int:
    """As ``shuffled``, but never ``value`` itself when there is another: the next place of one keyed cycle."""
    if size < 2:
        return value
    place = _unshuffled(value, size, key, about)
    return shuffled((place + 1) % size, size, key, about)


def _unshuffled(value: int, size: int, key: bytes, about: str) -> int:
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for turn in reversed(range(8)):
            word = hmac.digest(key, f"{about}|{size}|{turn}|{left:x}".encode(), "sha256")
            left, right = right ^ int.from_bytes(word * (half // 256 + 1), "big") & mask, left
        value = left << half | right
        if value < size:
            return value


def respelled(text: str, key: bytes, about: str, groups: list[str | None] | None = None) -> str:
    """``text`` with every letter and digit of the groups replaced, as one number of mixed base."""
    groups = groups or [GROUP_OF.get(c) for c in text]
    value, size = 0, 1
    for c, group in zip(text, groups):
        if group:
            value, size = value * len(group) + group.index(c), size * len(group)
    value = displaced(value, size, key, f"{about}|{''.join('x' if g else c for c, g in zip(text, groups))}")
    out = []
    for c, group in zip(reversed(text), reversed(groups)):
        if group:
            value, place = divmod(value, len(group))
            c = group[place]
        out.append(c)
    return "".join(reversed(out))


def check_digit(digits: str) -> str:
    """Luhn's digit after ``digits``."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _digits_into(form: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in form)


def canonical(kind: str, text: str) -> str:
    """What all spellings of an entity share."""
    if kind in ("phone", "card"):
        return "".join(filter(str.isdigit, text))
    return text.lower() if kind == "email" else ".".join(str(int(o)) for o in text.split(".")) if kind == "ip" else text


@lru_cache(maxsize=20_000)
def surrogate(kind: str, value: str, key: bytes) -> str:
    """Of a canonical entity."""
    if kind == "email":
        local, _, domain = value.partition("@")
        host, _, top = domain.rpartition(".")
        changed = respelled(f"{local}@{host}", key, kind)
        return f"{changed}.{top}"
    if kind == "card":
        body = value[0] + respelled(value[1:-1], key, f"card{value[0]}")
        off = int(value[-1]) - int(check_digit(value[:-1]))  # 0 for a real card; a wrong digit stays as wrong as it was
        return body + str((int(check_digit(body)) + off) % 10)
    if kind == "ip":
        number = int.from_bytes(bytes(map(int, value.split("."))), "big")
        return ".".join(map(str, displaced(number, 1 << 32, key, kind).to_bytes(4, "big")))
    if kind == "name":
        given, space, family = value.partition(" ")
        if given not in GENDER_OF:
            return _family(value, key)
        return _given(given, key) + space + (_family(family, key) if family else "")
    if kind == "phone":
        lead = next(lead for lead in LEADS if len(value) >= len(lead) and all(c in group for c, group in zip(value, lead)))
        return respelled(value, key, kind, [*lead, *GROUPS[:1] * (len(value) - len(lead))])
    return respelled(value, key, kind)


def _given(name: str, key: bytes) -> str:
    script, gender = GENDER_OF[name]
    names = GIVEN[script, gender]
    return names[displaced(names.index(name), len(names), key, f"{script}{gender}")]


ENDINGS = ("ская", "ский", "ова", "ева", "ина", "ов", "ев", "ин")


def _ending(name: str) -> str:
    return next((e for e in ENDINGS if name.endswith(e) and len(name) > len(e) + 1), "")


@lru_cache(maxsize=20_000)
def _letters(c: str) -> str | None:
    """The letters that take the place of ``c`` in a name: beyond the groups, those of its case among its 64 neighbours in Unicode."""
    if c in GROUP_OF or not c.isalpha():
        return GROUP_OF.get(c)
    first = ord(c) // 64 * 64
    return "".join(x for x in map(chr, range(first, first + 64)) if x.isalpha() and x not in GROUP_OF and (x.isupper(), x.islower()) == (c.isupper(), c.islower()))


def _family(name: str, key: bytes) -> str:
    """Another family name of the same letters' kinds; a gendered ending stays.

    The next names of the permutation are passed over while they have another ending or are given names, so distinct names stay distinct.
    """
    if name in GENDER_OF:
        return _given(name, key)
    ending = _ending(name)
    stem = name[:len(name) - len(ending)]
    groups = [_letters(c) for c in stem]
    while True:
        stem = respelled(stem, key, f"family{ending}", groups)
        if _ending(stem + ending) == ending and stem + ending not in GENDER_OF:
            return stem + ending


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what is found, without overlaps; earlier kinds go first where two begin alike."""
    found, families = [], set()
    if "@" in text:
        found += [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    if any(d in text for d in "0123456789"):
        found += [(m.start(), m.end(), "ip") for m in IP.finditer(text)]
        found += [(m.start(), m.end(), "card") for m in CARD.finditer(_without(text, found)) if _is_card(m[0])]
        found += [(m.start(), m.end(), "ssn") for m in SSN.finditer(text)]
        found += _phones(text, found)
    if not GENDER_OF.keys().isdisjoint(re.split(r"[^\w]+", text)):
        for m in NAME.finditer(text):
            family = m[2][1:]
            found.append((m.start(), m.end() if family[:1].isupper() else m.end(1), "name"))
            if family[:1].isupper() and family not in GENDER_OF:
                families.add(family)
        if families:
            alone = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, families), key=lambda f: (-len(f), f))) + r")(?!\w)")
            found += [(m.start(), m.end(), "name") for m in alone.finditer(text)]
    kept, end = [], 0
    for item in sorted(found, key=lambda f: (f[0], -f[1], KINDS.index(f[2]))):
        if item[0] >= end:
            kept.append(item)
            end = item[1]
    return kept


def _without(text: str, found: list[tuple[int, int, str]]) -> str:
    """``text`` with bars for what is found, except for digits after a plus."""
    parts, at = [], 0
    for start, end, _ in sorted(found):
        if start >= at and text[start - 1:start] != "+":
            parts += [text[at:start], "|" * (end - start)]
            at = end
    return "".join([*parts, text[at:]])


def _phones(text: str, others: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of telephone numbers; those that overlap are one."""
    text = _without(text, others)
    spans = [m.span() for m in PHONE.finditer(text)]
    spans += [m.span() for m in PHONES.finditer(text) if len(canonical("phone", m[0])) >= 7 and not DATE.fullmatch(m[0])]
    joined: list[tuple[int, int, str]] = []
    for start, end in sorted(spans):
        if joined and start < joined[-1][1]:
            start, end = joined[-1][0], max(end, joined.pop()[1])
        joined.append((start, end, "phone"))
    return joined


def _is_card(text: str) -> bool:
    digits = canonical("card", text)
    return len(set(digits)) > 1


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and where the entities stood in the original."""
    found, parts, at = entities(text), [], 0
    for start, end, kind in found:
        form = text[start:end]
        value = surrogate(kind, canonical(kind, form), key)
        parts += [text[at:start], _digits_into(form, value) if kind in ("phone", "card") else value]
        at = end
    return "".join([*parts, text[at:]]), found


def pseudonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with surrogates, counts n_<kind>, n_entities and spans (kind:start:end in the original)."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            columns = [[] for _ in range(len(KINDS) + 3)]
            for text in batch.column(1).to_pylist():
                new, found = replaced(text or "", key)
                kinds = [k for _, _, k in found]
                for column, value in zip(columns, (new, *map(kinds.count, KINDS), len(found), ",".join(f"{k}:{s}:{e}" for s, e, k in found))):
                    column.append(value)
            yield batch.column(0), *columns

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return each_batch(docs.select(F.col("doc_id").cast("long"), "text"), work, f"doc_id long, text string, {counts}, n_entities long, spans string")


def collisions(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, surrogate, entities) of surrogates that stand for two entities or for themselves; there should be none."""

    def pairs(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = {(k, canonical(k, t[s:e])) for t in batch.column(0).to_pylist() if t for s, e, k in entities(t)}
            yield [k for k, _ in found], [v for _, v in found], [surrogate(k, v, key) for k, v in found]

    distinct = each_batch(docs.select("text"), pairs, "kind string, value string, surrogate string").distinct()
    return (distinct.groupBy("kind", "surrogate").agg(F.count("*").alias("entities"), F.max(F.expr("value = surrogate")).alias("same"))
            .filter("entities > 1 or same").select("kind", "surrogate", "entities"))
