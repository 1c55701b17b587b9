"""Column functions over text: folding, tokens, titles, similarity, patterns and line shapes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from shelfmark import vocab
from shelfmark.functions.binding import let

WORD_BREAK = r"[^\p{L}\p{M}\p{N}]+"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x{85}\x{2028}\x{2029}]"
EDGE_SPACE = r"(?U)^\s+|\s+$"


def literals(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(text: Column) -> Column:
    """Trim any Unicode white space; ``trim`` alone only removes blanks."""
    return F.regexp_replace(text, EDGE_SPACE, "")


@lru_cache(maxsize=1)
def _fold_map() -> tuple[str, str]:
    """Every BMP letter whose canonical decomposition is one base plus marks, then the marks themselves."""
    source, target, marks = [], [], []
    for code in range(0xC0, 0xFFFE):
        char = chr(code)
        if unicodedata.category(char) == "Mn":
            marks.append(char)
            continue
        parts = unicodedata.normalize("NFD", char)
        if len(parts) > 1 and all(unicodedata.category(p) == "Mn" for p in parts[1:]):
            source.append(char)
            target.append(parts[0])
    return "".join(source + marks), "".join(target)


def fold(text: Column) -> Column:
    """Remove diacritics; letters without a decomposition, such as ß, stay."""
    source, target = _fold_map()
    return F.translate(text, source, target)


def search_text(text: Column) -> Column:
    """Lower case, white space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """Runs of letters, marks and digits, in order, repeats kept."""
    return F.array_remove(F.split(text, WORD_BREAK), "")


def query_tokens(text: Column, limit: int | None = None) -> Column:
    """All tokens of a query; ``limit`` (an application's is ``vocab.MAX_QUERY_TOKENS``) keeps the first ones."""
    tokens = words(F.lower(text))   # white space separates words, so it need not be collapsed
    return tokens if limit is None else F.slice(tokens, 1, limit)


def text_lines(text: Column) -> Column:
    """Trimmed, non-empty lines."""
    lines = F.transform(F.split(text, LINE_BREAK), strip)
    return F.filter(lines, lambda x: x != "")


def is_status_line(line: Column) -> Column:
    """Clock, battery, carrier and other short status remains."""
    return (
        (F.length(line) <= 2)
        | line.rlike(r"^\d{1,2}:\d{2}$")
        | line.rlike(r"^\d{1,3}%$")
        | F.lower(line).isin(*vocab.STATUS_CHROME)
        | ((F.length(line) <= 4) & (F.upper(line) == line) & line.rlike(r"[\p{L}\p{M}]"))
    )


def clean_text(text: Column, limit: int | None = None) -> Column:
    """Text for organising: status lines dropped, blanks squeezed; ``limit`` is for bounded payloads only."""
    kept = F.filter(text_lines(F.coalesce(text, F.lit(""))), lambda x: ~is_status_line(x))
    joined = strip(F.regexp_replace(F.array_join(kept, "\n"), r"[ \t]{2,}", " "))
    return joined if limit is None else F.left(joined, F.lit(limit))


def preview(cleaned: Column, limit: int = 160) -> Column:
    return F.when(F.length(cleaned) == 0, None).when(
        F.length(cleaned) > limit, F.concat(F.left(cleaned, F.lit(limit)), F.lit("…"))).otherwise(cleaned)


def is_sparse(cleaned: Column, limit: int = 12) -> Column:
    return F.length(strip(cleaned)) < limit


# ---- titles ----------------------------------------------------------------------------------------


def normalize_title(title: Column) -> Column:
    """Fold, lower, separators to blanks, one pass of double-blank replacement, trim.

    Blanks are not separators, so a run of three or more keeps two; results depend on that.
    """
    spaced = F.regexp_replace(F.lower(fold(title)), r"[^\p{L}\p{N} ]+", " ")
    return F.trim(F.replace(spaced, F.lit("  "), F.lit(" ")))


def sanitize_title(title: Column) -> Column:
    return F.array_join(F.slice(F.split(strip(title), r"(?U)\s+"), 1, 4), " ")


def is_acceptable_title(title: Column, denied: Sequence[str] | None = None) -> Column:
    denied = sorted(set(vocab.GENERIC_TITLES) | set(vocab.NOUN_DENYLIST)) if denied is None else denied
    trimmed, normalized = strip(title), normalize_title(strip(title))
    return (
        F.length(trimmed).between(3, 40)
        & ~F.contains(trimmed, F.lit("."))
        & F.size(F.split(trimmed, r"(?U)\s+")).between(1, 4)
        & ~normalized.isin(*denied)
        & ~F.startswith(normalized, F.lit("screenshot"))
    )


def first_emoji(text: Column) -> Column:
    """First grapheme when it is not plain ASCII."""
    first = F.regexp_extract(strip(text), r"^\X", 0)
    return F.when((first == "") | first.rlike(r"^[\x00-\x7F]+$"), None).otherwise(first)


def jaccard(a: Column, b: Column) -> Column:
    """Over arrays of distinct values; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def title_tokens(title: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(title, " "), ""))


def similarity(a: Column, b: Column, overlap: Column | None = None) -> Column:
    """Token Jaccard when at least one half (even if the edit ratio is higher), else the edit ratio; ``overlap`` is the Jaccard where it is known."""
    overlap = jaccard(title_tokens(a), title_tokens(b)) if overlap is None else overlap
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when(a == b, 1.0)
        .when((a == "") | (b == ""), 0.0)
        .when(overlap >= 0.5, overlap)
        .otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / longest))
    )


# ---- tokens and entities for pair scoring ----------------------------------------------------------


def distinctive_tokens(text: Column) -> Column:
    stop = literals(sorted(set(vocab.TEXT_STOPWORDS) | set(vocab.GEO_WORDS)))
    long = F.filter(words(F.lower(text)), lambda t: F.length(t) >= 4)
    return F.array_except(F.array_distinct(long), stop)


def long_words(text: Column) -> Column:
    """Letter runs of six or more, stop words left out."""
    runs = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}]+"), lambda t: F.length(t) >= 6)
    return F.array_except(F.array_distinct(runs), literals(vocab.TEXT_STOPWORDS))


def phrases(text: Column) -> Column:
    """Adjacent kept words (three or more letters, no stop word), both with at least four."""
    kept = F.filter(F.split(F.lower(text), WORD_BREAK), lambda t: (F.length(t) >= 3) & ~t.isin(*vocab.TEXT_STOPWORDS))

    def adjacent(run: Column) -> Column:
        long = lambda a, b: (F.length(a) >= 4) & (F.length(b) >= 4)
        return F.zip_with(run, F.slice(run, F.lit(2), F.greatest(F.size(run), F.lit(1))), lambda a, b: F.when(long(a, b), F.concat_ws(" ", a, b)).otherwise(""))

    return F.array_distinct(F.array_remove(let(kept, adjacent), ""))


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(group)))


def flight_numbers(text: Column, block: Sequence[str] = vocab.PAIR_DESIGNATOR_BLOCK) -> Column:
    low = F.lower(text)
    named = all_matches(low, vocab.FLIGHT_WORD_PATTERN)
    coded = F.filter(all_matches(low, vocab.DESIGNATOR_PATTERN), lambda t: ~F.left(t, F.lit(2)).isin(*block))
    return F.array_distinct(F.transform(F.array_union(named, coded), lambda t: F.replace(t, F.lit(" "), F.lit(""))))


def three_letter_codes(text: Column, strict: bool = False) -> Column:
    """Codes of three capitals.  The text is upper-cased first, so ordinary short words count too."""
    source = text if strict else F.upper(text)
    return F.array_except(all_matches(source, vocab.CODE_PATTERN), literals(vocab.PAIR_CODE_DENYLIST))


def domains(text: Column, strict: bool = False) -> Column:
    """Host names; amounts such as 12.00 match the pattern too unless ``strict``."""
    found = F.array_except(all_matches(F.lower(text), vocab.DOMAIN_PATTERN, 1), literals(vocab.DOMAIN_DENYLIST))
    return F.filter(found, lambda t: t.rlike("[a-z]")) if strict else found


def alnum_codes(text: Column) -> Column:
    """Six or more ASCII letters and digits with at least one of each; the letter must follow digits only."""
    return F.filter(all_matches(F.lower(text), vocab.ALNUM_PATTERN),
                    lambda t: t.rlike("^[a-z]*[0-9]") & t.rlike("^[0-9]*[a-z]"))


def entity_columns(text: Column, strict: bool = False) -> dict[str, Column]:
    low = F.lower(text)
    columns = {f"refs_{i}": all_matches(low, p) for i, p in enumerate(vocab.REFERENCE_PATTERNS)}
    columns.update(
        flights=flight_numbers(text), codes=three_letter_codes(text, strict), hosts=domains(text, strict),
        phrases=phrases(text), alnum=alnum_codes(text), long_words=long_words(text))
    return columns


# ---- needles, lines, redaction ---------------------------------------------------------------------


def trie_pattern(phrases: Iterable[str]) -> str:
    """One pattern for all ``phrases``: common beginnings are tried once, and the longest phrase at a place wins."""
    root: dict = {}
    for phrase in phrases:
        node = root
        for char in phrase:
            node = node.setdefault(char, {})
        node[""] = {}

    def alternatives(node: dict) -> str:
        branches = [(char if char.isalnum() else f"\\x{{{ord(char):x}}}") + alternatives(below) for char, below in sorted(node.items()) if char]
        joined = branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})" if branches else ""
        return f"(?:{joined})?" if "" in node and joined else joined

    return alternatives(root)


def found_words(text: Column, wanted: Iterable[str]) -> Column:
    """The distinct ``wanted`` words that stand between word boundaries in ``text``, in one pass."""
    part = r"[\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}]"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?<!{part})(?:{trie_pattern(set(wanted))})(?!{part})"), F.lit(0)))


def _needle_array(needles: Sequence[str]) -> Column:
    """A constant array from one literal; Catalyst folds the split."""
    return F.split(F.lit("\x1f".join(needles)), "\x1f")


FEW_HITS = 64     # of a needle in a batch of texts


def count_groups(text: Column, groups: dict[str, Sequence[str]]) -> Column:
    """A struct that says for each of the named ``groups`` how many of its needles occur in ``text``; in null texts none does.

    Each needle is looked for in a whole batch of texts at once, as bytes: in valid UTF-8 that finds the same as by characters.
    """
    names, needles = list(groups), list(dict.fromkeys(n for group in groups.values() for n in group))
    wanted = [n.encode() for n in needles]
    columns = [[needles.index(n) for n in group] for group in groups.values()]

    @F.arrow_udf("struct<" + ",".join(f"{name}:int" for name in names) + ">")
    def counts(texts: pa.Array) -> pa.Array:
        found = np.zeros((len(texts), len(wanted)), dtype=bool)
        values = texts.cast(pa.large_binary())
        ends, data = np.zeros(0, dtype=np.int64), b""
        if len(texts):
            ends = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset:values.offset + len(texts) + 1]
            data, ends = memoryview(values.buffers()[2] or b"")[ends[0]:ends[-1]].tobytes(), ends[1:] - ends[0]
        for column, needle in enumerate(wanted):
            place, steps = data.find(needle), 0
            while place >= 0:
                if steps == FEW_HITS:     # a common one is looked for text by text, without a step of Python for each
                    found[:, column] = pc.match_substring(values, needle).fill_null(False).to_numpy(zero_copy_only=False)
                    break
                steps += 1
                row = int(np.searchsorted(ends, place, side="right"))
                if place + len(needle) <= ends[row]:     # or it runs over into the next text
                    found[row, column] = True
                    place = data.find(needle, int(ends[row]))
                else:
                    place = data.find(needle, place + 1)
        return pa.StructArray.from_arrays([pa.array(found[:, at].sum(axis=1, dtype=np.int32)) for at in columns], names)

    return counts(F.coalesce(text, F.lit("")))


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    return F.exists(_needle_array(needles), lambda n: F.contains(text, n))


def word_runs(text: Column) -> Column:
    """Maximal runs of word characters; a word matches between word boundaries exactly when it is one of them."""
    return F.array_distinct(F.split(text, r"[^\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}]+"))


def count_words(text: Column, wanted: Sequence[str]) -> Column:
    """How many of ``wanted`` occur as whole words."""
    return F.size(F.array_intersect(word_runs(text), _needle_array(wanted)))


def redact(text: Column, limit: int = 280) -> Column:
    clean = strip(F.regexp_replace(F.regexp_replace(text, vocab.SECRET_PATTERN, "[redacted]"), r"(?U)\s+", " "))
    return let(clean, lambda c: F.when(F.length(c) == 0, None).when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 3)), F.lit("…"))).otherwise(c))


def bounded_note(text: Column, limit: int = 96) -> Column:
    return F.left(strip(text), F.lit(limit))


def line_shapes(lines: Column) -> Column:
    """Per line: clock-like, date header, single-word header, message, body, short, lower-cased text."""

    def shape(line: Column) -> Column:
        low = F.lower(line)
        size = F.length(line)
        clock = (size <= 16) & line.rlike(r"(?U)\b\d{1,2}[:.]\d{2}\b")
        date = low.isin(*vocab.DATE_HEADERS)
        letters = F.length(F.regexp_replace(line, r"[^\p{L}\p{M}]", ""))
        header = (
            ~clock & ~date & ~line.rlike(r"(?U)\s") & size.between(3, 22) & (letters >= 3)
            & ~low.isin(*vocab.CHAT_STATUS) & (letters / size >= 0.8)
        )
        message = size.between(8, 140) & ~clock & ~date & ~header & ~low.isin(*vocab.CHAT_STATUS)
        body = size.between(6, 140) & ~clock & ~header
        return F.struct(
            clock.alias("clock"), date.alias("date"), header.alias("header"), message.alias("message"),
            body.alias("body"), (size <= 24).alias("tiny"), (size > 100).alias("long"), low.alias("low"))

    return F.transform(lines, shape)


def count_where(values: Column, test) -> Column:
    return F.size(F.filter(values, test))


def count_adjacent(shapes: Column, test) -> Column:
    """Number of neighbouring line pairs for which ``test(first, second)`` holds."""
    shifted = F.slice(shapes, F.lit(2), F.greatest(F.size(shapes), F.lit(1)))
    hits = F.zip_with(shapes, shifted, lambda a, b: F.coalesce(test(a, b), F.lit(False)))
    return count_where(hits, lambda hit: hit)
