"""DuckDB spellings of the text rules, used only to state what a query should return."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from shelfmark import vocab

GENERIC = sorted(set(vocab.GENERIC_TITLES) | set(vocab.NOUN_DENYLIST))
NON_ASCII_LETTER = r"[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{1FFF}]"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listing(values: Iterable[str]) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def inside(values: Iterable[str]) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda t: t <> '')"


def search_text(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"


def query_tokens(x: str) -> str:
    return words(search_text(x))


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def lines(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '\\r\\n|[\\n\\r]'), lambda l: {strip('l')}), lambda l: l <> '')"


def is_status(x: str) -> str:
    return (rf"(length({x}) <= 2 or regexp_matches({x}, '^\d{{1,2}}:\d{{2}}$') or regexp_matches({x}, '^\d{{1,3}}%$') "
            rf"or lower({x}) in {inside(vocab.STATUS_CHROME)} "
            rf"or (length({x}) <= 4 and upper({x}) = {x} and regexp_matches({x}, '[\p{{L}}\p{{M}}]')))")


def clean(x: str) -> str:
    kept = f"list_filter({lines(x)}, lambda l: not {is_status('l')})"
    return strip(rf"regexp_replace(array_to_string({kept}, chr(10)), '[ \t]{{2,}}', ' ', 'g')")


def normalize_title(x: str) -> str:
    return rf"trim(replace(regexp_replace(strip_accents(lower({x})), '[^\p{{L}}\p{{N}} ]+', ' ', 'g'), '  ', ' '))"


def title_tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> ''))"


def jaccard(a: str, b: str) -> str:
    return (f"coalesce(len(list_intersect({a}, {b}))::double / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)")


def similarity(a: str, b: str) -> str:
    over = jaccard(title_tokens(a), title_tokens(b))
    return (f"case when {a} = {b} then 1.0 when {a} = '' or {b} = '' then 0.0 when {over} >= 0.5 then {over} "
            f"else greatest(0.0, 1 - levenshtein({a}, {b})::double / greatest(length({a}), length({b}))) end")


def distinctive(x: str) -> str:
    stop = inside(sorted(set(vocab.TEXT_STOPWORDS) | set(vocab.GEO_WORDS)))
    return f"list_distinct(list_filter({words(f'lower({x})')}, lambda t: length(t) >= 4 and t not in {stop}))"


def long_words(x: str) -> str:
    return (rf"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{M}}]+'), "
            f"lambda t: length(t) >= 6 and t not in {inside(vocab.TEXT_STOPWORDS)}))")


def kept_words(x: str) -> str:
    return (f"list_filter({words(f'lower({x})')}, lambda t: length(t) >= 3 and t not in {inside(vocab.TEXT_STOPWORDS)})")


def phrases_of(kept: str) -> str:
    """From a column that already holds the kept words."""
    good = f"list_filter(range(1, len({kept})), lambda i: length({kept}[i]) >= 4 and length({kept}[i + 1]) >= 4)"
    return f"list_distinct(list_transform({good}, lambda i: {kept}[i] || ' ' || {kept}[i + 1]))"


def guarded(x: str, mark: str) -> str:
    """Non-ASCII letters become ``mark`` so that RE2's ASCII word boundary agrees with the Unicode one."""
    return f"regexp_replace({x}, '{NON_ASCII_LETTER}', '{mark}', 'g')"


def matches(x: str, pattern: str, group: int = 0) -> str:
    return f"list_distinct(regexp_extract_all({x}, {text(pattern)}, {group}))"


def entities(x: str) -> dict[str, str]:
    low = guarded(f"lower({x})", "Z")
    up = guarded(f"upper({x})", "z")
    out = {f"refs_{i}": matches(low, p) for i, p in enumerate(vocab.REFERENCE_PATTERNS)}
    coded = (f"list_filter({matches(low, vocab.DESIGNATOR_PATTERN)}, "
             f"lambda t: t[1:2] not in {inside(vocab.PAIR_DESIGNATOR_BLOCK)})")
    named = matches(low, vocab.FLIGHT_WORD_PATTERN)
    out["flights"] = f"list_distinct(list_transform(list_concat({named}, {coded}), lambda t: replace(t, ' ', '')))"
    out["codes"] = (f"list_filter({matches(up, vocab.CODE_PATTERN)}, lambda t: t not in {inside(vocab.PAIR_CODE_DENYLIST)})")
    out["hosts"] = (f"list_filter({matches(low, vocab.DOMAIN_PATTERN, 1)}, lambda t: t not in {inside(vocab.DOMAIN_DENYLIST)})")
    out["alnum"] = (f"list_filter({matches(low, vocab.ALNUM_PATTERN)}, "
                    "lambda t: regexp_matches(t, '[0-9]') and regexp_matches(t, '[a-z]'))")
    out["long_words"] = long_words(x)
    return out


def any_of(x: str, needles: Sequence[str]) -> str:
    return "(" + " or ".join(f"contains({x}, {text(n)})" for n in needles) + ")"


def count_of(x: str, needles: Sequence[str]) -> str:
    return "(" + " + ".join(f"cast(contains({x}, {text(n)}) as int)" for n in needles) + ")"


def count_words(guarded_text: str, wanted: Sequence[str]) -> str:
    return "(" + " + ".join(rf"cast(regexp_matches({guarded_text}, '\b{w}\b') as int)" for w in wanted) + ")"
