"""Porter stemming of a distinct-term frame (the algorithm published by M. F. Porter, 1980)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

C, V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
MEASURE_0 = re.compile(f"^({C})?{V}{C}")                      # m > 0
MEASURE_1 = re.compile(f"^({C})?{V}{C}({V})?$")               # m = 1
MORE = re.compile(f"^({C})?{V}{C}{V}{C}")                     # m > 1
VOWEL = re.compile(f"^({C})?[aeiouy]")
SHORT = re.compile(f"^{C}[aeiouy][^aeiouwxy]$")

# Suffix tables of the published algorithm.
STEP_2 = dict(pair.split(":") for pair in (
    "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate "
    "ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log").split())
STEP_3 = dict(pair.split(":") for pair in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
STEP_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _swap(word: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            root = word[: -len(suffix)]
            return root + table[suffix] if MEASURE_0.match(root) else word
    return word


def _plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if MEASURE_0.match(word[:-3]) else word
    for suffix in ("ed", "ing"):
        root = word[: -len(suffix)]
        if word.endswith(suffix):
            if not VOWEL.match(root):
                return word
            if root.endswith(("at", "bl", "iz")):
                return root + "e"
            if re.search(r"([^aeiouylsz])\1$", root):
                return root[:-1]
            return root + "e" if SHORT.match(root) else root
    return word


def _trim(word: str) -> str:
    if word.endswith("ion") and word[-4:-3] in ("s", "t") and MORE.match(word[:-3]):
        return word[:-3]
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            return word[: -len(suffix)] if MORE.match(word[: -len(suffix)]) else word
    return word


def porter(word: str) -> str:
    """Stem of an English word; words with other letters or digits stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    word = _past(_plural(word))
    if word.endswith("y") and VOWEL.match(word[:-1]):
        word = word[:-1] + "i"
    word = _trim(_swap(_swap(word, STEP_2), STEP_3))
    if word.endswith("e"):
        root = word[:-1]
        if MORE.match(root) or (MEASURE_1.match(root) and not SHORT.match(root)):
            word = root
    return word[:-1] if word.endswith("ll") and MORE.match(word) else word


def _stem(terms: pd.Series) -> pd.Series:
    return terms.map(porter)


def stem_terms(terms: DataFrame) -> DataFrame:
    """``(term)`` to ``(term, stemmed)``; the caller passes distinct terms, never a whole posting list."""
    stem = F.pandas_udf(_stem, "string")
    return terms.select("term", stem("term").alias("stemmed"))
