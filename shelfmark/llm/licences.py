"""Licence scanning with a positional index of rare words.

Templates are licence notices.  Every template is listed under its rarest words and those of its key phrase, as counted
over all documents, with their positions.  A text looks up all listed words that it holds, for the templates whose key phrase
it has the words of; postings that agree on where the template would begin are laid over the text, and a
template counts if its key phrase stands there word for word.  The score is the share of
the template's words in place.  Base phrases are found wherever their words stand in a row.

Both passes (word counts, then look-up) read whole texts where they lie; what is shuffled is a count per template
word and task.  Null text counts as empty.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import each_batch, raw_texts

# Phrases that are licences by themselves.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Label, notice, mandatory phrase in it.
TEMPLATES = (
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
            "as published by the free software foundation", "redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
     "gnu lesser general public license"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
     "licensed under the apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "the software to deal in the software without restriction", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "released under the mit license", "the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "permission to use copy modify and or distribute this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
# Upper-case letters become lower; what isn't a letter, a digit or beyond ASCII becomes a space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def _phrase(text: str) -> list[bytes]:
    return text.encode().split()


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the phrase's words stand in a row."""
    found, at = [], -1
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at:at + len(phrase)] == phrase:
                found.append(at)
    except ValueError:
        return found


class Index:
    """Postings of the rarest words of each template and of its key phrase.  ``counts``: documents of each template word."""

    def __init__(self, counts: dict[bytes, int], rare: int = 6, of_key: int = 3):
        self.counts = counts
        self.templates = [(label, _phrase(notice), _phrase(key)) for label, notice, key in TEMPLATES]
        self.keys = [next(i for i in range(len(notice)) if notice[i:i + len(key)] == key) for _, notice, key in self.templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        rarity = lambda w: (counts.get(w, 0), w)
        for number, (_, notice, key) in enumerate(self.templates):
            for word in {*sorted(set(notice), key=rarity)[:rare], *sorted(set(key), key=rarity)[:of_key]}:
                self.postings.setdefault(word, []).extend((number, i) for i, w in enumerate(notice) if w == word)

    def look_up(self, words: list[bytes], present: set[bytes], votes: int = 2) -> list[tuple[str, float]]:
        """(label, score) of each template found, best first."""
        possible = {number for number, (_, _, key) in enumerate(self.templates) if present.issuperset(key)}
        if not possible:
            return []
        chosen = {word: kept for word in present & self.postings.keys() if (kept := [p for p in self.postings[word] if p[0] in possible])}
        ballot = Counter()
        for at, word in enumerate(words):
            if word in chosen:
                ballot.update((number, at - position) for number, position in chosen[word])
        found: dict[str, float] = {}
        for (number, shift), n in ballot.items():
            label, notice, key = self.templates[number]
            start = shift + self.keys[number]
            if n >= votes and start >= 0 and words[start:start + len(key)] == key:
                right = sum(0 <= shift + i < len(words) and words[shift + i] == word for i, word in enumerate(notice))
                found[label] = max(found.get(label, 0.0), right / len(notice))
        return sorted(found.items(), key=lambda f: (-f[1], f[0]))


VOCABULARY = {word for _, notice, _ in TEMPLATES for word in _phrase(notice)}


def word_counts(docs: DataFrame) -> dict[bytes, int]:
    """In how many documents each template word occurs; as many rows as the templates have words."""

    def count(batches: Iterator[pa.RecordBatch]):
        total = Counter()
        for batch in batches:
            for text in raw_texts(batch.column(0)):
                total.update(VOCABULARY.intersection(words_of(text)))
        yield [w.decode() for w in total], list(total.values())

    counted = each_batch(docs.select("text"), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {row["word"].encode(): row["n"] for row in counted.collect()}


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    The score is the best template's; a bare phrase counts a half.
    """
    index = Index(word_counts(docs))
    phrases = [(_phrase(p), label) for p, label in PHRASES.items()]

    def find(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            columns = [[] for _ in range(7)]
            for text in raw_texts(batch.column(1)):
                words = words_of(text)
                present = set(words)
                starts, base = [], set()
                for phrase, label in phrases:
                    if present.issuperset(phrase):
                        at = places(words, phrase)
                        starts += at
                        base.update([label] if at else ())
                found = index.look_up(words, present)
                score = max([s for _, s in found] + [0.5 if base else 0.0])
                for column, value in zip(columns, (len(words), len(starts), min(starts, default=None), max(starts, default=None),
                                                   ",".join(sorted(base)), ",".join(sorted(base | {label for label, _ in found})), score)):
                    column.append(value)
            yield batch.column(0), *columns

    return each_batch(docs.select(F.col("doc_id").cast("long"), "text"), find,
                      "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
