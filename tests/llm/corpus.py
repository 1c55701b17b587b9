"""Small tables that hold the odd cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, key string, label string, n long"
LONG = " ".join(f"word{i % 977}" for i in range(40_000))


def rows(count: int = 120, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta", "the", "of", "und", "der", "straße", "été", "x1", "end."]
    out = []
    for i in range(count):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))
        if i % 7 == 0:
            text = text.replace(" ", "\n", 2) + "  "
        if i % 11 == 0 and out:
            text = out[rng.randrange(len(out))][1] or ""
        out.append((i, text.upper() if i % 13 == 0 else text, rng.choice(["en", "de", None, "xx"]), rng.choice(["a", "b", "B", None]), len(text)))
    out += [(900, None, "en", "a", 0), (901, "", None, None, None), (902, " \t\n\r\x0b\x0c ", "en", "b", 7), (903, LONG, "en", "a", len(LONG)),
            (904, "one", "en", "b", 3), (904, "one", "en", "b", 3), (905, "ONE", "en", "b", 3), (None, "one", None, "c", 3), (None, None, None, None, None)]
    return [(*r, 0.5, 1, "k", "l", 7) for r in out]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def texts(spark, values, first: int = 0):
    return frame(spark, [(first + i, t, "en", "a", len(t or ""), 0.0, 0, "", "", 0) for i, t in enumerate(values)])
