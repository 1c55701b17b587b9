"""Quality classifier from weak labels.

Heuristic labellers vote good (1), bad (-1) or not at all (0) on every document.  Their accuracies, and the share of good
documents, are estimated without any true label by expectation-maximisation over the counts of vote patterns, which are at
most 3 to the number of labellers whatever the corpus.  The posteriors of at most ``sample`` documents (those with
the smallest hash of their id) train a linear scorer over hashed words and shape features, which then scores every
whole text where it lies.  The scorer sees words and shapes that no labeller has a rule for.

Null text counts as empty.  With fewer than two kinds of vote patterns the posterior is what the majority says.  An
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import each_batch, land, raw_texts

# Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset((
    "the of and to in a is that for it as was with be by on are this from or der die und den von zu das mit sich des auf ist im dem nicht "
    "ein eine als auch de la le et les en un du une que est pour qui dans par sur au avec pas el y los del se las por para con no una su al lo como"
).encode().split())
BITS = 18
SHAPES = 16
# Distinct words of a row that the scorer is fitted on at most; scoring takes them all.
LEARNT = 4096


def shape(text: bytes) -> tuple[list[bytes], dict[str, float]]:
    """The words, and what the labellers and the scorer look at."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    capital = size - len(text.translate(None, bytes(range(65, 91))))
    small = size - len(text.translate(None, bytes(range(97, 123))))
    lines = [line for line in text.split(b"\n") if line.strip()]
    return words, {
        "words": len(words),
        "mean": sum(map(len, words)) / n,
        "symbols": (size - len(text.translate(None, b"#*$%&|<>"))) / n,
        "capitals": capital / max(1, capital + small),
        "function": sum(w in FUNCTION_WORDS for w in words) / n,
        "variety": len(set(words)) / n,
        "lines": len(set(lines)) / max(1, len(lines)),
        "shouts": text.count(b"!") / n,
        "digits": (size - len(text.translate(None, b"0123456789"))) / size,
        "ends": sum(line.rstrip()[-1:] in (b".", b"!", b"?") for line in lines) / max(1, len(lines)),
    }


def _vote(bad: bool, good: bool = False) -> int:
    return -1 if bad else int(good)


# Most can only object: that a text is not oddly long or loud says little for it.
LABELLERS = {
    "length": lambda s: _vote(s["words"] < 10),
    "word_length": lambda s: _vote(not 2.5 <= s["mean"] <= 12),
    "symbols": lambda s: _vote(s["symbols"] > 0.1, s["symbols"] < 0.01),
    "capitals": lambda s: _vote(s["capitals"] > 0.4),
    "function_words": lambda s: _vote(s["function"] < 0.08 and s["words"] >= 20, s["function"] > 0.18),
    "repetition": lambda s: _vote((s["variety"] < 0.25 and s["words"] >= 50) or s["lines"] < 0.7),
    "shouting": lambda s: _vote(s["shouts"] > 0.1),
    "digits": lambda s: _vote(s["digits"] > 0.2),
    "sentences": lambda s: _vote(s["ends"] < 0.2, s["ends"] > 0.8),
}


def votes(s: dict[str, float]) -> list[int]:
    return [rule(s) for rule in LABELLERS.values()]


def code_of(pattern: list[int]) -> int:
    return sum((v + 1) * 3 ** i for i, v in enumerate(pattern))


def posteriors(codes: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 60) -> np.ndarray:
    """Probability of good for each vote pattern, by expectation-maximisation over their counts."""
    patterns = codes[:, None] // 3 ** np.arange(labellers) % 3  # 0 bad, 1 none, 2 good
    good = 1 / (1 + np.exp(-1.5 * (patterns - 1.0).sum(axis=1)))
    if len(codes) < 2:
        return good
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])  # class, pattern
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        log = np.log(prior)[:, None] + np.zeros_like(weight)
        for i in range(labellers):
            seen = np.stack([weight[:, patterns[:, i] == v].sum(axis=1) for v in range(3)], axis=1) + np.array([[2.0, 1, 1], [1, 1, 2]])
            log += np.log(seen / seen.sum(axis=1, keepdims=True))[:, patterns[:, i]]
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return good


def features(words: list[bytes], s: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: distinct lower-cased words, scaled to length one, and a step for each shape."""
    mask = (1 << BITS) - 1
    own = {zlib.crc32(w.lower()) & mask for w in set(words)}
    places = np.fromiter(own, np.int64, len(own))
    values = np.full(len(own), 1 / max(1.0, np.sqrt(len(own))))
    steps = [(1 << BITS) + SHAPES * i + min(SHAPES - 1, int(v * SHAPES) if name not in ("words", "mean") else int(np.log2(1 + v) * 1.2))
             for i, (name, v) in enumerate(s.items())]
    return np.concatenate([places, steps]), np.concatenate([values, np.ones(len(steps))])


def _learnt(places: np.ndarray) -> np.ndarray:
    """Which features of a row the scorer is fitted on: all shapes, and the LEARNT words with the smallest mixed buckets."""
    words = np.flatnonzero(places < 1 << BITS)
    if len(words) <= LEARNT:
        return np.arange(len(places))
    mixed = places[words] * 2654435761 % (1 << 32)
    return np.sort(np.concatenate([words[np.argsort(mixed, kind="stable")[:LEARNT]], np.flatnonzero(places >= 1 << BITS)]))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, step: float = 0.1, decay: float = 1e-4, size: int = 256) -> np.ndarray:
    """Weights (the last is the constant) of a logistic scorer for soft labels, by Adagrad."""
    w = np.zeros((1 << BITS) + SHAPES * 10 + 1)
    squares = np.full(w.shape, 1e-2)
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), size):
            batch = order[at:at + size]
            places = np.concatenate([rows[i][0] for i in batch])
            values = np.concatenate([rows[i][1] for i in batch])
            owner = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            z = w[-1] + np.bincount(owner, w[places] * values, len(batch))
            error = (1 / (1 + np.exp(-z)) - y[batch]) / len(batch)
            touched, back = np.unique(places, return_inverse=True)
            slope = np.bincount(back, error[owner] * values) + decay * w[touched]
            squares[touched] += slope ** 2
            w[touched] -= step * slope / np.sqrt(squares[touched])
            squares[-1] += error.sum() ** 2
            w[-1] -= step * error.sum() / np.sqrt(squares[-1])
    return w


def label_and_score(docs: DataFrame, sample: int = 8_000) -> DataFrame:
    """doc_id, n_votes, posterior (of the label model), score (of the trained scorer) and kept of every document."""
    spark, labellers = docs.sparkSession, len(LABELLERS)

    def vote(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield batch.column(0), [code_of(votes(shape(t)[1])) for t in raw_texts(batch.column(1))]

    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    voted = land(each_batch(narrow, vote, "doc_id long, code long"), "votes")
    patterns = voted.groupBy("code").agg(F.count("*").alias("n")).orderBy("code").collect()  # 3 ** labellers rows at most
    codes = np.array([r["code"] for r in patterns], np.int64)
    good = posteriors(codes, np.array([r["n"] for r in patterns], float), labellers)
    posterior = dict(zip(codes.tolist(), good.tolist()))

    drawn = voted.select(F.col("doc_id").alias("drawn")).distinct().orderBy(F.xxhash64("drawn"), "drawn").limit(sample)

    def featurise(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            made = []
            for text in raw_texts(batch.column(0)):
                words, s = shape(text)
                places, values = features(words, s)
                keep = _learnt(places)
                made.append((places[keep], values[keep], code_of(votes(s))))
            yield [m[0] for m in made], [m[1] for m in made], [m[2] for m in made]

    # ``sample`` rows of distinct ids, each of at most LEARNT words: small enough for every executor and for the driver.
    rows = narrow.join(F.broadcast(drawn), F.col("doc_id") == F.col("drawn")).groupBy("doc_id").agg(
        F.min(F.struct(F.sha2("text", 256).alias("digest"), "text")).alias("one")).select("one.text")
    table = each_batch(rows, featurise, "places array<int>, values array<double>, code long").orderBy("code", F.xxhash64("places")).collect()
    weights = fit([(np.array(r["places"], np.int64), np.array(r["values"])) for r in table], np.array([posterior[r["code"]] for r in table]))
    sent = spark.sparkContext.broadcast((weights, posterior))  # 2 ** BITS weights

    def score(batches: Iterator[pa.RecordBatch]):
        w, known = sent.value
        for batch in batches:
            columns = [[], [], [], []]
            for text in raw_texts(batch.column(1)):
                words, s = shape(text)
                cast = votes(s)
                places, values = features(words, s)
                p = float(1 / (1 + np.exp(-np.clip(w[-1] + w[places] @ values, -30, 30))))
                for column, value in zip(columns, (sum(v != 0 for v in cast), known[code_of(cast)], p, p >= 0.5)):
                    column.append(value)
            yield batch.column(0), *columns

    return each_batch(narrow, score, "doc_id long, n_votes int, posterior double, score double, kept boolean")
