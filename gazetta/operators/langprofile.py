"""Languages of texts by character n-grams: profiles from labelled texts, and naive Bayes over them.

A profile is the most frequent n-grams of a language's texts with their counts; counting is a grouped aggregation, and
what is kept has a fixed size, so it may be sent to all workers. A text's language is the one whose profile makes its
n-grams likeliest, over the n-grams that any profile has (add-one smoothing); with fewer than LEAST of them it is unknown.
Texts are in lower case, with one space for white space and one at either end.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazetta.functions.text import slices

SIZE, TOP, LEAST, DIGITS = 3, 300, 5, 6
_WHITE = re.compile("[ \t\n\r\f]+")


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[ \t\n\r\f]+", " ")), F.lit(" "))


#: Bits of a character, and characters that one number has room for.
BITS, FIT = 21, 3


def gram_keys(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of texts as numbers (size at most FIT), and the text that each is in."""
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    n = max(0, len(c) - size + 1)
    keys = np.zeros(n, np.int64)
    for i in range(size):
        keys = keys << BITS | c[i : i + n]
    whole = owner[:n] == owner[size - 1 : size - 1 + n]
    return keys[whole], owner[:n][whole]


def key_of(gram: str) -> int:
    return sum(ord(x) << BITS * i for i, x in enumerate(reversed(gram)))


def gram_of(key: int, size: int) -> str:
    return "".join(chr(key >> BITS * i & (1 << BITS) - 1) for i in reversed(range(size)))


def gram_counts(texts: list[str], size: int) -> tuple[list[str], list[int]]:
    """The distinct n-grams of some texts with their counts."""
    if size > FIT:
        found = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
        return list(found), list(found.values())
    keys, n = np.unique(gram_keys(texts, size)[0], return_counts=True)
    return [gram_of(k, size) for k in keys.tolist()], n.tolist()


def profiles(df: DataFrame, text: str, language: str, size: int = SIZE, top: int = TOP) -> DataFrame:
    """language, gram, n, rank: the top most frequent n-grams of each language (ties: the least gram).

    Each slice of a batch gives its distinct n-grams with their counts, so rows follow these and not the texts' length.
    """
    rows = df.where(F.col(language).isNotNull()).select(F.col(language).alias("language"), padded(F.col(text)).alias("t"))
    schema = df.select(F.col(language).alias("language"), F.lit("").alias("gram"), F.lit(0).cast("long").alias("n")).schema

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for s in slices([batch.column("t")]):
                names, at = pd.Series(batch.column("language").slice(at, len(s)).to_pylist(), dtype=object), at + len(s)
                for name, texts in s.groupby(names.to_numpy()):
                    found, n = gram_counts(texts.tolist(), size)
                    kind = batch.schema.field("language").type
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), kind), pa.array(found, pa.string()), pa.array(n, pa.int64())], ["language", "gram", "n"])

    counts = rows.mapInArrow(counted, schema).groupBy("language", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top)


class NgramId:
    """A language plug-in for models.language, from profiles as rows (language, gram, n)."""

    def __init__(self, rows: list[tuple[str, str, int]], size: int = SIZE, least: int = LEAST):
        self.size, self.least = size, least
        self.names = sorted({r[0] for r in rows})
        vocabulary = {g for _, g, _ in rows}
        totals = Counter()
        for name, _, n in rows:
            totals[name] += n
        known = {(name, g): n for name, g, n in rows}
        self.weights = {g: [math.log((known.get((name, g), 0) + 1) / (totals[name] + len(vocabulary))) for name in self.names] for g in vocabulary}
        if size <= FIT:
            self.keys = np.array(sorted(key_of(g) for g in vocabulary), np.int64)
            self.table = np.array([self.weights[gram_of(k, size)] for k in self.keys.tolist()]).reshape(len(self.keys), len(self.names))

    def padded(self, text: str) -> str:
        return f" {_WHITE.sub(' ', text.lower()).strip(' ')} "

    def best(self, scores: list[float], seen: int) -> str:
        if seen < self.least:
            return "unknown"
        # rounded, so that the order of addition does not count; of equals the first name
        return self.names[max(range(len(self.names)), key=lambda k: (round(scores[k], DIGITS), -k))]

    def one(self, text: str) -> str:
        t = self.padded(text)
        scores, seen = [0.0] * len(self.names), 0
        for g, n in Counter(t[i : i + self.size] for i in range(len(t) - self.size + 1)).items():
            if (w := self.weights.get(g)) is not None:
                seen += n
                for k, x in enumerate(w):
                    scores[k] += n * x
        return self.best(scores, seen)

    def detect(self, texts: pd.Series) -> pd.Series:
        texts = texts.fillna("")
        if self.size > FIT or not len(self.keys):
            return texts.map(self.one)
        keys, owner = gram_keys([self.padded(t) for t in texts], self.size)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[place] == keys
        place, owner = place[known], owner[known]
        seen = np.bincount(owner, minlength=len(texts)).tolist()
        scores = np.stack([np.bincount(owner, self.table[place, k], len(texts)) for k in range(len(self.names))], 1).tolist()
        return pd.Series([self.best(x, n) for x, n in zip(scores, seen, strict=True)], dtype=object)


def plug_in(found: DataFrame, size: int = SIZE, least: int = LEAST) -> Callable[[], NgramId]:
    """A maker for models.language. The profiles, of a fixed number of rows a language, come to the driver and go to the workers."""
    rows = [(r.language, r.gram, r.n) for r in found.select("language", "gram", "n").collect()]
    return lambda: NgramId(rows, size, least)
