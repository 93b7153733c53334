"""Model-backed steps as plug-ins, each with a default that runs offline and says what it is: a heuristic.

A plug-in is an object with one method over pandas Series. `apply` wraps it as an Arrow UDF; it is made once per task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gazetta.functions import text as T
from gazetta.scratch import materialize

DIMENSION = 384
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Frequent words by language for the default language vote.
LANGUAGE_WORDS = {
    "en": "the of and to in is that it for on with as was be by this are from or an".split(),
    "de": "der die und das nicht von zu den mit ist auf für im dem sich ein eine als auch es".split(),
    "fr": "le la les des et est une dans que qui pour pas sur du au par avec il elle de".split(),
    "es": "el la los las y que en un una por con para del se no es lo como más su".split(),
}
#: Names that the default annotator knows, with entity labels.
GAZETTEER = {
    "GPE": ["china", "taiwan", "japan", "philippines", "vietnam", "beijing", "taipei", "tokyo", "south korea", "singapore", "united states"],
    "LOC": ["south china sea", "east china sea", "taiwan strait", "indo-pacific"],
    "ORG": ["pla", "us navy", "navy", "coast guard", "ministry of defense", "united nations", "nato", "asean", "bank"],
    "EVENT": ["summit", "talks", "negotiation", "exercise"],
    "FAC": ["airport", "naval base", "shipyard"],
    "PRODUCT": ["missile", "aircraft", "submarine", "ai", "semiconductor"],
}


class Annotator(Protocol):
    """Entities of texts: lists of (text, label)."""

    def annotate(self, texts: pd.Series) -> pd.Series: ...


class Embedder(Protocol):
    """Unit vectors of texts."""

    def embed(self, texts: pd.Series) -> pd.Series: ...


class Summarizer(Protocol):
    def summarize(self, texts: pd.Series) -> pd.Series: ...


class Translator(Protocol):
    def translate(self, texts: pd.Series) -> pd.Series: ...


class LanguageId(Protocol):
    def detect(self, texts: pd.Series) -> pd.Series: ...


class GazetteerAnnotator:
    """Known names, and money, dates and numbers by pattern; names may overlap, longer ones first."""

    def __init__(self, names: dict[str, list[str]] = GAZETTEER):
        pairs = sorted(((n, label) for label, some in names.items() for n in some), key=lambda x: (-len(x[0]), x[0]))
        self.labels = {n: label for n, label in reversed(pairs)}
        self.names = re.compile(r"\b(" + "|".join(re.escape(n) for n, _ in pairs) + r")\b", re.I)
        self.patterns = [("MONEY", re.compile(r"[$€£]\s?\d[\d,.]*\d|\$\d")), ("DATE", re.compile(r"\b\d{4}-\d{2}-\d{2}\b")), ("CARDINAL", re.compile(r"\b\d+\b"))]

    def one(self, text: str) -> list[dict]:
        found = [{"text": m[0], "label": self.labels[m[0].lower()]} for m in self.names.finditer(text)]
        for label, pattern in self.patterns:
            found += [{"text": m[0], "label": label} for m in pattern.finditer(text)]
        return found

    def annotate(self, texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(self.one)


class NormalizedAnnotator:
    """Another annotator's entities with normalised, non-empty names, each pair of name and label once."""

    def __init__(self, inner: Annotator):
        self.inner = inner

    @staticmethod
    def name(text: str) -> str:
        low = re.sub(r"^(the|a|an)\s+", "", " ".join(text.split()).lower())
        return re.sub(r"\s+(inc|corp|llc|ltd|co|company|corporation)$", "", low)

    def one(self, found: list[dict]) -> list[dict]:
        pairs = {(self.name(e["text"]), e["label"]): None for e in found}
        return [{"text": t, "label": label} for t, label in pairs if t]

    def annotate(self, texts: pd.Series) -> pd.Series:
        return self.inner.annotate(texts).map(self.one)


class Places(dict):
    """The place and sign of grams, 2 * place + (sign is plus), made once for each gram; all are forgotten beyond most."""

    def __init__(self, size: int, most: int = 1 << 17, longest: int = 64):
        super().__init__()
        self.size, self.most, self.longest = size, most, longest

    def __missing__(self, gram: str) -> int:
        h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "big")
        at = h % self.size * 2 + (h >> 63)
        if len(gram) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[gram] = at
        return at


class HashEmbedder:
    """Signed feature hashing of words and word pairs, normalised: the same text has the same vector everywhere."""

    def __init__(self, size: int = DIMENSION):
        self.size, self.places = size, Places(size)

    def one(self, text: str) -> list[float]:
        return self.vector(text).tolist()

    def vector(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        grams = [*words, *map(" ".join, zip(words, words[1:], strict=False))]
        hits = np.bincount(np.fromiter(map(self.places.__getitem__, grams), np.int64, len(grams)), minlength=2 * self.size)
        v = (hits[1::2] - hits[::2]).astype(float)
        norm = np.sqrt(v @ v)
        return v / norm if norm else v

    def embed(self, texts: pd.Series) -> pd.Series:
        return pd.Series([self.vector(x) for x in texts.fillna("")], dtype=object)


class SeededEmbedder:
    """Normal noise seeded by the text's hash: a stand-in for tests of what follows, without meaning."""

    def __init__(self, size: int = DIMENSION):
        self.size = size

    def one(self, text: str) -> list[float]:
        seed = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big")
        return np.random.default_rng(seed).normal(size=self.size).tolist()

    def embed(self, texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(self.one)


class LeadSummarizer:
    """First sentences up to a length; short texts pass, cut at snippet length."""

    def __init__(self, short: int = 100, most: int = 600, snippet: int = 200):
        self.short, self.most, self.snippet = short, most, snippet

    def one(self, text: str) -> str:
        bare = text.strip()
        if len(bare) < self.short:
            return bare[: self.snippet] + ("..." if len(bare) > self.snippet else "")
        out = ""
        for sentence in _SENTENCE.split(" ".join(bare.split())):
            if out and len(out) + 1 + len(sentence) > self.most:
                break
            out = f"{out} {sentence}".strip()
        return out if len(out) <= self.most else out[: self.most] + "..."

    def summarize(self, texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(self.one)


class SameText:
    """No translation service: texts pass."""

    def translate(self, texts: pd.Series) -> pd.Series:
        return texts


class WordVote:
    """The language with most frequent words in the text; unknown without any."""

    def one(self, text: str) -> str:
        words = _WORD.findall(text.lower())
        votes = {code: sum(map(frozenset(some).__contains__, words)) for code, some in LANGUAGE_WORDS.items()}
        best = max(votes, key=lambda c: (votes[c], -list(votes).index(c)))
        return best if votes[best] else "unknown"

    def detect(self, texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(self.one)


def apply(c: Column, make: Callable[[], object], method: str, kind: str) -> Column:
    """c through a plug-in's method; make() runs once per task. Texts become Python objects by slices, whatever a batch has."""

    @F.arrow_udf(kind)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        plug = getattr(make(), method)
        for s in T.slices(parts):
            yield pa.Array.from_pandas(plug(s), type=arrow)

    arrow = to_arrow_type(run.returnType)

    return run(c)


def apply_all(columns: list[Column], make: Callable[[], object], method: str, kind: str) -> Column:
    """An array of what apply gives for each of some columns, by one worker of a task and not by one for each."""
    k = len(columns)

    @F.arrow_udf(f"array<{kind}>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        plug = getattr(make(), method)
        for a in T.pieces(parts):
            values = pa.Array.from_pandas(plug(a.flatten().to_pandas()), type=arrow.value_type)
            yield pa.ListArray.from_arrays(pa.array(range(0, k * len(a) + 1, k), pa.int32()), values, type=arrow)

    arrow = to_arrow_type(run.returnType)
    return run(F.array(*columns))


def tried(c: Column, make: Callable[[], object], method: str, kind: str) -> Column:
    """apply, with what went wrong: a struct of value and error. A batch in which a row fails is taken row by row, so only that row has no value."""

    @F.pandas_udf(f"value {kind}, error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        plug, missing = None, None
        try:
            plug = getattr(make(), method)
        except Exception as e:  # noqa: BLE001  the plug-in itself: all rows fail alike
            missing = f"{type(e).__name__}: {e}"

        def one(x: object) -> tuple[object, str | None]:
            try:
                return plug(pd.Series([x])).iloc[0], None
            except Exception as e:  # noqa: BLE001  what a plug-in may raise is not known
                return None, f"{type(e).__name__}: {e}"

        for s in parts:
            if missing is not None:
                rows = [(None, missing)] * len(s)
            else:
                try:
                    rows = [(x, None) for x in plug(s)]
                except Exception:  # noqa: BLE001
                    rows = [one(x) for x in s]
            yield pd.DataFrame({"value": pd.Series([x for x, _ in rows], dtype=object), "error": pd.Series([e for _, e in rows], dtype=object)})

    return run(c)


def entities(c: Column, make: Callable[[], Annotator] = GazetteerAnnotator) -> Column:
    return apply(c, make, "annotate", "array<struct<text:string,label:string>>")


def embedding(c: Column, make: Callable[[], Embedder] = HashEmbedder) -> Column:
    return apply(c, make, "embed", "array<double>")


def summary(c: Column, make: Callable[[], Summarizer] = LeadSummarizer) -> Column:
    return apply(c, make, "summarize", "string")


def translation(c: Column, make: Callable[[], Translator] = SameText) -> Column:
    return apply(c, make, "translate", "string")


def language(c: Column, make: Callable[[], LanguageId] = WordVote) -> Column:
    return apply(c, make, "detect", "string")


def tfidf(df: DataFrame, key: str, text: Column, features: int = 1000) -> DataFrame:
    """key, term, weight: the sparse TF-IDF vectors of all texts, of unit length.

    Terms are words of two or more letters or digits, and pairs of them, without the most frequent English words; the
    features most frequent in all texts (ties: by term) make the vocabulary. Weights are counts times ln((1 + texts) / (1 +
    texts with the term)) + 1. Texts without such a term have no row.

    A pair is not more frequent than either of its words. So words are counted first, and pairs only of words that are as
    frequent as the last of the features most frequent ones: what is shuffled follows the words, not the pairs of all texts.
    """
    stop = LANGUAGE_WORDS["en"]
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), 0), lambda w: ~w.isin(stop))
    texts = df.select(key, words.alias("__w"))
    totals = materialize(texts.select(F.explode("__w").alias("term")).groupBy("term").agg(F.count("*").alias("total")))
    last = totals.orderBy(F.desc("total"), "term").limit(features).agg(F.min("total")).first()[0]
    often = materialize(totals.where(F.col("total") >= F.lit(last)).select("term"))
    pairs = F.when(F.size("__w") > 1, F.zip_with(F.slice("__w", 1, F.size("__w") - 1), F.slice("__w", 2, F.size("__w") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    both = texts.select(key, F.explode(pairs).alias("p")).select(key, "p.a", "p.b")
    for side in ("a", "b"):
        both = both.join(often.select(F.col("term").alias(side)), side, "left_semi")
    terms = texts.select(key, F.explode("__w").alias("term")).join(often, "term", "left_semi").select(key, "term")
    counts = materialize(terms.unionByName(both.select(key, F.concat_ws(" ", "a", "b").alias("term"))).groupBy(key, "term").agg(F.count("*").alias("n")))
    n = df.count()
    vocabulary = counts.groupBy("term").agg(F.sum("n").alias("total"), F.count("*").alias("texts")).orderBy(F.desc("total"), "term").limit(features)
    idf = vocabulary.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("texts"))) + 1).alias("idf"))
    weighted = counts.join(F.broadcast(idf), "term").select(key, "term", (F.col("n") * F.col("idf")).alias("x"))
    norms = weighted.groupBy(F.col(key).alias("__k")).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return weighted.join(norms, F.col(key) == F.col("__k")).select(key, "term", (F.col("x") / F.col("norm")).alias("weight"))
