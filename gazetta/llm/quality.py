"""Quality classifier with hierarchical empirical Bayes.

Each document gives evidence of its own: a logistic regression over measures of its whole text (shares of capitals,
symbols and digits, repetition, word lengths), as log odds against the rate of good documents. Documents also stand on
a site: a host, and a section (path) of it. A host's rate is a beta posterior around the global rate, a section's one
around its host's; the strength of either prior is estimated from how much hosts (sections of a host) differ, by the
method of moments, so sites with few documents are shrunk and sites with many speak for themselves. All counts
are sums of the documents' own probabilities over all documents, by grouped aggregation; a document is left out of
its own site's rate. The score adds a section's log odds to the document's evidence.

The regression is fitted on at most TRAIN_ROWS labelled rows: the ids with the least hash, one row each (of several the one
with the least measures); rows whose crc32(id) modulo 5 is 0 are never learnt from. Everything else covers all rows.

Defined results: null and empty texts have zero measures; null hosts and sections are the empty string; null labels
are not learnt from, of several labels for an id the largest counts; without any label evidence is 0 and the score is
the site's rate of one half; repeated rows each count and repeat their result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetta.llm.common import map_texts, materialize
from gazetta.llm.toxicity import held_out

TRAIN_ROWS, RIDGE, STEPS = 20_000, 1.0, 25
#: The least and greatest strength of a prior, in documents.
STRENGTH = (1.0, 1e6)
MEASURES = ("length", "capitals", "marks", "symbols", "digits", "blanks", "lines", "non_ascii", "word_length", "distinct", "doubled", "tail")
_CAPITALS = bytes(range(65, 91))
_LOWERS = bytes(range(97, 123))
_MARKS, _SYMBOLS, _DIGITS = b"!?", b"#$%&*@^~|<>{}[]=+_\\", b"0123456789"
_NON_ASCII = bytes(range(128, 256))


def measures(text: str) -> list[float]:
    """The measures of a text, in the order of MEASURES."""
    raw = text.encode()
    n = len(raw)
    if not n:
        return [0.0] * len(MEASURES)

    def share(kind: bytes) -> float:
        return (n - len(raw.translate(None, kind))) / n

    words = raw.split()
    many = max(len(words), 1)
    capitals, lowers = share(_CAPITALS), share(_LOWERS)
    doubled = sum(map(bytes.__eq__, words, words[1:])) / many
    odd = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / many
    return [
        float(np.log1p(n)), capitals / max(capitals + lowers, 1e-9), share(_MARKS), share(_SYMBOLS), share(_DIGITS), share(b" \t"), share(b"\n"), share(_NON_ASCII),
        n / many, len(set(words)) / many ** 0.8, doubled, odd,
    ]


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge-penalised logistic regression on raw measures, by Newton steps."""
    if not len(y) or y.min() == y.max():
        return np.zeros(len(MEASURES)), 0.0
    mean, spread = x.mean(0), x.std(0)
    spread[spread == 0] = 1
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([RIDGE] * len(MEASURES) + [1e-6])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    raw = w[:-1] / spread
    return raw, float(w[-1] - raw @ mean)


def log_odds(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def site_of_url(url: Column) -> tuple[Column, Column]:
    """Host (without www.) and first path segment of a URL; empty strings if it has none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]*)", 1), F.lit(""))


def _strength(sites: DataFrame, mean: Column, weights: str = "n") -> DataFrame:
    """One row: the strength k of the beta prior, from the sites' rates around mean."""
    rate = F.col("good") / F.col(weights)
    observed = F.sum(F.col(weights) * (rate - mean) ** 2) / F.sum(weights)
    sampling = F.sum("inner") / F.sum(weights)
    level = F.sum(F.col("good")) / F.sum(weights)
    between = F.greatest(observed - sampling, F.lit(1e-9))
    k = F.least(F.greatest(level * (1 - level) / between - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))
    return sites.agg(F.coalesce(k, F.lit(STRENGTH[1])).alias("k"))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    host: Column,
    section: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    rows: int = TRAIN_ROWS,
) -> DataFrame:
    """doc_id, host, section, held_out, evidence (log odds of its own), host_rate, section_rate, score, predicted."""
    plain = docs.select(F.col(doc_id).alias("__id"), F.coalesce(host, F.lit("")).alias("__host"), F.coalesce(section, F.lit("")).alias("__section"), F.col(text).alias("__x"))
    measured = materialize(map_texts(plain, "__x", ["__id", "__host", "__section"], lambda: lambda x: (measures(x),), "m array<double>"))
    known = labels.select(F.col(doc_id).alias("__l"), F.col(label).cast("int").alias("__y")).where(F.col("__y").isNotNull() & ~held_out("__l"))
    known = known.groupBy("__l").agg(F.max("__y").alias("__y"))
    some = known.orderBy(F.xxhash64("__l"), "__l").limit(rows)
    found = measured.join(F.broadcast(some), F.col("__id") == F.col("__l")).groupBy("__id").agg(F.min("m").alias("m"), F.max("__y").alias("__y")).select("m", "__y").toPandas()
    x = np.array(found["m"].tolist(), float).reshape(-1, len(MEASURES))
    y = found["__y"].to_numpy(float)
    order = np.lexsort((y, *x.T)) if len(y) else []  # rows come in any order; sums shall not
    weights, intercept = logistic(x[order], y[order])
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    own = F.lit(intercept if len(y) else 0.0)
    for i, w in enumerate(weights):
        own = own + F.get("m", F.lit(i)) * float(w)
    evidence = F.least(F.greatest(own - float(np.log(base / (1 - base))), F.lit(-30.0)), F.lit(30.0))
    judged = measured.select("__id", "__host", "__section", evidence.alias("evidence"))
    judged = judged.withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + float(np.log(base / (1 - base)))))))

    # grouped aggregation: sections first, hosts from sections, the globe from hosts
    sections = materialize(judged.groupBy("__host", "__section").agg(F.count("*").alias("n"), F.sum("p").alias("good"), (F.sum(F.col("p") * (1 - F.col("p"))) / F.count("*")).alias("inner")))
    hosts = materialize(sections.groupBy("__host").agg(F.sum(F.col("inner") * F.col("n")).alias("__i"), F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("inner", F.col("__i") / F.col("n")).drop("__i"))
    world = hosts.agg(F.coalesce(F.sum("good") / F.sum("n"), F.lit(0.5)).alias("mu")).first()["mu"]
    k_host = _strength(hosts, F.lit(world)).first()["k"]
    host_rates = hosts.select(F.col("__host").alias("__h"), F.col("n").alias("host_n"), F.col("good").alias("host_good"))
    joined = sections.join(host_rates, F.col("__host") == F.col("__h"))
    k_section = _strength(joined, F.col("host_good") / F.col("host_n")).first()["k"]
    sites = materialize(joined.select(F.col("__host").alias("__h"), F.col("__section").alias("__s"), "n", "good", "host_n", "host_good"))

    both = judged.join(sites, (F.col("__host") == F.col("__h")) & (F.col("__section") == F.col("__s")))
    host_rate = (F.col("host_good") - F.col("p") + k_host * world) / (F.col("host_n") - 1 + k_host)
    section_rate = (F.col("good") - F.col("p") + k_section * F.col("host_rate")) / (F.col("n") - 1 + k_section)
    out = both.withColumn("host_rate", host_rate).withColumn("section_rate", section_rate)
    out = out.withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + log_odds(F.col("section_rate"))))))
    return out.select(
        F.col("__id").alias(doc_id), F.col("__host").alias("host"), F.col("__section").alias("section"), held_out("__id").alias("held_out"),
        "evidence", "host_rate", "section_rate", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
