"""Joins of texts by the Jaccard similarity of their word sets.

The words of a set are sorted with frequent ones last. If two sets share more than t of their words, they share one of the
first size - ceil(t * size) + 1 of either: its prefix. So sets meet at words of their prefixes only, where lengths and places
tell whether enough words can still be shared; what is left is verified. A pair is made at its first common word alone, so
no pair comes twice. Sets that are equal are one until the end.

For each set's best match two passes are made: the first, with the short prefixes of a high threshold, finds
good matches; what it found is then the least that a set still looks for, so frequent words are met only by sets without
a good match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetta.scratch import materialize

#: Words that are sorted last, by how frequent they are; the first pass's threshold.
FREQUENT, HIGH = 256, 0.5


def word_list(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.length(w) > 0))


def frequent_words(sets: DataFrame, most: int = FREQUENT) -> list[str]:
    """The most frequent words, the most frequent last: a list of bounded length."""
    counted = sets.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return [r.word for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()][::-1]


def sorted_sets(df: DataFrame, text: str, frequent: list[str]) -> DataFrame:
    """The distinct word sets of a text column: id (a hash of the words), w sorted with frequent words last, n."""
    known = F.array(*map(F.lit, frequent)) if frequent else F.array().cast("array<string>")
    order = F.array_sort(F.transform("w", lambda x: F.struct(F.array_position(known, x).alias("p"), x.alias("x"))))
    rows = df.select(word_list(F.col(text)).alias("w")).where(F.size("w") > 0)
    rows = rows.select(F.transform(order, lambda s: s["x"]).alias("w"))
    return rows.withColumn("id", set_id("w")).groupBy("id").agg(F.first("w").alias("w")).withColumn("n", F.size("w"))


def set_id(words: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.array_sort(words)), 256)


def least_shared(n: Column, m: Column, t: Column) -> Column:
    """The fewest words that sets of n and m words share if their similarity is above t."""
    return F.greatest(F.lit(1), F.ceil(t / (1 + t) * (n + m) - 1e-6))


def prefix(n: Column, t: Column) -> Column:
    return F.least(n, F.greatest(F.lit(1), n - F.ceil(t * n - 1e-6) + 1)).cast("int")


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs of sets that may be more similar than both least and the left set's own t: a, b, and their words."""
    t = F.col("t")
    x = left.select(F.col("id").alias("a"), F.col("w").alias("x"), F.col("n").alias("n"), "t", F.posexplode(F.slice("w", F.lit(1), prefix(F.col("n"), t))).alias("i", "word"))
    y = right.select(F.col("id").alias("b"), F.col("w").alias("y"), F.col("n").alias("m"), F.posexplode(F.slice("w", F.lit(1), prefix(F.col("n"), F.lit(least)))).alias("j", "word"))
    n, m, i, j = F.col("n"), F.col("m"), F.col("i"), F.col("j")
    lengths = (m >= t * n - 1e-6) & (n >= t * m - 1e-6)
    # places count from 0: the common word and what is behind it on either side
    places = F.least(n - i, m - j) >= least_shared(n, m, t)
    met = x.join(y, "word").where(lengths & places)
    return met.where(~F.arrays_overlap(F.slice("x", F.lit(1), i), F.slice("y", F.lit(1), j))).select("a", "b", "x", "y", "n", "m")


def verified(pairs: DataFrame, least: float) -> DataFrame:
    """a, b and jaccard (9 digits) of pairs above least."""
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.withColumn("s", shared).select("a", "b", F.round(F.col("s") / (F.col("n") + F.col("m") - F.col("s")), 9).alias("jaccard")).where(F.col("jaccard") > least)


def best_matches(rows: DataFrame, topics: DataFrame, row: str, text: str, topic: str, topic_text: str, least: float = 0.1) -> DataFrame:
    """row, topic and jaccard: each row's most similar topic above least (ties: the least topic). Texts without words match nothing."""
    some = rows.select(word_list(F.col(text)).alias("w")).unionByName(topics.select(word_list(F.col(topic_text)).alias("w")))
    frequent = frequent_words(some)
    left, right = materialize(sorted_sets(rows, text, frequent)), materialize(sorted_sets(topics, topic_text, frequent))
    # of topics with equal words the least stands for all
    names = topics.withColumn("w", word_list(F.col(topic_text))).where(F.size("w") > 0).groupBy(set_id("w").alias("b")).agg(F.min(topic).alias(topic))
    order = F.struct(-F.col("jaccard"), F.col(topic))
    first = max(HIGH, least)
    early = verified(candidates(left.withColumn("t", F.lit(first)), right, first), least).join(names, "b")
    early = materialize(early.groupBy("a").agg(F.min_by(F.struct(topic, "jaccard"), order).alias("e")).select("a", f"e.{topic}", "e.jaccard"))
    found = early.select(F.col("a").alias("__a"), F.col("jaccard").alias("__j"))
    # a little less than what was found, so that equals are met too and the least topic wins
    wanted = left.join(found, F.col("id") == F.col("__a"), "left").withColumn("t", F.greatest(F.lit(least), F.coalesce(F.col("__j") - 1e-6, F.lit(least))))
    late = verified(candidates(wanted, right, least), least).join(names, "b").select("a", topic, "jaccard")
    best = early.unionByName(late).groupBy("a").agg(F.min_by(F.struct(topic, "jaccard"), order).alias("e"))
    keyed = rows.withColumn("__w", word_list(F.col(text))).where(F.size("__w") > 0).select(row, set_id("__w").alias("__s"))
    return keyed.join(best, F.col("__s") == F.col("a")).select(row, f"e.{topic}", "e.jaccard")
