"""Vectors as arrays of doubles: products, norms, similarity, blends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def let(value: Column, fn) -> Column:
    """fn(value) with value computed once: within fn it is a bound variable, not an expression to repeat."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def unit(v: Column) -> Column:
    """v over its norm; a zero vector stays."""

    def scaled(s: Column) -> Column:
        return F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"])

    return let(doubles(v), lambda v: let(F.struct(v.alias("v"), norm(v).alias("n")), scaled))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""

    def of(s: Column) -> Column:
        return F.when(s["n"] > 0, s["d"] / s["n"]).otherwise(0.0)

    return let(F.struct(dot(a, b).alias("d"), (norm(a) * norm(b)).alias("n")), of)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def valid(v: Column, size: int) -> Column:
    """Whether v is a vector of that many elements; false for null."""
    return F.coalesce(F.size(v) == size, F.lit(False))


def rescaled(similarity: Column, digits: int = 4) -> Column:
    """From [-1, 1] to [0, 1], clipped and rounded."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (similarity + 1) / 2)), digits)


def blend(text: Column, tags: Column, entities: Column, tag_weight: float = 0.3, entity_weight: float = 0.2) -> Column:
    """text mixed with tags, then with entities, normalised; a null part is left out."""

    def mix(v: Column, other: Column, weight: float) -> Column:
        return F.when(other.isNull(), v).otherwise(F.zip_with(v, doubles(other), lambda x, y: x * (1 - weight) + y * weight))

    return unit(mix(mix(doubles(text), tags, tag_weight), entities, entity_weight))


def decoded(c: Column) -> Column:
    """A vector stored as JSON text."""
    return F.from_json(c, "array<float>")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct lower-case words of two texts; 0 if either has none."""

    def words(c: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: F.length(w) > 0))

    x, y = words(a), words(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def optimal_clusters(n: Column, most: int = 150) -> Column:
    """Number of clusters for n articles: n under 8, 8 up to 9, then a tenth, at least 20 and at most most and n."""
    return F.when(n < 10, F.least(n, F.lit(8))).otherwise(F.least(F.least(F.greatest(F.floor(n / 10), F.lit(20)), F.lit(most)), n)).cast("long")
