"""Entities to categories, prefixed tags and tag summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetta.functions import lexicon as L
from gazetta.functions import text as T
from gazetta.functions import vectors as V
from gazetta.operators import models

#: Entity label, category, tag prefix. Other labels are entities only.
LABELS = [
    ("GPE", "geo", "GEO"), ("LOC", "geo", "GEO"), ("ORG", "actor", "ACT"), ("PERSON", "command", "CMD"), ("EVENT", "event", "EVT"),
    ("FAC", "facility", "FAC"), ("PRODUCT", "technology", "TECH"), ("DATE", "time", "TIME"), ("TIME", "time", "TIME"),
    ("QUANTITY", "quantity", "QTY"), ("CARDINAL", "quantity", "QTY"), ("MONEY", "money", "MONEY"), ("LAW", "law", "LAW"),
    ("LANGUAGE", "language", "LANG"), ("NORP", "nationality", "NAT"), ("ORDINAL", "ordinal", "ORD"),
]
CATEGORIES = list(dict.fromkeys(c for _, c, _ in LABELS))


def _lookup(at: int) -> Column:
    return F.create_map(*[F.lit(x) for row in LABELS for x in (row[0], row[at])])


def with_error(df: DataFrame, *errors: Column) -> DataFrame:
    """Adds error, or keeps the one that a row has: the first of some that is not null."""
    own = [F.col("error")] if "error" in df.columns else []
    return df.withColumn("error", F.coalesce(*own, *errors))


def tag_columns(entities: Column, normalized: bool = False) -> dict[str, Column]:
    """entities, tags (prefixed) and tag_categories of an array of structs (text, label); all sorted and distinct."""
    named = entities
    if not normalized:
        named = F.filter(F.transform(entities, lambda e: F.struct(T.normalize_entity(e["text"]).alias("text"), e["label"].alias("label"))), lambda e: F.length(e["text"]) > 0)

    def of(category: str) -> Column:
        labels = [label for label, c, _ in LABELS if c == category]
        return F.array_sort(F.array_distinct(F.transform(F.filter(named, lambda e: e["label"].isin(labels)), lambda e: e["text"])))

    tags = F.transform(F.filter(named, lambda e: F.element_at(_lookup(2), e["label"]).isNotNull()), lambda e: F.concat(F.element_at(_lookup(2), e["label"]), F.lit(":"), e["text"]))
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), of(c).alias("value")) for c in CATEGORIES]), lambda p: F.size(p["value"]) > 0)
    return {
        "entities": F.array_sort(F.array_distinct(F.transform(named, lambda e: e["text"]))),
        "tags": F.array_sort(F.array_distinct(tags)),
        "tag_categories": F.map_from_entries(pairs),
    }


def tag_articles(df: DataFrame, title: str, text: str, make=models.GazetteerAnnotator, errors: bool = False) -> DataFrame:
    """Adds entities, tags, tag_categories, sentiment, topics, escalation_score, region, topic and priority_level.

    With errors, rows that the annotator fails on have no entities and an error.
    """
    # names are normalised beside the model, so that the categories below are plain filters
    both, named = F.concat_ws(" ", F.col(title), F.col(text)), lambda: models.NormalizedAnnotator(make())
    if errors:
        found = df.withColumn("__x", models.tried(both, named, "annotate", "array<struct<text:string,label:string>>"))
        found = with_error(found.withColumn("__e", F.col("__x.value")), F.col("__x.error")).drop("__x")
    else:
        found = df.withColumn("__e", models.entities(both, named))
    out = found.withColumns(tag_columns(F.col("__e"), normalized=True)).drop("__e")
    return out.withColumns(
        {
            "sentiment": L.sentiment(F.col(text)),
            "topics": L.topics_of_entities(F.col("tag_categories")),
            "escalation_score": L.escalation_score(F.col("entities")),
            "region": L.region_of(F.element_at("tag_categories", F.lit("geo"))),
            "topic": L.topic_of(F.col("tag_categories")),
            "priority_level": L.priority_of(F.col("entities")),
        }
    )


def merge_chunks(df: DataFrame, key: str, columns: tuple[str, ...] = ("tags", "entities")) -> DataFrame:
    """Array columns of an article's chunks, put together, distinct and sorted."""
    return df.groupBy(key).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in columns])


def only_categories(categories: Column, wanted: list[str]) -> Column:
    return F.map_filter(categories, lambda k, _: k.isin(wanted))


def tag_summary(categories: Column, n: int = 3) -> Column:
    """"Category: a, b, c..." by category in order, joined by "; "; a fixed text without any."""
    entries = F.array_sort(F.map_entries(F.coalesce(categories, F.create_map().cast("map<string,array<string>>"))))
    filled = F.filter(entries, lambda e: F.size(e["value"]) > 0)
    said = F.transform(filled, lambda e: F.concat(F.initcap(e["key"]), F.lit(": "), F.array_join(F.slice(e["value"], 1, n), ", "), F.when(F.size(e["value"]) > n, "...").otherwise("")))
    return F.when(F.size(filled) > 0, F.array_join(said, "; ")).otherwise("No tags identified")


def word_counts(words: Column) -> Column:
    """Distinct words of an array with their counts (structs n, w), by sorting and the places where runs begin: nothing is shuffled."""

    def runs(ws: Column) -> Column:
        begin = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: (i == 0) | (F.get(ws, i) != F.get(ws, i - 1)))

        def counted(at: Column) -> Column:
            return F.transform(at, lambda i, k: F.struct((F.coalesce(F.get(at, k + 1), F.size(ws)) - i).alias("n"), F.get(ws, i).alias("w")))

        return V.let(begin, counted)

    empty = F.array().cast("array<struct<n:int,w:string>>")
    return F.when(F.size(words) > 0, V.let(F.array_sort(words), runs)).otherwise(empty)


def keywords(df: DataFrame, key: str, title: Column, text: Column, groups: dict[str, list[str]], n: int = 10) -> DataFrame:
    """key, found (group names with a phrase in the text), general (words over two letters that occur twice, most frequent first, at most n of the first 20)."""
    stop = sorted({w for some in models.LANGUAGE_WORDS.values() for w in some})

    def of(low: Column) -> Column:
        words = F.filter(F.split(low, r"(?U)[^\p{L}\p{N}_]+"), lambda w: (F.length(w) > 2) & ~w.isin(stop))
        often = F.filter(word_counts(words), lambda x: x["n"] > 1)
        ranked = F.slice(F.array_sort(F.transform(often, lambda x: F.struct((-x["n"]).alias("m"), x["w"].alias("w")))), 1, min(n, 20))
        return F.struct(L.groups_found(low, groups).alias("found"), F.transform(ranked, lambda x: x["w"]).alias("general"))

    found = df.select(key, V.let(L.title_and_text(title, text), of).alias("__k"))
    return found.select(key, "__k.found", "__k.general")
