"""Word lists and what is read off them: sentiment, tags, places, topics, escalation, priority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazetta.functions.vectors import let

# The lists below decide results and stand in their natural order.
POSITIVE = "cooperation peace dialogue agreement partnership stability progress development growth success positive constructive friendly mutual".split()
NEGATIVE = "conflict tension threat aggression hostility sanction blockade invasion war crisis danger risk escalation provocation".split()
KEYWORD_GROUPS = {
    "china": ["china", "chinese", "beijing"],
    "taiwan": ["taiwan", "taiwanese", "taipei"],
    "usa": ["usa", "america", "united states"],
    "japan": ["japan", "japanese", "tokyo"],
    "military": ["military", "army", "navy", "defense"],
    "economic": ["trade", "economy", "business"],
    "diplomatic": ["diplomat", "embassy", "foreign"],
}
SEMANTIC_GROUPS = {
    "military": ["military", "defense", "armed forces", "navy", "army", "air force"],
    "diplomacy": ["diplomatic", "embassy", "foreign minister", "ambassador"],
    "economic": ["trade", "economic", "market", "business", "investment"],
    "technology": ["technology", "cyber", "tech", "digital", "ai", "semiconductor"],
    "security": ["security", "threat", "risk", "warning", "alert"],
}
COUNTRIES = {
    "china": ["china", "chinese", "beijing"],
    "taiwan": ["taiwan", "taiwanese", "taipei"],
    "usa": ["usa", "america", "united states"],
    "japan": ["japan", "japanese", "tokyo"],
    "south korea": ["korea", "korean", "seoul"],
}
ESCALATION = {"taiwan": 1.0, "pla": 0.9, "invasion": 0.95, "missile": 0.85, "south china sea": 0.7, "navy": 0.7}
#: Topic: names by entity category that show it.
NER_TOPICS = {
    "military": {"actor": ["pla", "ministry of defense", "navy"], "technology": ["missile", "aircraft"]},
    "political": {"command": ["president", "ministry", "minister", "government"], "actor": ["party", "congress", "ministry"]},
    "technology": {"technology": ["ai", "artificial intelligence", "r&d", "research"]},
    "diplomatic": {"event": ["summit", "talks", "negotiation", "diplomacy"]},
    "economic": {"actor": ["bank", "commerce", "trade", "finance"]},
    "security": {"actor": ["security", "coast guard", "police"]},
}
REGIONS = {
    "East Asia": ["china", "taiwan", "south china sea", "east china sea"],
    "Southeast Asia": ["philippines", "vietnam", "malaysia", "indonesia", "singapore"],
    "Northeast Asia": ["japan", "south korea"],
}
HIGH_PRIORITY = ["china", "taiwan", "south china sea", "us navy", "philippines", "japan"]
#: Words that occur in the invented texts, to exercise the matchers on data that the lists above miss.
PLAIN_GROUPS = {"articles": ["the ", "der ", "le ", "el "], "ending": ["tion", "keit", "ment", "ción"], "licence": ["license", "rights"], "rare": ["hahaha", "zzz"]}


def contains_any(text: Column, words: list[str], whole_word: bool = False) -> Column:
    """Whether any word is a substring of text, or stands in it between word borders."""
    if whole_word:
        pattern = "|".join(rf"\Q{w}\E" for w in words)
        return text.rlike(rf"(?U)\b(?:{pattern})\b")
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def count_words(text: Column, words: list[str]) -> Column:
    """How many of the words are substrings of text."""
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])


def groups_found(text: Column, groups: dict[str, list[str]], whole_word: bool = False) -> Column:
    """Names of the groups with a word in text, in the groups' order. The text is computed once."""
    return let(text, lambda t: F.array_compact(F.array(*[F.when(contains_any(t, words, whole_word), name) for name, words in groups.items()])))


def title_and_text(title: Column, content: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit(""))))


def sentiment(text: Column, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE) -> Column:
    """Struct sentiment, confidence, positive_score, negative_score: the side with more words found, at most 0.9 sure."""

    def judged(n: Column) -> Column:
        up, down = n["up"], n["down"]
        sure = F.least(F.lit(0.9), F.abs(up - down) / F.greatest(up, down, F.lit(1)))
        label = F.when(up > down, "positive").when(down > up, "negative").otherwise("neutral")
        return F.struct(label.alias("sentiment"), F.when(up == down, 0.5).otherwise(sure).alias("confidence"), up.alias("positive_score"), down.alias("negative_score"))

    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: let(F.struct(count_words(low, positive).alias("up"), count_words(low, negative).alias("down")), judged))


def sentiment_score(text: Column, **lists) -> Column:
    """Signed confidence: the default of the pluggable sentiment model."""
    return let(sentiment(text, **lists), lambda s: F.when(s["sentiment"] == "positive", s["confidence"]).when(s["sentiment"] == "negative", -s["confidence"]).otherwise(0.0))


def primary_country(text: Column, countries: dict[str, list[str]] = COUNTRIES) -> Column:
    """The first country, in the table's order, with a name in text; null without one."""
    return let(text, lambda t: F.coalesce(*[F.when(contains_any(t, words), name) for name, words in countries.items()]))


def locations(text: Column, countries: dict[str, list[str]] = COUNTRIES) -> Column:
    """All countries with a name in text, in the table's order."""
    return groups_found(text, countries)


def significance(keyword_tags: Column, country: Column, city: Column) -> Column:
    tags = F.least(F.size(keyword_tags) / 10, F.lit(0.3))
    return F.least(tags + F.when(country.isNotNull(), 0.1).otherwise(0.0) + F.when(city.isNotNull(), 0.1).otherwise(0.0), F.lit(1.0))


def escalation_score(entities: Column, weights: dict[str, float] = ESCALATION) -> Column:
    """Sum of the entities' weights over 3, at most 1, to three places."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    total = F.aggregate(entities, F.lit(0.0), lambda a, e: a + F.coalesce(F.element_at(table, F.lower(e)), F.lit(0.0)))
    return F.round(F.least(F.coalesce(total, F.lit(0.0)) / 3, F.lit(1.0)), 3)


def high_priority_tags(tags: Column, threshold: float = 0.7, weights: dict[str, float] = ESCALATION) -> Column:
    """Tags whose value (behind the last colon) weighs at least threshold."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.filter(tags, lambda t: F.coalesce(F.element_at(table, F.lower(F.substring_index(t, ":", -1))), F.lit(0.0)) >= threshold)


def _lower_all(values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), F.lower)


def topics_of_entities(categories: Column) -> Column:
    """Sorted topics of a map from category to entities."""
    found = []
    for topic, by_category in NER_TOPICS.items():
        hits = [F.arrays_overlap(_lower_all(F.element_at(categories, category)), F.array(*map(F.lit, names))) for category, names in by_category.items()]
        found.append(F.when(reduce(lambda a, b: a | b, hits), topic))
    return F.array_sort(F.array_compact(F.array(*found)))


def region_of(geo: Column) -> Column:
    """Unknown without places, else the first region with one of them, else Asia Pacific."""
    names = _lower_all(geo)
    region = F.coalesce(*[F.when(F.arrays_overlap(names, F.array(*map(F.lit, places))), region) for region, places in REGIONS.items()], F.lit("Asia Pacific"))
    return F.when(F.size(names) == 0, "Unknown").otherwise(region)


def topic_of(categories: Column) -> Column:
    def has(category: str) -> Column:
        return F.coalesce(F.size(F.element_at(categories, category)), F.lit(0)) > 0

    return F.when(has("event") | has("facility"), "Security & Defense").when(has("technology"), "Technology").when(has("money"), "Economy").when(has("law"), "Politics").otherwise("General")


def priority_of(entities: Column) -> Column:
    names = _lower_all(entities)
    return F.when(F.arrays_overlap(names, F.array(*map(F.lit, HIGH_PRIORITY))), "HIGH").when(F.size(names) > 3, "MEDIUM").otherwise("LOW")


def priority_mark(level: Column) -> Column:
    return F.when(level == "HIGH", "🔴").when(level == "MEDIUM", "🟡").when(level == "LOW", "🟢").otherwise("⚪")


def escalation_mark(score: Column) -> Column:
    return F.when(score >= 8, "🚨").when(score >= 6, "⚠️").when(score >= 4, "📈").otherwise("📊")
