from collections import Counter

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gazetta.functions import lexicon as L
from gazetta.functions import text as T


def values(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, t {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


@pytest.mark.parametrize("entities", ["full", "common"])
def test_clean_text(spark, entities):
    got = values(spark, [None, "", "a<b>c</b>d", "a.b,c:d;e", "&lt;p&gt;x", "  a \n\t b  ", "漢字, ok!"], lambda c: T.clean_text(c, entities=entities))
    assert got == ["", "", "acd", "abc:d;e", "x", "a b", "漢字 ok"]


def test_clean_text_strict_and_full_entities(spark):
    assert values(spark, ["a:b;c"], lambda c: T.clean_text(c, mode="strict")) == ["abc"]
    assert values(spark, ["caf&eacute; &#8364;5 &notanentity;"], lambda c: T.clean_text(c)) == ["café €5 ¬anentity;"]


def test_titles(spark):
    pages = ["<title></title><h1>H</h1>", "<title>a\nb</title>", "<TITLE x=1>A &amp; B</TITLE>", "<h1 class=x>Head</h1>", None, "no tags"]
    assert values(spark, pages, T.extract_title) == ["", None, "A  B", "Head", None, None]


def test_meta_description(spark):
    pages = ["<meta name='description' content='About us'>", '<meta content="x" name="description">', ""]
    assert values(spark, pages, T.extract_meta_description) == ["About us", None, None]


def test_language(spark):
    texts = ["漢漢漢abcdefgh", "かかabcdefgh", "한한abcdefgh", "漢abcdefghi", "", None, "漢"]
    assert values(spark, texts, T.detect_language) == ["zh-cn", "ja", "ko", "en", "en", "en", "zh-cn"]
    assert values(spark, texts, lambda c: T.detect_language(c, "translator")) == ["zh", "ja", "ko", "en", "en", "en", "en"]


def test_entities_and_snippets(spark):
    assert values(spark, ["  The  Acme  Corp ", "An Apple Inc", "Company"], T.normalize_entity) == ["acme", "apple", "company"]
    assert values(spark, ["x" * 200, "x" * 201], T.snippet) == ["x" * 200, "x" * 200 + "..."]


def plain_chunks(text, size):
    if len(text) <= size:
        return [text]
    done, held = [], ""
    for s in text.split(". "):
        if len(held) + len(s) < size:
            held += s + ". "
        else:
            if held:
                done.append(held.strip(" "))
            held = s + ". "
    return [*done, held.strip(" ")] if held else done


def test_chunks(spark):
    texts = ["abc", "a. b. c. d", "one two. three. " * 5, "x" * 40 + ". y", ". . .", "", None]
    got = values(spark, texts, lambda c: T.chunk_text(c, 10))
    assert got[:-1] == [plain_chunks(t, 10) for t in texts[:-1]] and got[-1] == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .", max_size=200))
def test_translation_chunks_keep_letters_and_limit(text):
    chunks = T.translation_chunks(text, 20)
    assert all(len(c) <= 20 for c in chunks)
    letters = lambda s: s.replace(" ", "").replace(".", "")
    if all(len(w) < 19 for w in text.split()):
        assert letters("".join(chunks)) == letters(text)


def test_embedding_text(spark):
    df = spark.createDataFrame([("T#1", "x" * 2001, ["a", ""], []), (None, "", None, ["e f"])], "t string, b string, g array<string>, e array<string>")
    got = [r[0] for r in df.select(T.embedding_text(F.col("t"), F.col("b"), F.col("g"), F.col("e"))).collect()]
    assert got == ["T 1 " + "x" * 2000 + "... Topics: a", "Entities: e f"]


def test_sentiment(spark):
    got = values(spark, ["peace war", "peace dialogue war", "peace", "warm", None], L.sentiment)
    assert [(r["sentiment"], r["confidence"]) for r in got] == [("neutral", 0.5), ("positive", 0.5), ("positive", 0.9), ("negative", 0.9), ("neutral", 0.5)]
    assert values(spark, ["warm", "a war."], lambda c: L.contains_any(c, ["war"], whole_word=True)) == [False, True]


def test_escalation_priority_region(spark):
    lists = [["taiwan", "navy"], ["taiwan", "pla", "invasion", "missile"], [], None, ["Vietnam"], ["a", "b", "c", "d"]]
    assert values(spark, lists, L.escalation_score, "array<string>") == [0.567, 1.0, 0.0, 0.0, 0.0, 0.0]
    assert values(spark, lists, L.region_of, "array<string>") == ["East Asia", "East Asia", "Unknown", "Unknown", "Southeast Asia", "Asia Pacific"]
    assert values(spark, lists, L.priority_of, "array<string>") == ["HIGH", "HIGH", "LOW", "LOW", "LOW", "MEDIUM"]


def test_topics(spark):
    maps = [{"actor": ["PLA"], "event": ["Talks"]}, {"technology": ["missile"]}, {}, {"money": ["$5"]}]
    assert values(spark, maps, L.topics_of_entities, "map<string,array<string>>") == [["diplomatic", "military"], ["military"], [], []]
    assert values(spark, maps, L.topic_of, "map<string,array<string>>") == ["Security & Defense", "Technology", "General", "Economy"]


def test_significance_and_groups(spark):
    df = spark.createDataFrame([(["a"] * 5, "china", None)], "t array<string>, c string, y string")
    assert round(df.select(L.significance(F.col("t"), F.col("c"), F.col("y"))).first()[0], 6) == 0.4
    assert values(spark, ["navy trade in tokyo"], lambda c: L.groups_found(c, L.KEYWORD_GROUPS)) == [["japan", "military", "economic"]]


def test_cleaning_is_idempotent(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    once = df.select(T.clean_text(F.col("text"), entities="common").alias("t"))
    assert once.where(T.clean_text(F.col("t"), entities="common") != F.col("t")).count() == 0


def test_languages_by_ngrams(spark):
    from gazetta.operators import langprofile as LP
    from gazetta.operators import models
    from gazetta.plans import queries

    folder = "/root/testdata/sf0.01"
    make = LP.plug_in(LP.profiles(queries.labelled(spark, folder), "text", "lang"))
    held = queries.docs(spark, folder).join(queries.labelled(spark, folder).select("doc_id"), "doc_id", "left_anti").where(F.length("text") > 100)
    rows = held.select("lang", models.language(F.col("text"), make).alias("found")).collect()
    assert len(rows) > 100 and sum(r.lang == r.found for r in rows) > 0.98 * len(rows)
    one = make()
    assert one.one("") == one.one("12 34") == one.one("\u6f22\u5b57" * 9) == "unknown"
    few = spark.createDataFrame([("a b", "x"), (None, "x"), ("B", None)], "t string, l string")
    assert [tuple(r) for r in LP.profiles(few, "t", "l").orderBy("rank").collect()] == [("x", " a ", 1, 1), ("x", " b ", 1, 2), ("x", "a b", 1, 3)]
    assert LP.profiles(few.limit(0), "t", "l").count() == 0


def test_gram_counts_are_those_of_all_places():
    from gazetta.operators import langprofile as LP

    texts = [" ab abab ", "", "x", "  ", " 😀a😀a é ", "\x00ab"]
    for size in (1, 2, 3, 4):
        want = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
        assert dict(zip(*LP.gram_counts(texts, size), strict=True)) == want
    plug = LP.NgramId([("x", " ab", 5), ("x", "bab", 2), ("y", "aba", 3), ("y", " x ", 1)], least=1)
    some = pd.Series([*texts, None, "aba aba", "😀 ab"])
    assert plug.detect(some).tolist() == [plug.one(t or "") for t in some]


def test_profiles_send_distinct_grams(spark):
    """A row for each n-gram of a slice of texts and not for each place."""
    from gazetta.operators import langprofile as LP

    df = spark.range(50).coalesce(1).select(F.repeat(F.lit("abc "), 500).alias("t"), F.lit("x").alias("l"))
    out = LP.profiles(df, "t", "l")
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.gram: r.n for r in out.collect()} == {" ab": 25000, "abc": 25000, "bc ": 25000, "c a": 24950}
