"""Records that a model fails on: their batch goes on, three tries, then they are given up."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gazetta.operators import models
from gazetta.sources import store
from gazetta.streaming import chain


class Fussy:
    """Fails on texts that hold a word, as a service does on a request."""

    def __init__(self, word):
        self.word = word

    def _all(self, texts):
        if texts.fillna("").str.contains(self.word).any():
            raise ValueError(f"no {self.word}")
        return texts

    def embed(self, texts):
        return self._all(texts).map(lambda t: [float(len(t or "")), 1.0])

    def translate(self, texts):
        return self._all(texts).map(lambda t: t and f"en {t}")

    def annotate(self, texts):
        return self._all(texts).map(lambda t: [{"text": "taiwan", "label": "GPE"}])


class Broken:
    def __init__(self):
        raise OSError("no model")

    def embed(self, texts: pd.Series) -> pd.Series:
        return texts


def test_only_the_failing_row_has_no_value(spark):
    df = spark.createDataFrame([(i, "bad" if i == 7 else f"t{i}") for i in range(20)] + [(99, None)], "id int, t string").coalesce(1)
    got = {r.id: r.x for r in df.select("id", models.tried(F.col("t"), lambda: Fussy("bad"), "embed", "array<double>").alias("x")).collect()}
    assert got[7].value is None and got[7].error == "ValueError: no bad"
    assert all(got[i].value == [2.0 if i < 10 else 3.0, 1.0] and got[i].error is None for i in range(20) if i != 7) and got[99].value == [0.0, 1.0]
    broken = df.select(models.tried(F.col("t"), Broken, "embed", "array<double>").alias("x")).collect()
    assert {r.x.error for r in broken} == {"OSError: no model"} and {r.x.value for r in broken} == {None}


def test_steps_report_errors(spark):
    # han characters are no English, so they are translated
    rows = [("1", "title", "漢字漢字 bad 漢字漢字"), ("2", "title", "漢字漢字 good 漢字漢字"), ("3", "title", "all bad english text"), ("4", None, "")]
    got = {r.article_id: r for r in chain.translated(spark.createDataFrame(rows, "article_id string, title string, content string"), lambda: Fussy("bad")).collect()}
    assert set(got) == {"1", "2", "3"} and got["1"].error == "ValueError: no bad" and got["2"].error is None and got["3"].error is None
    assert got["2"].translated_title == "en title"
    rows = spark.createDataFrame([("1", "bad", "t"), ("2", "good", "t")], "article_id string, translated_content string, translated_title string")
    got = {r.article_id: (r.tags, r.error) for r in chain.tagged(rows, lambda: Fussy("bad")).collect()}
    assert got["2"] == (["GEO:taiwan"], None) and got["1"][1] == "ValueError: no bad"


def test_a_bad_record_does_not_stop_its_batch(spark, tmp_path):
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    rows = [(str(i), "title", f"text {i} {'bad' if i == 3 else 'worse' if i == 4 else ''}") for i in range(8)]
    schema = "article_id string, title string, content string"
    store.push(spark.createDataFrame(rows, schema).coalesce(1), source)
    retries = chain.retry_table(spark, f"file://{tmp_path}/retries")
    words = ["bad|worse"]

    def step(df):
        return chain.embedded(df.withColumns({"tags": F.array(F.lit("t")), "entities": F.array(F.lit("e"))}), 2, lambda: Fussy(words[0]))

    def run():
        chain.queue_stage(spark, source, schema, step, target, f"file://{tmp_path}/cp", retries=retries).awaitTermination()

    def states():
        return {r.article_id: (r.state, r.attempt) for r in retries.read().collect()}

    def out():
        return sorted(spark.read.json(f"{target}/*").select("article_id").toPandas()["article_id"])

    run()
    assert out() == [str(i) for i in range(8) if i not in (3, 4)]
    assert states() == {"3": ("waiting", 1), "4": ("waiting", 1)}
    failed = {r.article_id: r for r in retries.read().collect()}
    assert "bad" in failed["3"].record and failed["3"].error.startswith("ValueError")
    now = spark.sql("select current_timestamp() as t").first().t
    assert 50 < (failed["3"].due - now).total_seconds() <= 60
    # none is due yet, then both are; one goes well now
    assert chain.requeue_due(spark, retries, source) == 0
    words[0] = "worse"
    for attempt, pause in ((2, 120), (3, 180)):
        assert chain.requeue_due(spark, retries, source, F.current_timestamp() + F.expr(f"INTERVAL {pause + 1} SECONDS")) == (2 if attempt == 2 else 1)
        assert states()["4"] == ("queued", attempt - 1)
        run()
        assert states() == {"3": ("done", 1), "4": ("waiting" if attempt == 2 else "given_up", attempt)}
    assert out() == [str(i) for i in range(8) if i != 4]
    assert chain.requeue_due(spark, retries, source, F.current_timestamp() + F.expr("INTERVAL 1 DAY")) == 0


def test_without_a_table_of_retries_an_error_stops_the_stream(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    store.push(spark.createDataFrame([("1", "bad")], "article_id string, content string"), source)
    step = lambda df: chain.embedded(df.withColumns({"title": F.lit("t"), "tags": F.array(F.lit("t")), "entities": F.array(F.lit("e"))}), 2, lambda: Fussy("bad"))
    with pytest.raises(Exception, match="1: ValueError: no bad"):
        chain.queue_stage(spark, source, "article_id string, content string", step, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
