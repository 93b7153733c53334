"""Keyed tables: merges, whole versions, touched buckets, repeats of a stream's batch."""

import pytest
from pyspark.sql import functions as F

from gazetta.sources.keyed import KeyedTable, step_patch, written_by_stream
from gazetta.streaming import stages

SCHEMA = "article_id string, translated_text string, translated_title string, source_language string, target_language string, tags array<string>, entities array<string>, tag_categories map<string,array<string>>, cluster_id string, summary string, updated_at timestamp"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/t", spark.createDataFrame([], SCHEMA).schema, "article_id", buckets=4, compact=3, stamp="updated_at")


def rows_of(df, *columns):
    return {r.article_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_steps_write_their_own_fields(spark, table):
    base = spark.createDataFrame([(str(i), f"text {i}", "de") for i in range(20)], "article_id string, translated_text string, source_language string")
    table.upsert(step_patch(base, "translate"))
    table.upsert(step_patch(spark.createDataFrame([("1", ["a"]), ("2", None), ("99", ["n"])], "article_id string, tags array<string>"), "tag"))
    table.upsert(step_patch(spark.createDataFrame([("1", "c1"), (None, "c2")], "article_id string, cluster_id string"), "cluster"))
    got = rows_of(table.read(), "translated_text", "target_language", "tags", "entities", "tag_categories", "cluster_id")
    assert len(got) == 21
    assert got["1"] == ("text 1", "en", ["a"], [], {}, "c1") and got["2"] == ("text 2", "en", [], [], {}, None)
    assert got["3"] == ("text 3", "en", None, None, None, None) and got["99"] == (None, None, ["n"], [], {}, None)
    assert table.read().where("updated_at is null").count() == 0
    with pytest.raises(ValueError):
        step_patch(base, "other")


def test_nulls_do_not_overwrite_and_the_newest_wins(spark, table):
    for value in ("a", None, "b", None):
        table.upsert(spark.createDataFrame([("1", value)], "article_id string, summary string"))
    assert rows_of(table.read(), "summary") == {"1": ("b",)}
    assert rows_of(table.get(["1", "2"]), "summary") == {"1": ("b",)}


def test_only_touched_buckets_are_written(spark, table):
    table.upsert(spark.createDataFrame([(str(i), "x") for i in range(40)], "article_id string, summary string"))
    before = table.manifest()["buckets"]
    assert len(before) == 4
    table.upsert(spark.createDataFrame([("7", "y")], "article_id string, summary string"))
    after = table.manifest()["buckets"]
    changed = [b for b in after if after[b] != before[b]]
    assert len(changed) == 1 and after[changed[0]][0] == before[changed[0]][0]
    # more deltas than compact: that bucket becomes one file, the others stay
    for i in range(3):
        table.upsert(spark.createDataFrame([("7", f"y{i}")], "article_id string, summary string"))
    last = table.manifest()["buckets"]
    assert len(last[changed[0]]) == 2 and all(last[b] == before[b] for b in last if b != changed[0])
    assert rows_of(table.read(), "summary") == {str(i): ("x" if i != 7 else "y2",) for i in range(40)}


def test_readers_keep_their_version(spark, table):
    table.upsert(spark.createDataFrame([("1", "a")], "article_id string, summary string"))
    old = table.read()
    table.upsert(spark.createDataFrame([("1", "b"), ("2", "c")], "article_id string, summary string"))
    assert rows_of(old, "summary") == {"1": ("a",)} and rows_of(table.read(), "summary") == {"1": ("b",), "2": ("c",)}


def test_a_failed_write_is_not_seen(spark, table, monkeypatch):
    table.upsert(spark.createDataFrame([("1", "a")], "article_id string, summary string"))
    monkeypatch.setattr(table, "_save", lambda m: (_ for _ in ()).throw(RuntimeError("no")))
    with pytest.raises(RuntimeError):
        table.upsert(spark.createDataFrame([("1", "b")], "article_id string, summary string"))
    assert rows_of(table.read(), "summary") == {"1": ("a",)}


def test_old_files_leave(spark, table, tmp_path):
    for i in range(12):
        table.upsert(spark.createDataFrame([("1", str(i))], "article_id string, summary string"))
    assert rows_of(table.read(), "summary") == {"1": ("11",)}
    assert len(list((tmp_path / "t/versions").iterdir())) <= 3 and len(list((tmp_path / "t/data").iterdir())) <= 12


def test_a_batch_of_a_stream_counts_once(spark, table, tmp_path):
    step = written_by_stream(table, "tagger")
    batch = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "b")], "article_id string, summary string")
    step(batch, 0)
    number = table.manifest()["number"]
    step(batch, 0)
    assert table.manifest()["number"] == number
    batch.write.parquet(str(tmp_path / "in"))
    stream = stages.files(spark, str(tmp_path / "in"), "article_id string, summary string")
    stages.run_stage(stream.withColumn("summary", F.upper("summary")), written_by_stream(table, "summarizer"), str(tmp_path / "cp")).awaitTermination(60)
    assert rows_of(table.read(), "summary") == {"1": ("A",), "2": ("B",)}
