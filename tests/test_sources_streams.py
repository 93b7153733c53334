import json
import time

import pytest
from pyspark.sql import functions as F

from gazetta.sources import readers, store
from gazetta.streaming import stages


def test_source_lists(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"name": "a", "url": "u", "type": "x"}]))
    (tmp_path / "s.txt").write_text("one\n\n two \n")
    assert [tuple(r) for r in readers.source_list(spark, str(tmp_path / "s.json")).collect()] == [("a", "u", "x")]
    assert [r.name for r in readers.source_list(spark, str(tmp_path / "s.txt")).collect()] == ["one", "two"]
    with pytest.raises(ValueError):
        readers.source_list(spark, "s.csv")


def test_queue_rows(spark):
    df = spark.createDataFrame([('{"article_id": "1", "region": "x"}',), ("42",), ('"43"',)], "value string")
    got = {(r.article_id, r.region) for r in readers.queued(df, "article_id string, region string").collect()}
    assert got == {("1", "x"), ("42", None), ("43", None)}


def test_merge_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a")], "k int, x string")
    store.merge(spark, path, rows, "k")
    store.merge(spark, path, spark.createDataFrame([(1, None), (2, "b")], "k int, x string"), "k")
    last = store.versions(spark, path)[-1]
    assert sorted(map(tuple, spark.read.parquet(last).collect())) == [(1, "a"), (2, "b")]


def test_external_rows(spark):
    df = spark.createDataFrame([("t", "c", "u", [1.0])], "title string, content string, url string, title_embedding array<float>")
    row = store.external_rows(df, "gdelt").first()
    assert row.source == "GDELT" and row.source_url == "u" and row.title_embedding == "[1.0]"
    with pytest.raises(ValueError):
        store.external_rows(df, "other")


def test_upsert_stream_is_idempotent(spark, tmp_path):
    spark.createDataFrame([("1", "a"), ("2", "b"), ("1", "a")], "id string, x string").write.parquet(str(tmp_path / "in"))
    df = stages.files(spark, str(tmp_path / "in"), "id string, x string")
    for _ in range(2):
        stages.upsert_stage(spark, stages.once_each(df, "id"), str(tmp_path / "out"), "id", str(tmp_path / "cp")).awaitTermination(60)
    last = store.versions(spark, str(tmp_path / "out"))[-1]
    assert sorted(map(tuple, spark.read.parquet(last).collect())) == [("1", "a"), ("2", "b")]


def test_stream_counts_match_batch_on_closed_windows(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    counts = stages.window_counts(stream, late="10 minutes")
    query = counts.writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.table("counts").collect()}
    batch = {tuple(r) for r in stages.window_counts(events).collect()}
    assert got <= batch and len(batch) - len(got) <= 5
    assert stages.progress(query)


def test_when_enough(spark):
    seen = []
    run = stages.when_enough(3, lambda df, n: seen.append(n))
    run(spark.range(2), 0)
    run(spark.range(3), 1)
    assert seen == [1]


def test_status_log(spark, tmp_path):
    log = stages.StatusLog()
    spark.streams.addListener(log)
    try:
        spark.createDataFrame([("1", "a")], "id string, x string").write.parquet(str(tmp_path / "in"))
        df = stages.files(spark, str(tmp_path / "in"), "id string, x string")
        stages.run_stage(df, lambda batch, n: None, str(tmp_path / "cp")).awaitTermination(60)
        for _ in range(50):
            if any(e[2] == "ended" for e in log.events):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    assert {"started", "ended"} <= {e[2] for e in log.events}


def test_small_batches_are_held_until_there_are_enough(spark, tmp_path):
    seen, hold = [], str(tmp_path / "hold")

    def step(df, n):
        seen.append((n, sorted(r.id for r in df.collect())))

    run = stages.when_enough(4, step, hold)
    run(spark.range(0, 2), 0)
    run(spark.range(2, 3), 1)
    run(spark.range(2, 3), 1)  # run again: not held twice
    assert seen == []
    run = stages.when_enough(4, step, hold)  # a new run finds what is held
    run(spark.range(3, 5), 2)
    run(spark.range(3, 5), 2)
    assert seen == [(2, [0, 1, 2, 3, 4])]
    run(spark.range(9, 10), 3)
    run(spark.range(10, 13), 4)
    assert seen[1:] == [(4, [9, 10, 11, 12])]


def test_failed_step_gets_the_held_rows_again(spark, tmp_path):
    seen, fail = [], [True]

    def step(df, n):
        if fail.pop():
            raise RuntimeError("no")
        seen.append(df.count())

    run = stages.when_enough(2, step, str(tmp_path / "hold"))
    with pytest.raises(RuntimeError):
        run(spark.range(2), 0)
    fail.append(False)
    run(spark.range(2), 0)
    assert seen == [2]


def test_malformed_records_are_kept(spark):
    rows = ['{"article_id":"1"', '{"article_id": "2", "region": "x", "more": [1]}', "{}", "17", ' "q" ', "a b", None, "[1]"]
    got = [tuple(r) for r in readers.queued(spark.createDataFrame([(x,) for x in rows], "value string"), "article_id string, region string").collect()]
    assert got == [('{"article_id":"1"', None), ("2", "x"), (None, None), ("17", None), ("q", None), ("a b", None), (None, None), ("[1]", None)]


def test_upsert_takes_whole_rows(spark, tmp_path):
    rows = [("1", 1, "a", "z"), ("1", 2, "b", "c"), ("2", None, "x", None), ("2", None, None, "y")]
    df = spark.createDataFrame(rows, "id string, t int, x string, y string")
    got = {r.id: tuple(r) for r in stages.last_rows(df, "id", "t").collect()}
    assert got["1"] == ("1", 2, "b", "c") and got["2"] in rows[2:]
    df.write.parquet(str(tmp_path / "in"))
    stream = stages.files(spark, str(tmp_path / "in"), "id string, t int, x string, y string")
    stages.upsert_stage(spark, stream, str(tmp_path / "out"), "id", str(tmp_path / "cp"), order="t").awaitTermination(60)
    assert {r.id: (r.x, r.y) for r in spark.read.parquet(store.versions(spark, str(tmp_path / "out"))[-1]).collect()}["1"] == ("b", "c")


def test_old_versions_leave(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(5):
        store.merge(spark, path, spark.createDataFrame([(i,)], "k int"), "k", keep=2)
    assert len(store.versions(spark, path)) == 2 and spark.read.parquet(store.versions(spark, path)[-1]).count() == 5


def test_queue_folder(spark, tmp_path):
    path = str(tmp_path / "q")
    assert store.queue_size(spark, path) == 0
    store.push(spark.createDataFrame([("1", "x"), ("2", None)], "article_id string, region string"), path)
    store.push(spark.createDataFrame([("3", "y")], "article_id string, region string"), path)
    assert store.queue_size(spark, path) == 3
    got = {tuple(r) for r in readers.queued(spark.read.text(path), "article_id string, region string").collect()}
    assert got == {("1", "x"), ("2", None), ("3", "y")}
    store.clear_queue(spark, path)
    assert store.queue_size(spark, path) == 0


def test_chain_of_stages(spark, tmp_path):
    from gazetta.streaming import chain

    words = {"a": "navy ships sail near taiwan and the pla watches them", "b": "banks raise rates and trade slows in the market"}
    rows = [(f"{g}{i}", f"title {g} {i}", f"{text}. More about it, part {i}.", "u") for g, text in words.items() for i in range(6)]
    store.push(spark.createDataFrame(rows + [("x", "no text", "", "u"), ("a0", "again", words["a"], "u")], chain.RAW_QUEUE).repartition(3), str(tmp_path / "raw"))
    for _ in range(2):  # a second run finds nothing new
        chain.run_chain(spark, str(tmp_path / "raw"), str(tmp_path / "out"), k=2, threshold=0.1, size=64)
    articles = spark.read.parquet(store.versions(spark, str(tmp_path / "out/articles"))[-1])
    clusters = spark.read.parquet(store.versions(spark, str(tmp_path / "out/clusters"))[-1])
    assert articles.count() == 12 and {len(r.embedding) for r in articles.collect()} == {64}
    groups = {}
    for r in articles.collect():
        groups.setdefault(r.cluster_id, set()).add(r.article_id[0])
    assert sorted(map(tuple, groups.values())) == [("a",), ("b",)]
    assert {r.cluster_id: (r.member_count, r.status) for r in clusters.collect()} == {c: (6, "complete") for c in groups}
    assert all(r.summary and r.theme.startswith("title") for r in clusters.collect())
    assert any("GEO:taiwan" in r.tags for r in articles.collect())


def test_cluster_rows_and_updates(spark, tmp_path):
    path, now = str(tmp_path / "clusters"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    store.merge(spark, path, store.cluster_rows(spark.createDataFrame([("c1", "ships", 3), ("c2", "rates", 2)], "id string, label string, member_count int"), now), "id")
    first = spark.read.parquet(store.versions(spark, path)[-1]).withColumns({"updated_at": F.lit(None).cast("timestamp"), "summary": F.lit(None).cast("string")})
    store.merge(spark, str(tmp_path / "c"), first, "id")
    store.merge(spark, str(tmp_path / "c"), store.cluster_update(spark.createDataFrame([("c1", "said", 4)], "id string, summary string, member_count int"), now, "complete"), "id")
    got = {r.id: (r.status, r.summary, r.member_count, r.label) for r in spark.read.parquet(store.versions(spark, str(tmp_path / "c"))[-1]).collect()}
    assert got == {"c1": ("complete", "said", 4, "ships"), "c2": ("pending", None, 2, "rates")}
