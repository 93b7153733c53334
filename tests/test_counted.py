"""Rows that a stream holds until there are enough: over restarts, by groups, and by time."""

import time

from gazetta.streaming import counted, stages

SCHEMA = "article_id string, topic string, n int"


def test_held_rows_outlive_a_restart(spark, tmp_path):
    seen = []

    def step(rows, number):
        seen.append(sorted((r.article_id, r.n, r.released) for r in rows.collect()))

    def run(rows, wait=3600):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stages.files(spark, str(tmp_path / "in"), SCHEMA)
        counted.when_counted(stream, "topic", 3, step, str(tmp_path / "cp"), wait_seconds=wait).awaitTermination(60)

    before = {k: spark.conf.get(k, None) for k in counted.SETTINGS}
    run([("1", "a", 1), ("2", "a", 1), ("9", None, 1)])
    assert seen == []
    run([("2", "a", 2)])  # queued again: it counts once, and the last one stays
    assert seen == []
    run([("3", "a", 3), ("4", "a", 4)])
    assert seen == [[("1", 1, "count"), ("2", 2, "count"), ("3", 3, "count")]]
    run([("5", "a", 5), ("6", "a", 6)])
    assert seen[1:] == [[("4", 4, "count"), ("5", 5, "count"), ("6", 6, "count")]]
    assert {k: spark.conf.get(k, None) for k in counted.SETTINGS} == before


def test_few_rows_leave_after_a_pause(spark, tmp_path):
    seen = []

    def run(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stages.files(spark, str(tmp_path / "in"), SCHEMA)
        counted.when_counted(stream, "topic", 9, lambda b, _: seen.extend((r.article_id, r.released) for r in b.collect()), str(tmp_path / "cp"), wait_seconds=1).awaitTermination(60)

    run([("1", "a", 1), ("2", "a", 1)])
    assert seen == []
    time.sleep(2)
    run([("3", "b", 1)])
    assert sorted(seen) == [("1", "time"), ("2", "time")]
