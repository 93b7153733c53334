"""The queue as a data source: batches, streams, restarts, size, peek, clear; uncommitted files are not there."""

from gazetta.sources import queue, store


def push(spark, path, values, parts=2):
    df = spark.createDataFrame([(v,) for v in values], "value string").repartition(parts)
    df.write.format(queue.NAME).mode("append").save(path)


def test_one_source_for_all(spark, tmp_path):
    spark.dataSource.register(queue.RecordQueue)
    path, seen = f"file://{tmp_path}/q", []
    assert queue.size(path) == 0 and queue.peek(path, 3) == []
    push(spark, path, ["a", None, "two\nlines", '{"k": 1}'])
    assert queue.size(path) == 4 and {r.value for r in spark.read.format(queue.NAME).load(path).collect()} == {"a", None, "two\nlines", '{"k": 1}'}

    def run():
        stream = spark.readStream.format(queue.NAME).load(path)
        writer = stream.writeStream.foreachBatch(lambda b, n: seen.append(sorted(str(r.value) for r in b.collect())))
        writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)

    run()
    assert seen == [["None", "a", "two\nlines", '{"k": 1}']]
    run()  # nothing new
    assert len(seen) == 1
    push(spark, path, ["b"], 1)
    push(spark, path, ["c", "d"], 1)
    run()  # a restart goes on behind what it has read
    assert seen[1:] == [["b", "c", "d"]] and queue.size(path) == 7 and queue.size(path, 1) == 3
    assert queue.peek(path, 3) == ["d", "c", "b"]
    # a file without an entry in the log, as a lost task leaves it
    (tmp_path / "q/data/lost.jsonl").write_text('"x"\n')
    assert queue.size(path) == 7 and spark.read.format(queue.NAME).load(path).count() == 7
    queue.clear(path)
    assert queue.size(path) == 0 and spark.read.format(queue.NAME).load(path).count() == 0


def test_records_of_rows(spark, tmp_path):
    spark.dataSource.register(queue.RecordQueue)
    path = f"file://{tmp_path}/q"
    rows = spark.createDataFrame([("1", "x"), ("2", None)], "article_id string, region string")
    store.records(rows).write.format(queue.NAME).mode("append").save(path)
    store.records(rows.limit(0)).write.format(queue.NAME).mode("append").save(path)
    assert sorted(r.value for r in spark.read.format(queue.NAME).load(path).collect()) == ['{"article_id":"1","region":"x"}', '{"article_id":"2"}']
