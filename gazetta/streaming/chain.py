"""The stages as a chain of queues: translate, tag, embed, cluster. Each reads its queue as a stream and writes the next one.

A micro-batch's records replace those of an earlier try of the same batch, so a batch that is run again is queued once.

A record that a model fails on does not stop its batch: the others go on, and it goes to a table of retries with what
went wrong, how often it was tried, and when it is due again; after ATTEMPTS tries it is given up there. `requeue_due`
puts the due ones back into the stage's queue.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gazetta import schemas
from gazetta.operators import models
from gazetta.operators import relational as R
from gazetta.plans import pipeline
from gazetta.scratch import materialize
from gazetta.sources import store
from gazetta.sources.keyed import KeyedTable
from gazetta.streaming import stages

RAW_QUEUE = "article_id string, title string, content string, url string"
EMBEDDED_QUEUE = "article_id string, title string, content string, tags array<string>, entities array<string>, embedding array<double>, region string, topic string"


#: Tries of a record, and seconds from each failed one to the next.
ATTEMPTS, PAUSES = 3, (60, 120, 180)
RETRIES = "article_id string, record string, attempt int, due timestamp, error string, state string"


def retry_table(spark: SparkSession, path: str) -> KeyedTable:
    """Failed records of a stage by id: state is waiting, queued, given_up or done."""
    return KeyedTable(spark, path, spark.createDataFrame([], RETRIES).schema, "article_id", buckets=8)


def translated(df: DataFrame, make=models.SameText) -> DataFrame:
    """Records for tagging, and errors. Rows without an id or a text are left out."""
    rows = df.where(F.col("article_id").isNotNull() & (F.length(F.coalesce("content", F.lit(""))) > 0))
    out = pipeline.translate(R.with_defaults(rows, {"title": F.lit("")}), "title", "content", make, errors=True)
    return out.select("article_id", F.col("cleaned_text").alias("translated_content"), F.col("title_translated").alias("translated_title"), F.col("language").alias("original_language"), "error")


def tagged(df: DataFrame, make=models.GazetteerAnnotator) -> DataFrame:
    """Records for embedding, and errors."""
    rows = df.withColumnsRenamed({"translated_title": "title_translated", "translated_content": "cleaned_text"})
    out = pipeline.tag(rows.where(F.length(F.coalesce("cleaned_text", F.lit(""))) > 0), make, errors=True)
    return out.select("article_id", F.col("cleaned_text").alias("content"), F.col("title_translated").alias("title"), "tags", "entities", "error")


def embedded(df: DataFrame, size: int = models.DIMENSION, make=None) -> DataFrame:
    """Records for clustering, and errors."""
    out = pipeline.embed(df.withColumnsRenamed({"title": "title_translated", "content": "cleaned_text"}), size, make, errors=True)
    out = out.withColumnsRenamed({"title_translated": "title", "cleaned_text": "content"}).where((F.size("embedding") > 0) | F.col("error").isNotNull())
    fields = {"region": F.lit("Unknown"), "topic": F.lit("Unknown")}
    return R.with_defaults(out, fields).select("article_id", "title", "content", "tags", "entities", "embedding", "region", "topic", "error")


def note_failures(rows: DataFrame, done: DataFrame, retries: KeyedTable, stage: str, number: int, attempts: int = ATTEMPTS) -> None:
    """Writes the failed records of a micro-batch into its stage's table of retries; those that went well after all are done there."""
    records = rows.select("article_id", F.to_json(F.struct(*rows.columns)).alias("record"))
    before = retries.read().where("state <> 'done'").select(F.col("article_id").alias("__id"), F.col("attempt").alias("__n"))
    judged = done.select("article_id", "error").join(before, F.col("article_id") == F.col("__id"), "left").where("error is not null or __id is not null")
    attempt = F.coalesce("__n", F.lit(0)) + 1
    pause = F.element_at(F.array(*map(F.lit, PAUSES)), F.least(attempt, F.lit(len(PAUSES))))
    failed = F.col("error").isNotNull()
    state = F.when(~failed, "done").when(attempt >= attempts, "given_up").otherwise("waiting")
    due = F.when(failed, F.timestamp_seconds(F.unix_timestamp(F.current_timestamp()) + pause))
    patch = judged.join(records, "article_id").select("article_id", "record", F.when(failed, attempt).cast("int").alias("attempt"), due.alias("due"), "error", state.alias("state"))
    retries.upsert(materialize(patch), stage, number)


def requeue_due(spark: SparkSession, retries: KeyedTable, source: str, now: Column | None = None) -> int:
    """Puts the waiting records that are due back into a queue; returns how many. A record that is queued twice is processed twice, with one result."""
    due = materialize(retries.read().where((F.col("state") == "waiting") & (F.col("due") <= (now if now is not None else F.current_timestamp()))))
    n = due.count()
    if n:
        due.select(F.col("record").alias("value")).write.mode("append").text(source)
        retries.upsert(due.select("article_id", F.lit("queued").alias("state")))
    return n


def queue_stage(
    spark: SparkSession, source: str, schema: str, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, batch: int = 10, retries: KeyedTable | None = None, **trigger
) -> StreamingQuery:
    """step over a queue's records, to the queue under target. Repeats of an id within a micro-batch go.

    Rows with an error go to the table of retries; without one, they stop the stream.
    """

    def run(rows: DataFrame, number: int) -> None:
        rows = materialize(rows.dropDuplicates(["article_id"]))
        done = materialize(step(rows))
        if retries is not None:
            note_failures(rows, done, retries, target, number)
        elif bad := done.where("error is not null").limit(1).collect():
            raise RuntimeError(f"{bad[0].article_id}: {bad[0].error}")
        store.records(done.where("error is null").drop("error")).write.mode("overwrite").text(f"{target}/batch={number:09d}")

    return stages.run_stage(stages.queue(spark, source, schema, batch), run, checkpoint, **trigger)


def cluster_stage(
    spark: SparkSession, source: str, folder: str, checkpoint: str, hold: str, least: int = 5, k: int | None = None, threshold: float = 0.85, batch: int = 10, **trigger
) -> StreamingQuery:
    """Clusters what is queued as soon as there are least records, and stores articles, clusters and their summaries under folder."""

    def run(rows: DataFrame, _: int) -> None:
        rows = stages.last_rows(rows, "article_id")
        store.merge(spark, f"{folder}/articles", rows.withColumn("cluster_id", F.lit(None).cast("string")), "article_id")
        assigned, stored = pipeline.clustering_run(rows, "article_id", "title", "content", k, threshold)
        if stored.limit(1).count():
            pipeline.store_clusters(spark, folder, assigned, stored, "article_id")

    stream = stages.queue(spark, source, EMBEDDED_QUEUE, batch)
    return stages.run_stage(stream, stages.when_enough(least, run, hold), checkpoint, **trigger)


def run_chain(spark: SparkSession, source: str, folder: str, least: int = 5, k: int | None = None, threshold: float = 0.85, size: int = models.DIMENSION) -> None:
    """All that is queued under source through all stages; results are tables and queues under folder."""
    steps = ((source, RAW_QUEUE, translated), ("tagging_queue", schemas.TAGGING_QUEUE, tagged), ("embedding_queue", schemas.EMBEDDING_QUEUE, lambda df: embedded(df, size)))
    targets = ("tagging_queue", "embedding_queue", "clustering_queue")
    for (name, schema, step), target in zip(steps, targets, strict=True):
        at = name if name == source else f"{folder}/{name}"
        queue_stage(spark, at, schema, step, f"{folder}/{target}", f"{folder}/checkpoints/{target}", retries=retry_table(spark, f"{folder}/retries/{target}")).awaitTermination()
    cluster_stage(spark, f"{folder}/clustering_queue", folder, f"{folder}/checkpoints/clusters", f"{folder}/held", least, k, threshold).awaitTermination()

