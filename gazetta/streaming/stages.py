"""Stage queues as streams: sources, deduplication, enrichment, upserts by batch, event-time counts."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from gazetta.scratch import file_system, remove, scratch_path
from gazetta.sources.readers import queued
from gazetta.sources.store import merge


def files(spark: SparkSession, path: str, schema: str, batch: int = 10, kind: str = "parquet") -> DataFrame:
    """A folder as a stream, at most batch files for each trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", batch).format(kind).load(path)


def queue(spark: SparkSession, path: str, schema: str, batch: int = 10, key: str = "article_id") -> DataFrame:
    """A folder of JSON lines as a stage's queue; a line that is no object is a bare id."""
    return queued(spark.readStream.option("maxFilesPerTrigger", batch).text(path), schema, key=key)


def once_each(df: DataFrame, key: str, time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Repeats of a key go: within a watermark's delay, whose state is bounded, or for good without a time column."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]) if time else df.dropDuplicates([key])


def run_stage(df: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, every: str = "5 minutes") -> StreamingQuery:
    """step for each micro-batch: all that is there and then stop, or at intervals. step shall be idempotent by batch."""
    writer = df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def last_rows(batch: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One whole row for each key: that with the largest order (nulls first), of several such the last by its JSON text."""
    rest = [c for c in batch.columns if c != key]
    text = F.to_json(F.struct(*rest))
    best = F.max_by(F.struct(*rest), F.struct(F.col(order).isNotNull(), F.col(order), text) if order else text)
    return batch.groupBy(key).agg(best.alias("__r")).select(key, "__r.*")


def upsert_stage(spark: SparkSession, df: DataFrame, target: str, key: str, checkpoint: str, order: str | None = None, **trigger) -> StreamingQuery:
    """Merges each micro-batch into the table under target, by key; a batch that is run again changes nothing.

    Of several rows with one key in a batch, the one with the largest order counts, as a whole.
    """

    def step(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            merge(spark, target, last_rows(batch, key, order), key)

    return run_stage(df, step, checkpoint, **trigger)


def when_enough(least: int, step: Callable[[DataFrame, int], None], hold: str | None = None) -> Callable[[DataFrame, int], None]:
    """step for all held rows as soon as there are at least so many; until then batches are held as tables under hold.

    hold names a folder that all executors share and that outlives the stream; without one, a scratch folder serves one run.
    Held batches leave when step is done. A marker names the last batch that step had, so one that is run again is not
    held twice; if step itself fails it gets the same rows again, so it shall be idempotent.
    """
    places: list[str] = [hold] if hold else []

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not places:
            places.append(scratch_path(spark))
        fs, root = file_system(spark, places[0])
        found = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        taken = max((int(x.split("-")[1]) for x in found if x.startswith("taken-")), default=-1)
        held = {f"held-{int(x.split('-')[1])}" for x in found if x.startswith("held-") and int(x.split("-")[1]) > taken}
        for x in set(found) - held:
            if x.startswith("held-"):  # step had them; the run ended before they were removed
                remove(spark, f"{places[0]}/{x}")
        if number <= taken:
            return
        batch.write.mode("overwrite").parquet(f"{places[0]}/held-{number}")
        held.add(f"held-{number}")
        rows = spark.read.schema(batch.schema).parquet(*[f"{places[0]}/{x}" for x in sorted(held)])
        if rows.limit(least).count() < least:
            return
        step(rows, number)
        fs.mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{places[0]}/taken-{number}"))
        for x in held:
            remove(spark, f"{places[0]}/{x}")

    return run


def window_counts(events: DataFrame, time: str = "ts", size: str = "5 minutes", by: tuple[str, ...] = ("event_type",), late: str | None = None) -> DataFrame:
    """Counts and sums of value by tumbling window and columns; with late, a watermark for streams."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("__t", late) if late else rows
    out = rows.groupBy(F.window("__t", size), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n", "total")


class StatusLog(StreamingQueryListener):
    """Stage events of all streams as (pipeline_id, stage, message), kept for the last `most`."""

    def __init__(self, most: int = 1000):
        self.events: deque[tuple[str, str, str]] = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.events.append((str(event.runId), event.name or "", "started"))

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.events.append((str(event.progress.runId), event.progress.name or "", f"{event.progress.numInputRows} rows"))

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.events.append((str(event.runId), "", f"failed: {event.exception}" if event.exception else "ended"))


def progress(query: StreamingQuery) -> list[dict]:
    """Rows and seconds of each finished micro-batch, with rows per second (0 without time)."""
    out = []
    for p in query.recentProgress:
        seconds = p["durationMs"].get("triggerExecution", 0) / 1000
        out.append({"batch": p["batchId"], "rows": p["numInputRows"], "seconds": seconds, "per_second": p["numInputRows"] / seconds if seconds else 0.0})
    return out
