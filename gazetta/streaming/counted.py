"""Rows held in a stream's state until there are enough of them, or until they have waited long enough.

Each group keeps fewer than `least` rows: as soon as there are that many they leave together, and a timer lets a
smaller number leave after a pause without new rows. The state is in the query's checkpoint, so a restart finds what is held, and a
batch that is run again gives the same rows; no folders or marker files are listed. Of rows with one id in a group the last
that came stays, so a record that is queued twice counts once while it is held.

Timers are looked at when a micro-batch runs. Without new rows one runs at each trigger only if Spark is told so (its
setting for batches without data), which a query that ends when all is read must not be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    """The settings that such a query needs when it starts; what was there before comes back."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Held(StatefulProcessor):
    """Holds rows by group; gives them out with why they left (count or time)."""

    def __init__(self, columns: list[str], schema, id_column: str, least: int, wait_ms: int):  # noqa: ANN001
        self.columns, self.schema, self.id_column, self.least, self.wait_ms = columns, schema, id_column, least, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)

    def _out(self, rows: list[tuple], why: str) -> Iterator[Row]:
        for r in rows:
            yield Row(**dict(zip(self.columns, r, strict=True)), released=why)

    def _timers(self, at: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        place = self.columns.index(self.id_column)
        held = {r[place]: tuple(r) for r in self.held.get()} if self.held.exists() else {}
        out: list[tuple] = []
        for r in rows:
            row = tuple(r[c] for c in self.columns)
            held[row[place]] = row
            if len(held) == self.least:
                out += held.values()
                held = {}
        self.held.clear()
        if held:
            self.held.put(list(held.values()))
        self._timers(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms if held and self.wait_ms else None)
        return self._out(out, "count")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        self.held.clear()
        return self._out(held, "time")

    def close(self) -> None:
        pass


def released(df: DataFrame, by: str, least: int, id_column: str = "article_id", wait_seconds: int = 0) -> DataFrame:
    """The rows of a stream, given out by groups of least or more (or after wait_seconds without new ones), and released: count or time.

    by is the column that groups; rows of one group pass one task, which holds fewer than least of them.
    """
    df = df.drop("released")
    grouped = df.withColumn("__by", F.coalesce(F.col(by).cast("string"), F.lit("")))
    made = Held(df.columns, df.schema, id_column, least, wait_seconds * 1000)
    out = StructType([*df.schema.fields, StructField("released", StringType())])
    return grouped.groupBy("__by").transformWithState(statefulProcessor=made, outputStructType=out, outputMode="Append", timeMode="ProcessingTime")


def when_counted(df: DataFrame, by: str, least: int, step: Callable[[DataFrame, int], None], checkpoint: str, id_column: str = "article_id", wait_seconds: int = 0, once: bool = True, every: str = "5 minutes") -> StreamingQuery:
    """step for what each micro-batch releases, if anything. A batch that is run again gets the same rows, so step shall be idempotent by batch."""

    def run(rows: DataFrame, number: int) -> None:
        rows.persist()
        try:
            if rows.limit(1).count():
                step(rows, number)
        finally:
            rows.unpersist()

    with settings(df.sparkSession):
        writer = released(df, by, least, id_column, wait_seconds).writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
