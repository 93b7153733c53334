"""Window panes with revisions, from a stream.

Rows come in batches. A streaming query groups them by pane (hour and kind) and keeps each pane's totals as its state; in
update mode a batch gives the panes that it changed, with their new totals. foreachBatch joins these changes with the
table of panes that the batch before left in the shared folder, which knows what has been published: a pane that is due
and not yet published is emitted, and one that was published before and has changed is retracted and replaced. Rows of closed panes
are split off before the aggregation and pass it by. The query's watermark lets Spark forget the state of closed panes,
and the table forgets them too, so both hold open panes only.

Each batch starts the query anew on one checkpoint; a batch is one micro-batch, as the query takes what is there and
runs no further one without data, and an empty batch feeds a file without rows. Everything a batch writes is named by its number
and overwritten when it is run again, so a restart after a failure repeats it with the same result. Joins and aggregations are
dealt out by pane after partial sums; the driver gets one number of each batch, its latest event time.

Event times may lie before 1970, where a watermark cannot start: the stream's own time is SHIFT later, from year 1.

Defined results: rows without ts are dropped; of several rows with one click_id the one of the least (arrived_at, ts,
kind, value) counts, nulls first; rows without click_id are each their own; without arrived_at, ts stands for it; a null kind is
`none`; a null value, or one that is not finite, is 0 cents; an empty table gives no rows. Times without a zone are taken as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.scratch import scratch_path

#: Batches of the contract; microseconds of an hour and a day.
BATCHES = 10
HOUR, DAY = 3_600_000_000, 86_400_000_000
#: How long after a pane's end it is due, and closed.
DUE, CLOSED = 12 * HOUR, 2 * DAY
#: From year 1 to 1970, in whole hours.
SHIFT = 719_162 * DAY
ROWS = "click_id long, kind string, at_us long, cents long"
PANES = "kind string, hour long, n_rows long, cents long, published boolean, open boolean, records array<struct<record:string,n_rows:long,cents:long>>"
CHANGES = "record string, kind string, hour long, click_id long, n_rows long, cents long, at_us long"
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def micros(ts: str) -> Column:
    """Microseconds from 1970 to a time, read off its fields, so no zone counts."""
    t = F.col(ts)
    seconds = F.hour(t).cast("long") * 3600 + F.minute(t) * 60
    return F.unix_date(F.to_date(t)).cast("long") * DAY + seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("long")


def hour_of(us: Column) -> Column:
    """The hour of a time since 1970, rounded down before 1970 too."""
    return F.call_function("div", us - F.pmod(us, F.lit(HOUR)), F.lit(HOUR))


def batched(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """click_id, kind, event time, cents and batch of each click, once."""
    whole = clicks.where(F.col("ts").isNotNull()).select("click_id", F.coalesce("arrived_at", "ts").alias("arrived_at"), "ts", "kind", "value")
    rest = F.struct("arrived_at", "ts", "kind", "value")
    # rows without an id are told apart by a number that no other row has
    own = F.when(F.col("click_id").isNull(), F.monotonically_increasing_id())
    once = whole.groupBy("click_id", own.alias("__own")).agg(F.min(rest).alias("r")).select("click_id", "r.*")
    day = F.unix_date(F.to_date("arrived_at")).cast("long")
    q = F.pmod(day, F.lit(10))
    later = F.coalesce(F.greatest(F.lit(0), F.crc32(F.col("click_id").cast("string")) % 30 - 23), F.lit(0))
    finite = F.coalesce(F.abs("value") < F.lit(float("inf")), F.lit(False)) & ~F.isnan("value")
    return once.select(
        "click_id",
        F.coalesce("kind", F.lit("none")).alias("kind"),
        (micros("ts") - (day - q) * DAY).alias("at_us"),
        F.when(finite, F.floor(F.lit(100) * F.col("value") + 0.5)).otherwise(0).cast("long").alias("cents"),
        F.least(F.lit(batches - 1), q + later).cast("int").alias("batch"),
    )


def stream_changes(spark: SparkSession, feed: str, mark: int | None, closed: int) -> DataFrame:
    """The panes that a micro-batch changes, with their new totals and latest event time, and its rows of closed panes (late)."""
    rows = spark.readStream.schema(ROWS).parquet(feed).withColumn("at", F.timestamp_micros(F.col("at_us") + SHIFT))
    rows = rows.withWatermark("at", f"{closed} microseconds")
    hour = hour_of(F.col("at_us"))
    late = F.lit(False) if mark is None else (hour + 1) * HOUR + closed <= mark
    panes = rows.where(~late).groupBy(F.window("at", "1 hour").alias("w"), "kind").agg(F.count("*").alias("n_rows"), F.sum("cents").alias("cents"), F.max("at_us").alias("at_us"))
    panes = panes.select(F.lit("pane").alias("record"), "kind", hour_of(F.unix_micros("w.start") - SHIFT).alias("hour"), F.lit(-1).cast("long").alias("click_id"), "n_rows", "cents", "at_us")
    return panes.unionByName(rows.where(late).select(F.lit("late").alias("record"), "kind", hour.alias("hour"), "click_id", F.lit(1).cast("long").alias("n_rows"), "cents", "at_us"))


def published(table: DataFrame, changes: DataFrame, mark: int | None, last: bool, due: int, closed: int) -> DataFrame:
    """The table of panes after a batch: totals, whether they are published, whether the pane stays open, and the batch's records."""
    new = changes.where("record = 'pane'").select(F.col("kind").alias("__k"), F.col("hour").alias("__h"), F.col("n_rows").alias("__n"), F.col("cents").alias("__c"))
    # by a shuffle whatever their sizes: both grow with the kinds and the open hours
    both = table.hint("merge").join(new, (F.col("kind") == F.col("__k")) & (F.col("hour") == F.col("__h")), "full_outer")
    changed, was = F.col("__n").isNotNull(), F.coalesce("published", F.lit(False))
    kind, hour = F.coalesce("kind", "__k"), F.coalesce("hour", "__h")
    n, cents = F.coalesce("__n", "n_rows"), F.coalesce("__c", "cents")
    end = (hour + 1) * HOUR
    is_due = F.lit(False) if mark is None else F.lit(mark) >= end + due
    is_open = F.lit(True) if mark is None else F.lit(mark) < end + closed

    def record(name: str, n: Column, cents: Column) -> Column:
        return F.struct(F.lit(name).alias("record"), n.alias("n_rows"), cents.alias("cents"))

    first = F.when(is_due, record("emit", n, cents))
    if last:
        first = first.otherwise(record("final", n, cents))
    records = F.when(~was, F.array_compact(F.array(first))).when(changed, F.array(record("retract", F.col("n_rows"), F.col("cents")), record("replace", n, cents)))
    records = F.coalesce(records, F.array().cast("array<struct<record:string,n_rows:long,cents:long>>"))
    return both.select(kind.alias("kind"), hour.alias("hour"), n.alias("n_rows"), cents.alias("cents"), (was | is_due).alias("published"), is_open.alias("open"), records.alias("records"))


def advance(spark: SparkSession, root: str, number: int, mark: int | None, last: bool = False, due: int = DUE, closed: int = CLOSED) -> int | None:
    """Runs the query once over what is new in the feed under root. Returns the latest event time so far; mark is that of the batches before."""

    def step(batch: DataFrame, _: int) -> None:
        own = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{root}/changes/batch={number}")
        changes = own.read.schema(CHANGES).parquet(f"{root}/changes/batch={number}")
        before = own.read.schema(PANES).parquet(f"{root}/panes/batch={number - 1}").where("open").drop("open", "records") if number else own.createDataFrame([], PANES).drop("open", "records")
        published(before, changes, mark, last, due, closed).write.mode("overwrite").parquet(f"{root}/panes/batch={number}")

    kept = spark.conf.get(NO_DATA)
    spark.conf.set(NO_DATA, "false")
    try:
        query = stream_changes(spark, f"{root}/feed", mark, closed).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(NO_DATA, kept)
    latest = spark.read.schema(CHANGES).parquet(f"{root}/changes/batch={number}").agg(F.max("at_us")).first()[0]
    return max((x for x in (mark, latest) if x is not None), default=None)


def records(spark: SparkSession, root: str) -> DataFrame:
    """What all batches published: batch, hour, click_id (-1 but for late rows), n_rows, cents, record, kind."""
    panes = spark.read.schema(f"{PANES}, batch long").parquet(f"{root}/panes").where(F.size("records") > 0).select("batch", "hour", "kind", F.explode("records").alias("r"))
    panes = panes.select("batch", "hour", F.lit(-1).cast("long").alias("click_id"), "r.n_rows", "r.cents", "r.record", "kind")
    late = spark.read.schema(f"{CHANGES}, batch long").parquet(f"{root}/changes").where("record = 'late'")
    return panes.unionByName(late.select("batch", "hour", "click_id", "n_rows", "cents", "record", "kind"))


def pane_records(rows: DataFrame, batches: int, due: int = DUE, closed: int = CLOSED) -> DataFrame:
    """Feeds rows (of ROWS and batch) to the query, batch by batch, from a new folder, and returns all records."""
    spark = rows.sparkSession
    root = scratch_path(spark)
    staged = f"{root}/staged"
    rows.write.partitionBy("batch").parquet(staged)
    staged = spark.read.schema(f"{ROWS}, batch int").parquet(staged)
    mark = None
    for number in range(batches):
        staged.where(F.col("batch") == number).drop("batch").write.mode("append").parquet(f"{root}/feed")
        mark = advance(spark, root, number, mark, number == batches - 1, due, closed)
    return records(spark, root)


def revised_panes(clicks: DataFrame) -> DataFrame:
    """The records of clicks in the contract's batches."""
    return pane_records(batched(clicks), BATCHES)


def _crc32(column: str) -> str:
    """CRC-32 of a number's decimal digits in SQL: eight shifts for each byte, from all ones."""
    byte = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))"
    bytes_ = f"list_transform(string_split(cast({column} as varchar), ''), lambda ch: cast(ascii(ch) as bigint))"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {bytes_}), lambda c, b: {byte}), 4294967295)"


#: The same in DuckDB's SQL, from sums by pane and batch.
ORACLE = f"""
with once as (
  select * from (
    select click_id, ts, coalesce(kind, 'none') as kind, value, coalesce(arrived_at, ts) as arrived_at,
      row_number() over (partition by click_id order by coalesce(arrived_at, ts), ts, kind nulls first, value nulls first) as k
    from clicks where ts is not null
  ) where k = 1
), days as (
  select *, date_diff('day', date '1970-01-01', cast(arrived_at as date)) as d from once
), placed as (
  select click_id, kind, epoch_us(ts) - (d - d % 10) * {DAY} as at_us, cast(coalesce(floor(100 * value + 0.5), 0) as bigint) as cents,
    least({BATCHES - 1}, d % 10 + greatest(0, {_crc32("click_id")} % 30 - 23)) as batch
  from days
), numbers as (
  select unnest(range({BATCHES})) as batch
), marks as (
  select n.batch, (select max(at_us) from placed p where p.batch < n.batch) as mark from numbers n
), hours as (
  select p.*, cast(floor(at_us / {HOUR}.0) as bigint) as hour, m.mark from placed p join marks m using (batch)
), split as (
  select *, (hour + 1) * {HOUR} as ends, coalesce(mark >= (hour + 1) * {HOUR} + {CLOSED}, false) as late from hours
), sums as (
  select kind, hour, ends, batch, count(*) as n, sum(cents) as c from split where not late group by all
), dues as (
  select s.kind, s.hour, s.ends, min(s.batch) as first, (select min(m.batch) from marks m where m.mark >= s.ends + {DUE}) as due from sums s group by all
), panes as (
  select kind, hour, case when due is not null then greatest(first, due) end as emitted from dues
), totals as (
  select s.*, p.emitted, sum(n) over w as n_rows, sum(c) over w as cents
  from sums s join panes p using (kind, hour) window w as (partition by s.kind, s.hour order by s.batch)
), lags as (
  select *, lag(n_rows) over w as old_n, lag(cents) over w as old_c, row_number() over (partition by kind, hour, batch <= coalesce(emitted, 99) order by batch desc) as back
  from totals window w as (partition by kind, hour order by batch)
)
select cast(batch as bigint) as batch, hour, click_id, 1::bigint as n_rows, cents, 'late' as record, kind from split where late
union all
select cast(coalesce(emitted, {BATCHES - 1}) as bigint), hour, -1, n_rows::bigint, cents::bigint, case when emitted is null then 'final' else 'emit' end, kind from lags where batch <= coalesce(emitted, 99) and back = 1
union all
select cast(batch as bigint), hour, -1, old_n::bigint, old_c::bigint, 'retract', kind from lags where batch > emitted
union all
select cast(batch as bigint), hour, -1, n_rows::bigint, cents::bigint, 'replace', kind from lags where batch > emitted
"""
