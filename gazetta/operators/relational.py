"""Selections, upserts, counts, top values and modes over article tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazetta.functions.text import strip
from gazetta.schemas import ALIASES
from gazetta.scratch import materialize


def unprocessed(articles: DataFrame, processed: DataFrame, key: str, newest: list[Column], n: int | None = None) -> DataFrame:
    """Articles without a processed row, newest first; the limit, if any, comes after the anti join."""
    out = articles.join(processed.select(key), key, "left_anti").orderBy(*newest)
    return out.limit(n) if n is not None else out


def page(df: DataFrame, order: list[Column], offset: int = 0, size: int = 100) -> DataFrame:
    """Rows offset to offset + size - 1 in a total order."""
    return df.orderBy(*order).offset(offset).limit(size)


def newest(df: DataFrame, order: list[Column], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def pending(processed: DataFrame, vector: str = "embedding", cluster: str = "cluster_id") -> DataFrame:
    """Rows that wait for clustering: with a vector and without a cluster."""
    return processed.where((F.coalesce(F.size(vector), F.lit(0)) > 0) & F.col(cluster).isNull())


def untagged(raw: DataFrame, order: list[Column], n: int | None = None, tags: str = "tags") -> DataFrame:
    """Raw rows that have no tags yet, newest first."""
    out = raw.where(F.col(tags).isNull()).orderBy(*order)
    return out.limit(n) if n is not None else out


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Every field of defaults: its own value, or the default where it is null or the table lacks it. Defaults may name other fields."""
    given = {c: (F.coalesce(F.col(c), value) if c in df.columns else value) for c, value in defaults.items()}
    return df.withColumns(given)


def batch_totals(df: DataFrame, columns: list[str], group: list[str] | None = None) -> DataFrame:
    """articles, and for each array column the number of its elements in all rows (by group); null arrays have none."""
    sums = [F.coalesce(F.sum(F.greatest(F.size(c), F.lit(0))), F.lit(0)).alias(f"total_{c}") for c in columns]
    return (df.groupBy(*group) if group else df.groupBy()).agg(F.count("*").alias("articles"), *sums)


def peek(queue: DataFrame, sequence: str, n: int) -> DataFrame:
    """The n records that were queued last, last first."""
    return queue.orderBy(F.desc(sequence)).limit(n)


def only_new(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of batch whose key is not stored, one for each key; null keys are rejected."""
    return batch.where(F.col(key).isNotNull()).dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def upsert(stored: DataFrame, patch: DataFrame, key: str, stamp: Column | None = None, stamp_column: str = "updated_at") -> DataFrame:
    """stored with patch's rows merged in by key: fields that patch gives replace, nulls never overwrite, new keys are added.

    patch has at most one row for a key. Its columns that stored lacks are dropped.
    """
    own = [c for c in patch.columns if c != key and c in stored.columns]
    new = patch.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in own])
    both = stored.join(new, stored[key] == new["__key"], "full_outer")
    touched = F.col("__key").isNotNull()

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(F.col(key), F.col("__key")).alias(key)
        kept = F.coalesce(F.col(f"__{c}"), F.col(c)) if c in own else F.col(c)
        if stamp is not None and c == stamp_column:
            kept = F.when(touched, stamp).otherwise(kept)
        return kept.cast(stored.schema[c].dataType).alias(c)

    return both.select(*map(value, stored.columns))


def resolve_aliases(df: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """One column for each field, from the first of its names that is not null; other columns are dropped."""
    out = []
    for field, names in aliases.items():
        some = [F.col(n).cast("string") for n in names if n in df.columns]
        out.append((F.coalesce(*some) if some else F.lit(None).cast("string")).alias(field))
    return df.select(*out)


def with_columns_or_null(df: DataFrame, columns: list[str], kind: str = "string") -> DataFrame:
    """Exactly these columns; missing ones are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c in columns])


def ingest_reason(title: Column, body: Column, least_title: int = 5, least_body: int = 50) -> Column:
    """Why an article is rejected, or null: its stripped body, then its stripped title, is too short."""
    short_body = F.length(strip(F.coalesce(body, F.lit("")))) < least_body
    short_title = F.length(strip(F.coalesce(title, F.lit("")))) < least_title
    return F.when(short_body, "body too short").when(short_title, "title too short")


def storable(title: Column, content: Column) -> Column:
    return (F.length(F.coalesce(title, F.lit(""))) > 0) & (F.length(F.coalesce(content, F.lit(""))) > 0)


def top_values(df: DataFrame, group: list[str], values: Column, n: int = 5) -> DataFrame:
    """The n most frequent elements of an array column by group, with counts and ranks; ties by value, ascending."""
    counts = df.select(*group, F.explode(values).alias("value")).groupBy(*group, "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def modal_value(df: DataFrame, group: list[str], column: str, default: str = "Unknown") -> DataFrame:
    """The most frequent value by group (ties: the least); default where all are null."""
    counts = df.groupBy(*group, column).agg(F.count(column).alias("n"))
    best = F.min_by(F.col(column), F.struct(-F.col("n"), F.col(column)))
    return counts.groupBy(*group).agg(F.coalesce(best, F.lit(default)).alias(column))


def histogram(df: DataFrame, columns: list[str], name: str = "value") -> DataFrame:
    """Counts of the values of several columns in one histogram."""
    return df.select(F.explode(F.array(*[F.col(c) for c in columns])).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def numbered(df: DataFrame, order: list[Column], group: list[str] | None = None, name: str = "number") -> DataFrame:
    """Adds each row's number in order (within group), from 0.

    Rows are sorted by ranges and written once; a row's place in its range is the low part of its id, and the counts of
    (range, group) give what stands before it. So neither all rows nor those of a large group meet in one task.
    """
    keys = group or []
    ordered = materialize(df.orderBy(*keys, *order).withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    ordered = ordered.withColumns({"__part": part, "__place": place})
    first = ordered.groupBy("__part", *keys).agg(F.min("__place").alias("__first"), F.count("*").alias("__size"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = first.withColumn("__start", F.coalesce(F.sum("__size").over(before), F.lit(0)) - F.col("__first"))
    starts = starts.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__start")
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return ordered.join(starts, same).withColumn(name, F.col("__place") + F.col("__start")).select(*df.columns, name)


def batches(df: DataFrame, order: list[Column], size: int, group: list[str] | None = None) -> DataFrame:
    """Adds batch: rows in order (within group), size at a time, from 0."""
    rows = numbered(df, order, group, "__n")
    return rows.withColumn("batch", F.floor(F.col("__n") / size).cast("long")).select(*df.columns, "batch")
