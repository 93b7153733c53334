"""Writers: appends of valid rows, merges into Parquet tables, JSON records for queues and external tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.operators.relational import resolve_aliases, upsert
from gazetta.scratch import file_system, remove


def raw_rows(articles: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows of the raw table: aliases resolved, rows without address or text dropped, stamped."""
    fields = resolve_aliases(articles)
    valid = (F.length(F.coalesce("url", F.lit(""))) > 0) & (F.length(F.coalesce("content", F.lit(""))) > 0)
    return fields.where(valid).select(
        F.coalesce("id", F.sha2(F.concat_ws("|", "url", "content"), 256)).alias("id"), F.col("url").alias("source_url"), "title", F.col("content").alias("text_content"), "published_date",
        (now if now is not None else F.current_timestamp()).alias("created_at"),
    )


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def merge(spark: SparkSession, path: str, patch: DataFrame, key: str, stamp: Column | None = None, keep: int = 3) -> str:
    """Upserts patch into the newest version of a table kept as versions under path; returns the new version's path.

    A version appears under its name only when it is whole: readers take the last of `versions`. A repeated merge of the
    same patch gives the same rows. The last keep versions stay, so that readers of an older one can finish.
    """
    old = versions(spark, path)
    merged = upsert(spark.read.parquet(old[-1]), patch, key, stamp) if old else patch
    number = int(old[-1].rsplit("/v", 1)[1].split("-")[0]) + 1 if old else 0
    name = f"{path}/v{number:08d}-{uuid.uuid4().hex[:8]}"
    merged.write.parquet(name)
    for done in versions(spark, path)[:-keep]:
        remove(spark, done)
    return name


def versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions of a table, oldest first."""
    fs, hadoop = file_system(spark, path)
    if not fs.exists(hadoop):
        return []
    found = [s.getPath().toString() for s in fs.listStatus(hadoop) if s.isDirectory()]
    return sorted(p for p in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def records(df: DataFrame, name: str = "value") -> DataFrame:
    """Rows as JSON text, as queues and topics carry them."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def push(df: DataFrame, path: str) -> None:
    """Rows to the end of a queue: a folder of JSON lines that the next stage reads as a stream."""
    records(df).write.mode("append").text(path)


def queue_size(spark: SparkSession, path: str) -> int:
    """Records of a queue; 0 without one."""
    fs, at = file_system(spark, path)
    return spark.read.text(path).count() if fs.exists(at) and len(fs.listStatus(at)) else 0


def clear_queue(spark: SparkSession, path: str) -> None:
    remove(spark, path)


def predictions(df: DataFrame, key: str, event_type: Column, region: Column, score: Column, model: str) -> DataFrame:
    """Rows of the predictions table for tagged rows."""
    return df.select(F.col(key).alias("osint_id"), event_type.alias("event_type"), region.alias("region"), score.alias("likelihood_score"), F.lit(model).alias("model_used"))


def cluster_rows(df: DataFrame, now: Column) -> DataFrame:
    """New rows of the clusters table: label, description, centre, member count and representative of df; status pending."""
    fields = ["label", "description", "center_embedding", "member_count", "representative_article_id"]
    own = [F.col(c) if c in df.columns else F.lit(None).alias(c) for c in fields]
    return df.select("id", *own, F.lit("pending").alias("status"), now.alias("created_at"))


def cluster_update(df: DataFrame, now: Column, status: str | None = None) -> DataFrame:
    """A patch for merge() of the clusters table: df's fields, the time, and a new status if one is given."""
    out = df.withColumn("updated_at", now)
    return out.withColumn("status", F.lit(status)) if status else out


#: Columns of the two external tables.
OSINT = "title content url source primary_country primary_city primary_region all_locations keyword_tags semantic_tags geographic_tags sentiment_score significance_score language scraped_at processed_at title_embedding content_embedding".split()
GDELT = "title content source_url source primary_country primary_city primary_region keyword_tags semantic_tags geographic_tags sentiment_score significance_score language processed_at title_embedding content_embedding".split()


def external_rows(df: DataFrame, kind: str) -> DataFrame:
    """Rows for the osint or gdelt table: its columns, vectors as JSON text, missing ones null."""
    if kind not in ("osint", "gdelt"):
        raise ValueError(f"unknown kind of data: {kind}")
    if kind == "gdelt":
        df = df.withColumn("source", F.lit("GDELT")).withColumn("source_url", F.col("source_url") if "source_url" in df.columns else F.col("url"))
    out = []
    for c in OSINT if kind == "osint" else GDELT:
        if c not in df.columns:
            out.append(F.lit(None).cast("string").alias(c))
        else:
            out.append((F.to_json(F.col(c)) if c.endswith("_embedding") else F.col(c)).alias(c))
    return df.select(*out)
