"""Source lists, tables, queued records and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.functions import text as T
from gazetta.schemas import SOURCES


def source_list(spark: SparkSession, path: str) -> DataFrame:
    """name, url, type of a .json array or of a .txt with one address a line (blank lines go, type news)."""
    if path.endswith(".json"):
        return spark.read.schema(SOURCES).option("multiLine", True).json(path)
    if path.endswith(".txt"):
        line = F.trim("value")
        return spark.read.text(path).where(F.length(line) > 0).select(line.alias("name"), line.alias("url"), F.lit("news").alias("type"))
    raise ValueError(f"a source list is .json or .txt: {path}")


def first_sources(sources: DataFrame, n: int, order: str = "name") -> DataFrame:
    """The first n sources by order; a cap that the caller asks for."""
    return sources.orderBy(order).limit(n)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; timestamps without a zone are taken as UTC."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    zoned = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"}
    return df.withColumns(zoned) if zoned else df


def queued(df: DataFrame, schema: str, value: str = "value", key: str = "article_id") -> DataFrame:
    """Records of a queue: JSON objects by schema. Any other row is a bare id, as it stands: a malformed record, a number,
    quoted text (without its quotes). An object without a key has a null one; null rows have null fields."""
    parsed = df.select(F.col(value).alias("__v"), F.from_json(F.col(value), schema).alias("__r"), F.from_json(F.col(value), "map<string,string>", {"mode": "PERMISSIVE"}).alias("__m"))
    bare = F.col("__m").isNull() | ~F.col("__v").rlike(r"^\s*\{")
    kept = parsed.select("__v", "__r.*", bare.alias("__bare"))
    fields = [c for c in kept.columns if c not in ("__v", "__bare")]
    quoted = F.col("__v").rlike(r'^\s*"[^"]*"\s*$')
    name = F.when(quoted, F.regexp_extract("__v", '"([^"]*)"', 1)).otherwise(T.strip(F.col("__v")))
    return kept.select(*[F.when(~F.col("__bare"), F.col(c)).otherwise(name.cast(kept.schema[c].dataType) if c == key else None).alias(c) for c in fields])


def scraped(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Articles of fetched pages: title, description, author, date, url, host; text is left to the extractors."""
    page = F.col(html)
    return pages.withColumns({"title": T.extract_title(page), "description": T.extract_meta_description(page), "author": T.extract_author(page), "date": T.extract_published(page), "host": F.regexp_extract(F.col(url), r"^[a-z]+://([^/:?#]+)", 1)})


def needs_translation(language: Column) -> Column:
    return F.coalesce(language, F.lit("unknown")) != "en"
