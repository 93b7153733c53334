"""Ids that are the same in every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cluster_id(members: Column) -> Column:
    """A cluster's id: a hash of its sorted members."""
    return F.concat(F.lit("cluster_"), F.substring(F.sha2(F.array_join(F.array_sort(members.cast("array<string>")), "|"), 256), 1, 16))


def article_id(url: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", url, text), 256)


def article_key(number: Column, source: Column) -> Column:
    return F.concat(F.lit("article_"), number.cast("string"), F.lit("_"), source)
