"""Clusters of articles: sizes, centroids, medoids, summaries, assignment by similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, DoubleType, StructField, StructType

from gazetta.functions import vectors as V
from gazetta.operators.relational import modal_value, top_values
from gazetta.operators.search import ROWS, matrix

LEAST_SIZE = 3


def sizes(df: DataFrame, cluster: str, member: str, least: int = 1, noise: int | None = -1) -> DataFrame:
    """cluster, n and sorted members of clusters with at least so many; the noise label is none.

    The member lists are the result; their lengths are those of the clusters.
    """
    kept = df.where(F.col(cluster).isNotNull())
    kept = kept.where(F.col(cluster) != noise) if noise is not None else kept
    return kept.groupBy(cluster).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(member)).alias("members")).where(F.col("n") >= least)


def centroids(df: DataFrame, cluster: str, vector: str, digits: int | None = None) -> DataFrame:
    """Element-wise means by cluster, with n; rows without a vector are left out.

    Elements are averaged under (cluster, place), so a large cluster is summed on the map side.
    """
    parts = df.where(F.size(vector) > 0).select(cluster, F.posexplode(V.doubles(F.col(vector))).alias("pos", "x"))
    means = parts.groupBy(cluster, "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    value = F.col("x") if digits is None else F.round("x", digits)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("pos"), value.alias("x"))))
    return means.groupBy(cluster).agg(F.max("n").alias("n"), F.transform(ordered, lambda s: s["x"]).alias("center"))


def to_center(df: DataFrame, centers: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Adds similarity, each row's cosine to its own center. Centers are one row for each cluster."""
    return df.join(centers.select(cluster, "center"), cluster).withColumn("similarity", V.cosine(F.col(vector), F.col("center"))).drop("center")


def near_center(df: DataFrame, cluster: str, vector: str, threshold: float = 0.85) -> DataFrame:
    """Rows at least threshold similar to their cluster's centroid."""
    return to_center(df, centroids(df, cluster, vector), cluster, vector).where(F.col("similarity") >= threshold)


def medoids(df: DataFrame, cluster: str, member: str, vector: str) -> DataFrame:
    """The member nearest to the centroid by cluster (ties: the least member)."""
    both = df.join(centroids(df, cluster, vector), cluster)
    far = F.round(V.distance(F.col(vector), F.col("center")), 9)
    return both.groupBy(cluster).agg(F.min_by(member, F.struct(far, F.col(member))).alias("medoid"), F.count("*").alias("n"))


def stats(df: DataFrame, cluster: str) -> DataFrame:
    """One row: total, clustered, unclustered, n_clusters, mean and largest size."""
    by = df.groupBy(cluster).agg(F.count("*").alias("n"))
    has = F.col(cluster).isNotNull()
    return by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("clustered"),
        F.coalesce(F.sum(F.when(~has, F.col("n"))), F.lit(0)).alias("unclustered"),
        F.count(cluster).alias("n_clusters"),
        F.coalesce(F.round(F.avg(F.when(has, F.col("n"))), 6), F.lit(0.0)).alias("mean_size"),
        F.coalesce(F.max(F.when(has, F.col("n"))), F.lit(0)).alias("largest"),
    )


def summaries(df: DataFrame, cluster: str, member: str, title: Column, tags: Column, topic: str, region: str, least: int = LEAST_SIZE) -> DataFrame:
    """size, top_tags (5), primary_topic, primary_region, representative_title (of the least member with one).

    Tags, topics and regions are counted together, and what is counted is dealt out by cluster once for ranks, lists and the join.
    """
    rows = df.withColumns({"__title": title, "__tags": F.coalesce(tags, F.array().cast("array<string>"))})
    base = rows.groupBy(cluster).agg(
        F.count("*").alias("size"), F.min_by("__title", F.when(F.length("__title") > 0, F.col(member))).alias("representative_title")
    ).where(F.col("size") >= least)

    def of(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))

    every = F.concat(F.transform("__tags", lambda t: of("tag", t)), F.array(of("topic", F.col(topic)), of("region", F.col(region))))
    counts = rows.select(cluster, F.explode(every).alias("e")).select(cluster, "e.*").where("kind = 'tag' or value is not null").groupBy(cluster, "kind", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(cluster, "kind").orderBy(F.desc("n"), "value"))
    best = counts.repartition(cluster).withColumn("rank", rank).where((F.col("rank") == 1) | (F.col("kind") == "tag") & (F.col("rank") <= 5))
    first = {name: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("value"))), F.lit("Unknown")).alias(name) for kind, name in (("topic", "primary_topic"), ("region", "primary_region"))}
    listed = F.array_sort(F.collect_list(F.when(F.col("kind") == "tag", F.struct("rank", "value"))))
    top = best.groupBy(cluster).agg(F.transform(listed, lambda s: s["value"]).alias("top_tags"), *first.values())
    out = base.join(top, cluster, "left")
    defaults = {"top_tags": F.array().cast("array<string>"), "primary_topic": F.lit("Unknown"), "primary_region": F.lit("Unknown")}
    return out.select(cluster, "size", "representative_title", *[F.coalesce(c, d).alias(c) for c, d in defaults.items()])


def summary_text(topic: Column, n: Column, entities: Column, tags: Column) -> Column:
    """One paragraph about a cluster: its topic, size, first three entities and tags."""
    head = F.when(F.length(topic) > 0, F.concat(F.lit("Topic Cluster: "), topic, F.lit(". Contains "), n.cast("string"), F.lit(" articles. "))).otherwise(
        F.concat(F.lit("Cluster of "), n.cast("string"), F.lit(" articles. "))
    )

    def listed(name: str, values: Column, end: str) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(f"{name}: "), F.concat_ws(", ", F.slice(values, 1, 3)), F.lit(end))).otherwise("")

    return F.concat(head, listed("Key entities", entities, ". "), listed("Common tags", tags, "."))


def article_topic(title: Column, terms: Column) -> Column:
    """The first three of: terms (place, command and actor prefixes cut, others over two characters) and long words of the title's first five; else the title's start."""
    bare = F.transform(terms, lambda t: F.when(t.rlike("^(GEO|CMD|ACT):"), F.regexp_replace(t, "^[A-Z]+:", "")).otherwise(F.when(F.length(t) > 2, t)))
    words = F.filter(F.slice(F.filter(F.split(F.coalesce(title, F.lit("")), r"\s+"), lambda w: F.length(w) > 0), 1, 5), lambda w: F.length(w) > 2)
    found = F.slice(F.concat(F.array_compact(F.coalesce(bare, F.array().cast("array<string>"))), words), 1, 3)
    return F.when(F.size(found) > 0, F.array_join(found, " ")).otherwise(F.substring(F.coalesce(title, F.lit("")), 1, 50))


def cluster_topics(df: DataFrame, cluster: str, topic: Column) -> DataFrame:
    """The five most frequent words of the members' topics, those over two characters, joined."""
    words = F.filter(F.split(topic, r"\s+"), lambda w: F.length(w) > 0)
    top = top_values(df, [cluster], words, 5).where(F.length("value") > 2)
    listed = F.array_sort(F.collect_list(F.struct("rank", "value")))
    return top.groupBy(cluster).agg(F.array_join(F.transform(listed, lambda s: s["value"]), " ").alias("topic"))


#: Bytes of centres that are broadcast at once.
CENTER_BYTES = 32 << 20


def assign_to_centers(rows: DataFrame, centers: DataFrame, row: str, cluster: str, vector: str, threshold: float, most: int = 100_000) -> DataFrame:
    """Each row's nearest stored center (ties: the least cluster) and similarity; cluster null under threshold.

    Centers come in blocks of at most most, and at most CENTER_BYTES; each batch of rows meets a block in one matrix product,
    and only with several blocks are a row's best ones compared by a shuffle. A row without a vector, or with one of
    another size, has no cluster and no similarity.
    """
    kind = centers.schema[cluster].dataType
    wide = centers.agg(F.max(F.size("center"))).first()[0] or 0
    size = max(1, min(most, CENTER_BYTES // max(1, 8 * wide)))
    found, count, block = None, 0, []
    ordered = centers.where(F.size("center") == wide).select(F.col(cluster).alias("c"), V.doubles(F.col("center")).alias("v")).orderBy("c")
    for r in ordered.toLocalIterator():
        block.append((r.c, r.v))
        if len(block) == size:
            part, block = _to_block(rows, block, row, vector, wide, kind), []
            found, count = part if found is None else found.unionByName(part), count + 1
    if block or found is None:
        part = _to_block(rows, block, row, vector, wide, kind)
        found, count = part if found is None else found.unionByName(part), count + 1
    if count > 1:
        best = found.where("__s is not null").groupBy(row).agg(F.min(F.struct((-F.col("__s")).alias("d"), F.col("__c").alias("c"))).alias("b"))
        found = rows.select(row).join(best, row, "left").select(row, F.col("b.c").alias("__c"), (-F.col("b.d")).alias("__s"))
    return found.select(row, F.when(F.col("__s") >= threshold, F.col("__c")).alias(cluster), F.col("__s").alias("similarity"))


def _to_block(rows: DataFrame, block: list[tuple], row: str, vector: str, wide: int, kind: DataType) -> DataFrame:
    """row, __c and __s: the nearest of a block's centers, which are in order, so the first of several as near is the least."""
    sent = rows.sparkSession.sparkContext.broadcast(([c for c, _ in block], np.array([v for _, v in block], float).reshape(len(block), wide)))
    schema = StructType([rows.schema[row], StructField("__c", kind), StructField("__s", DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        norms = np.linalg.norm(q, axis=1, keepdims=True)
        q = np.divide(q, norms, out=np.zeros_like(q), where=norms > 0)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                m, good = matrix(part.column(1), max(wide, 1))
                best, scores = [None] * part.num_rows, [None] * part.num_rows
                if len(names) and len(good):
                    s = np.round(m @ q.T, 9)
                    first = s.argmax(1)
                    for i, k, x in zip(good.tolist(), first.tolist(), s[np.arange(len(good)), first].tolist(), strict=True):
                        best[i], scores[i] = names[k], x
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.types[0]), pa.array(best, arrow.types[1]), pa.array(scores, arrow.types[2])], schema=arrow)

    return rows.select(row, vector).mapInArrow(run, schema)


def kmeans(df: DataFrame, member: str, vector: str, k: int, threshold: float = 0.85, seed: int = 42, rounds: int = 200) -> DataFrame:
    """member, cluster, similarity by k-means; cluster is null for rows less similar to their centre than threshold."""
    points = df.where(F.size(vector) > 0).withColumn("features", array_to_vector(V.doubles(F.col(vector))))
    model = KMeans(k=k, seed=seed, maxIter=rounds, initSteps=5).fit(points)
    centers = df.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "cluster int, center array<double>")
    labelled = model.transform(points).withColumn("cluster", F.col("prediction").cast("int")).select(member, vector, "cluster")
    out = labelled.join(F.broadcast(centers), "cluster").withColumn("similarity", V.cosine(F.col(vector), F.col("center")))
    return out.select(member, F.when(F.col("similarity") >= threshold, F.col("cluster")).alias("cluster"), "similarity")
