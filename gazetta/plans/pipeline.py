"""Stages composed: ingest, translate, tag, embed, cluster, summarise; and steps by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazetta.functions import lexicon as L
from gazetta.functions import text as T
from gazetta.functions import vectors as V
from gazetta.operators import clusters, density, hierarchy, models, tagging
from gazetta.operators import relational as R
from gazetta.operators.relational import ingest_reason
from gazetta.plans import reports
from gazetta.scratch import materialize
from gazetta.sources import store
from gazetta.sources.vectorindex import VectorIndex


def ingest(articles: DataFrame, title: str = "title", body: str = "content") -> tuple[DataFrame, DataFrame]:
    """Accepted articles, and rejected ones with a reason."""
    judged = articles.withColumn("reason", ingest_reason(F.col(title), F.col(body)))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def translate(df: DataFrame, title: str = "title", body: str = "content", make=models.SameText, errors: bool = False) -> DataFrame:
    """Adds language, title_translated, content_translated, cleaned_text and translation_status; English passes as it is.

    With errors, rows that the translator fails on keep their texts and have an error.
    """
    out = df.withColumn("language", T.detect_language(F.col(body), "translator"))
    need = T.needs_translation(F.col("language"), F.col(body))
    if errors:
        # null for English: the translator may fail on what it need not see
        out = out.withColumns({f"__{c}": models.tried(F.when(need, F.col(c)), make, "translate", "string") for c in (title, body)})
        out = tagging.with_error(out, *[F.when(need, F.col(f"__{c}.error")) for c in (title, body)])

    else:
        out = out.withColumn("__new", models.apply_all([F.col(title), F.col(body)], make, "translate", "string"))

    def of(c: str, at: int) -> Column:
        new = F.coalesce(F.col(f"__{c}.value"), F.col(c)) if errors else F.get("__new", F.lit(at))
        return F.when(need, new).otherwise(F.col(c))

    out = out.withColumns({"title_translated": of(title, 0), "content_translated": of(body, 1)}).drop(f"__{title}", f"__{body}", "__new")
    status = F.when(~need, "not_needed").when(F.col("content_translated") == F.col(body), "failed").otherwise("translated")
    return out.withColumns({"cleaned_text": T.clean_text(F.col("content_translated")), "translation_status": status})


def tag(df: DataFrame, make=models.GazetteerAnnotator, errors: bool = False) -> DataFrame:
    return tagging.tag_articles(df, "title_translated", "cleaned_text", make, errors)


def embed(df: DataFrame, size: int = models.DIMENSION, make: Callable[[], models.Embedder] | None = None, errors: bool = False) -> DataFrame:
    """Adds embedding: of the prepared text, mixed with those of the tags and entities. With errors, a row that the embedder fails on has none, and an error."""
    make = make or (lambda: models.HashEmbedder(size))
    texts = {"__t": T.embedding_text(F.col("title_translated"), F.col("cleaned_text"), F.col("tags"), F.col("entities")), "__g": F.concat_ws(" ", "tags"), "__e": F.concat_ws(" ", "entities")}
    if errors:
        out = df.withColumns({name: models.tried(c, make, "embed", "array<double>") for name, c in texts.items()})
        out = tagging.with_error(out, *[F.col(f"{name}.error") for name in texts]).withColumns({name: F.col(f"{name}.value") for name in texts})
    else:
        both = df.withColumn("__all", models.apply_all(list(texts.values()), make, "embed", "array<double>"))
        out = both.withColumns({name: F.get("__all", F.lit(i)) for i, name in enumerate(texts)}).drop("__all")
    has = lambda c: F.size(c) > 0
    mixed = V.blend(F.col("__t"), F.when(has("tags"), F.col("__g")), F.when(has("entities"), F.col("__e")))
    return out.withColumn("embedding", mixed).drop("__t", "__g", "__e")


def cluster(df: DataFrame, key: str, k: int | None = None, threshold: float = 0.85) -> DataFrame:
    """Adds cluster (null: rejected) and similarity by k-means over the embeddings; k is estimated if it is not given."""
    if k is None:
        n = df.where(F.size("embedding") > 0).count()
        k = df.sparkSession.range(1).select(V.optimal_clusters(F.lit(n))).first()[0]
    if k < 1:
        return df.withColumns({"cluster": F.lit(None).cast("int"), "similarity": F.lit(None).cast("double")})
    return df.join(clusters.kmeans(df, key, "embedding", k, threshold), key, "left")


#: Members whose texts a cluster's summary is made of.
SUMMARISED = 32


def cluster_texts(df: DataFrame, cluster: str, key: str, body: str, least: int = clusters.LEAST_SIZE, most: int = SUMMARISED) -> DataFrame:
    """cluster, n, text (texts of the first `most` members in key order, parted by empty lines) of clusters that are large enough.

    A summary has a few sentences, so later members add nothing to it; only the first ones are brought together, and
    those of each partition are chosen before rows move.
    """
    rows = df.where(F.col(cluster).isNotNull())
    sizes = rows.groupBy(cluster).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    first = rows.select(cluster, F.col(key).alias("k"), F.col(body).alias("b")).withColumn("__r", F.row_number().over(Window.partitionBy(cluster).orderBy("k"))).where(F.col("__r") <= most)
    texts = first.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("k", "__r", "b"))).alias("r"))
    return sizes.join(texts, cluster).select(cluster, "n", F.array_join(F.transform("r", lambda x: x["b"]), "\n\n").alias("text"))


def summarise(df: DataFrame, cluster: str, key: str, body: str, make=models.LeadSummarizer) -> DataFrame:
    return cluster_texts(df, cluster, key, body).withColumn("summary", models.summary(F.col("text"), make)).drop("text")


def process_article(df: DataFrame, title: Column, content: Column) -> DataFrame:
    """Tags by word lists, country, signed sentiment and significance of articles. Title and text are lower-cased once."""

    def of(low: Column) -> Column:
        return F.struct(L.groups_found(low, L.KEYWORD_GROUPS).alias("keyword_tags"), L.groups_found(low, L.SEMANTIC_GROUPS).alias("semantic_tags"), L.primary_country(low).alias("primary_country"))

    city = F.lit(None).cast("string")
    out = df.withColumn("__found", V.let(L.title_and_text(title, content), of))
    return out.withColumns(
        {
            "keyword_tags": F.col("__found.keyword_tags"),
            "semantic_tags": F.col("__found.semantic_tags"),
            "primary_country": F.col("__found.primary_country"),
            "primary_city": city,
            "sentiment_score": L.sentiment_score(content),
            "significance_score": L.significance(F.col("__found.keyword_tags"), F.col("__found.primary_country"), city),
        }
    ).drop("__found")


STEPS: dict[str, Callable[[DataFrame], DataFrame]] = {"translate": translate, "tag": tag, "embed": embed}


def run_step(name: str, df: DataFrame) -> DataFrame:
    if name not in STEPS:
        raise ValueError(f"no step {name}; there are {', '.join(STEPS)}")
    return STEPS[name](df)


def run_chain(df: DataFrame, names: list[str]) -> DataFrame:
    """Steps by name, one after the other."""
    for name in names:
        df = run_step(name, df)
    return df


def run_articles(articles: DataFrame) -> DataFrame:
    """Accepted articles through all row-wise stages."""
    accepted, _ = ingest(articles)
    return run_chain(accepted, list(STEPS))


def cluster_records(rows: DataFrame, cluster: str, key: str, title: Column, tags: Column, entities: Column, vector: str, least: int = 1) -> DataFrame:
    """Rows of the clusters table: cluster, member_count, top_tags and top_entities (10), summary, representative id (medoid), theme and status.

    Small clusters are complete with a fixed text as their summary, others have one made from their topic, size, entities and tags.
    """
    members = rows.where(F.col(cluster).isNotNull()).withColumns({"__tags": tags, "__entities": entities})

    def top(column: str, name: str) -> DataFrame:
        ranked = R.top_values(members, [cluster], F.col(column), 10).groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("t"))
        return ranked.select(cluster, F.transform("t", lambda s: s["value"]).alias(name))

    none = F.array().cast("array<string>")
    base = clusters.medoids(members.where(F.size(vector) > 0), cluster, key, vector).select(cluster, F.col("medoid").alias("representative_article_id"))
    sizes = members.groupBy(cluster).agg(F.count("*").alias("member_count")).where(F.col("member_count") >= least)
    topics = clusters.cluster_topics(members, cluster, clusters.article_topic(title, F.concat(tags, entities)))
    out = sizes.join(base, cluster, "left").join(top("__tags", "top_tags"), cluster, "left").join(top("__entities", "top_entities"), cluster, "left").join(topics, cluster, "left")
    out = out.withColumns({"top_tags": F.coalesce("top_tags", none), "top_entities": F.coalesce("top_entities", none), "theme": F.coalesce("topic", F.lit(""))}).drop("topic")
    small = F.col("member_count") < clusters.LEAST_SIZE
    said = clusters.summary_text(F.col("theme"), F.col("member_count"), F.col("top_entities"), F.col("top_tags"))
    return out.withColumns({"summary": F.when(small, reports.SINGLE).otherwise(said), "status": F.when(small, "complete").otherwise("pending")})


def clustering_run(df: DataFrame, key: str, title: str, body: str, k: int | None = None, threshold: float = 0.85, make=models.LeadSummarizer) -> tuple[DataFrame, DataFrame]:
    """The whole run: k estimated, k-means, a summary of each cluster that is large enough. Assignments, and clusters to store.

    Clusters have an id that is the same in every run, member_count, summary and status complete.
    """
    assigned = materialize(cluster(df, key, k, threshold))
    kept = assigned.where(F.col("cluster").isNotNull())
    said = summarise(kept, "cluster", key, body, make)
    first = kept.groupBy("cluster").agg(F.min_by(title, key).alias("theme"), F.min(F.col(key)).alias("__first"))
    stored = said.join(first, "cluster").withColumnRenamed("n", "member_count")
    ident = F.concat(F.lit("cluster_"), F.substring(F.sha2(F.concat_ws("|", F.col("__first").cast("string"), F.col("member_count").cast("string")), 256), 1, 16))
    return assigned, stored.select("cluster", ident.alias("cluster_id"), "member_count", "theme", "summary", F.lit("complete").alias("status"))


def store_clusters(spark: SparkSession, folder: str, assigned: DataFrame, stored: DataFrame, key: str) -> None:
    """Writes a run back: cluster ids into the table of articles under folder, records into that of clusters. A repeated run changes nothing."""
    patch = assigned.join(F.broadcast(stored.select("cluster", "cluster_id")), "cluster").select(key, "cluster_id")
    store.merge(spark, f"{folder}/articles", patch, key)
    store.merge(spark, f"{folder}/clusters", stored.drop("cluster"), "cluster_id")


def density_run(spark: SparkSession, rows: DataFrame, folder: str, key: str, vector: str, title: str, size: int, least: int = 2) -> dict[str, int]:
    """HDBSCAN over all rows, written back: records into the table of clusters under folder, cluster ids into that of processed articles.

    A repeated run over the same rows changes nothing. Returns the counts of a worker's report.
    """
    labels = materialize(hierarchy.hdbscan(rows, key, vector, size, least))
    found = materialize(hierarchy.cluster_rows(labels, rows, key, vector, title))
    store.merge(spark, f"{folder}/clusters", store.cluster_rows(found, F.current_timestamp()), "id")
    patch = labels.join(found.select("cluster", F.col("id").alias("cluster_id")), "cluster").select(key, "cluster_id")
    store.merge(spark, f"{folder}/articles_processed", patch, key)
    return {"clusters_created": found.count(), "articles_processed": labels.count()}


def topic_run(spark: SparkSession, rows: DataFrame, folder: str, key: str, vector: str, topic: str, cluster: str, size: int) -> dict:
    """The whole run by topics: index, counts, assignment of what has no cluster, write-back, counts again.

    The index is stored under folder; new assignments go into its table of processed articles, and every cluster's size and
    representative into that of clusters. A repeated run over the same rows changes nothing.
    """
    if not rows.limit(1).count():
        return {"status": "no_articles", "total_articles": 0}
    rows = materialize(rows.select(key, vector, topic, F.col(cluster).cast("long").alias(cluster)))
    index = VectorIndex.create(spark, f"{folder}/index", rows, key, vector, size)
    before = clusters.stats(rows, cluster).first().asDict()
    found = materialize(density.assign_all_by_topic(rows, key, vector, topic, cluster, size))
    whole = materialize(rows.drop(cluster).join(found.withColumnRenamed("cluster", cluster), key, "left"))
    fresh = found.join(rows.where(F.col(cluster).isNull()).select(key), key, "left_semi")
    patch = fresh.select(key, F.concat(F.lit("cluster_"), F.col("cluster")).alias("cluster_id"))
    store.merge(spark, f"{folder}/articles_processed", patch, key)
    members = clusters.medoids(whole.where(F.col(cluster).isNotNull()), cluster, key, vector)
    kept = members.select(F.concat(F.lit("cluster_"), F.col(cluster)).alias("cluster_id"), F.col("n").alias("member_count"), F.col("medoid").alias("representative_article_id"))
    store.merge(spark, f"{folder}/clusters", kept, "cluster_id")
    after = clusters.stats(whole, cluster).first().asDict()
    return {"status": "success", "total_articles": after["total"], "assigned": fresh.count(), "before": before, "after": after, "index": index.stats()}
