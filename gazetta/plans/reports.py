"""Status counters, cluster reports and digests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazetta.functions import lexicon as L
from gazetta.operators.clusters import LEAST_SIZE
from gazetta.operators.relational import modal_value, top_values

SINGLE = "Single article cluster - no summary needed"


def counters(articles: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """One row: total, processed, unprocessed articles; each table is read once."""
    marked = articles.select(key).join(processed.select(F.col(key).alias("__p")).distinct(), F.col(key) == F.col("__p"), "left")
    return marked.agg(F.count("*").alias("total"), F.count("__p").alias("processed"), F.count_if(F.col("__p").isNull()).alias("unprocessed"))


def today(df: DataFrame, time: str, now: Column, status: Column) -> DataFrame:
    """One row: all rows, those since midnight, those of the last 24 hours, and the complete ones among these."""
    t = F.col(time).cast("timestamp")
    recent = t >= now - F.expr("INTERVAL 1 DAY")
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(t >= F.date_trunc("day", now)).alias("since_midnight"),
        F.count_if(recent).alias("last_day"),
        F.count_if(recent & status).alias("complete_last_day"),
    )


def health(status: DataFrame, component: str, healthy: Column) -> DataFrame:
    """One row: components, healthy ones, and healthy or degraded."""
    by = status.groupBy(component).agg(F.every(healthy).alias("ok"))
    return by.agg(F.count("*").alias("components"), F.count_if("ok").alias("healthy"), F.when(F.every("ok"), "healthy").otherwise("degraded").alias("status"))


def source_categories(df: DataFrame, name: Column, words: tuple[str, str]) -> DataFrame:
    """One row: sources whose name has the first word, the second, neither (case does not count)."""
    low = F.lower(F.coalesce(name, F.lit("")))
    a, b = low.contains(words[0]), low.contains(words[1])
    return df.agg(F.count("*").alias("total"), F.count_if(a).alias("first"), F.count_if(b).alias("second"), F.count_if(~a & ~b).alias("neither"))


def ingest_status(articles: DataFrame, queue: DataFrame, processed: DataFrame, clusters: DataFrame, key: str, summary: str) -> DataFrame:
    """One row for a dashboard: articles_scraped (stored and queued), articles_processed, clusters_created, summaries_generated, queue_size, status."""
    done = articles.join(processed.select(key).distinct(), key, "left_semi")
    parts = [
        articles.agg(F.count("*").alias("stored"), F.count(summary).alias("summaries_generated")),
        queue.agg(F.count("*").alias("queue_size")), done.agg(F.count("*").alias("articles_processed")), clusters.agg(F.count("*").alias("clusters_created")),
    ]
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(p)  # one row each
    status = F.when(F.col("queue_size") > 0, "active").otherwise("inactive")
    return one.select((F.col("stored") + F.col("queue_size")).alias("articles_scraped"), "articles_processed", "clusters_created", "summaries_generated", "queue_size", status.alias("status"))


def pending_clusters(clusters: DataFrame, status: str = "status") -> DataFrame:
    return clusters.where(F.col(status) == "pending")


def recent_complete(clusters: DataFrame, time: str, now: Column, status: str = "status") -> DataFrame:
    """Clusters that were completed in the last 24 hours."""
    return clusters.where((F.col(status) == "complete") & (F.col(time).cast("timestamp") >= now - F.expr("INTERVAL 1 DAY")) & (F.col(time).cast("timestamp") <= now))


def daily_digest(clusters: DataFrame, members: DataFrame, cluster: str, time: str, now: Column, region: str, topic: str, source: str) -> DataFrame:
    """grouped_digest of the clusters that were completed in the last 24 hours; clusters without members are left out."""
    some = recent_complete(clusters, time, now).select(cluster)
    return grouped_digest(members.join(some, cluster, "left_semi"), cluster, region, topic, source)


def cluster_stats(members: DataFrame, cluster: str, score: str, tags: Column, entities: Column, escalation: str) -> DataFrame:
    """Per cluster article_count, avg_confidence, unique_tags, unique_entities, max_escalation and escalation_level (by thresholds 0.3 and 0.7)."""
    rows = members.withColumns({"__tags": tags, "__entities": entities})
    base = rows.groupBy(cluster).agg(F.count("*").alias("article_count"), F.round(F.avg(score), 6).alias("avg_confidence"), F.round(F.max(escalation), 6).alias("max_escalation"))
    for c, name in (("__tags", "unique_tags"), ("__entities", "unique_entities")):
        distinct = rows.select(cluster, F.explode(c).alias("t")).distinct().groupBy(cluster).agg(F.count("*").alias(name))
        base = base.join(distinct, cluster, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    level = F.when(F.col("max_escalation") >= 0.7, "high").when(F.col("max_escalation") >= 0.3, "medium").otherwise("low")
    return base.withColumn("escalation_level", level)


def route_summaries(sizes: DataFrame, size: str = "n", least: int = LEAST_SIZE) -> DataFrame:
    """Pending clusters: small ones are complete with a fixed text, others are to be summarised."""
    small = F.col(size) < least
    return sizes.withColumns({"status": F.when(small, "complete").otherwise("pending"), "summary": F.when(small, SINGLE)})


def cluster_details(df: DataFrame, cluster: str, confidence: str, tags: Column, n: int = 5) -> DataFrame:
    """article_count, mean confidence, distinct tags and the top ones with counts by cluster."""
    rows = df.withColumn("__tags", tags)
    base = rows.groupBy(cluster).agg(F.count("*").alias("article_count"), F.round(F.avg(confidence), 6).alias("avg_confidence"))
    distinct = rows.select(cluster, F.explode("__tags").alias("t")).groupBy(cluster).agg(F.count_distinct("t").alias("unique_tags"))
    top = top_values(rows, [cluster], F.col("__tags"), n).groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("t"))
    told = F.array_join(F.transform("t", lambda s: F.concat(s["value"], F.lit(":"), s["n"].cast("string"))), ",")
    out = base.join(distinct, cluster, "left").join(top.select(cluster, told.alias("top_tags")), cluster, "left")
    return out.withColumns({"unique_tags": F.coalesce("unique_tags", F.lit(0)), "top_tags": F.coalesce("top_tags", F.lit(""))})


def grouped_digest(members: DataFrame, cluster: str, region: str, topic: str, source: str, least: int = 1) -> DataFrame:
    """region, topic, item (its number there), cluster, n and sorted sources: the modal region and topic of each cluster's members."""
    base = members.groupBy(cluster).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(source)).alias("sources")).where(F.col("n") >= least)
    named = base.join(modal_value(members, [cluster], region, "Unknown Region"), cluster).join(modal_value(members, [cluster], topic, "General"), cluster)
    return named.withColumn("item", F.row_number().over(Window.partitionBy(region, topic).orderBy(cluster)))


def flat_markdown(df: DataFrame, region: str, topic: str, item: str, text: str) -> DataFrame:
    """One row for each region: its heading, topics' headings and items, as lines of markdown."""
    topics = df.groupBy(region, topic).agg(F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), F.col(text).alias("t")))).alias("items"))
    lines = F.concat_ws("\n", F.concat(F.lit("### "), F.col(topic)), F.concat_ws("\n", F.transform("items", lambda s: F.concat(F.lit("- "), s["t"]))), F.lit(""))
    parts = topics.withColumn("part", lines).groupBy(region).agg(F.array_sort(F.collect_list(F.struct(topic, "part"))).alias("parts"))
    return parts.select(region, F.concat_ws("\n", F.concat(F.lit("## "), F.col(region), F.lit("\n")), F.array_join(F.transform("parts", lambda s: s["part"]), "\n")).alias("markdown"))


def with_marks(df: DataFrame, priority: str = "priority_level", score: str = "escalation_score") -> DataFrame:
    return df.withColumns({"priority_mark": L.priority_mark(F.col(priority)), "escalation_mark": L.escalation_mark(F.col(score))})


def render_digest(rows: list[dict], now: datetime, name: str = "Daily Digest") -> str:
    """Markdown of a day's clusters: dicts with region, topic, theme, summary, priority_level, escalation_score, n, sources and marks.

    The clusters of one day's report come to the driver; their number is that of the report's entries.
    """
    out = [f"# {name}", f"## {now:%B %d, %Y}", "", f"**Summary**: {len(rows)} completed clusters in the last 24 hours", "", "---", ""]
    if not rows:
        out += ["**No completed clusters found in the last 24 hours.**", ""]
    last: tuple[str | None, str | None] = (None, None)
    for r in sorted(rows, key=lambda r: (r["region"], r["topic"])):
        if r["region"] != last[0]:
            out += [f"## {r['region']}", ""]
        if (r["region"], r["topic"]) != last:
            out += [f"### {r['topic']}", ""]
        last = (r["region"], r["topic"])
        more = "..." if len(r["sources"]) > 3 else ""
        out += [
            f"#### {r.get('priority_mark', '')} {r['theme']} {r.get('escalation_mark', '')}".rstrip(), "", f"**Summary**: {r['summary']}", "", "**Details**:",
            f"- Priority: {r['priority_level']}", f"- Escalation score: {r['escalation_score']}", f"- Articles: {r['n']}", f"- Sources: {', '.join(r['sources'][:3])}{more}", "",
        ]
    return "\n".join([*out, "---", f"*Generated on {now:%Y-%m-%d %H:%M:%S} UTC*", f"*Total clusters analysed: {len(rows)}*"])


def render_error(error: str, now: datetime, name: str = "Daily Digest") -> str:
    return f"# {name}\n## {now:%B %d, %Y}\n\n**Error**: the digest could not be made\n\n**Details**: {error}"


def render_cluster(report: dict) -> str:
    """Markdown of one cluster: label, count, description, score, escalation, tag and entity counts, top articles."""
    out = [f"# Cluster report: {report['label']}", "", f"- Articles: {report['article_count']}", f"- Average score: {report.get('avg_confidence', 0):.2f}", f"- Escalation: {report.get('escalation_level', 'unknown')}", "", report.get("description") or "No description.", ""]
    for name in ("tags", "entities"):
        out += [f"## Top {name}", "", *[f"- {k}: {n}" for k, n in report.get(f"top_{name}", [])], ""]
    return "\n".join([*out, "## Articles", "", *[f"- {a}" for a in report.get("articles", [])]])
