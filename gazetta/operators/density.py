"""Clustering that the built-in library lacks: HDBSCAN on one batch, greedy assignment by topic, leader groups.

These are sequential or quadratic by nature. They serve bounded batches: group_in_pandas refuses a batch above its limit
and names the way for whole tables: `hierarchy.hdbscan` gives the labels of HDBSCAN, and assign_all_by_topic
assign_by_topic's result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType

from gazetta.functions import vectors as V
from gazetta.operators import relational as R
from gazetta.operators import search, setjoin
from gazetta.scratch import materialize

#: Rows of one batch at most.
MOST = 5_000
#: Topics that reach the driver, or are broadcast, at once.
TOPICS = 4_096


def hdbscan(points: np.ndarray, least: int = 2, samples: int = 1) -> np.ndarray:
    """Labels by HDBSCAN (Campello et al. 2013), Euclidean, excess of mass; -1 is noise. Clusters are numbered by their first row."""
    n = len(points)
    labels = np.full(n, -1)
    if n < max(2, least):
        return labels
    squares = (points * points).sum(1)
    d = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * points @ points.T, 0))
    core = np.sort(d, axis=1)[:, min(samples, n - 1)]
    reach = np.maximum(np.maximum(core[:, None], core[None, :]), d)
    np.fill_diagonal(reach, np.inf)
    # minimum spanning tree
    best, origin, inside = reach[0].copy(), np.zeros(n, int), np.zeros(n, bool)
    inside[0] = True
    edges = []
    for _ in range(n - 1):
        j = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((float(best[j]), int(origin[j]), j))
        inside[j] = True
        closer = ~inside & (reach[j] < best)
        best[closer], origin[closer] = reach[j][closer], j
    edges.sort()
    # single linkage tree: nodes n.. join two others at a distance
    parent = list(range(2 * n - 1))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    size, kids, height = [1] * n + [0] * (n - 1), {}, {}
    for k, (w, a, b) in enumerate(edges):
        a, b, node = top(a), top(b), n + k
        kids[node], height[node], size[node] = (a, b), w, size[a] + size[b]
        parent[a] = parent[b] = node

    def members(node: int) -> list[int]:
        stack, out = [node], []
        while stack:
            x = stack.pop()
            stack.extend(kids[x]) if x in kids else out.append(x)
        return out

    # condensed tree: a cluster lives from its birth until it splits into two of at least `least`
    clusters = [{"node": 2 * n - 2, "birth": 0.0, "mass": 0.0, "kids": []}]
    stack = [0]
    while stack:
        c = stack.pop()
        node, birth = clusters[c]["node"], clusters[c]["birth"]
        while node in kids:
            rate = 1 / height[node] if height[node] > 0 else 1e12
            a, b = kids[node]
            big = [x for x in (a, b) if size[x] >= least]
            if len(big) == 2:
                clusters[c]["mass"] += size[node] * (rate - birth)
                for x in (a, b):
                    clusters.append({"node": x, "birth": rate, "mass": 0.0, "kids": []})
                    clusters[c]["kids"].append(len(clusters) - 1)
                    stack.append(len(clusters) - 1)
                break
            left = size[node] - sum(size[x] for x in big)
            clusters[c]["mass"] += left * (rate - birth)
            if not big:
                break
            node = big[0]
        else:
            continue
    # excess of mass, the root never chosen
    chosen: set[int] = set()
    value: dict[int, float] = {}
    for c in range(len(clusters) - 1, -1, -1):
        below = sum(value[k] for k in clusters[c]["kids"])
        value[c] = max(clusters[c]["mass"], below)
        if c and (not clusters[c]["kids"] or clusters[c]["mass"] >= below):
            chosen.add(c)
    final, stack = [], list(clusters[0]["kids"])
    while stack:
        c = stack.pop()
        if c in chosen:
            final.append(c)
        else:
            stack.extend(clusters[c]["kids"])
    groups = sorted((sorted(members(clusters[c]["node"])) for c in final), key=lambda g: g[0])
    for label, group in enumerate(groups):
        labels[group] = label
    return labels


def group_in_pandas(df: DataFrame, fn, schema: str, most: int = MOST, batch: str | None = None) -> DataFrame:
    """fn over each batch as one pandas frame. A batch above the limit is an error, never a sample."""

    def checked(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most:
            raise ValueError(f"a batch of {len(pdf)} rows is above {most}; use hierarchy.hdbscan or assign_all_by_topic")
        return fn(pdf)

    return df.withColumn("__batch", F.col(batch) if batch else F.lit(0)).groupBy("__batch").applyInPandas(lambda pdf: checked(pdf.drop(columns="__batch")), schema)


def hdbscan_clusters(df: DataFrame, key: str, vector: str, least: int = 2, samples: int = 1, most: int = MOST, batch: str | None = None) -> DataFrame:
    """key, cluster by HDBSCAN on each batch; rows without a vector are left out. Labels are those of the batch, which is returned too if it is named."""
    kind = df.schema[key].dataType.simpleString()
    named = f", {batch} {df.schema[batch].dataType.simpleString()}" if batch else ""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        points = np.array(pdf[vector].tolist(), float)
        return pd.DataFrame({key: pdf[key].to_numpy(), "cluster": hdbscan(points, least, samples).astype("int32")} | ({batch: pdf[batch].to_numpy()} if batch else {}))

    some = df.where(F.size(vector) > 0).select(key, vector, *([batch] if batch else []))
    return group_in_pandas(some, fn, f"{key} {kind}, cluster int{named}", most, batch)


def word_set(text: str) -> frozenset[str]:
    return frozenset((text or "").lower().split())


def overlap(a: frozenset[str], b: frozenset[str]) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def topic_words(topics: list[str]) -> frozenset[str]:
    """Of a cluster's members' topics the five most frequent words (ties: the least), those over two characters."""
    counts = Counter(w for t in topics for w in (t or "").split())
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:5]
    return frozenset(w.lower() for w, _ in top if len(w) > 2)


def leader_groups(topics: list[str], least: float = 0.1) -> list[int]:
    """Each topic joins the most similar leader above least (the first of several), or becomes one; the leader's place is the group."""
    leaders: list[tuple[int, frozenset[str]]] = []
    out = []
    for i, topic in enumerate(topics):
        words = word_set(topic)
        scored = [(overlap(words, w), -k) for k, (_, w) in enumerate(leaders)]
        best = max(scored, default=(0.0, 0))
        if best[0] > least:
            out.append(leaders[-best[1]][0])
        else:
            leaders.append((i, words))
            out.append(i)
    return out


def assign_by_topic(df: DataFrame, key: str, vector: str, topic: str, cluster: str, neighbours: int = 15, small: int = 3, most: int = MOST, batch: str | None = None) -> DataFrame:
    """key, cluster: greedy assignment of unclustered rows in key order.

    A row's topic is compared with those of clusters (topic_words). Of the nearest rows (similarity 0.5 or more) in small
    clusters, 0.7 Jaccard + 0.3 similarity decides, if the Jaccard is above 0.1; else the first neighbour whose larger
    cluster is above 0.2. Leftovers form leader groups: those of three become clusters; others join the most similar
    small cluster above 0.1 (ties: the least), or stay alone. New clusters are numbered after the largest number in use.
    Clusters, their sizes and topics are those before the pass.
    """
    kind = df.schema[key].dataType.simpleString()

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        m = np.array(pdf[vector].tolist(), float)
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)
        words = [word_set(t) for t in pdf[topic]]
        start = [None if pd.isna(c) else int(c) for c in pdf[cluster]]
        count = pd.Series([c for c in start if c is not None], dtype="int64").value_counts().to_dict()
        about = {c: topic_words([t for t, x in zip(pdf[topic], start, strict=True) if x == c]) for c in count}
        now, free = list(start), max(count, default=0) + 1
        left = []
        for i, c in enumerate(start):
            if c is not None:
                continue
            scores = np.round(m @ m[i], 9)
            near = [j for j in np.lexsort((np.arange(len(m)), -scores)) if j != i][:neighbours]
            near = [j for j in near if scores[j] >= 0.5 and start[j] is not None]
            like = {c: overlap(words[i], about[c]) for c in {start[j] for j in near}}
            best = max(((0.7 * like[start[j]] + 0.3 * scores[j], -k, start[j]) for k, j in enumerate(near) if count[start[j]] < small), default=None)
            if best is not None and like[best[2]] > 0.1:
                now[i] = best[2]
            else:
                now[i] = next((start[j] for j in near if count[start[j]] >= small and like[start[j]] > 0.2), None)
            if now[i] is None:
                left.append(i)
        groups = leader_groups([pdf[topic][i] for i in left])
        by: dict[int, list[int]] = {}
        for i, g in zip(left, groups, strict=True):
            by.setdefault(g, []).append(i)
        for group in by.values():
            if len(group) >= small:
                for i in group:
                    now[i] = free
                free += 1
                continue
            for i in group:
                best = max(((round(overlap(words[i], about[c]), 9), -c) for c in count if count[c] < small), default=(0.0, 0))
                if best[0] > 0.1:
                    now[i] = -best[1]
                else:
                    now[i], free = free, free + 1
        return pd.DataFrame({key: pdf[key].to_numpy(), "cluster": np.array(now, "int64")})

    some = df.where(F.size(vector) > 0).select(key, vector, topic, cluster, *([batch] if batch else []))
    return group_in_pandas(some, fn, f"{key} {kind}, cluster long", most, batch)


class TopicIndex:
    """Word sets by their words: the overlap of one set with all of them at once."""

    def __init__(self, most: int):
        self.places: dict[str, list[int]] = {}
        self.sizes = np.zeros(most, "int64")
        self.n = 0

    def add(self, words: list[str]) -> None:
        for w in words:
            self.places.setdefault(w, []).append(self.n)
        self.sizes[self.n] = len(words)
        self.n += 1

    def best(self, words: list[str], first: int) -> tuple[float, int]:
        """The largest overlap with the first so many sets, and the first place that has it."""
        found = [k for w in words for k in self.places.get(w, ()) if k < first]
        if not found:
            return 0.0, 0
        shared = np.bincount(found, minlength=first)
        scores = shared / (len(words) + self.sizes[:first] - shared)
        at = int(np.argmax(scores))
        return float(scores[at]), at


def _against(rows: DataFrame, key: str, block: list[tuple], least: float) -> DataFrame:
    """rows (key, words, leader, score) with the block's most similar topic as leader, if it is above least and score.

    The block is in key order; each of its topics leads itself and serves later rows only.
    """
    schema = to_arrow_schema(rows.schema)
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [k for k, _ in sent.value]
        index = TopicIndex(len(names))
        for _, words in sent.value:
            index.add(words)
        for b in batches:
            out = []
            for k, words, leader, score in zip(*(c.to_pylist() for c in b.columns), strict=True):
                first = bisect_left(names, k)
                if first < len(names) and names[first] == k:
                    leader, score = k, 1.0
                else:
                    new, at = index.best(words, first)
                    if new > max(least, score):
                        leader, score = names[at], new
                out.append((leader, score))
            leaders, scores = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(schema.types[0]), b.column(1).cast(schema.types[1]), pa.array(leaders, schema.types[2]), pa.array(scores, schema.types[3])], schema=schema)

    return rows.mapInArrow(run, rows.schema)


def all_leader_groups(rows: DataFrame, key: str, least: float = 0.1, block: int = TOPICS) -> DataFrame:
    """leader_groups in key order over rows (key, words): adds leader, the key of the group's first row.

    The first open rows come to the driver, a block at a time; those unlike all before them in the block are leaders, as
    rows like an earlier leader are no longer open. Every row then meets the new leaders.
    """
    kind = rows.schema[key].dataType
    state = materialize(rows.select(key, "words", F.lit(None).cast(kind).alias("leader"), F.lit(0.0).alias("score")))
    while True:
        first = state.where("leader is null").orderBy(key).limit(block).select(key, "words").collect()
        index, leaders = TopicIndex(len(first)), []
        for k, words in first:
            if index.best(words, index.n)[0] <= least:
                index.add(words)
                leaders.append((k, words))
        if leaders:
            state = materialize(_against(state, key, leaders, least))
        if len(first) < block:
            return state.drop("score")


@F.pandas_udf(ArrayType(StringType()))
def topic_list(topics: pd.Series) -> pd.Series:
    """The words of a topic as they stand."""
    return topics.map(lambda t: (t or "").split())


@F.pandas_udf(ArrayType(StringType()))
def lower_set(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: sorted({w.lower() for w in ws}))


def topic_rows(df: DataFrame, key: str, vector: str, topic: str, cluster: str, size: int) -> DataFrame:
    """key, v, said (the topic's words), words (their lower-case set) and cluster of rows whose vector has size elements, none null."""
    good = V.valid(F.col(vector), size) & ~F.exists(vector, lambda x: x.isNull())
    rows = df.where(good).select(F.col(key).alias("key"), F.col(vector).alias("v"), topic_list(F.col(topic)).alias("said"), F.col(cluster).cast("long").alias("cluster"))
    return rows.withColumn("words", lower_set("said"))


def cluster_words(rows: DataFrame, small: int) -> DataFrame:
    """cluster, about (topic_words of its members) and few: fewer members than small."""
    held = rows.where("cluster is not null")
    top = R.top_values(held, ["cluster"], F.col("said"), 5).where(F.length("value") > 2).groupBy("cluster").agg(F.collect_list("value").alias("about"))
    sizes = held.groupBy("cluster").agg((F.count("*") < small).alias("few"))
    out = sizes.join(top, "cluster", "left").select("cluster", F.coalesce("about", F.array().cast("array<string>")).alias("about"), "few")
    return out.withColumn("about", lower_set("about"))


def by_neighbours(rows: DataFrame, groups: DataFrame, size: int, neighbours: int = 15, least: float = 0.5, block: int = search.BLOCK) -> DataFrame:
    """key and new: the cluster that an unclustered row's nearest rows suggest, if any does. rows of topic_rows, groups of cluster_words."""
    free = rows.where("cluster is null")
    near = search.nearest(rows, free, neighbours, "key", "v", size, digits=9, block=block).where(F.col("similarity") >= least)
    held = rows.where("cluster is not null").select(F.col("key").alias("neighbour_id"), "cluster").join(groups, "cluster")
    pairs = near.join(held, "neighbour_id").join(free.select(F.col("key").alias("query_id"), F.col("words").alias("a")), "query_id")
    b = F.col("about")
    overlaps = F.when((F.size("a") > 0) & (F.size(b) > 0), F.size(F.array_intersect("a", b)) / F.size(F.array_union("a", b))).otherwise(0.0)
    pairs = pairs.withColumn("o", overlaps).withColumn("s", 0.7 * F.col("o") + 0.3 * F.col("similarity"))
    best = pairs.groupBy("query_id").agg(
        F.max(F.when(F.col("few"), F.struct("s", -F.col("rank"), "o", "cluster"))).alias("x"), F.min(F.when(~F.col("few") & (F.col("o") > 0.2), F.struct("rank", "cluster"))).alias("y")
    )
    joined = best.select(F.col("query_id").alias("key"), F.when(F.col("x.o") > 0.1, F.col("x.cluster")).otherwise(F.col("y.cluster")).alias("new"))
    return joined.where("new is not null")


def assign_all_by_topic(df: DataFrame, key: str, vector: str, topic: str, cluster: str, size: int, neighbours: int = 15, small: int = 3, block: int = TOPICS) -> DataFrame:
    """key, cluster: assign_by_topic over all rows as one batch, without a limit. key is unique and not null.

    Neighbours are searched among all rows, clusters' sizes and topics come from all rows, and leftovers are grouped over all
    rows; new clusters have numbers of their own in the whole table. Vectors of another size or with nulls are left out.
    """
    rows = materialize(topic_rows(df, key, vector, topic, cluster, size))
    groups = materialize(cluster_words(rows, small))
    free = rows.where("cluster is null")

    # first pass: the neighbours' clusters
    joined = materialize(by_neighbours(rows, groups, size, neighbours, block=block))

    # second pass: groups of leftovers, and small clusters for rows of groups that are too small
    led = all_leader_groups(free.join(joined, "key", "left_anti").select("key", "words"), "key", 0.1, block)
    alone = led.groupBy("leader").agg(F.count("*").alias("n")).where(F.col("n") < small).select("leader", F.lit(True).alias("alone"))
    led = materialize(led.join(alone, "leader", "left").select("key", "words", "leader", F.coalesce("alone", F.lit(False)).alias("alone")))
    texts = led.where("alone").select("key", F.concat_ws(" ", "words").alias("t"))
    options = groups.where("few").select("cluster", F.concat_ws(" ", "about").alias("u"))
    taken = materialize(setjoin.best_matches(texts, options, "key", "t", "cluster", "u", 0.1).select("key", F.col("cluster").alias("new")))

    # numbers of new clusters: groups in the order of their leaders, and the rows that stay alone in theirs
    new = led.join(taken, "key", "left_anti").select("key", "leader", "alone")
    units = materialize(new.where("alone or key = leader").select("key", "leader"))
    last = rows.agg(F.coalesce(F.max("cluster"), F.lit(0))).first()[0]
    numbers = R.batches(units, [F.col("leader"), F.col("key")], 1).select(F.col("key").alias("unit"), (F.col("batch") + last + 1).alias("new"))
    made = new.withColumn("unit", F.when(F.col("alone"), F.col("key")).otherwise(F.col("leader"))).join(numbers, "unit").select("key", "new")
    found = joined.unionByName(taken).unionByName(made)
    return rows.select("key", "cluster").join(found, "key", "left").select(F.col("key").alias(key), F.coalesce("cluster", "new").alias("cluster"))
