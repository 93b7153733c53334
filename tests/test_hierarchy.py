"""HDBSCAN of a whole table, neighbours by blocks, the stored index and the set join, each against a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazetta.operators import blocks as B
from gazetta.operators import density
from gazetta.operators import hierarchy as H
from gazetta.operators import search
from gazetta.plans import queries


def plain_hdbscan(points, least, samples):
    """By thresholds: components of the graph of pairs within each reachability, all merges of one length at once."""
    n = len(points)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, min(samples, n - 1)]
    w = np.maximum(np.maximum(core[:, None], core[None]), d)
    parts = [(frozenset([i]), None) for i in range(n)]
    clusters = []  # [members who left, rates, kids]
    for t in sorted({w[i, j] for i in range(n) for j in range(i)}):
        label = list(range(n))
        for i in range(n):
            for j in range(i):
                if w[i, j] <= t and label[i] != label[j]:
                    old = label[i]
                    label = [label[j] if x == old else x for x in label]
        new = []
        for name in dict.fromkeys(label):
            members = frozenset(i for i in range(n) if label[i] == name)
            inside = [(p, c) for p, c in parts if p <= members]
            if len(inside) == 1:
                new.append(inside[0])
                continue
            rate = 1 / t if t > 0 else 1e12
            kids = [c for _, c in inside if c is not None]
            rest = [i for p, c in inside if c is None for i in p]
            if len(kids) == 1:
                c = kids[0]
                clusters[c]["left"] += [(i, rate) for i in rest]
            elif kids or len(rest) >= least:
                c = len(clusters)
                clusters.append({"left": [(i, rate) for i in rest], "split": rate, "kids": kids, "own": sorted(members)})
                for k in kids:
                    clusters[k]["birth"] = rate
            else:
                c = None
            if c is not None:
                clusters[c]["own"] = sorted(members)
            new.append((members, c))
        parts = new
    worth, chosen = [0.0] * len(clusters), set()
    for c, x in enumerate(clusters):
        if "birth" not in x:
            continue
        inner = sum(len(clusters[k]["own"]) for k in x["kids"])
        mass = inner * (x["split"] - x["birth"]) + sum(r - x["birth"] for _, r in x["left"])
        below = sum(worth[k] for k in x["kids"])
        worth[c] = max(mass, below)
        if not x["kids"] or mass >= below - 1e-9 * abs(mass):
            chosen.add(c)
    groups, stack = [], [k for x in clusters if "birth" not in x for k in x["kids"]]
    while stack:
        c = stack.pop()
        if c in chosen:
            groups.append(clusters[c]["own"])
        else:
            stack += clusters[c]["kids"]
    labels = [-1] * n
    for i, g in enumerate(sorted(groups)):
        for m in g:
            labels[m] = i
    return labels


def blobs(rng, n, dim):
    return np.concatenate([rng.normal(4 * i, 0.3 + i / 4, (n // 3, dim)) for i in range(3)] + [rng.uniform(-5, 15, (n - 3 * (n // 3), dim))])


def frame(spark, points):
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>").repartition(4)


def labels_of(df):
    rows = sorted((r.id, r.cluster) for r in df.collect())
    return [c for _, c in rows]


@pytest.mark.parametrize("least,samples,block,band", [(2, 1, 2048, 500_000), (2, 1, 15, 500_000), (3, 2, 15, 9), (5, 3, 2048, 9)])
def test_whole_table_against_thresholds(spark, least, samples, block, band):
    rng = np.random.default_rng(least + block)
    points = blobs(rng, 44, 2)
    points[40] = points[3]  # a copy
    if band > 9:
        assert labels_of(H.hdbscan(frame(spark, points), "id", "v", 2, least, samples, block, band)) == plain_hdbscan(points, least, samples)
        return
    # ties that a band divides are merged in order: without them the bands change nothing
    points = rng.normal(size=(40, 3))
    whole = H.hdbscan(frame(spark, points), "id", "v", 3, least, 1, block, 500_000)
    assert labels_of(H.hdbscan(frame(spark, points), "id", "v", 3, least, 1, block, band)) == labels_of(whole) == plain_hdbscan(points, least, 1)


def test_5000_rows_are_those_of_the_batch_algorithm(spark):
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.normal(rng.normal(0, 6, 8), 0.7, (200, 8)) for _ in range(20)] + [rng.normal(0, 8, (1000, 8))])
    assert labels_of(H.hdbscan(frame(spark, points), "id", "v", 8, 5, 1, block=1300)) == list(density.hdbscan(points, 5, 1))


def test_the_tree_is_the_shortest(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(90, 3))
    rows = frame(spark, points).select(F.col("id").alias("k"), "v")
    cored = H.core_distances(rows, 3, 4, 20)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    core = {r.k: r.core for r in cored.collect()}
    assert np.allclose([core[i] for i in range(90)], np.sort(d, 1)[:, 4])
    edges, blocks = H.cell_trees(cored, 3, 20)
    assert blocks == 5
    tree = H.spanning_tree(edges).collect()
    assert len(tree) == 89 and len({(r.a, r.b) for r in tree}) == 89
    one = H.tree_of(list(range(90)), points, np.sort(d, 1)[:, 4])
    assert np.allclose(sorted(r.w for r in tree), sorted(one[2]))


@pytest.mark.parametrize("kind", ["normal", "copies", "lattice", "far", "near"])
def test_forests_are_those_of_exact_lengths(kind):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(120, 6))
    if kind == "copies":
        points[40:90] = points[3]
    if kind == "lattice":
        points = rng.integers(0, 3, (120, 6)).astype(float)
    if kind == "far":
        points = points * 1e-4 + 1000
    if kind == "near":
        points[60:] = points[:60] + rng.normal(size=(60, 6)) * 1e-9
    keys, left, none = rng.permutation(120).tolist(), rng.random(120) < 0.4, np.zeros(120)
    for core in (none, rng.random(120) * 3):
        for side in (None, left):
            d = np.stack([np.maximum(np.maximum(B.distances(points, p), core), c) for p, c in zip(points, core, strict=True)])
            pairs = [(d[i, j], *sorted((keys[i], keys[j]))) for i in range(120) for j in range(i) if side is None or side[i] != side[j]]
            up, want = list(range(120)), []
            for w, a, b in sorted(pairs):
                x, y = a, b
                while up[x] != x:
                    x = up[x]
                while up[y] != y:
                    y = up[y]
                if x != y:
                    up[x] = y
                    want.append((a, b, w))
            assert sorted(zip(*H.forest_of(keys, points, core, side), strict=True)) == sorted(want)


def test_cells_of_one_blocks_rows_and_of_two(spark):
    """Every pair is in one cell, so no edge comes twice, and a row is not measured against its block in each cell."""
    points = np.random.default_rng(6).normal(size=(90, 3))
    edges, blocks = H.cell_trees(frame(spark, points).select(F.col("id").alias("k"), "v", F.lit(0.0).alias("core")), 3, 20)
    rows = edges.collect()
    assert blocks == 5 and len({(r.a, r.b) for r in rows}) == len(rows)


def test_cells_give_only_edges_between_their_blocks(spark):
    """Of two blocks' rows the edges within a block are known, and were once given by each cell again."""
    points = np.random.default_rng(6).normal(size=(90, 3))
    edges, blocks = H.cell_trees(frame(spark, points).select(F.col("id").alias("k"), "v", F.lit(0.0).alias("core")), 3, 20)
    assert blocks == 5 and edges.count() < 90 + (blocks - 1) * 90 // 2 + 45


def tree_lengths(points, core):
    return np.sort(H.tree_of(list(range(len(points))), points, core)[2])


@pytest.mark.parametrize("kind", ["normal", "copies", "lattice", "far", "near", "clusters", "one"])
def test_block_trees_are_the_shortest(kind, monkeypatch):
    monkeypatch.setattr(H, "LEAF", 20)
    monkeypatch.setattr(H, "TILE", (16, 24))
    rng = np.random.default_rng(4)
    points = rng.normal(size=(230, 6))
    if kind == "copies":
        points[40:190] = points[3]
    if kind == "lattice":
        points = rng.integers(0, 3, (230, 6)).astype(float)
    if kind == "far":
        points = points * 1e-4 + 1000
    if kind == "near":
        points[115:] = points[:115] + rng.normal(size=(115, 6)) * 1e-9
    if kind == "clusters":
        points = points * 0.01 + rng.normal(size=(5, 6))[rng.integers(0, 5, 230)]
    if kind == "one":
        points[:] = 1.0
    for core in (np.zeros(230), rng.random(230) * 3):
        a, b, w, line, gaps = H.block_tree(points, core)
        assert np.array_equal(np.sort(w), tree_lengths(points, core))
        for i in range(229):
            assert w[i] == max(np.linalg.norm(points[a[i]] - points[b[i]]), core[a[i]], core[b[i]]) or np.isclose(w[i], max(np.linalg.norm(points[a[i]] - points[b[i]]), core[a[i]], core[b[i]]))
        # any two rows are joined at the greatest gap between them
        place, reach = np.argsort(line), np.full((230, 230), np.inf)
        np.fill_diagonal(reach, 0)
        groups = {i: [i] for i in range(230)}
        of = list(range(230))
        for k in np.argsort(w, kind="stable"):
            x, y = of[a[k]], of[b[k]]
            reach[np.ix_(groups[x], groups[y])] = reach[np.ix_(groups[y], groups[x])] = w[k]
            for i in groups[y]:
                of[i] = x
            groups[x] += groups.pop(y)
        for i in range(0, 230, 7):
            assert np.array_equal(H.reach_of(gaps, place[i], place[i])[place], reach[i])
        assert (H.reach_of(gaps, 50, 65) >= reach[line[50:66]][:, line].max(0)).all()


def test_few_pairs_are_measured(monkeypatch):
    points = np.random.default_rng(3).normal(size=(4000, 16))
    measured = []
    plain = B.distances
    sides = [H.block_tree(x, np.zeros(2000)) for x in (points[:2000], points[2000:])]
    monkeypatch.setattr(B, "distances", lambda m, p: measured.append(len(m)) or plain(m, p))
    H.joined(points, np.zeros(4000), 2000, *[np.concatenate([sides[0][i], sides[1][i] + 2000 * (i < 2)]) for i in range(3)])
    assert sum(measured) < 4000 * 40  # of four million


def test_rows_that_are_not_finite_are_noise(spark):
    points = np.random.default_rng(9).normal(size=(60, 3))
    want = labels_of(H.hdbscan(frame(spark, points), "id", "v", 3, 2, 1, 15))
    odd = np.concatenate([points, [[np.nan, 0, 0], [np.inf, 1, 1], [np.nan, 0, 0]]])
    assert labels_of(H.hdbscan(frame(spark, odd), "id", "v", 3, 2, 1, 15)) == [*want, -1, -1, -1]
    assert set(labels_of(H.hdbscan(frame(spark, odd[60:]), "id", "v", 3))) == {-1}


def test_trees_and_choices_in_one_task_or_by_rounds(spark):
    rng = np.random.default_rng(12)
    edges = {(int(a), int(b)): float(w) for a, b, w in zip(*np.sort(rng.integers(0, 60, (2, 400)), 0), rng.integers(0, 40, 400)) if a < b}
    df = spark.createDataFrame([(*e, w) for e, w in edges.items()], "a long, b long, w double")
    one, many, some = (sorted(tuple(r) for r in H.spanning_tree(df, band).collect()) for band in (1000, 0, 40))
    assert one == many == some and len(one) == len({x for e in edges for x in e}) - 1
    above = [(c, c + int(rng.integers(1, 9)) if c < 90 else None, bool(rng.random() < 0.3)) for c in range(91)]
    above = [(c, min(up, 90) if up is not None else None, ok) for c, up, ok in above]
    clusters = spark.createDataFrame(above, "c long, above long, chosen boolean")
    assert sorted(map(tuple, H.chosen_above(clusters, 1000).collect())) == sorted(map(tuple, H.chosen_above(clusters, 0).collect()))


def test_few_and_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert [tuple(r) for r in H.hdbscan(df, "id", "v", 2).collect()] == [(1, -1)]
    assert H.hdbscan(df.limit(0), "id", "v", 2).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)] + [(9, [5.0, 5.0])], "id long, v array<double>")
    assert {r.cluster for r in H.hdbscan(same, "id", "v", 2).collect()} == {-1}


def test_query_covers_all_vectors(spark, small):
    rows = {r.vec_id: r.cluster for r in queries.QUERIES["hdbscan_clusters"](spark, small).collect()}
    stored = queries.vectors(spark, small).orderBy("vec_id").collect()
    want = density.hdbscan(np.array([r.embedding for r in stored], float), 2, 1)
    assert rows == {r.vec_id: int(c) for r, c in zip(stored, want, strict=True)}


def test_clusters_are_written_back(spark, small, tmp_path):
    from gazetta.plans import pipeline
    from gazetta.sources import store

    rows = queries.titled(spark, small).join(queries.vectors(spark, small), F.col("doc_id") == F.col("vec_id")).select("doc_id", "title", "embedding")
    folder = f"file://{tmp_path}/tables"
    articles = f"{folder}/articles_processed"
    store.merge(spark, articles, rows.select("doc_id", F.lit(None).cast("string").alias("cluster_id")), "doc_id")
    for _ in range(2):
        done = pipeline.density_run(spark, rows, folder, "doc_id", "embedding", "title", queries.SIZE)
        stored = spark.read.parquet(store.versions(spark, f"{folder}/clusters")[-1]).collect()
        assert done["clusters_created"] == len(stored) > 0 and done["articles_processed"] == rows.count()
    held = {r.doc_id: r.cluster_id for r in spark.read.parquet(store.versions(spark, articles)[-1]).collect()}
    assert len(held) == rows.count()
    vectors = {r.doc_id: (r.title, r.embedding) for r in rows.collect()}
    for c in stored:
        own = sorted(i for i, x in held.items() if x == c.id)
        assert len(own) == c.member_count >= 2 and c.representative_article_id == own[0] and c.status == "pending"
        assert np.allclose(c.center_embedding, np.mean([vectors[i][1] for i in own], 0))
        assert c.description == f"Cluster of {len(own)} articles. Representative: {vectors[own[0]][0][:100]}..."


def test_run_by_topics(spark, small, tmp_path):
    from gazetta.plans import pipeline
    from gazetta.sources import store
    from gazetta.sources.vectorindex import VectorIndex

    folder = f"file://{tmp_path}/run"
    rows = queries.topic_articles(spark, small).withColumn("cluster", F.when(F.col("vec_id") % 4 > 0, F.col("label").cast("long"))).select("vec_id", "embedding", "topic", "cluster")
    want = {r.vec_id: r.cluster for r in density.assign_by_topic(rows, "vec_id", "embedding", "topic", "cluster").collect()}
    for _ in range(2):
        report = pipeline.topic_run(spark, rows, folder, "vec_id", "embedding", "topic", "cluster", queries.SIZE)
    free = {r.vec_id for r in rows.where("cluster is null").collect()}
    assert report["status"] == "success" and report["total_articles"] == len(want) and report["assigned"] == len(free) > 20
    assert report["before"]["unclustered"] == len(free) and report["after"]["unclustered"] == 0 and report["after"]["n_clusters"] == len(set(want.values()))
    stored = {r.vec_id: r.cluster_id for r in spark.read.parquet(store.versions(spark, f"{folder}/articles_processed")[-1]).collect()}
    assert stored == {i: f"cluster_{want[i]}" for i in free}
    sizes = {r.cluster_id: r.member_count for r in spark.read.parquet(store.versions(spark, f"{folder}/clusters")[-1]).collect()}
    assert sizes == {f"cluster_{c}": list(want.values()).count(c) for c in set(want.values())}
    assert VectorIndex.load(spark, f"{folder}/index").stats()["total_vectors"] == len(want)
    assert pipeline.topic_run(spark, rows.limit(0), folder, "vec_id", "embedding", "topic", "cluster", queries.SIZE)["status"] == "no_articles"


def test_summaries_scan_twice(spark, small):
    df = queries.QUERIES["cluster_summaries"](spark, small)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") <= 2 and plan.count("Exchange hashpartitioning") <= 4


def test_neighbours_by_blocks(spark):
    rng = np.random.default_rng(4)
    m = np.round(rng.normal(size=(60, 4)), 1)
    m[7] = m[8] = m[9]
    m[11] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(70, None), (71, [1.0]), (72, [None] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    u = np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)
    want = set()
    for i in range(0, 60, 3):
        near = sorted(((-round(float(u[i] @ u[j]), 6) + 0.0, j) for j in range(60) if j != i))[:5]
        want |= {(i, j, k + 1) for k, (_, j) in enumerate(near)}
    for block in (7, 4096):
        got = search.nearest(df, df.where("vec_id % 3 = 0"), 5, size=4, block=block)
        assert {(r.query_id, r.neighbour_id, r["rank"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert search.nearest(df.limit(0), df, 5, size=4).count() == 0


# --- the stored index


def scanned(rows, query, k):
    """The k nearest of all rows by a scan."""
    q = np.array(query) / max(np.linalg.norm(query), 1e-300)
    out = []
    for i, v in rows:
        n = np.linalg.norm(v)
        s = float(np.dot(v, q) / n) if n > 0 else 0.0
        out.append((-round(max(0, min(1, (s + 1) / 2)), 4), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


def test_index_is_the_scan_and_reads_less(spark, tmp_path):
    from gazetta.sources import vectorindex as X

    rng = np.random.default_rng(6)
    centers = rng.normal(size=(12, 6)) * 4
    rows = [(i, (centers[i % 12] + rng.normal(0, 0.4, 6)).tolist()) for i in range(600)]
    rows[5] = (5, [0.0] * 6)
    rows[9] = (9, rows[21][1])
    bad = [(1000, None), (1001, [1.0]), (1002, [None] * 6), (1003, [float("nan")] * 6)]
    schema = "id long, v array<double>"
    path = f"file://{tmp_path}/index"
    index = X.VectorIndex.create(spark, path, spark.createDataFrame(rows[:300] + bad, schema).repartition(3), "id", "v", 6, cells=12)
    assert index.stats() == {"total_vectors": 300, "dimension": 6, "insert_count": 0, "rejected": 4}

    def check(held, loaded):
        fewest = 99
        for q in [centers[3], centers[7] + 1, rng.normal(size=6), -centers[1], np.zeros(6)]:
            got = [(r.id, r.similarity) for r in loaded.search(q.tolist(), 7).orderBy(F.desc("similarity"), "id").collect()]
            assert got == scanned(held, q, 7)
            fewest = min(fewest, loaded.read["cells"])
            assert loaded.read["cells"] <= loaded.read["of_cells"] <= 13
        assert fewest <= 3

    check(rows[:300], index)
    assert index.add(spark.createDataFrame(rows[300:340] + bad[:2], schema)) == 40
    check(rows[:340], X.VectorIndex.load(spark, path))
    assert index.state["new"] and index.stats()["total_vectors"] == 340
    index.add(spark.createDataFrame(rows[340:600], schema))
    again = X.VectorIndex.load(spark, path)
    assert not again.state["new"] and again.stats() == {"total_vectors": 600, "dimension": 6, "insert_count": 300, "rejected": 6}
    check(rows, again)
    assert again.search([1.0] * 5).count() == 0 and len(again.search([1.0] * 6, 1000).collect()) == 600
    again.clear()
    empty = X.VectorIndex.load(spark, path)
    assert empty.search([1.0] * 6).count() == 0 and empty.stats()["total_vectors"] == 0
    empty.add(spark.createDataFrame(rows[:5], schema))
    assert [(r.id, r.similarity) for r in X.VectorIndex.load(spark, path).search(rows[0][1], 2).collect()] == scanned(rows[:5], rows[0][1], 2)
    with pytest.raises(FileNotFoundError):
        X.VectorIndex.load(spark, f"{path}-other")


def test_empty_index(spark, tmp_path):
    from gazetta.sources import vectorindex as X

    index = X.VectorIndex.create(spark, f"file://{tmp_path}/index", spark.createDataFrame([], "id long, v array<double>"), "id", "v", 3)
    assert index.search([1.0, 0.0, 0.0]).count() == 0
    index.add(spark.createDataFrame([(1, [2.0, 0.0, 0.0])], "id long, v array<double>"))
    assert [tuple(r) for r in index.search([1.0, 0.0, 0.0]).collect()] == [(1, 1.0)]


# --- the set join


def plain_best(rows, topics, least):
    def words(t):
        return {w for w in (t or "").lower().split() if w}

    out = {}
    for i, t in rows:
        scored = [(-round(len(words(t) & words(u)) / len(words(t) | words(u)), 9), j) for j, u in topics if words(t) & words(u)]
        scored = [x for x in scored if -x[0] > least]
        if scored:
            out[i] = (min(scored)[1], -min(scored)[0])
    return out


@pytest.mark.parametrize("least", [0.05, 0.1, 0.4, 0.7])
def test_best_matches_are_those_of_all_pairs(spark, least):
    from gazetta.operators import setjoin

    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    weights = 1 / np.arange(1, 61)
    weights /= weights.sum()

    def some(n):
        return [(i, " ".join(rng.choice(words, int(rng.integers(0, 12)), p=weights))) for i in range(n)]

    rows, topics = some(250) + [(900, None), (901, " The  the\tEND ")], some(60) + [(70, None), (71, "the end")]
    rows += [(1000 + i, rows[3][1]) for i in range(50)]
    a, b = spark.createDataFrame(rows, "id long, t string").repartition(3), spark.createDataFrame(topics, "topic long, u string")
    got = {r.id: (r.topic, r.jaccard) for r in setjoin.best_matches(a, b, "id", "t", "topic", "u", least).collect()}
    assert got == plain_best(rows, topics, least)


def test_common_words_make_few_candidates(spark):
    from gazetta.operators import setjoin

    rows = [(i, " ".join(["the", "of", "and", *(f"r{i}_{k}" for k in range(7))])) for i in range(300)]
    topics = [(i, " ".join(["the", "of", "and", *(f"r{i}_{k}" for k in range(7))])) for i in range(300)]
    a, b = spark.createDataFrame(rows, "id long, t string"), spark.createDataFrame(topics, "topic long, u string")
    words = a.select(setjoin.word_list(F.col("t")).alias("w"))
    frequent = setjoin.frequent_words(words, 3)
    assert set(frequent) == {"the", "of", "and"}
    left, right = setjoin.sorted_sets(a, "t", frequent).withColumn("t", F.lit(0.5)), setjoin.sorted_sets(b, "u", frequent)
    assert setjoin.candidates(left, right, 0.5).count() == 300
    # 90,000 pairs share the common words
    assert {r.id: r.topic for r in setjoin.best_matches(a, b, "id", "t", "topic", "u", 0.1).collect()} == {i: i for i in range(300)}
