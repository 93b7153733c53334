import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gazetta.functions import text
from gazetta.functions import vectors as V
from gazetta.operators import clusters as C
from gazetta.operators import density, models, search, tagging
from gazetta.operators import relational as R
from gazetta.plans import pipeline, queries, reports


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.unit(F.col("a")).alias("u"), V.distance(F.col("a"), F.col("b")).alias("d"), V.rescaled(F.lit(0.5)).alias("r")).collect()
    assert [round(r.c, 9) for r in rows] == [0.96, 0.0]
    assert rows[0].u == [0.6, 0.8] and rows[1].u == [0.0, 0.0]
    assert round(rows[0].d, 9) == round(2**0.5, 9) and rows[0].r == 0.75


def test_blend_is_unit_and_keeps_text_without_parts(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], None)], "t array<double>, g array<double>, e array<double>")
    v = df.select(V.blend(F.col("t"), F.col("g"), F.col("e"))).first()[0]
    assert np.allclose(v, np.array([0.7, 0.3]) / np.hypot(0.7, 0.3))


def test_valid_and_jaccard(spark):
    df = spark.createDataFrame([([1.0], "a b c", "B c d"), (None, "", "x"), ([1.0, 2.0], None, None)], "v array<float>, s string, t string")
    rows = df.select(V.valid(F.col("v"), 1).alias("v"), V.jaccard(F.col("s"), F.col("t")).alias("j")).collect()
    assert [r.v for r in rows] == [True, False, False] and [r.j for r in rows] == [0.5, 0.0, 0.0]


def test_optimal_clusters(spark):
    df = spark.createDataFrame([(n,) for n in (5, 9, 10, 200, 1000, 5000)], "n long").coalesce(1)
    assert [r[0] for r in df.select(V.optimal_clusters(F.col("n"))).collect()] == [5, 8, 10, 20, 100, 150]


def test_upsert(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "k int, x string, y int")
    patch = spark.createDataFrame([(1, None, 5), (3, "c", None)], "k int, x string, y int").withColumn("extra", F.lit(1))
    once = R.upsert(stored, patch, "k")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 5), (2, "b", None), (3, "c", None)]
    assert sorted(map(tuple, R.upsert(once, patch, "k").collect())) == sorted(map(tuple, once.collect()))


def test_unprocessed_has_older_rows(spark):
    articles = spark.createDataFrame([(i, i) for i in range(10)], "id int, t int")
    done = spark.createDataFrame([(i,) for i in range(5, 10)], "id int")
    assert [r.id for r in R.unprocessed(articles, done, "id", [F.desc("t")], 3).collect()] == [4, 3, 2]


def test_modal_and_top_values(spark):
    df = spark.createDataFrame([(1, "b", ["x", "y"]), (1, "a", ["y"]), (2, None, None), (2, None, ["z"])], "g int, v string, l array<string>")
    assert {r.g: r.v for r in R.modal_value(df, ["g"], "v").collect()} == {1: "a", 2: "Unknown"}
    top = R.top_values(df, ["g"], F.col("l"), 1).collect()
    assert {(r.g, r.value, r.n) for r in top} == {(1, "y", 2), (2, "z", 1)}


def test_batches(spark):
    df = spark.range(0, 1050).repartition(7)
    got = {r.id: r.batch for r in R.batches(df, [F.col("id")], 100).collect()}
    assert got == {i: i // 100 for i in range(1050)}


def test_ingest_limits(spark):
    rows = [("title", "x" * 50), ("titl", "x" * 50), ("title", " " + "x" * 49 + " "), (None, None)]
    good, bad = pipeline.ingest(spark.createDataFrame(rows, "title string, content string"))
    assert good.count() == 1
    assert sorted(r.reason for r in bad.collect()) == ["body too short", "body too short", "title too short"]


def test_centroids_medoids(spark):
    df = spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 0, [2.0, 0.0]), (3, 0, [1.0, 0.1]), (4, 1, [5.0, 5.0]), (5, 1, None)], "id int, c int, v array<float>")
    centers = {r.c: r.center for r in C.centroids(df, "c", "v", 6).collect()}
    assert centers == {0: [1.0, 0.033333], 1: [5.0, 5.0]}
    assert {r.c: r.medoid for r in C.medoids(df.where("v is not null"), "c", "id", "v").collect()} == {0: 3, 1: 4}


def test_summary_text_and_routes(spark):
    df = spark.createDataFrame([("t", 3, ["a", "b", "c", "d"], ["x"]), ("", 2, [], [])], "t string, n int, e array<string>, g array<string>")
    got = [r[0] for r in df.select(C.summary_text(F.col("t"), F.col("n"), F.col("e"), F.col("g"))).collect()]
    assert got == ["Topic Cluster: t. Contains 3 articles. Key entities: a, b, c. Common tags: x.", "Cluster of 2 articles. "]
    routed = reports.route_summaries(df.select("n")).orderBy("n").collect()
    assert [(r.status, r.summary) for r in routed] == [("complete", reports.SINGLE), ("pending", None)]


def test_nearest_blocks_and_ties(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 8))
    m[7] = m[3]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(100, None), (101, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = df.where("vec_id % 5 = 3")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = set()
    for q in range(3, 60, 5):
        s = np.round(unit @ unit[q], 6)
        order = sorted((j for j in range(60) if j != q), key=lambda j: (-s[j], j))[:4]
        want |= {(q, j, k) for k, j in enumerate(order, 1)}
    for block in (2, 4096):
        got = {(r.query_id, r.neighbour_id, r["rank"]) for r in search.nearest(df, queries, 4, size=8, block=block).collect()}
        assert got == want


def test_assign_in_blocks(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [-1.0, -1.0])], "id int, v array<double>")
    centers = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.7, 0.7])], "c int, center array<double>")
    for most in (100, 1):
        got = {r.id: r.c for r in C.assign_to_centers(rows, centers, "id", "c", "v", 0.9, most).collect()}
        assert got == {1: 0, 2: 1, 3: None}


def test_hdbscan_finds_blobs():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(0, 0.1, (15, 2)), rng.normal(5, 0.1, (15, 2)), [[50.0, 50.0]]])
    labels = density.hdbscan(points, 5, 2)
    assert set(labels[:15]) == {0} and set(labels[15:30]) == {1} and labels[30] == -1
    assert list(density.hdbscan(points[:1])) == [-1]


def test_hdbscan_names_the_batch_of_a_label(spark, small):
    vectors = queries.vectors(spark, small)
    rows = density.hdbscan_clusters(vectors.withColumn("batch", F.floor(F.col("vec_id") / 50)), "vec_id", "embedding", 2, 1, batch="batch").collect()
    assert len(rows) == vectors.count() and all(r.batch == r.vec_id // 50 for r in rows)
    assert len({r.batch for r in rows}) > 1


def test_leader_groups():
    assert density.leader_groups(["a b", "b c", "x y", "", "y"]) == [0, 0, 2, 3, 2]


@pytest.mark.parametrize("name", ["vector_normalize_whole", "vector_blend_whole", "embedding_decode_whole"])
def test_queries_return_whole_vectors(spark, small, name):
    rows = queries.QUERIES[name](spark, small).groupBy("vec_id").agg(F.count_distinct("pos").alias("n"), F.sum(F.col("x") * F.col("x")).alias("s"), F.max("pos").alias("last")).collect()
    assert len(rows) == queries.vectors(spark, small).count() and {(r.n, r["last"]) for r in rows} == {(64, 63)}
    if name != "embedding_decode_whole":
        assert all(abs(r.s - 1) < 1e-4 for r in rows if r.vec_id % 7 or name != "vector_normalize_whole")


def test_greedy_assignment(spark):
    rows = [(1, [1.0, 0.0], "navy ships", 1), (2, [0.9, 0.1], "navy ships sail", None), (3, [0.0, 1.0], "bank rates", None), (4, [0.0, 0.9], "bank rates up", None), (5, [0.1, 1.0], "bank rates down", None)]
    df = spark.createDataFrame(rows, "id int, v array<double>, t string, c long")
    got = {r.id: r.cluster for r in density.assign_by_topic(df, "id", "v", "t", "c").collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 2, 5: 2}


def test_assignment_of_a_whole_table(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    base = rng.normal(size=(12, 8))
    rows = []
    for i in range(120):
        v, t = base[i % 12] + rng.normal(0, 0.4, 8), " ".join(rng.choice(words, int(rng.integers(0, 7))))
        rows.append((i, v.tolist(), t, None if i % 2 else 50 + i // 6 if i % 4 else 7))
    df = spark.createDataFrame(rows, "id long, v array<double>, t string, c long")
    want = {r.id: r.cluster for r in density.assign_by_topic(df, "id", "v", "t", "c").collect()}
    for block in (3, 4096):
        got = density.assign_all_by_topic(df.repartition(5), "id", "v", "t", "c", 8, block=block).collect()
        assert len(got) == len(rows) and {r.id: r.cluster for r in got} == want


def test_topics_are_assigned_over_blocks_of_ids(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.topic_articles(spark, folder).withColumn("cluster", F.when(F.col("vec_id") % 4 > 0, F.col("label").cast("long")))
    want = {r.vec_id: r.cluster for r in density.assign_by_topic(rows, "vec_id", "embedding", "topic", "cluster").collect()}
    assert len(want) > 200 and {r.vec_id: r.cluster for r in queries.QUERIES["topic_assign_greedy"](spark, folder).collect()} == want


def test_topics_are_those_of_clusters(spark):
    """The nearest row's own topic is another, but its cluster's topic is like the new row's."""
    rows = [(1, [1.0, 0.0], "odd words", 7), (2, [0.0, 1.0], "navy ships", 7), (3, [0.0, 1.0], "navy ships", 7), (4, [0.9, 0.1], "navy ships", None), (5, [0.2, 1.0], "bank rates", None)]
    df = spark.createDataFrame(rows, "id int, v array<double>, t string, c long")
    # five words at most, and short ones take places too
    assert density.topic_words(["a navy b", "navy Ships", None, "an"]) == {"navy", "ships"} and density.topic_words(["a navy b", "navy ships", "an of"]) == {"navy"}
    want = {1: 7, 2: 7, 3: 7, 4: 7, 5: 8}
    assert {r.id: r.cluster for r in density.assign_by_topic(df, "id", "v", "t", "c").collect()} == want
    assert {r.id: r.cluster for r in density.assign_all_by_topic(df, "id", "v", "t", "c", 2).collect()} == want


def test_batch_limit_is_an_error(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "id int, v array<double>")
    with pytest.raises(Exception, match="above 3"):
        density.hdbscan_clusters(df, "id", "v", most=3).collect()


def test_tagging(spark):
    df = spark.createDataFrame([("The PLA and Taiwan", "talks on $5 missile deal in Beijing"), (None, None)], "title string, text string")
    a, b = sorted(tagging.tag_articles(df, "title", "text").collect(), key=lambda r: -len(r.tags))
    assert a.tags == ["ACT:pla", "EVT:talks", "GEO:beijing", "GEO:taiwan", "MONEY:$5", "QTY:5", "TECH:missile"]
    assert a.tag_categories["geo"] == ["beijing", "taiwan"] and a.region == "East Asia" and a.priority_level == "HIGH"
    assert a.topics == ["diplomatic", "military"] and b.tags == [] and b.topic == "General"


def test_tag_summary(spark):
    df = spark.createDataFrame([({"geo": ["a", "b", "c", "d"], "actor": []},), (None,)], "m map<string,array<string>>")
    assert [r[0] for r in df.select(tagging.tag_summary(F.col("m"))).collect()] == ["Geo: a, b, c...", "No tags identified"]


def test_models():
    e = models.HashEmbedder(16)
    assert e.one("a b") == e.one("a b") and abs(sum(x * x for x in e.one("a b")) - 1) < 1e-9 and e.one("") == [0.0] * 16
    assert models.LeadSummarizer().one("short") == "short"
    assert models.WordVote().one("der Hund und die Katze") == "de" and models.WordVote().one("qq") == "unknown"


def test_digest_render():
    from datetime import datetime

    now = datetime(2024, 1, 2, 3, 4, 5)
    rows = [dict(region="B", topic="t", theme="x", summary="s", priority_level="LOW", escalation_score=1, n=2, sources=["a", "b", "c", "d"])]
    text = reports.render_digest(rows, now)
    assert "## January 02, 2024" in text and "Sources: a, b, c..." in text and "## B" in text
    assert "No completed clusters" in reports.render_digest([], now)


def test_cluster_report_and_error_page():
    from datetime import datetime

    report = {"label": "Cluster_1", "article_count": 3, "avg_confidence": 0.5, "escalation_level": "high", "description": "About ships.", "top_tags": [("GEO:taiwan", 2)], "top_entities": [("navy", 1)], "articles": ["One", "Two"]}
    text = reports.render_cluster(report)
    assert text.startswith("# Cluster report: Cluster_1") and "- Articles: 3" in text and "- Average score: 0.50" in text and "- Escalation: high" in text
    assert "## Top tags\n\n- GEO:taiwan: 2" in text and "## Top entities\n\n- navy: 1" in text and text.endswith("- One\n- Two")
    assert "No description." in reports.render_cluster({"label": "x", "article_count": 0})
    page = reports.render_error("no table", datetime(2024, 1, 2))
    assert page.startswith("# Daily Digest\n## January 02, 2024") and "no table" in page


def test_seeded_embedder_and_wanted_categories(spark):
    e = models.SeededEmbedder(8)
    assert e.one("a") == e.one("a") != e.one("b") and len(e.one("")) == 8
    df = spark.createDataFrame([("a",), (None,)], "t string").select(models.embedding(F.col("t"), lambda: models.SeededEmbedder(8)).alias("v"))
    assert [r.v for r in df.collect()] == [e.one("a"), e.one("")]
    df = spark.createDataFrame([({"geo": ["a"], "actor": ["b"]},), (None,)], "m map<string,array<string>>")
    assert [r[0] for r in df.select(tagging.only_categories(F.col("m"), ["geo"])).collect()] == [{"geo": ["a"]}, None]


def test_scratch_tables_go(spark):
    from gazetta import scratch

    path = scratch.scratch_path(spark)
    spark.range(3).write.parquet(path)
    fs, at = scratch.file_system(spark, path)
    assert fs.exists(at)
    scratch.clear_scratch(spark)
    assert not fs.exists(at) and scratch.materialize(spark.range(2)).count() == 2


def test_white_space_is_no_text(spark):
    rows = [("title", "\n\t " * 30), (" \ntitl\t", "x" * 50), ("title", "\n" + "x" * 50 + " ")]
    good, bad = pipeline.ingest(spark.createDataFrame(rows, "title string, content string"))
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["body too short", "title too short"]
    names = spark.createDataFrame([("\tThe  Acme\n Corp ",), (" a bank",)], "n string")
    assert [r[0] for r in names.select(text.normalize_entity(F.col("n"))).collect()] == ["acme", "bank"]


def test_batches_by_group_with_a_hot_one(spark):
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 5}") for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, s string").repartition(6)
    places = {}
    want = {}
    for i, s in rows:
        want[i] = places.get(s, 0) // 7
        places[s] = places.get(s, 0) + 1
    assert {r.id: r.batch for r in R.batches(df, [F.col("id")], 7, ["s"]).collect()} == want
    assert R.batches(df.limit(0), [F.col("id")], 7).count() == 0


def test_long_words_are_cut_not_lost():
    word = "".join(chr(97 + i % 26) for i in range(1500))
    chunks = text.translation_chunks(f"One. {word} two three. Four {word}", 450)
    assert max(map(len, chunks)) <= 450 and "".join(" ".join(chunks).split()) == "".join(f"One. {word} two three. Four {word}".split())


def test_plans_read_the_text_once(spark, small):
    plan = queries.QUERIES["process_articles"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") <= 4
    plan = queries.QUERIES["top_keywords"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1


def test_word_counts(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "b", "a"],), ([],), (None,)], "w array<string>")
    got = [r[0] for r in df.select(tagging.word_counts(F.col("w"))).collect()]
    assert [[tuple(x) for x in g] for g in got] == [[(2, "a"), (3, "b"), (1, "c")], [], []]


def test_nearest_centre_with_odd_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [1.0, 1.0])], "id int, v array<double>").repartition(2)
    centers = spark.createDataFrame([("b", [0.0, 1.0]), ("a", [1.0, 0.0])], "c string, center array<double>")
    for most in (1, 10):
        got = {r.id: (r.c, r.similarity) for r in C.assign_to_centers(rows, centers, "id", "c", "v", 0.5, most).collect()}
        assert got == {1: ("a", 1.0), 2: (None, None), 3: (None, None), 4: (None, 0.0), 5: ("a", 0.707106781)}
    assert {r.c for r in C.assign_to_centers(rows, centers.limit(0), "id", "c", "v", 0.5).collect()} == {None}


def test_cluster_texts_take_the_first_members(spark):
    df = spark.createDataFrame([(1 if i % 2 else 2, i, f"t{i}") for i in range(200)] + [(3, 900, "x"), (None, 901, "y")], "c int, id int, b string").repartition(4)
    got = {r.c: (r.n, r.text) for r in pipeline.cluster_texts(df, "c", "id", "b", most=3).collect()}
    assert got == {1: (100, "t1\n\nt3\n\nt5"), 2: (100, "t0\n\nt2\n\nt4")}


def test_clustering_run(spark, small):
    rows = queries.titled(spark, small).join(queries.vectors(spark, small), F.col("doc_id") == F.col("vec_id")).select("doc_id", "title", "text", "embedding")
    assigned, stored = pipeline.clustering_run(rows, "doc_id", "title", "text", threshold=0.15)
    sizes = {r.cluster: r.n for r in assigned.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    assert assigned.count() == rows.count() and len([c for c in sizes if c is not None]) <= max(20, rows.count() // 10)
    kept = {r.cluster: r for r in stored.collect()}
    assert set(kept) == {c for c, n in sizes.items() if c is not None and n >= 3} and all(kept[c].member_count == sizes[c] and kept[c].summary and kept[c].status == "complete" for c in kept)
    assert len({r.cluster_id for r in kept.values()}) == len(kept)
    assert pipeline.cluster(rows.limit(0), "doc_id").count() == 0


def test_plug_ins_get_slices_of_batches(spark):
    """What a worker holds as objects follows the slice: by rows, and by bytes of long texts."""

    class Length:
        def detect(self, texts):
            return texts.map(lambda _: str(len(texts)))

    short = spark.range(3000).coalesce(1).select(models.language(F.col("id").cast("string"), Length).alias("n"))
    assert max(int(r.n) for r in short.collect()) == text.SLICE
    long = spark.range(40).coalesce(1).select(models.language(F.repeat(F.lit("x"), 200_000), Length).alias("n"))
    assert max(int(r.n) for r in long.collect()) <= 5
    assert [len(s) for s in text.slices(iter([pa.array([], pa.string()), pa.array(["a", None])]))] == [0, 2]


def test_hashed_grams_are_those_of_the_definition():
    words = "the cat sat on the mat on the cat".split()
    want = np.zeros(16)
    for gram in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
        h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "big")
        want[h % 16] += 1 if h >> 63 else -1
    e = models.HashEmbedder(16)
    e.places.most = 3
    for v in (e.one("The cat sat on the mat, on the CAT!"), e.embed(pd.Series(["The cat sat on the mat, on the CAT!", None]))[0]):
        assert np.array_equal(v, want / np.sqrt(want @ want))
    assert len(e.places) <= 3


def test_text_search_embeds_once(spark, small):
    assert "ArrowEvalPython" not in queries.text_search(spark, small)._jdf.queryExecution().executedPlan().toString()


def test_tfidf_counts_pairs_of_frequent_words_only(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["aa", "bb", "cc"], 6).tolist() + [f"w{rng.integers(400)}" for _ in range(30)]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate([*texts, "aa bb", "", None])), "id long, t string")
    kept, write = [], models.materialize
    monkeypatch.setattr(models, "materialize", lambda x: kept.append(write(x)) or kept[-1])
    for features in (5, 9, 40):
        got = {(r.id, r.term): r.weight for r in models.tfidf(df, "id", F.col("t"), features).collect()}
        counts = [Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]) for w in (t.split() for t in [*texts, "aa bb"])]
        total, n = sum(counts, Counter()), 63
        vocabulary = sorted(total, key=lambda t: (-total[t], t))[:features]
        idf = {t: math.log((1 + n) / (1 + sum(t in c for c in counts))) + 1 for t in vocabulary}
        rows = {(i, t): c[t] * idf[t] for i, c in enumerate(counts) for t in vocabulary if c[t]}
        assert got.keys() == rows.keys()
        for (i, t), x in rows.items():
            assert abs(got[i, t] - x / math.sqrt(sum(y * y for (j, _), y in rows.items() if j == i))) < 1e-9
    # the first call: of three words and their pairs, not of every pair
    assert kept[2].count() < sum(map(len, counts)) / 4


def test_articles_pass_four_workers(spark, small):
    """Translation, references, entities and embeddings: one worker each, whatever number of columns goes through."""
    plan = queries.article_pipeline(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 4


def test_several_columns_through_one_plug_in(spark):
    df = spark.createDataFrame([(i, f"a {i}", None if i % 3 else f"b {i}") for i in range(700)], "id long, x string, y string").coalesce(1)
    make = lambda: models.HashEmbedder(8)
    both = df.select("x", "y", models.apply_all([F.col("x"), F.col("y")], make, "embed", "array<double>").alias("v"), models.embedding(F.col("x"), make).alias("vx"), models.embedding(F.col("y"), make).alias("vy"))
    rows = both.collect()
    assert len(rows) == 700 and all(r.v == [r.vx, r.vy] for r in rows)
