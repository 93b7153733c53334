"""Operators that compare or learn: against brute force, SQL and held-out rows."""

import hashlib
import random
import time
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from gazetta.llm import decontam, linededup, quality, queries, simhash, toxicity
from gazetta.llm.common import materialize, table
from tests.llm.conftest import ROWS
from tests.llm.test_texts import plain_words


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


# --- simhash


def plain_fingerprint(text):
    words = simhash.hex_words(text or "")
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, threshold=2):
    """Least id in reach, by comparing all pairs of distinct fingerprints."""
    distinct = sorted(set(fps.values()))
    parent = {f: f for f in distinct}

    def top(f):
        while parent[f] != f:
            f = parent[f]
        return f

    links = defaultdict(int)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= threshold:
                parent[top(a)] = top(b)
                links[a] += 1
                links[b] += 1
    least = {}
    for i, f in fps.items():
        least[top(f)] = min(i, least.get(top(f), i))
    return {i: least[top(f)] for i, f in fps.items()}, links


def test_fingerprints_and_groups(spark, small):
    rows = duckdb.sql(f"select doc_id, text from '{small}/documents.parquet'").fetchall()
    r = random.Random(5)
    for i in range(40):  # near copies of long texts
        words = rows[i][1].split(" ")
        words[r.randrange(len(words))] = "changed"
        rows.append((10_000 + i, " ".join(words * 6)))
        rows.append((20_000 + i, " ".join(words * 6) + " end"))
    rows += [(30_000, None), (30_001, ""), (30_002, "  "), (30_003, "one"), (30_004, "ONE"), (30_005, "one two")]
    got = {x.doc_id: x for x in simhash.near_duplicates(documents(spark, rows)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in rows}
    want, links = plain_components(fps)
    assert {i: x.fingerprint for i, x in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: x.component_id for i, x in got.items()} == want
    assert {i: x.n_links for i, x in got.items()} == {i: links[fps[i]] for i in fps}


def test_links_lose_none_and_chains_meet(spark):
    r = random.Random(9)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        f = r.getrandbits(64)
        fps.add(f)
        for _ in range(12):  # a chain of one or two flipped bits a step
            for b in r.sample(range(64), r.randint(1, 2)):
                f ^= 1 << b
            fps.add(f)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = [(a.a % (1 << 64), a.b % (1 << 64)) for a in simhash.links(df).collect()]
    listed = sorted(fps)
    want = {frozenset((a, b)) for i, a in enumerate(listed) for b in listed[:i] if (a ^ b).bit_count() <= 2}
    assert len(got) == len(want) and {frozenset(p) for p in got} == want
    labels = {x.v: x.label for x in simhash.components(simhash.links(df)).collect()}
    ids = {f: signed(f) for f in fps}
    want_labels, _ = plain_components({signed(f): f for f in fps})
    linked = {f for p in want for f in p}
    assert {v: labels[v] for v in labels} == {ids[f]: want_labels[ids[f]] for f in linked}


def test_copies_are_not_broadcast(spark):
    # Spark sizes the copies by the fingerprints that they are made of, here a few KB
    df = materialize(spark.range(500).select(F.xxhash64("id").alias("fp")))
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 0
    plan = simhash.links(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in random.Random(1).sample(range(300), 300)], "a long, b long")
    assert {x.label for x in simhash.components(edges).collect()} == {0}


def test_simhash_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ROWS)
    assert {x.component_id for x in got if x.doc_id in (2, 3, 4)} == {2} and {x.component_id for x in got if x.doc_id in (1, 5)} == {1}
    assert simhash.near_duplicates(empty).count() == 0


# --- decontamination


def plain_contamination(docs, items):
    windows = defaultdict(set)
    for name, text in items:
        w = plain_words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else []:
            windows[tuple(w[i : i + n])].add(str(name))
    sizes = {len(w) for w in windows}
    out = {}
    for i, text in docs:
        w = plain_words(text)
        hit, names = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    hit |= set(range(k, k + n))
                    names |= found
        said = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out[i] = (len(w), len(hit), len(names), said, len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block_words", [500_000, 300])
def test_contamination(spark, small, block_words):
    docs = duckdb.sql(f"select doc_id, text from '{small}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{small}/benchmark.parquet'").fetchall()
    r = random.Random(2)
    items += [(900, "short item Here"), (901, "a b c d e f g h i j k l m"), (902, None), (903, "..."), (904, "one"), (905, "x y x y x y x y x y x y x y x y"), (901, "a b c d e f g h i j k l m")]
    for i in range(60):
        words = plain_words(r.choice(items[:40])[1])
        a = r.randrange(max(1, len(words) - 14))
        cut = words[a : a + r.randint(11, 20)]
        docs.append((50_000 + i, f"{docs[i][1]} {' '.join(cut)} {docs[i + 1][1]}"))
    docs += [(60_000, "SHORT, item: here!"), (60_001, "x y " * 30), (60_002, "a b c d e f g h i j k l"), (60_003, None), (60_004, "a-b.c d e f g h i j k l m one"), (60_005, "one")]
    df, bench = documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: tuple(x)[1:] for x in decontam.contamination_digest(df, bench, block_words=block_words).collect()}
    assert got == plain_contamination(docs, items)


@pytest.mark.parametrize("block_words", [1, 500_000])
def test_items_without_an_id_hit(spark, block_words):
    passage = " ".join(f"w{i}" for i in range(20))
    df = documents(spark, [(1, f"before {passage} behind"), (2, "nothing of it"), (3, f"{passage} and one two three four")])
    bench = spark.createDataFrame([(8, "one two three four"), (None, passage), (None, None)], "item_id long, text string")
    got = {x.doc_id: x for x in decontam.contamination_digest(df, bench, block_words=block_words).collect()}
    assert {i: (x.n_hit, x.n_items, x.contaminated) for i, x in got.items()} == {1: (20, 0, True), 2: (0, 0, False), 3: (24, 1, True)}
    assert [got[i].items_sha256 for i in (1, 3)] == [hashlib.sha256(x).hexdigest() for x in (b"", b"8")]


def test_contamination_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "quick brown fox"), (2, None)], "item_id long, text string")
    for words in (500_000, 1):
        got = decontam.contamination_digest(odd, bench, block_words=words).collect()
        assert len(got) == len(ROWS) and {x.doc_id for x in got if x.contaminated} == {1, 5}
    assert decontam.contamination_digest(empty, bench).count() == 0
    assert {x.n_hit for x in decontam.contamination_digest(odd, bench.limit(0)).collect()} == {0}


@pytest.mark.parametrize("block_words", [1, 500_000])
def test_contamination_of_periodic_texts(spark, block_words):
    r = random.Random(9)
    items = [(i, " ".join(r.choice("ab") for _ in range(r.randint(1, 40)))) for i in range(12)] + [(20, "a " * 60), (21, "a b " * 30), (22, "a b c " * 9), (23, "a " * 12)]
    docs = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 300)))) for i in range(30)] + [(40, "a " * 500), (41, "a b " * 200), (42, "c a b " * 50), (43, "a " * 500), (44, "b " * 12 + "c " + "a " * 13)]
    df, bench = documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: tuple(x)[1:] for x in decontam.contamination_digest(df, bench, block_words=block_words).collect()}
    assert got == plain_contamination(docs, items)


def test_repeated_words_take_no_more_time():
    known = decontam.Items([("1", "same " * 5000), ("2", "same other " * 2000)])
    began = time.process_time()
    spans, names = known.hits(decontam.words_of("same " * 1_000_000))
    assert spans == [(0, 1_000_000)] and names == {"1"} and time.process_time() - began < 10


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontam, "MULTIPLIER", np.uint64(0))
    known = decontam.Items([("1", "a b c"), ("2", "d e f"), ("3", "a b c d")])
    assert known.hits(decontam.words_of("x d e f a b c e a b c d")) == ([(1, 7), (8, 12)], {"1", "2", "3"})


# --- line dedup


def plain_line_dedup(docs, least):
    """All maximal runs that occur before, by comparing every pair of places."""
    lines = [(i, p, line) for i, t in sorted(docs) for p, line in enumerate((t or "").split("\n"))]
    ends = {}
    for k, (i, _, _) in enumerate(lines):
        ends[i] = k + 1
    gone = set()
    for q in range(len(lines)):
        for p in range(q):
            n = 0
            while q + n < ends[lines[q][0]] and p + n < ends[lines[p][0]] and lines[q + n][2] == lines[p + n][2]:
                n += 1
            if sum(line.count(" ") + 1 for _, _, line in lines[q : q + n]) > least:
                gone |= set(range(q, q + n))
    out = defaultdict(list)
    for k, (i, _, line) in enumerate(lines):
        out[i] += [] if k in gone else [line]
    return {i: "\n".join(out[i]) for i, _ in docs}


def test_line_dedup_random(spark):
    r = random.Random(4)
    pool = ["a b", "c", "d e f", "", "g h i j k", "l m n o p q r s t"]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 14)))) for i in range(40)]
    docs += [(100, docs[3][1]), (101, docs[3][1] + "\ntail"), (102, "g h i j k\n" * 9), (103, None)]
    for least in (3, 7, 12):
        got = {x.doc_id: x.text or "" for x in linededup.dedup_lines(documents(spark, docs), min_words=least).collect()}
        assert got == plain_line_dedup(docs, least)


def test_line_dedup_odd_rows(odd, empty):
    out = linededup.dedup_lines(odd, min_words=3)
    got = defaultdict(list)
    for x in out.collect():
        got[x.doc_id].append(x)
    assert out.columns[: len(odd.columns)] == odd.columns and sum(map(len, got.values())) == len(ROWS)
    assert got[1][0].text.startswith("the quick") and [x.text for x in got[5]] == ["", ""] and got[2][0].text is None
    assert linededup.dedup_lines(empty).count() == 0


def test_line_dedup_broadcasts_nothing(spark, small, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df)

    monkeypatch.setattr(linededup, "materialize", seen)
    out = linededup.dedup_lines(materialize(table(spark, small, "documents")))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not any("Broadcast" in p for p in plans)


def test_line_dedup_is_native(odd):
    plan = linededup.dedup_lines(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_line_dedup_sql(spark, small):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{small}/documents.parquet'")
    want = {r[0]: r[1:] for r in db.sql(queries.ORACLE_SQL["op9_line_dedup"]).fetchall()}
    got = {x.doc_id: (x.n_lines, x.n_removed, x.text) for x in queries.op9_line_dedup(spark, small).collect()}
    assert got == want


# --- classifiers


def test_ftrl_learns_and_is_sparse():
    r = random.Random(0)
    rows = []
    for _ in range(400):
        y = r.random() < 0.3
        words = [f"w{r.randrange(500)}" for _ in range(30)] + (["badword"] if y else [])
        r.shuffle(words)
        rows.append((toxicity.features(" ".join(words)).tobytes(), int(y)))
    at, w, bias = toxicity.train([rows[:300]] * 5)
    dense = np.zeros(1 << toxicity.TABLE_BITS)
    dense[at] = w
    right = [(toxicity.chance(bias + dense[np.frombuffer(f, np.uint32)].sum()) >= 0.5) == bool(y) for f, y in rows[300:]]
    assert np.mean(right) > 0.97 and len(at) < 300


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    out = toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    rows = out.join(table(spark, folder, "labels"), "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and x.predicted == int(x.score >= 0.5) and 0 <= x.score <= 1 for x in rows)
    test = [x for x in rows if x.held_out]
    assert np.mean([x.predicted == x.toxic for x in test]) > 0.97
    toxic = [x.predicted for x in test if x.toxic]
    clean = [x.predicted for x in test if not x.toxic]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.01


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (1, 1), (6, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == len(ROWS) and len({x.score for x in got if x.doc_id in (2, 3, 4)}) == 1
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {x.score for x in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.0}


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.op1_quality_classifier(spark, folder).join(table(spark, folder, "labels"), "doc_id").collect()
    test = [x for x in rows if x.held_out]
    assert np.mean([x.predicted == x.quality for x in test]) > 0.97
    good = [x for x in test if x.quality]
    assert np.mean([x.keep for x in good]) > 0.99


def test_quality_shrinks_sparse_sites(spark):
    words = "plain words of a text that is fine"
    docs = [(i, words if i % 10 else "JUNK!! JUNK!! JUNK!!", "big", "a") for i in range(200)]
    docs += [(1000 + i, "JUNK!! JUNK!! JUNK!!", "bad", "a") for i in range(60)] + [(2000, words, "lone", "x"), (2001, words, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    labels = df.select("doc_id", F.when(F.col("text").startswith("plain"), 1).otherwise(0).alias("quality"))
    got = {x.doc_id: x for x in quality.classify(df, labels, F.col("source"), F.col("lang")).collect()}
    assert got[1].section_rate > got[2000].section_rate > got[1000].section_rate
    assert got[1].predicted == 1 and got[1000].predicted == 0 and got[2001].host == ""


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (1, 1), (6, 0), (7, None)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        got = quality.classify(odd, known, F.col("source"), F.col("lang")).collect()
        assert len(got) == len(ROWS) and all(0 <= x.score <= 1 for x in got)
    assert quality.classify(empty, labels, F.col("source"), F.col("lang")).count() == 0


def test_site_of_url(spark):
    df = spark.createDataFrame([("http://www.A.com/x/y?q",), ("https://u@b.org:80",), (None,), ("nothing",)], "u string")
    host, section = quality.site_of_url(F.col("u"))
    assert [tuple(r) for r in df.select(host, section).collect()] == [("a.com", "x"), ("b.org", ""), ("", ""), ("", "")]


# --- pipeline


def test_pipeline_by_brute_force(spark, small):
    scores = {x.doc_id: x.predicted for x in queries.op10_toxicity(spark, small).collect()}
    rows = duckdb.sql(f"select doc_id, text from '{small}/documents.parquet' order by doc_id").fetchall()
    clean = [(i, t) for i, t in rows if not scores[i]]
    db = duckdb.connect()
    db.sql("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", clean)
    cut = {r[0]: r[3] for r in db.sql(linededup.oracle()).fetchall()}
    groups, _ = plain_components({i: plain_fingerprint(t) for i, t in cut.items()})
    single = [(i, t) for i, t in cut.items() if groups[i] == i]
    items = duckdb.sql(f"select item_id, text from '{small}/benchmark.parquet'").fetchall()
    dirty = plain_contamination(single, items)
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in single if not dirty[i][4]}
    got = {x.doc_id: x.decoded_sha256 for x in corpus_pipeline.run(spark, small).collect()}
    assert got == want


def test_one_of_each_with_null_and_repeated_ids(spark, small):
    text = "the quick brown fox jumps over the lazy dog"
    other, third, alone = "an entirely different line about ships at sea", "nobody has read this sentence before today", "only a row without an id has these words in it"
    rows = [(5, text), (None, text.upper()), (None, alone), (None, alone.title()), (None, "yet another text that no other row of these holds"), (7, third), (7, other), (3, other.upper()), (9, None), (9, "")]
    df = documents(spark, rows).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "1L as n_chars")
    got = [(x.doc_id, x.text) for x in corpus_pipeline.keep_one_of_each(spark, df, small).collect()]
    assert len(got) == 6
    assert {x for x in got if x[0] is not None} == {(5, text), (7, third), (3, other.upper()), (9, None)}
    assert sorted(t.lower() for i, t in got if i is None) == sorted([alone, rows[4][1]])


def test_stages_with_odd_rows(spark, small, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, small)
            assert out.count() <= len(ROWS)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == list(corpus_pipeline.COLUMNS)


def code_words():
    """All words of the Golay code: multiples of the generator polynomial."""
    words = [0]
    for i in range(12):
        words += [w ^ (simhash.GENERATOR << i) for w in words]
    return np.array(words, np.uint64)


def test_copies_meet_like_literal_replication():
    """One block: copies to every anchor within covering radius plus threshold, compared with its homes, find the same pairs."""
    words, r = code_words(), np.random.default_rng(3)
    assert len(set(words.tolist())) == 4096
    fps = r.integers(0, 1 << 23, 150, dtype=np.uint64)
    fps = np.unique(np.concatenate([fps, fps ^ np.uint64(1 << 4), fps ^ np.uint64(0b11 << 9), fps ^ np.uint64(1 << 22 | 1)]))
    distance = np.bitwise_count(fps[:, None] ^ words[None, :])
    assert distance.min(1).max() <= 3
    home, place, anchor = simhash.anchors(fps, 2, ((0, 23),))
    assert (home == words[distance.argmin(1)] >> np.uint64(11)).all()
    literal = {(i, int(words[j] >> np.uint64(11))) for i, j in zip(*np.nonzero(distance <= 3 + 2), strict=True)}
    own = set(zip(place.tolist(), anchor.tolist(), strict=True))
    assert own <= literal and len(own) == len(place)

    def pairs(copies):
        at = defaultdict(list)
        for i, a in copies:
            at[a].append(i)
        return {(i, j) for i, h in enumerate(home.tolist()) for j in at[h] if i != j and int(fps[i] ^ fps[j]).bit_count() <= 2}

    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if i != j and int(fps[i] ^ fps[j]).bit_count() <= 2}
    assert pairs(own) == pairs(literal) == want and len(want) > 300


def test_hot_vertices_and_labels(spark):
    rows = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5040)] + [(2999, 5000)]
    edges = spark.createDataFrame(rows, "a long, b long").repartition(3)
    assert [r[0] for r in simhash.hot_keys(edges, "a").collect()] == [0]
    got = {x.v: x.label for x in simhash.components(edges).collect()}
    assert len(got) == 3041 and set(got.values()) == {0}
    table = spark.createDataFrame([(0, "x"), (5000, "y")], "__key long, up string")
    found = simhash.lookup(edges, "a", table, simhash.hot_keys(edges, "a")).collect()
    assert len(found) == 3000 and {(r.a, r.up) for r in found} == {(0, "x"), (5000, "y")}


def test_long_repeats_of_lines(spark):
    r = random.Random(8)
    run = [f"line {i} {'x ' * r.randint(0, 3)}" for i in range(500)]
    docs = [(1, "\n".join(run)), (2, "head\n" + "\n".join(run[40:460]) + "\ntail"), (3, "\n".join(run[:20] + ["other"] + run[20:])), (4, "\n".join(["a b c"] * 130 + run[499:]))]
    got = {x.doc_id: x.text or "" for x in linededup.dedup_lines(documents(spark, docs)).collect()}
    assert got == plain_line_dedup(docs, linededup.MIN_WORDS)
    assert got[2] == "head\ntail" and got[3] == "other"


def test_result_names_that_docs_has(spark):
    df = spark.createDataFrame([(1, "a b c\nd", 7, 8, "k"), (2, "a b c\nd", 7, 8, "k")], "doc_id long, text string, n_lines int, n_removed int, __x string")
    out = linededup.dedup_lines(df, min_words=2)
    assert out.columns == ["doc_id", "text", "__x", "n_lines", "n_removed"]
    assert {tuple(x) for x in out.collect()} == {(1, "a b c\nd", "k", 2, 0), (2, "", "k", 2, 2)}
    clash = df.withColumns({c: F.lit(1) for c in ("held_out", "predicted", "evidence", "host", "section", "contaminated", "n_hit", "fingerprint", "n_links", "score")})
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, toxic int, quality int")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for found in (simhash.near_duplicates(clash), toxicity.toxicity(clash, labels), quality.classify(clash, labels, F.col("host").cast("string"), F.col("section").cast("string")), decontam.contamination_digest(clash, bench)):
        assert found.count() == 2 and len(set(found.columns)) == len(found.columns)
