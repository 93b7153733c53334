"""Learning and fuzzy search against plain versions of their rules."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazetta.llm import licenses, quality, toxicity

# --- FTRL


def plain_ftrl(rows, epochs, bits):
    """Weights by coordinate, as the published rule states them, one at a time."""
    z, n, bias = defaultdict(float), defaultdict(float), 1 << bits

    def weight(i):
        l1, l2 = (0.0, 0.0) if i == bias else (toxicity.L1, toxicity.L2)
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + l2)

    for _ in range(epochs):
        for places, label in rows:
            at = [*places, bias]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in at:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z if weight(i)}


def test_ftrl_is_the_per_coordinate_rule(monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 0.4)
    r = random.Random(6)
    rows = []
    for _ in range(200):
        y = int(r.random() < 0.4)
        rows.append((sorted({r.randrange(60) for _ in range(12)} | ({61, 62} if y and r.random() < 0.8 else set())), y))
    want = plain_ftrl(rows, 3, 8)
    at, w, bias = toxicity.train([[(np.array(p, np.uint32).tobytes(), y) for p, y in rows]] * 3, bits=8)
    got = dict(zip(at.tolist(), w.tolist(), strict=True)) | {256: bias}
    assert set(got) == set(want) and 5 < len(got) < 64
    assert all(abs(got[i] - want[i]) < 1e-5 for i in want)


def test_calibration():
    r = np.random.default_rng(2)
    s = r.normal(size=4000)
    y = (r.random(4000) < 1 / (1 + np.exp(-(2.0 * s - 1)))).astype(float)
    scale, shift = toxicity.platt(s, y)
    assert abs(scale - 2) < 0.25 and abs(shift + 1) < 0.2
    assert toxicity.platt(s[:5], y[:5]) == (1.0, 0.0) and toxicity.platt(-s, y) == (1.0, 0.0)
    rows = [(np.array([i % 7, 10 + (i % 3 == 0)], np.uint32).tobytes(), int(i % 3 == 0)) for i in range(300)]
    plain, scaled = toxicity.train([rows] * 3, bits=8), toxicity.train([rows] * 4, bits=8, calibration=4)
    assert (plain[0] == scaled[0]).all()
    ratio = scaled[1] / plain[1]
    assert np.allclose(ratio, ratio[0], rtol=1e-4)


def test_repeated_ids_are_learnt_once(spark):
    rows = [(i, "bad word here" if i % 3 == 0 else "good words there") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    often = spark.createDataFrame(rows + [rows[1]] * 500, "doc_id long, text string")
    a, b = toxicity.fit(once, labels), toxicity.fit(often, labels)
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


# --- empirical Bayes


def plain_posteriors(rows, base):
    """Rates and scores of (key, host, section, evidence), by plain sums."""
    odds = math.log(base / (1 - base))
    p = {k: 1 / (1 + math.exp(-(e + odds))) for k, _, _, e in rows}
    sections, hosts = defaultdict(list), defaultdict(list)
    for k, h, s, _ in rows:
        sections[h, s].append(p[k])
        hosts[h].append(p[k])
    mu = sum(p.values()) / len(p)

    def strength(groups, mean):
        n = sum(map(len, groups.values()))
        observed = sum(len(g) * (sum(g) / len(g) - mean(key)) ** 2 for key, g in groups.items()) / n
        sampling = sum(sum(x * (1 - x) for x in g) for g in groups.values())
        inner = sum(sum(x * (1 - x) for x in g) / len(g) for g in groups.values())
        return n, observed, sampling, inner

    out = {}
    level = mu

    def k_of(groups, mean):
        n, observed, _, inner = strength(groups, mean)
        between = max(observed - inner / n, 1e-9)
        return min(max(level * (1 - level) / between - 1, quality.STRENGTH[0]), quality.STRENGTH[1])

    def k_of_hosts():
        n = len(p)
        observed = sum(len(g) * (sum(g) / len(g) - mu) ** 2 for g in hosts.values()) / n
        inner = 0.0
        for h in hosts:
            parts = [(len(g), sum(x * (1 - x) for x in g) / len(g)) for (hh, _), g in sections.items() if hh == h]
            inner += sum(m * i for m, i in parts) / sum(m for m, _ in parts)
        return min(max(level * (1 - level) / max(observed - inner / n, 1e-9) - 1, quality.STRENGTH[0]), quality.STRENGTH[1])

    k_host, k_section = k_of_hosts(), k_of(sections, lambda key: sum(hosts[key[0]]) / len(hosts[key[0]]))
    for k, h, s, e in rows:
        host = (sum(hosts[h]) - p[k] + k_host * mu) / (len(hosts[h]) - 1 + k_host)
        section = (sum(sections[h, s]) - p[k] + k_section * host) / (len(sections[h, s]) - 1 + k_section)
        out[k] = (host, section, 1 / (1 + math.exp(-(e + math.log(section / (1 - section))))))
    return out


def test_posteriors_by_plain_sums(spark):
    r = random.Random(12)
    words = "plain words of a text that is fine and goes on for a while".split()
    docs = []
    for i in range(300):
        host = r.choice(["a", "a", "b", "c", None])
        junk = r.random() < {"a": 0.1, "b": 0.8, "c": 0.4, None: 0.5}[host]
        text = " ".join(r.choice(["JUNK!!", "$$$", "Buy", *words[:3]] if junk else words) for _ in range(r.randint(3, 30)))
        docs.append((i, text, host, r.choice(["x", "y", "z"])))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, int("JUNK" not in t)) for i, t, _, _ in docs if i % 2], "doc_id long, quality int")
    got = quality.classify(df, labels, F.col("source"), F.col("lang")).collect()
    learnt = [int("JUNK" not in t) for i, t, _, _ in docs if i % 2 and not next(x.held_out for x in got if x.doc_id == i)]
    want = plain_posteriors([(x.doc_id, x.host, x.section, x.evidence) for x in got], min(max(sum(learnt) / len(learnt), 1e-3), 1 - 1e-3))
    for x in got:
        assert np.allclose((x.host_rate, x.section_rate, x.score), want[x.doc_id], atol=1e-6)
        assert x.predicted == int(x.score >= 0.5)


def test_sites_decide_where_evidence_does_not(spark):
    """The same ambiguous text on a good and on a bad host; a host with one document follows the global rate."""
    good, bad, mixed = "calm words of a text that is fine", "JUNK!! JUNK!! $$$", "calm words JUNK!! of a $$$ text"
    docs = [(i, good, "good", "p") for i in range(400)] + [(1000 + i, bad, "bad", "p") for i in range(400)]
    docs += [(5000 + i, mixed, "good" if i % 2 else "bad", "p") for i in range(20)] + [(9000, mixed, "lone", "p")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i in [*range(400), *range(1000, 1400)]] + [(5000 + i, i % 2) for i in range(10)], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality.classify(df, labels, F.col("source"), F.col("lang")).collect()}
    assert got[5001].evidence == got[5000].evidence and got[5001].predicted == 1 and got[5000].predicted == 0
    assert got[5000].section_rate < got[9000].section_rate < got[5001].section_rate
    often = df.unionByName(df.where("doc_id = 1").crossJoin(spark.range(300)).select(df.columns))
    assert quality.classify(often, labels, F.col("source"), F.col("lang")).where("doc_id = 5000").first().evidence == pytest.approx(got[5000].evidence)


# --- fuzzy notices


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_notice(words, notice):
    """All spans of whole words within the notice's edits whose name is unchanged, and of those that overlap the best."""
    found, joined, starts = [], " ".join(words), []
    at = 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    for i in range(len(words)):
        for j in range(i, len(words)):
            part = joined[starts[i] : starts[j] + len(words[j])]
            if len(part) > len(notice.words) + notice.edits:
                break
            if f" {notice.name} " in f" {part} " or not notice.name:
                e = distance(part, notice.words)
                if e <= notice.edits:
                    found.append((e, i, j))
    out = []
    for e, i, j in sorted(found):
        if all(j < a or i > b for a, b, _ in out):
            out.append((i, j, e))
    return sorted(out)


def test_fuzzy_search_by_plain_distance():
    r = random.Random(21)
    for round_ in range(400):
        notice = r.choice(licenses.NOTICES)
        words = []
        for _ in range(r.randint(1, 4)):
            words += r.choices(["the", "license", "mit", "a", "public", "use", "é", "of", "rights", "kit"], k=r.randint(0, 3))
            text = list(r.choice([notice, r.choice(licenses.NOTICES)]).words)
            for _ in range(r.randint(0, notice.edits + 1)):
                k = r.randrange(len(text))
                text[k : k + 1] = r.choice([[], [r.choice("abcé ")], [text[k], r.choice("xyz ")]])
                text = text or ["a"]
            words += "".join(text).split()
        _, hits = licenses.scan(" ".join(words), (notice,))
        got = sorted((h["first_word"], h["last_word"], h["edits"]) for h in hits)
        assert got == plain_notice(words, notice), (round_, notice, words)


@pytest.mark.parametrize("text", ["kit license", "hit license", "disc license", "bad license", "bsb license", "several public license", "mitt license"])
def test_a_changed_name_is_another_license(text):
    assert licenses.scan(f"under the {text} of it")[1] == []
