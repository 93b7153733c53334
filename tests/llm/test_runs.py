"""Periodic runs against their definition, token files against the library, panes against a plain loop."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from gazetta.llm import runs as R
from gazetta.llm import tokenfile as T
from gazetta.llm.queries import QUERIES


def plain_runs(w, least, times):
    """All maximal stretches by their definition."""
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            start, length = i, j - i + q
            if j > i and length >= max(least, times * q) and not any(all(w[start + x] == w[start + x + p] for x in range(length - p)) for p in range(1, q)):
                out.append((start, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_those_of_the_definition(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 5])
            w = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 9)
                w = w[:a] + [w[a + i % p] for i in range(n - a)]
            texts.append(w)
        least, times = rng.choice([(24, 3), (4, 2), (6, 3), (10, 3)])
        assert R.runs_of(texts, least, times) == [plain_runs(w, least, times) for w in texts]


def test_long_periods_and_long_runs():
    many = [f"w{i}" for i in range(5000)]
    assert R.runs_of([many * 4, ["x"] * 100_000, many]) == [[(0, 20_000, 5000)], [(0, 100_000, 1)], []]
    fibonacci = ["a", "b"]
    while len(fibonacci) < 400:
        fibonacci = fibonacci + fibonacci[: len(fibonacci) * 610 // 987]
    assert R.runs_of([fibonacci], 6, 3) == [plain_runs(fibonacci, 6, 3)]


def plain_digest(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w, 24, 3)
    best = None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    rest = b" ".join(x for i, x in enumerate(w) if i not in gone)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(rest).hexdigest())


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_op11_on_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = [plain_digest(r.doc_id, r.text) for r in docs if len((r.text or "").split()) <= 1500]
    got = QUERIES["op11_periodic_runs"](spark, small)
    found = {tuple(r) for r in got.collect()}
    assert len(found) == len({r.doc_id for r in docs}) and found.issuperset(want)
    assert sum(r[1] > 0 for r in want) > 5


def test_op11_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = {r.doc_id: r for r in R.run_digest(odd).collect()}
    for i, t in rows:
        if i != 6:
            assert tuple(got[i]) == plain_digest(i, t)
    assert got[6].n_runs >= 1 and R.run_digest(empty).count() == 0
    cut = {r.doc_id: r for r in R.find_runs(odd).collect()}
    assert cut[6].collapsed == "word" and [tuple(x) for x in cut[6].runs] == [(0, 30_000, 1)] and cut[2].collapsed == ""


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 1500])
@pytest.mark.parametrize("most", [0, 1, 300, 10**6, 2**45])
def test_elias_fano(n, most):
    rng = random.Random(n + most)
    values = sorted(rng.randint(0, most) for _ in range(n))
    e = T.EliasFano(T.EliasFano.pack(np.array(values, np.uint64)))
    assert len(e) == n and e.all().tolist() == values
    for i in rng.sample(range(n), min(n, 40)):
        assert e[i] == values[i]
    for x in (0, most // 3, most):
        assert e.up_to(x) == sum(v <= x for v in values)
    with pytest.raises(IndexError):
        e[n]


def test_elias_fano_is_near_minimal():
    ends = np.cumsum(np.full(10_000, 700, np.uint64))
    assert len(T.EliasFano.pack(ends)) * 8 / 10_000 < 2 + 9.5 + 0.5


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(T.default_tokenizer())


def test_ids_are_those_of_the_library(library):
    words = T.WordIds(T.default_tokenizer(), 2)
    rng = random.Random(4)
    odd = [chr(c) for c in (0, 1, 9, 10, 11, 12, 13, 28, 31, 32, 0x85, 0xA0, 0xAA, 0xB5, 0xC9, 0xD7, 0xDF, 0xE9, 0xF7, 0xFF, 0x130, 0x301, 0x308, 0x3A3, 0x1100, 0x1161, 0x2028, 0x212B, 0x3000, 0xFB01, 0x1F600)]
    odd += [*"aAzZ'’s!?<|>09.-", "<|endoftext|>", "<|startoftext|>", "'s", "n't", "'LL", "thequick"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["", "word " * 3000, "x" * 5000]
    for text, ids in zip(texts, words.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_remembered_words_have_a_bound(library, monkeypatch):
    monkeypatch.setattr(T, "CACHED", 20)
    words = T.WordIds(T.default_tokenizer(), 2)
    for k in range(30):
        texts = [f"word{k} the other{k % 3} tiny {chr(97 + k % 26) * 60}"]
        assert np.frombuffer(words.ids(texts)[0], "<u2").tolist() == library.encode(texts[0], add_special_tokens=False).ids
        assert len(words.known) + len(words.older) <= 60


def plain_digests(library, rows):
    """By ascending id (nulls first), then by the texts' XXH64 as a signed number."""
    signed = lambda t: (xxhash.xxh64(t.encode(), seed=42).intdigest() + 2**63) % 2**64
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, signed(x[1] or "")))
    ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    out, start = [], 0
    for i, x in ids:
        out.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    return out


def test_op12_on_small_table(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(QUERIES["op12_token_files"](spark, small)) == sorted(plain_digests(library, [tuple(r) for r in docs]), key=str)


def test_op12_many_small_files(spark, odd, empty, library, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    docs = odd.where("doc_id is null or doc_id <> 5").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(8, f"text {i}") for i in range(9)], "doc_id long, text string"))
    manifest = T.write_dataset(docs, folder, file_ids=5).orderBy("first").collect()
    assert len(manifest) > 3 and sum(r.n_docs for r in manifest) == docs.count()
    want = plain_digests(library, [(r.doc_id, r.text) for r in docs.collect()])
    read = T.read_documents(spark, folder).collect()
    assert sorted(((r.doc_id, r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in read), key=str) == sorted(want, key=str)
    at = 0
    for r in manifest:
        system, top = T.file_system(folder)
        with system.open_input_file(f"{top}/{r.path}") as opened:
            file = T.TokenFile(opened)
            assert r.first == at and len(file) == r.n_docs
            for i in range(len(file)):
                doc_id, start, n, crc = next(w for w in want if w[1] == at + file.bounds(i)[0])
                assert file.doc_id(i) == doc_id and zlib.crc32(file.ids(i).astype("<u4").tobytes()) == crc
                assert file.doc_at(file.bounds(i)[0]) == i and file.doc_at(file.bounds(i)[1] - 1) == i
        at += r.n_ids
    assert T.token_digest(empty).count() == 0
    assert rows_of(T.token_digest(odd)) == sorted(plain_digests(library, [(r.doc_id, r.text) for r in odd.collect()]), key=str)
