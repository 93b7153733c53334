"""Benchmark decontamination by winnowing.

Items and documents are word sequences. Of the hashes of all runs of k words, each window of w successive ones
keeps its least; two texts that share w + k - 1 words share such a window and so a kept hash. With w + k - 1 = 13
no occurrence of a 13-word window is missed. A document's kept hashes are joined with those of the items, and where one
agrees, the whole window is compared, word by word, with the windows of items that keep it; windows that agree and touch are one stretch.
Equal windows of the items are one window with a list of items, so repeated words cost no more than others: the work
follows the lengths of the texts. An item of fewer words is its own window; for each such length the same is done
with a k and w that guarantee it.

Items of about BLOCK_WORDS words in all (their bytes are counted first) go to the workers by a broadcast, and documents pass once. More
of them are joined by shuffles: documents' kept hashes with the items' first, and then the windows of the documents
that have such a hash with the items' windows, by their words. Copies of a text are one text there.

Defined results: null, empty or wordless texts have n_words 0 and no hit, and such items have no window; repeated
items both count (their ids are distinct) and repeated rows repeat their result; with an empty benchmark nothing is hit. An item whose id is null hits like any other:
it counts in n_hit, spans and contaminated; items lists ids, so n_items and items_sha256 leave it out.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetta.llm.common import SLICE, Remembered, map_texts, materialize, once_per_worker

#: Words of a window; words of a hashed run.
WINDOW, RUN = 13, 5
#: Words of the items that a broadcast holds, and bytes that a word counts for: 4 MB of text, about 60 MB with their tables.
BLOCK_WORDS, WORD_BYTES = 500_000, 8
#: Bytes outside [0-9A-Za-z] and the non-ASCII ones become spaces; A-Z becomes a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def run_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k successive ids."""
    n = len(ids) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h + ids[j : j + n]) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def kept(h: np.ndarray, w: int) -> np.ndarray:
    """The least hash of each w successive ones (of all, if there are fewer)."""
    size = 1
    while size < w and len(h) > 1:
        step = min(size, w - size, len(h) - 1)
        h = np.minimum(h[:-step], h[step:])
        size += step
    return h


def scheme(n: int) -> tuple[int, int]:
    """k and w that show every shared run of n words."""
    k = min(n, RUN)
    return k, n - k + 1


def window_keys(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each n successive ids: the kept hash, and a hash of all of them."""
    k, w = scheme(n)
    return kept(run_hashes(ids, k), w), run_hashes(ids, n)


def stretches(starts: list[int], n: int) -> list[tuple[int, int]]:
    """Windows of n words at ascending starts, those that touch put together."""
    return merged([(s, s + n) for s in starts])


class Windows:
    """The different windows of n words of some items: kept hashes, hashes of all words, one place of each, and the items that have it."""

    def __init__(self, n: int, words: np.ndarray, places: np.ndarray, owners: np.ndarray):
        """places: where windows start in words; owners: the items that they belong to."""
        self.n, self.words = n, words
        own = words[places[:, None] + np.arange(n)]
        least, whole = self._hash(own)
        order = np.lexsort((owners, *(own[:, j] for j in range(n - 1, -1, -1)), whole))
        own, whole, places, owners = own[order], whole[order], places[order], owners[order]
        new = np.concatenate([[True], (own[1:] != own[:-1]).any(1)])
        self.kept = np.unique(least)
        self.whole, self.place = whole[new], places[new]
        window = np.cumsum(new) - 1
        fresh = np.concatenate([[True], (window[1:] != window[:-1]) | (owners[1:] != owners[:-1])])
        self.items = owners[fresh]
        self.first = np.searchsorted(window[fresh], np.arange(len(self.whole) + 1))

    def _hash(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kept and whole hash of each row of words."""
        k, w = scheme(self.n)
        runs = np.stack([row_hash(own[:, j : j + k]) for j in range(w)])
        return runs.min(0), row_hash(own)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts in ids of windows that are here, ascending, and which they are."""
        least, whole = window_keys(ids, self.n)
        at = np.flatnonzero(self.kept[np.minimum(np.searchsorted(self.kept, least), len(self.kept) - 1)] == least)
        starts, found = [at[:0]], [at[:0]]
        if len(at):
            # windows with one hash but other words stand side by side
            a, b = np.searchsorted(self.whole, whole[at], "left"), np.searchsorted(self.whole, whole[at], "right")
            step = 0
            while (more := np.flatnonzero(a + step < b)).size:
                j = a[more] + step
                same = (ids[at[more][:, None] + np.arange(self.n)] == self.words[self.place[j][:, None] + np.arange(self.n)]).all(1)
                starts.append(at[more][same])
                found.append(j[same])
                step += 1
        starts, found = np.concatenate(starts), np.concatenate(found)
        order = np.argsort(starts, kind="stable")
        return starts[order], found[order]

    def owners(self, found: np.ndarray) -> set[int]:
        """The items that have any of some windows."""
        out: set[int] = set()
        for j in np.unique(found).tolist():
            out.update(self.items[self.first[j] : self.first[j + 1]].tolist())
        return out


def row_hash(rows: np.ndarray) -> np.ndarray:
    """run_hashes of each row as one run."""
    h = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        h = (h + rows[:, j]) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


class Items:
    """Some items: numbers of their words, and their windows by length."""

    def __init__(self, items: list[tuple[str | None, str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str | None] = []
        words: list[int] = []
        places: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text or "")]
            if ids:
                n = min(len(ids), WINDOW)
                places[n].append((len(words), len(ids) - n + 1, len(self.names)))
                self.names.append(name)
                words += ids
        whole = np.array(words, np.uint64)
        self.windows = []
        for n, spans in sorted(places.items()):
            at = np.concatenate([np.arange(a, a + count) for a, count, _ in spans])
            self.windows.append(Windows(n, whole, at, np.repeat([i for _, _, i in spans], [count for _, count, _ in spans])))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Stretches (first word, word behind the last) and the names of the items that hit."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        spans: list[tuple[int, int]] = []
        names: set[str | None] = set()
        for windows in self.windows:
            if len(ids) >= windows.n:
                starts, found = windows.find(ids)
                if len(starts):
                    spans += stretches(starts.tolist(), windows.n)
                    names.update(self.names[i] for i in windows.owners(found))
        return merged(spans), names


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _by_broadcast(docs: DataFrame, items: list[tuple[str | None, str]], text: str, keep: list[str]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)
    key = uuid.uuid4().hex

    def make() -> Callable[[str], tuple]:
        known = once_per_worker(key, lambda: Items(sent.value))

        def one(x: str) -> tuple:
            words = words_of(x)
            spans, names = known.hits(words)
            return len(words), [{"first": a, "behind": b} for a, b in spans], sorted(x for x in names if x is not None)

        return one

    return map_texts(docs, text, keep, make, RESULT)


RESULT = "n_words long, spans array<struct<first:long,behind:long>>, items array<string>"


def word_numbers(words: list[bytes], known: Remembered) -> np.ndarray:
    """Hashes of words, the same in every worker."""
    return np.array(list(map(known.__getitem__, words)), np.uint64)


def _numbers() -> Remembered:
    return Remembered(lambda w: xxhash.xxh64_intdigest(w), 400_000, 64)


def windows_of_items(items: DataFrame) -> DataFrame:
    """n, kept (hash), words and item of each different window of each item (i, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _numbers()
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(t)
                if not words:
                    continue
                n = min(len(words), WINDOW)
                least, _ = window_keys(word_numbers(words, numbers), n)
                rows = {b" ".join(words[s : s + n]): int(x) for s, x in enumerate(least.astype(np.int64).tolist())}
                yield pa.RecordBatch.from_pydict({"n": [n] * len(rows), "kept": list(rows.values()), "words": [w.decode() for w in rows], "item": [i] * len(rows)}, schema=_WINDOWS)

    return items.mapInArrow(run, "n int, kept long, words string, item string")


_WINDOWS = pa.schema([("n", pa.int32()), ("kept", pa.int64()), ("words", pa.string()), ("item", pa.string())])
_KEPT = pa.schema([("k", pa.binary()), ("n", pa.int32()), ("kept", pa.int64())])
_FOUND = pa.schema([("k", pa.binary()), ("n", pa.int32()), ("words", pa.string()), ("starts", pa.list_(pa.int64()))])


def _by_shuffle(docs: DataFrame, items: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The same by joins, for items of any number and length. Documents meet them as different texts, by a hash of 256 bits."""
    windows = materialize(windows_of_items(items))
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())
    whole = docs.withColumn("__t", F.coalesce(text, F.lit(""))).withColumn("__k", F.unhex(F.sha2("__t", 256)))
    texts = materialize(whole.select(F.col("__k").alias("k"), F.col("__t").alias("t")).dropDuplicates(["k"]))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _numbers()
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = word_numbers(words_of(t), numbers)
                for n in lengths:
                    if len(ids) >= n:
                        least = np.unique(window_keys(ids, n)[0]).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(least), pa.binary()), pa.array([n] * len(least), pa.int32()), pa.array(least)], schema=_KEPT)

    known = windows.select("n", "kept").distinct()
    met = texts.mapInArrow(keys, "k binary, n int, kept long").join(known, ["n", "kept"], "left_semi")
    # the hashes that a text shares with items are no more than those that it keeps
    met = met.groupBy("k").agg(F.collect_list(F.struct("n", "kept")).alias("met"))
    some = materialize(texts.join(met, "k").select("k", "t", "met"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _numbers()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for r in batch.slice(at, SLICE).to_pylist():
                    words = words_of(r["t"])
                    ids = word_numbers(words, numbers)
                    by: dict[int, list[int]] = defaultdict(list)
                    for m in r["met"]:
                        by[m["n"]].append(m["kept"])
                    for n, shared in by.items():
                        least = window_keys(ids, n)[0].astype(np.int64)
                        found: dict[bytes, list[int]] = defaultdict(list)
                        for s in np.flatnonzero(np.isin(least, np.array(shared, np.int64))).tolist():
                            found[b" ".join(words[s : s + n])].append(s)
                        yield pa.RecordBatch.from_pydict({"k": [r["k"]] * len(found), "n": [n] * len(found), "words": [w.decode() for w in found], "starts": list(found.values())}, schema=_FOUND)

    owners = windows.groupBy("n", "words").agg(F.collect_set("item").alias("items"))
    hits = some.mapInArrow(candidates, "k binary, n int, words string, starts array<long>").join(owners, ["n", "words"])
    hits = hits.select("k", F.transform("starts", lambda s: F.struct(s.alias("first"), (s + F.col("n")).alias("behind"))).alias("spans"), "items")
    hits = hits.groupBy("k").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    @F.pandas_udf("array<struct<first:long,behind:long>>")
    def together(lists):  # noqa: ANN001, ANN202
        return lists.map(lambda xs: [{"first": a, "behind": b} for a, b in merged([(x["first"], x["behind"]) for x in xs])])

    hits = materialize(hits.select(F.col("k").alias("__h"), together("spans").alias("spans"), "items"))
    counted = map_texts(whole, "__t", [*keep, "__k"], lambda: lambda x: (len(words_of(x)),), "n_words long")
    joined = counted.join(hits, F.col("__k") == F.col("__h"), "left")
    empty = [F.array().cast(t) for t in ("array<struct<first:long,behind:long>>", "array<string>")]
    return joined.select(*keep, "n_words", F.coalesce("spans", empty[0]).alias("spans"), F.coalesce("items", empty[1]).alias("items"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per document (and keep's columns): n_words, n_hit, spans (of hit words), items (sorted ids as strings), contaminated.

    contaminated: some word is hit, and at least one in twenty. Items of more than WORD_BYTES * block_words bytes in all
    are joined by shuffles.
    """
    columns = [doc_id, *[c for c in keep if c != doc_id]]
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + 1), F.lit(0))).first()[0]
    if size <= WORD_BYTES * block_words:
        out = _by_broadcast(docs, [(r.i, r.t) for r in items.collect()], text, columns)
    else:
        out = _by_shuffle(docs, items, text, columns)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["behind"] - s["first"])
    out = out.withColumn("n_hit", n_hit)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination_digest(docs: DataFrame, benchmark: DataFrame, **more) -> DataFrame:
    """contamination() with the items counted and hashed."""
    out = contamination(docs, benchmark, **more)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )

