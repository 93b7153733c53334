"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64-bit majorities over the hashes of word shingles. Links (few differing bits) are found around
anchors: the words of a covering code. The code is a direct sum of three binary Golay codes of length 23, which are
perfect with covering radius 3, over all bits of the fingerprint (the last block has 18 of them and 5 zeros): 2 ** 36
anchors. Every fingerprint has its home, the nearest anchor, and is copied to the anchors within covering radius plus
threshold that some fingerprint within the threshold of it has as its home. So each link meets at the home of either
end, and homes are compared with copies there, never copies with copies.

Only distinct fingerprints take part; documents with one fingerprint are one vertex from the start. Components are
the least label over links, by rounds of neighbours' least labels and pointer jumps on tables in the shared folder. A
vertex with many links, or a label with many vertices, is looked up apart (see lookup), so neither fills one task.

Defined results: a text without words (null, empty, blanks) has fingerprint zero and links like any other; fewer
words than a shingle has are one shingle; repeated rows repeat their result; null ids are ignored when a component
is named, and a component of null ids alone has a null name; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.pandas.types import to_arrow_schema

from gazetta.llm.common import map_texts, materialize

SHINGLE, BITS, DIFFERING, SEED = 3, 64, 2, 42
#: Hashes whose bits are counted at once.
BLOCK = 65_536
#: The Golay code's length, its generator polynomial (fixed value) and the number of its syndromes.
LENGTH, GENERATOR, SYNDROMES = 23, 0b101011100011, 1 << 11
#: The lowest bit and the width of the blocks within the fingerprint.
BLOCKS = ((0, 23), (23, 23), (46, 18))
#: A key with at least one in so many of the rows is hot: there are at most so many.
HOT = 1_000


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of the space-joined shingles of an A-Z-lower-cased text's words, with repeats."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest, n = xxhash.xxh64_intdigest, len(words) - size + 1
    if n <= 1:
        return np.array([digest(joined, SEED)], np.uint64)
    behind = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *behind[: n - 1].tolist()]
    ends = (behind[size - 1 :] - 1).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Bits that are set in over half of the shingles' hashes, as a signed 64-bit number."""
    h = shingle_hashes(text, size)
    if not len(h):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), BLOCK):
        part = h[at : at + BLOCK]
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = SHINGLE) -> DataFrame:
    """keep's columns and fp, the signed 64-bit fingerprint."""

    def make():
        return lambda x: (fingerprint(x, size),)

    return map_texts(docs, text, list(keep), make, "fp long")


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    rest = words.astype(np.uint64)
    for bit in range(LENGTH - 1, 10, -1):
        rest = np.where(rest >> np.uint64(bit) & np.uint64(1), rest ^ np.uint64(GENERATOR << (bit - 11)), rest)
    return rest


@cache
def leaders() -> np.ndarray:
    """By syndrome: the step to the nearest code word."""
    leader = np.zeros(SYNDROMES, np.uint64)
    for level in (_flips(LENGTH, n) for n in range(4)):
        e = np.array(level, np.uint64)
        leader[syndrome(e).astype(np.int64)] = e
    return leader


def _flips(width: int, n: int) -> list[int]:
    """All words of n bits among the lowest width ones."""
    return [sum(1 << i for i in some) for some in combinations(range(width), n)]


@cache
def cells(threshold: int, width: int = LENGTH) -> list[np.ndarray]:
    """By number of flipped bits (of the lowest width) up to threshold, and by syndrome: the steps to code words that first
    become the nearest with so many flips. Rows are filled up with -1."""
    leader = leaders()
    seen: list[set[int]] = [set() for _ in range(SYNDROMES)]
    steps: list[np.ndarray] = []
    for cost in range(threshold + 1):
        e = np.array(_flips(width, cost), np.uint64)
        moved = syndrome(e).astype(np.int64)
        fresh = []
        for s in range(SYNDROMES):
            new = set((e ^ leader[s ^ moved]).tolist()) - seen[s]
            seen[s] |= new
            fresh.append(sorted(new))
        wide = max(map(len, fresh))
        steps.append(np.array([[*f, *[-1] * (wide - len(f))] for f in fresh], np.int64).reshape(SYNDROMES, wide))
    return steps


def anchors(fps: np.ndarray, threshold: int = DIFFERING, blocks: tuple[tuple[int, int], ...] = BLOCKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Homes; and for copies, the place of each in fps and its anchor.

    A code word is named by its upper 12 bits, which determine it; an anchor by its words' names side by side.
    """
    leader, check = leaders(), np.uint64(LENGTH - 12)
    parts = [fps >> np.uint64(at) & np.uint64((1 << width) - 1) for at, width in blocks]
    marks = [syndrome(p).astype(np.int64) for p in parts]

    def named(words: np.ndarray, k: int) -> np.ndarray:
        return words >> check << np.uint64(12 * k)

    home = np.zeros(len(fps), np.uint64)
    for k, (p, m) in enumerate(zip(parts, marks, strict=True)):
        home |= named(p ^ leader[m], k)
    places, found = [], []
    for costs in product(range(threshold + 1), repeat=len(blocks)):
        if sum(costs) > threshold:
            continue
        place, anchor = np.arange(len(fps)), np.zeros(len(fps), np.uint64)
        for k, (cost, p, m, (_, width)) in enumerate(zip(costs, parts, marks, blocks, strict=True)):
            step = cells(threshold, width)[cost][m[place]]
            row, column = np.nonzero(step >= 0)
            words = p[place[row]] ^ step[row, column].astype(np.uint64)
            place, anchor = place[row], anchor[row] | named(words, k)
        places.append(place)
        found.append(anchor)
    return home, np.concatenate(places), np.concatenate(found)


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.column(0).slice(at, rows).to_numpy(zero_copy_only=False).astype(np.int64)


_ANCHORED = StructType([StructField("anchor", LongType()), StructField("fp", LongType())])


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for fps in _batches(batches):
        home, _, _ = anchors(fps.view(np.uint64), 0)
        yield pa.RecordBatch.from_arrays([pa.array(home.view(np.int64)), pa.array(fps)], schema=to_arrow_schema(_ANCHORED))


def links(distinct: DataFrame, threshold: int = DIFFERING) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) that differ in at most threshold bits; each pair once."""

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps in _batches(batches, 1024):
            _, place, anchor = anchors(fps.view(np.uint64), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fps[place])], schema=to_arrow_schema(_ANCHORED))

    homes = distinct.select("fp").mapInArrow(_homes, _ANCHORED).select("anchor", F.col("fp").alias("a"))
    spread = distinct.select("fp").mapInArrow(copies, _ANCHORED).select("anchor", F.col("fp").alias("b"))
    # A copy meets its partner at the partner's home: a pair is seen from both ends, and the smaller one's home keeps it.
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    # always by a shuffle: Spark sizes both sides by distinct's rows and not by their copies, so it may broadcast over a hundred times what it allows
    return homes.hint("merge").join(spread, (homes["anchor"] == spread["anchor"]) & near).select("a", "b")


def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """The keys that at least one in HOT rows have, at most HOT of them, as a small table; None without any."""
    counts = rows.groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("__n"))
    total = rows.count()
    found = counts.where((F.col("__n") * HOT >= total) & (F.col("__n") > 1)).select("__hot").collect()
    return rows.sparkSession.createDataFrame(found, counts.select("__hot").schema) if found else None


def lookup(rows: DataFrame, key: str, table: DataFrame, hot: DataFrame | None) -> DataFrame:
    """rows joined with table's row of their key (its columns __key, unique, and others); rows without one go.

    Hot keys are at most HOT by their definition, so their rows of the table are broadcast; the others are joined by a shuffle.
    """
    if hot is None:
        return rows.join(table, rows[key] == table["__key"]).drop("__key")
    some = F.broadcast(table.join(F.broadcast(hot), table["__key"] == hot["__hot"], "left_semi"))
    many = rows.join(some, rows[key] == some["__key"]).drop("__key")
    few = rows.join(F.broadcast(hot), rows[key] == hot["__hot"], "left_anti")
    return many.unionByName(few.join(table, few[key] == table["__key"]).drop("__key"))


def components(edges: DataFrame, vertex: str = "v", rounds: int = 64) -> DataFrame:
    """Component of each vertex of edges (columns a, b): the least vertex that can be reached from it.

    Each round, a vertex takes the least label among its own and its neighbours', and then its label's label, so labels
    at least halve their distance to the least one along settled chains. Ends when a round changes nothing.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    many = hot_keys(both, "b")
    labels = materialize(both.groupBy(F.col("a").alias(vertex)).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    for _ in range(rounds * 1_000):
        table = labels.select(F.col(vertex).alias("__key"), F.col("label").alias("near"))
        near = lookup(both, "b", table, many).groupBy("a").agg(F.min("near").alias("near"))
        taken = materialize(labels.join(near, labels[vertex] == near["a"]).select(vertex, F.col("label").alias("old"), F.least("label", "near").alias("label")))
        table = taken.select(F.col(vertex).alias("__key"), F.col("label").alias("up"))
        jumped = lookup(taken, "label", table, hot_keys(taken, "label"))
        jumped = materialize(jumped.select(vertex, "old", F.least("label", "up").alias("label")))
        if not jumped.where(F.col("old") != F.col("label")).limit(1).count():
            return jumped.select(vertex, "label")
        labels = jumped.select(vertex, "label")
    raise RuntimeError("components did not settle")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = DIFFERING, size: int = SHINGLE
) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id (the least doc_id in reach), n_links.

    n_links counts the other distinct fingerprints that the row's own one links to.
    """
    marked = materialize(fingerprints(docs, text, (doc_id,), size))
    least = materialize(marked.groupBy("fp").agg(F.min(doc_id).alias("least")))
    edges = materialize(links(least, threshold))
    degrees = edges.select(F.col("a").alias("v")).unionByName(edges.select(F.col("b").alias("v"))).groupBy("v").agg(F.count("*").alias("links"))
    joined = components(edges)
    named = joined.join(least, joined["v"] == least["fp"]).groupBy(F.col("label").alias("__key")).agg(F.min("least").alias("component_id"))
    linked = lookup(joined, "label", named, hot_keys(joined, "label")).select("v", "component_id").join(degrees, "v")
    per_fp = materialize(  # so that the last join reads both sides plainly, and a fingerprint with many rows can be split
        least.join(linked, least["fp"] == linked["v"], "left").select(
            F.col("fp").alias("__fp"), F.coalesce("component_id", "least").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links")
        )
    )
    return marked.join(per_fp, marked["fp"] == per_fp["__fp"]).select(
        doc_id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links"
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = DIFFERING, size: int = SHINGLE) -> DataFrame:
    """One row of docs of each component: the least doc_id (null only if there is no other), then the least hash of the text.

    Components are named by fingerprints and rows are found by id and text, so null and repeated ids do not mix them.
    """
    hashed = F.coalesce(F.sha2(F.col(text), 256), F.lit(""))
    marked = fingerprints(docs.select(doc_id, text, hashed.alias("__hash")), text, (doc_id, "__hash"), size)
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("__hash").alias("hash"))
    first = materialize(marked.groupBy("fp").agg(F.min(order).alias("first")))
    joined = components(links(first, threshold))
    label = F.coalesce(joined["label"], first["fp"]).alias("__label")
    kept = first.join(joined, first["fp"] == joined["v"], "left").groupBy(label).agg(F.min("first").alias("f"))
    kept = kept.select(F.col("f.id").alias("__kept"), F.col("f.hash").alias("__kept_hash"))
    rows = docs.withColumn("__hash", hashed)
    rows = rows.join(kept, F.col(doc_id).eqNullSafe(F.col("__kept")) & (F.col("__hash") == F.col("__kept_hash")), "left_semi")
    return rows.dropDuplicates([doc_id, "__hash"]).drop("__hash")


def hex_words(text: str) -> list[str]:
    """The words that shingles are made of, as the rule states them; for tests."""
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
