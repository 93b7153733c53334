"""Periodic runs of words by partition refinement.

Positions whose next q words agree form a class of level q. A class of level q + 1 holds the positions of one class of
level q whose successors lie in one class too, so classes are refined by taking the predecessors of a class out of theirs.
Of the parts into which a class falls the largest need not be looked at (its predecessors stay where they are), so every
position is handled at most log n times: the smaller-half strategy. The members of a class are linked in text order; two
neighbours at distance q in a class of level q are a square of period q with a primitive root, and squares of one period
at successive places are one run: a maximal stretch with that smallest period.

The texts of a slice are refined together, each with words of its own and a separator between them, so no class spans
two texts. The first DENSE levels, where most positions are in classes, sort all positions of classes in numpy; the
further ones follow the smaller halves. Only periods up to a third of the longest text are looked for.

Defined results: null, empty and blank texts have no words and no runs; a document without an id is not altered by
`planted`; equal rows have equal results; a text of one repeated word is one run of period 1.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from gazetta.llm.common import SLICE, _cuts

#: Words that a run has at least, and periods.
LEAST, TIMES = 24, 3
#: Levels that are refined by sorting; characters of texts that are refined together, or one longer text.
DENSE, TOGETHER = 5, 2_000_000

#: Start, length and period of a run, in words.
Run = tuple[int, int, int]


class Classes:
    """The classes of one level with several members, refined level by level; members are linked in text order."""

    def __init__(self, level: int, classes: list[list[int]], most: int):
        self.level, self.most = level, most
        self.of: dict[int, int] = {}
        self.after: dict[int, int] = {}
        self.before: dict[int, int] = {}
        self.size: list[int] = []
        self.head: list[int] = []
        #: By distance: places whose neighbour was found so far behind. They count if that still holds at that level.
        self.due: dict[int, list[int]] = defaultdict(list)
        self.squares: dict[int, list[int]] = {}
        for members in classes:
            self._add(members)
        #: What the next level is split by: classes, and places that are alone in theirs.
        self.queue = classes
        self.alone = [i + 1 for i in self.of if i + 1 not in self.of]

    def _add(self, members: list[int]) -> None:
        k = len(self.size)
        self.size.append(len(members))
        self.head.append(members[0])
        last = -1
        for i in members:
            self.of[i] = k
            self.before[i] = last
            if last >= 0:
                self.after[last] = i
                if self.level < i - last <= self.most:
                    self.due[i - last].append(last)
            last = i
        self.after[last] = -1

    def _take(self, i: int, k: int) -> None:
        """Takes i out of its class k; its neighbours become neighbours."""
        a, b = self.before[i], self.after[i]
        if a >= 0:
            self.after[a] = b
        else:
            self.head[k] = b
        if b >= 0:
            self.before[b] = a
            if a >= 0 and self.level <= b - a <= self.most:
                self.due[b - a].append(a)
        self.size[k] -= 1

    def _leave(self, i: int) -> None:
        del self.of[i], self.after[i], self.before[i]

    def _members(self, k: int) -> list[int]:
        out, i = [], self.head[k]
        while i >= 0:
            out.append(i)
            i = self.after[i]
        return out

    def refine(self) -> None:
        """One level further; the squares of that period are then in squares."""
        self.level += 1
        level, most, of = self.level, self.most, self.of
        parts: dict[int, list[int]] = {}
        gone: list[int] = []
        for i in self.alone:
            k = of.get(i - 1)
            if k is not None:
                self._take(i - 1, k)
                self._leave(i - 1)
                gone.append(i - 1)
                parts.setdefault(k, [])
        for members in self.queue:
            new: dict[int, int] = {}
            tails: dict[int, int] = {}
            for i in members:
                j = i - 1
                k = of.get(j)
                if k is None:
                    continue
                self._take(j, k)
                e = new.get(k)
                if e is None:
                    e = new[k] = len(self.size)
                    self.size.append(0)
                    self.head.append(j)
                    parts.setdefault(k, []).append(e)
                    self.before[j] = -1
                else:
                    last = tails[e]
                    self.after[last] = j
                    self.before[j] = last
                    if level <= j - last <= most:
                        self.due[j - last].append(last)
                self.after[j] = -1
                tails[e] = j
                of[j] = e
                self.size[e] += 1
        self.queue, self.alone = [], gone
        for k, split in parts.items():
            split.append(k)
            largest = max(split, key=self.size.__getitem__)
            for e in split:
                if self.size[e] == 1:
                    self.alone.append(self.head[e])
                    self._leave(self.head[e])
                elif e != largest and self.size[e]:
                    self.queue.append(self._members(e))
        found = [i for i in self.due.pop(level, ()) if self.after.get(i) == i + level]
        if found:
            self.squares[level] = found


def squares(ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of all squares with a primitive root and a period up to most."""
    places, periods = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    key, at = ids.astype(np.int64), np.arange(len(ids))
    cls = np.full(len(ids) + 1, -1, np.int64)
    starts = at[:0]
    for level in range(1, min(DENSE, most) + 1):
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        new = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        sizes = np.diff(new, append=len(key))
        several = np.repeat(sizes > 1, sizes)
        at = at[several]
        sizes = sizes[sizes > 1]
        starts = np.cumsum(sizes) - sizes
        number = np.repeat(np.arange(len(sizes)), sizes)
        near = np.flatnonzero((np.diff(at) == level) & (np.diff(number) == 0))
        places.append(at[near])
        periods.append(np.full(len(near), level))
        if level < min(DENSE, most):
            cls[:] = -1
            cls[at] = number
            both = np.flatnonzero((cls[:-1] >= 0) & (cls[1:] >= 0))
            key, at = cls[both] * len(sizes) + cls[both + 1], both
    if most > DENSE and len(starts):
        members = at.tolist()
        ends = [*starts[1:].tolist(), len(members)]
        classes = Classes(DENSE, [members[a:b] for a, b in zip(starts.tolist(), ends, strict=True)], most)
        while classes.of and classes.level < most:
            classes.refine()
        for period, found in classes.squares.items():
            places.append(np.unique(np.array(found, np.int64)))
            periods.append(np.full(len(places[-1]), period))
    return np.concatenate(places), np.concatenate(periods)


def runs_of(sequences: list[list], least: int = LEAST, times: int = TIMES) -> list[list[Run]]:
    """The runs of each sequence of words: maximal stretches of least words or more and times periods or more, by start, then period."""
    parts, lengths, base = [], [], 0
    for words in sequences:
        table: dict = {}
        known = table.setdefault
        # each sequence has numbers of its own, so its words are in classes with no others; the last one is its separator
        own = [known(w, len(table)) for w in words]
        own.append(len(table))
        parts.append(np.array(own, np.int64) + base)
        base += len(table) + 1
        lengths.append(len(words))
    out: list[list[Run]] = [[] for _ in sequences]
    if not parts:
        return out
    most = max(lengths) // times
    if most < 1 or max(lengths) < least:
        return out
    place, period = squares(np.concatenate(parts), most)
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    first = np.flatnonzero((np.diff(place, prepend=-2) != 1) | (np.diff(period, prepend=0) != 0))
    last = np.append(first[1:], len(place)) - 1
    start, q = place[first], period[first]
    length = place[last] - start + 2 * q
    long = np.flatnonzero(length >= np.maximum(least, times * q))
    start, q, length = start[long], q[long], length[long]
    begins = np.cumsum([0, *(n + 1 for n in lengths)])
    whose = np.searchsorted(begins, start, "right") - 1
    for i in np.lexsort((q, start)).tolist():
        d = int(whose[i])
        out[d].append((int(start[i] - begins[d]), int(length[i]), int(q[i])))
    return out


def highest(runs: list[Run]) -> Run | None:
    """The run of greatest length / period; of several the first, then that of the smallest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    held = np.ones(len(words), bool)
    for start, length, period in runs:
        held[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(held).tolist()]


def words_of(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ in UTF-8."""
    return text.encode().split()


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, of one document in ten with a periodic end whose place and period its id decides."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def map_runs(
    docs: DataFrame, one: Callable[[list[bytes], list[Run]], tuple], schema: str, doc_id: str = "doc_id", text: str = "text", alter: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
    least: int = LEAST, times: int = TIMES,
) -> DataFrame:
    """doc_id and what one returns for each document's words and runs. alter may change the words by the document's id first."""
    fields = docs.select(doc_id).schema.fields
    extra: StructType = _parse_datatype_string(schema)
    out = StructType([*fields, *extra.fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                whole = batch.slice(at, SLICE)
                ids, texts = whole.column(0).to_pylist(), whole.column(1).to_pylist()
                for a, b in _cuts(texts, TOGETHER):
                    words = [words_of(x or "") for x in texts[a:b]]
                    if alter is not None:
                        words = [alter(i, w) for i, w in zip(ids[a:b], words, strict=True)]
                    rows = [one(w, r) for w, r in zip(words, runs_of(words, least, times), strict=True)]
                    new = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), arrow.types[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([whole.column(0).slice(a, b - a).cast(arrow.types[0]), *new], schema=arrow)

    return docs.select(F.col(doc_id), F.col(text).alias("__text")).mapInArrow(run, out)


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, runs (start, length, period, in words) and collapsed: the words, each run cut to its first period."""

    def one(words: list[bytes], runs: list[Run]) -> tuple:
        return [{"start": s, "length": n, "period": q} for s, n, q in runs], b" ".join(collapsed(words, runs)).decode()

    return map_runs(docs, one, "runs array<struct<start:long,length:long,period:long>>, collapsed string", doc_id, text, least=least, times=times)


def run_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each document, with a periodic end planted in one of ten: n_runs, the highest run, hashes of all runs and of what is left."""

    def one(words: list[bytes], runs: list[Run]) -> tuple:
        start, length, period = highest(runs) or (None, None, None)
        milli = 1000 * length // period if period else None
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        return (
            len(runs), start, length, period, milli,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest(),
        )

    columns = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return map_runs(docs, one, columns, doc_id, text, alter=planted)
