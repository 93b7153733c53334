"""Token counts by a two-tier lookup on the map side.

A text's count is the sum of its parts' counts (see pieces.PARTS: no piece of the vocabulary crosses a part's
border). A small table of frequent parts and their counts goes to every worker once, with one byte for each
count; parts that it lacks are encoded by the library and remembered by the worker process, over all its tasks.
Nothing is shuffled.

The frequent parts are those of about SAMPLE_ROWS rows, drawn evenly from the whole table whatever its order: each task counts
the parts of its drawn rows and sends its list to the driver. The table only moves work between the two tiers:
any part that it lacks is encoded, so every text is counted whole and exactly, whatever the table holds.

Defined results: null and empty texts have 0 tokens; a part longer than pieces.LONGEST is encoded and not kept.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetta.llm.common import SLICE, Remembered, map_texts, once_per_worker
from gazetta.llm.pieces import LONGEST, MARK, PARTS, default_model

#: How many frequent parts are broadcast (under 2 MB), and how many rows they come from, on average.
FREQUENT, SAMPLE_ROWS = 32_768, 2_000
#: Parts that a worker remembers besides.
CACHED = 400_000
#: Distinct parts that a task counts at once (rare ones leave), and those that it sends.
COUNTED, SENT = 262_144, 8_192


@cache
def _library(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model)


def count_part(library: sentencepiece.SentencePieceProcessor, part: str) -> int:
    """Tokens of one part. The library puts a space mark before a text: it stands for the part's own first one,
    and behind a line feed, which merges with nothing, the part is seen as it is in its text."""
    if part[0] in (" ", MARK):
        return len(library.encode(part[1:])) if len(part) > 1 else 1
    return len(library.encode("\n" + part)) - 2


class Lengths(Remembered):
    """Tokens by part: the frequent ones, and others that the worker met."""

    def __init__(self, model: str, frequent: dict[str, int]):
        library = _library(model)
        super().__init__(lambda part: count_part(library, part), CACHED, LONGEST, frequent)

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, PARTS.findall(f" {text}"))) if text else 0


def frequent_parts(docs: DataFrame, text: str, model: str, size: int = FREQUENT, rows: int = SAMPLE_ROWS, seed: int = 7) -> dict[str, int]:
    """Token counts of the most frequent parts of a sample; at most size parts.

    The driver gets at most SENT parts of each task with a drawn row, so at most rows * SENT, and in fact about those of rows texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for x in batch.column(0).slice(at, SLICE).to_pylist():
                    seen.update(p for p in PARTS.findall(f" {x}") if len(p) <= LONGEST)
                    if len(seen) > COUNTED:
                        seen = Counter(dict(seen.most_common(COUNTED // 2)))
        top = seen.most_common(SENT)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["part", "n"])

    some = docs.select(F.col(text).alias("t")).where(F.col("t").isNotNull())
    count = some.count()
    drawn = some if count <= rows else some.sample(rows / count, seed)
    total: Counter[str] = Counter()
    for r in drawn.mapInArrow(run, "part string, n long").collect():
        total[r.part] += r.n
    library = _library(model)
    return {part: count_part(library, part) for part, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:size]}


def count_tokens(
    docs: DataFrame, model: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 4096
) -> DataFrame:
    """keep's columns, n_bytes (UTF-8), n_tokens, over_limit (n_tokens above limit) of each whole text."""
    model = model or default_model()
    table = frequent_parts(docs, text, model)
    packed = docs.sparkSession.sparkContext.broadcast((list(table), bytes(min(n, 255) for n in table.values())))
    key = uuid.uuid4().hex

    def lengths() -> Lengths:
        names, sizes = packed.value
        return Lengths(model, {k: n for k, n in zip(names, sizes, strict=True) if n < 255})

    def make():
        count = once_per_worker(key, lengths).count

        def one(x: str) -> tuple:
            n = count(x)
            return len(x.encode()), n, n > limit

        return one

    return map_texts(docs, text, list(keep), make, "n_bytes long, n_tokens long, over_limit boolean")
