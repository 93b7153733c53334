"""What the operators share: Arrow row maps and what a worker keeps. Scratch tables are those of gazetta.scratch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from gazetta.scratch import materialize, shared_dir

__all__ = ["SLICE", "Remembered", "map_slices", "map_texts", "materialize", "once_per_worker", "shared_dir", "table"]

#: Rows of an Arrow batch that become Python objects at once.
SLICE = 256
#: What a worker process keeps from task to task, by key; so many at most.
_KEPT: dict[str, object] = {}
KEPT = 4

T = TypeVar("T")


def once_per_worker(key: str, make: Callable[[], T]) -> T:
    """make()'s result, made once in each worker process and kept for its later tasks; the oldest of KEPT leave."""
    if key not in _KEPT:
        while len(_KEPT) >= KEPT:
            del _KEPT[next(iter(_KEPT))]
        _KEPT[key] = make()
    return _KEPT[key]


class Remembered(dict):
    """make(key) by key: the fixed ones, and up to most others in two generations, so that frequent ones stay.

    Keys longer than longest are made each time.
    """

    def __init__(self, make: Callable[[str], object], most: int, longest: int, fixed: dict[str, object] | None = None):
        super().__init__(fixed or {})
        self.make, self.most, self.longest, self.fixed = make, most, longest, fixed or {}
        self.older: dict[str, object] = {}

    def __missing__(self, key: str):  # noqa: ANN204
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= len(self.fixed) + self.most // 2:
                self.older = dict(self)
                self.clear()
                self.update(self.fixed)
            self[key] = value
        return value


def map_texts(
    df: DataFrame, text: str, keep: list[str], make: Callable[[], Callable[[str], tuple]], schema: str
) -> DataFrame:
    """One row per row of df: the columns of keep, then what make()'s function returns for the text (null: empty).

    make runs once per task, in the worker. Rows pass in slices, so memory follows SLICE texts and not the batch.
    """

    def many() -> Callable[[list], list[tuple]]:
        one = make()
        return lambda texts: [one(x or "") for x in texts]

    return map_slices(df, text, keep, many, schema)


def map_slices(
    df: DataFrame, column: str, keep: list[str], make: Callable[[], Callable[[list], list[tuple]]], schema: str, size: int | None = None
) -> DataFrame:
    """Like map_texts, but the function takes the values of a slice and returns their tuples.

    A slice has at most SLICE rows and, if size is given, about size bytes (or characters) of values, or one longer value.
    """
    fields = df.select(*keep).schema.fields
    extra: StructType = _parse_datatype_string(schema)
    out = StructType([*fields, *extra.fields])
    arrow = to_arrow_schema(out)
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                whole = batch.slice(at, SLICE)
                values = whole.column(width).to_pylist()
                for a, b in _cuts(values, size):
                    part = whole.slice(a, b - a)
                    new = [pa.array(c, type=t) for c, t in zip(zip(*many(values[a:b]), strict=True), arrow.types[width:], strict=True)]
                    old = [part.column(i).cast(arrow.types[i]) for i in range(width)]
                    yield pa.RecordBatch.from_arrays([*old, *new], schema=arrow)

    return df.select(*[F.col(c) for c in keep], F.col(column).alias("__text")).mapInArrow(run, out)


def _cuts(values: list, size: int | None) -> Iterator[tuple[int, int]]:
    at = held = 0
    for i, x in enumerate(values):
        n = len(x or "")
        if size is not None and held and held + n > size:
            yield at, i
            at, held = i, 0
        held += n + 1
    if values:
        yield at, len(values)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
