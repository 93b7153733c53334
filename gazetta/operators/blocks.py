"""All pairs of two tables of vectors, by blocks.

Both sides are dealt to blocks by a hash. A cell is one block of either side: its rows meet in one task, in matrix
products of bounded size. So nothing goes through the driver, memory follows the blocks, and a cell's result is for its caller to merge.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a block at most, on average; rows of the left side in one product.
BLOCK, ROWS = 4096, 512


def usable(df: DataFrame, vector: str, size: int) -> DataFrame:
    """Rows whose vector has size elements, none of them null."""
    return df.where(F.coalesce(F.size(vector) == size, F.lit(False)) & ~F.exists(vector, lambda x: x.isNull()))


def count_of(rows: int, block: int) -> int:
    """Blocks for so many rows."""
    return max(1, -(-rows // block))


def in_blocks(df: DataFrame, blocks: int, name: str) -> DataFrame:
    """Adds a row's block; equal rows have the same."""
    return df.withColumn(name, F.pmod(F.xxhash64(*df.columns), F.lit(blocks)).cast("int"))


def all_blocks(df: DataFrame, blocks: int, name: str) -> DataFrame:
    """A copy of each row for every block of the other side."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def block_join(left: DataFrame, right: DataFrame, blocks: tuple[int, int], cell: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType | str) -> DataFrame:
    """What cell returns for each pair of blocks; it gets the columns of left and right, __i and __j."""
    a = all_blocks(in_blocks(left, blocks[0], "__i"), blocks[1], "__j")
    # columns of its own, as left and right may be one table
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    b = all_blocks(in_blocks(right, blocks[1], "__j"), blocks[0], "__i")
    return a.groupBy("__i", "__j").cogroup(b.groupBy("__i", "__j")).applyInArrow(cell, schema)


def matrix(table: pa.Table, name: str, size: int) -> np.ndarray:
    """The vectors of a column, as rows."""
    flat = table.column(name).combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows over their norms; zero rows stay."""
    norms = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def distances(m: np.ndarray, point: np.ndarray) -> np.ndarray:
    """From each row of m to a point (or to its own row of points), by the same sums whatever else is in m, so that both directions agree to the last bit."""
    d = m - point
    return np.sqrt(np.einsum("ij,ij->i", d, d))
