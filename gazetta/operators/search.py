"""Nearest neighbours of a query set, exactly.

Queries and corpus meet by blocks (`blocks.block_join`): every cell keeps the best k of its corpus block for each of its
queries, and the final rank is taken by query over its cells. Neither side goes through the driver or is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gazetta.functions import vectors as V
from gazetta.operators import blocks as B

#: Rows of a block: with 1,024 elements each, 32 MB.
BLOCK = B.BLOCK
#: Rows of one product with centres.
ROWS = 2048


def matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the vectors that have size elements, and their places."""
    rows = column.to_pylist()
    good = np.array([i for i, x in enumerate(rows) if x is not None and len(x) == size and None not in x], int)
    m = np.array([rows[i] for i in good], np.float64).reshape(-1, size)
    norms = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0), good


def best_of(scores: np.ndarray, names: np.ndarray, own: object, k: int) -> list[tuple[float, object]]:
    """The k largest scores and their names (ties: the least name), without own."""
    # everything at least as good as the k-th (one more for the query itself) may be among the best
    edge = np.partition(scores, -(k + 1))[-(k + 1)] if len(scores) > k + 1 else -np.inf
    some = [(-float(scores[i]), names[i]) for i in np.flatnonzero(scores >= edge).tolist() if own is None or names[i] != own]
    return sorted(some)[:k]


def nearest(corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", size: int = 64, itself: bool = False, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """query_id, neighbour_id, similarity, rank: the k most similar rows of corpus for every query (ties: the least id).

    Similarities are rounded before they are ranked. Vectors of another size or with nulls are left out; zero vectors
    have similarity 0. A query is not its own neighbour unless itself is set. block bounds the rows of a block on either side.
    """
    left = B.usable(queries, vector, size).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    right = B.usable(corpus, vector, size).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    n, m = left.count(), right.count()
    # a corpus of few blocks is cut further, so that all cores have cells; queries of one block are sent once to each
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    shape = (B.count_of(n, block), max(B.count_of(m, block), min(cores, B.count_of(m, 256))))
    kind = corpus.schema[key].dataType
    schema = StructType().add("query_id", kind).add("neighbour_id", kind).add("similarity", "double")
    arrow = to_arrow_schema(schema)

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if a.num_rows and b.num_rows:
            q, c = B.unit_rows(B.matrix(a, "v", size)), B.unit_rows(B.matrix(b, "v", size))
            own, names = a.column("k").to_pylist(), b.column("k").to_pylist()
            for at in range(0, len(q), B.ROWS):
                for i, scores in enumerate(np.round(q[at : at + B.ROWS] @ c.T, digits) + 0.0, at):
                    rows += [(own[i], name, -s) for s, name in best_of(scores, names, None if itself else own[i], k)]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    found = B.block_join(left, right, shape, cell, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(corpus: DataFrame, query: list[float], k: int = 5, key: str = "vec_id", vector: str = "embedding", scaled: bool = True) -> DataFrame:
    """The k rows most similar to one vector; similarity rescaled to [0, 1] and rounded to 4 places if scaled.

    The vector is a literal, and top-k is taken per partition before rows move.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    raw = V.cosine(F.col(vector), q)
    similarity = V.rescaled(raw) if scaled else F.round(raw, 6)
    return corpus.where(V.valid(F.col(vector), len(query))).select(key, similarity.alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def stored_vectors(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Rows of the index: key and unit vector of every valid vector; duplicates stay."""
    return df.where(V.valid(F.col(vector), size)).select(key, V.unit(F.col(vector)).alias("unit"))


def projected(df: DataFrame, vector: str, k: int, out: str = "projected") -> DataFrame:
    """Adds the first k principal components of the valid vectors; the model is fitted on the whole table."""
    points = df.withColumn("__v", array_to_vector(V.doubles(F.col(vector))))
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(points)
    return model.transform(points).withColumn(out, vector_to_array("__p")).drop("__v", "__p")


def index_stats(df: DataFrame, vector: str, size: int) -> DataFrame:
    """One row: stored, rejected, dimension."""
    good = V.valid(F.col(vector), size)
    return df.agg(F.count_if(good).alias("stored"), F.count_if(~good).alias("rejected"), F.lit(size).alias("dimension"))
