"""A stored index of vectors that searches exactly.

Unit vectors lie in cells: folders of Parquet files by nearest centre. Of each cell the table `cells` keeps the centre, the
number of vectors and the radius, the largest angle between the centre and a vector in it. Angles between unit vectors obey the
triangle inequality, so no vector of a cell is nearer to a query than their angle to the centre less the radius. A search reads the
cells by nearness until it has k vectors, and then only those that may hold a better one than the k-th: the result is that of a scan.

Added vectors are first kept in a folder of their own, which every search reads; once there are FLUSH of them they are
put into cells, whose radii grow as needed. Vectors are never rewritten. `cells` is kept in versions, and a vector file counts
only if the newest version names the write that made it, so an add that failed half-way leaves nothing behind. One writer at a time.

Vectors of another size, with nulls or not finite are rejected and counted; zero vectors have similarity 0 to all and are in cell -1;
duplicates stay.
"""

from __future__ import annotations

import json
import math
import uuid

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.functions import vectors as V
from gazetta.operators.clusters import assign_to_centers
from gazetta.scratch import file_system, materialize, remove
from gazetta.sources import store

#: Added vectors that are put into cells together; vectors that centres are fitted on; vectors of a cell, about; cells at most.
FLUSH, FITTED, PER_CELL, CELLS = 100, 100_000, 1_000, 4_096
#: Angles are compared with this much room for rounding.
ROOM = 1e-6
NEW = -2


def valid(vector: str, size: int) -> Column:
    return V.valid(F.col(vector), size) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


class VectorIndex:
    """An index under a path. state: its key column and type, size, and counts of what was stored, rejected and added."""

    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self.state = spark, path, state
        #: Of the last search: cells and files that were read, and that there are.
        self.read: dict[str, int] = {}

    # -- making and keeping

    @classmethod
    def create(cls, spark: SparkSession, path: str, df: DataFrame, key: str, vector: str, size: int, cells: int | None = None, seed: int = 7) -> VectorIndex:
        """A new index of df's vectors. Centres are fitted on about FITTED of them at most, drawn evenly; all are stored."""
        good = df.where(valid(vector, size))
        n, rejected = good.count(), df.count()
        rejected -= n
        index = cls(spark, path, {"key": key, "vector": vector, "kind": df.schema[key].dataType.simpleString(), "size": size, "stored": 0, "rejected": rejected, "inserts": 0, "writes": [], "version": 0})
        k = max(1, min(cells or n // PER_CELL or 1, CELLS, n or 1))
        unit = good.select(key, V.unit(F.col(vector)).alias("unit"))
        points = (unit if n <= FITTED else unit.sample(FITTED / n, seed)).where(V.norm(F.col("unit")) > 0)
        centers = [[1.0] + [0.0] * (size - 1)]
        if k > 1:
            model = KMeans(k=k, seed=seed, maxIter=20).fit(points.withColumn("features", array_to_vector("unit")))
            centers = [c.tolist() for c in model.clusterCenters() if np.linalg.norm(c) > 0] or centers
        index.centers = spark.createDataFrame([(i, c) for i, c in enumerate(centers)], "cell int, center array<double>")
        index._put(unit, n)
        return index

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        """The index that is stored under a path; without one this is an error."""
        found = store.versions(spark, f"{path}/state")
        if not found:
            raise FileNotFoundError(f"no index under {path}")
        index = cls(spark, path, json.loads(spark.read.text(found[-1]).first()[0]))
        index.centers = index._cells().where("cell >= 0").select("cell", "center")
        return index

    def _save(self) -> None:
        """A new version of the state: from here on what was written before counts."""
        self.state["version"] += 1
        name = f"{self.path}/state/v{self.state['version']:08d}-{uuid.uuid4().hex[:8]}"
        self.spark.createDataFrame([(json.dumps(self.state),)], "value string").coalesce(1).write.text(name)
        for old in store.versions(self.spark, f"{self.path}/state")[:-2]:
            remove(self.spark, old)

    def _cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells/{self.state['cells']}")

    def _put(self, unit: DataFrame, count: int) -> None:
        """Unit vectors into their cells, by one write; the table of cells is made anew from the old one and what came."""
        key, write = self.state["key"], uuid.uuid4().hex
        zero = F.coalesce(V.norm(F.col("unit")) == 0, F.lit(False))
        kept = materialize(unit.withColumn("__n", F.monotonically_increasing_id()))
        near = assign_to_centers(kept.where(~zero), self.centers, "__n", "cell", "unit", -2.0)
        placed = kept.join(near, "__n", "left").select(key, "unit", F.coalesce(F.when(zero, F.lit(-1)), "cell").alias("cell"), "similarity")
        placed.select(key, "unit", "cell").write.partitionBy("cell").parquet(f"{self.path}/vectors/{write}")
        angle = F.when(F.col("cell") >= 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "similarity"))))
        came = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max(angle).alias("radius"))
        old = self._cells().select("cell", "n", "radius") if "cells" in self.state else came.limit(0)
        both = old.unionByName(came).groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
        whole = self.centers.join(both, "cell", "full").select("cell", "center", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("radius", F.lit(0.0)).alias("radius"))
        whole.write.parquet(f"{self.path}/cells/{write}")
        self.state["cells"] = write
        self.state["writes"].append(write)
        self.state["stored"] += count
        self._save()

    # -- adding

    def add(self, df: DataFrame) -> int:
        """Adds df's vectors; returns how many. They are searched at once, and put into cells when FLUSH have come."""
        key, vector, size = self.state["key"], self.state["vector"], self.state["size"]
        rows = materialize(df.select(key, vector, valid(vector, size).alias("good")))
        counts = rows.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).first()
        self.state["rejected"] += counts.bad
        if not counts.good:
            self._save()
            return 0
        write = uuid.uuid4().hex
        rows.where("good").select(key, V.unit(F.col(vector)).alias("unit")).write.parquet(f"{self.path}/new/{write}")
        waiting = self.state.setdefault("new", {})
        waiting[write] = counts.good
        self.state["inserts"] += counts.good
        if sum(waiting.values()) >= FLUSH:
            rest, n = self._new(), sum(waiting.values())
            self.state["new"] = {}
            self._put(rest, n)
            for name in waiting:
                remove(self.spark, f"{self.path}/new/{name}")
        else:
            self._save()
        return counts.good

    def _schema(self) -> str:
        return f"{self.state['key']} {self.state['kind']}, unit array<double>"

    def _new(self) -> DataFrame:
        paths = [f"{self.path}/new/{w}" for w in self.state.get("new", {})]
        return self.spark.read.schema(self._schema()).parquet(*paths) if paths else self.spark.createDataFrame([], self._schema())

    # -- searching

    def _files(self, cells: list[int]) -> list[str]:
        """The folders of some cells, of all writes that count."""
        fs, _ = file_system(self.spark, self.path)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        found = [f"{self.path}/vectors/{w}/cell={c}" for w in self.state["writes"] for c in cells]
        return [p for p in found if fs.exists(path(p))]

    def _top(self, folders: list[str], query: list[float], k: int) -> list[tuple]:
        """The k best of some folders and of what is new: (rounded similarity, key)."""
        rows = self._new()
        if folders:
            rows = rows.unionByName(self.spark.read.schema(self._schema()).parquet(*folders))
        q = F.array(*map(F.lit, query))
        # the norms are 1 (or 0): a product is the cosine
        scored = rows.select(self.state["key"], V.rescaled(V.dot(F.col("unit"), q)).alias("similarity"))
        return [tuple(r) for r in scored.orderBy(F.desc("similarity"), self.state["key"]).limit(k).collect()]

    def search(self, query: list[float], k: int = 5) -> DataFrame:
        """key and similarity (rescaled to [0, 1], 4 places) of the k nearest; a query of another size finds nothing."""
        key, kind = self.state["key"], self.state["kind"]
        schema = f"{key} {kind}, similarity double"
        self.read = {"cells": 0, "of_cells": 0, "folders": 0}
        q = np.array(query, float)
        if len(q) != self.state["size"] or not np.isfinite(q).all() or k < 1:
            return self.spark.createDataFrame([], schema)
        norm = float(np.sqrt(q @ q))
        unit = (q / norm if norm else q).tolist()
        best: dict[int, float] = {}
        sizes: dict[int, int] = {}
        for r in self._cells().where("n > 0").collect():
            sizes[r.cell] = r.n
            if r.cell < 0 or not norm:
                best[r.cell] = 0.0
                continue
            c = np.array(r.center)
            angle = math.acos(max(-1.0, min(1.0, float(c @ unit / np.sqrt(c @ c)))))
            best[r.cell] = math.cos(max(0.0, angle - r.radius - ROOM))
        order = sorted(best, key=lambda c: (-best[c], c))
        first, held = [], 0
        for c in order:
            if held >= k:
                break
            first.append(c)
            held += sizes[c]
        found = self._top(self._files(first), unit, k)
        least = found[k - 1][1] if len(found) >= k else -1.0
        # a cell counts if its best possible similarity, rounded, is not below the k-th
        more = [c for c in order if c not in first and round((best[c] + 1) / 2 + ROOM, 4) >= least]
        if more:
            found = self._top(self._files(first + more), unit, k)
        read = first + more
        self.read = {"cells": len(read), "of_cells": len(order), "folders": len(self._files(read))}
        return self.spark.createDataFrame(found, schema)

    # -- the rest

    def stats(self) -> dict[str, int]:
        return {"total_vectors": self.state["stored"] + sum(self.state.get("new", {}).values()), "dimension": self.state["size"], "insert_count": self.state["inserts"], "rejected": self.state["rejected"]}

    def clear(self) -> None:
        """All vectors go; the centres stay for what is added later."""
        self.state |= {"stored": 0, "inserts": 0, "rejected": 0, "new": {}}
        gone, self.state["writes"] = self.state["writes"], []
        write = uuid.uuid4().hex
        self.centers.select("cell", "center", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("radius")).write.parquet(f"{self.path}/cells/{write}")
        self.state["cells"] = write
        self._save()
        for w in gone:
            remove(self.spark, f"{self.path}/vectors/{w}")
