"""Tables with a key, kept in buckets of delta files.

An upsert writes its rows once, as a delta in the buckets of their keys; nothing else is rewritten. A manifest, one small
file for each version, lists the deltas of every bucket, oldest first, so readers see whole versions, whatever is being
written. Reading merges on the fly: of each field the newest value that is not null. A bucket with more than COMPACT
deltas is merged into one file when it is next written to. A look-up by keys reads their buckets only.

Upserts from a stream name their source and batch; the manifest remembers the last batch of each source, so a batch that
is run again changes nothing. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gazetta.scratch import file_system, materialize, remove
from gazetta.sources import store
from gazetta.streaming.stages import last_rows

#: Buckets of a table, deltas of a bucket before they are merged, versions that stay readable.
BUCKETS, COMPACT, KEEP = 32, 8, 3

#: The fields of an article's processed row that each step writes, with what stands for a missing value in its rows.
STEP_FIELDS: dict[str, dict[str, str | None]] = {
    "translate": {"translated_text": None, "translated_title": None, "source_language": None, "target_language": "'en'"},
    "embed": {"embedding": None},
    "tag": {"tags": "array()", "entities": "array()", "tag_categories": "map()"},
    "cluster": {"cluster_id": None},
    "summarize": {"summary": None},
}


def step_patch(df: DataFrame, step: str, key: str = "article_id") -> DataFrame:
    """The rows that a step upserts: key and its fields; fields that df lacks are null, and empty ones have the step's default."""
    if step not in STEP_FIELDS:
        raise ValueError(f"no step {step}; there are {', '.join(STEP_FIELDS)}")
    fields = []
    for name, default in STEP_FIELDS[step].items():
        c = F.col(name) if name in df.columns else F.lit(None)
        fields.append((c if default is None else F.coalesce(c, F.expr(default))).alias(name))
    return df.select(key, *fields)


class KeyedTable:
    """A table under a path. schema has its columns, with a key that is never null."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = BUCKETS, compact: int = COMPACT, keep: int = KEEP, stamp: str | None = None):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        self.buckets, self.compact, self.keep, self.stamp = buckets, compact, keep, stamp

    # -- versions

    def manifest(self) -> dict:
        """The newest version: its number, folders by bucket, and the last batch of each source."""
        found = store.versions(self.spark, f"{self.path}/versions")
        return json.loads(self.spark.read.text(found[-1]).first()[0]) if found else {"number": 0, "buckets": {}, "sources": {}, "size": self.buckets}

    def _save(self, manifest: dict) -> None:
        name = f"{self.path}/versions/v{manifest['number']:08d}-{uuid.uuid4().hex[:8]}"
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(name)
        found = store.versions(self.spark, f"{self.path}/versions")
        if len(found) > self.keep:
            held = {f for v in found[-self.keep :] for some in json.loads(self.spark.read.text(v).first()[0])["buckets"].values() for f in some}
            gone = {f for v in found[: -self.keep] for some in json.loads(self.spark.read.text(v).first()[0])["buckets"].values() for f in some} - held
            for v in found[: -self.keep]:
                remove(self.spark, v)
            self._drop(gone, held)

    def _drop(self, gone: set[str], held: set[str]) -> None:
        """Removes folders of buckets; a write of which none is held goes as a whole."""
        kept = {f.split("/")[0] for f in held}
        for f in {f if f.split("/")[0] in kept else f.split("/")[0] for f in gone}:
            remove(self.spark, f"{self.path}/data/{f}")

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    # -- writing

    def upsert(self, patch: DataFrame, source: str | None = None, batch: int | None = None) -> int:
        """Merges patch into the table; returns the version. Nulls never overwrite. A stamp column, if the table has one, gets the time.

        patch has some of the table's columns and at most one row for a key; rows without a key are left out, as are
        columns that the table lacks.
        """
        manifest = self.manifest()
        if source is not None and batch is not None and manifest["sources"].get(source, -1) >= batch:
            return manifest["number"]
        number = manifest["number"] + 1
        fields = []
        for f in self.schema.fields:
            c = F.current_timestamp() if f.name == self.stamp else F.col(f.name) if f.name in patch.columns else F.lit(None)
            fields.append(c.cast(f.dataType).alias(f.name))
        rows = patch.where(F.col(self.key).isNotNull()).select(*fields, F.lit(number).cast("long").alias("__seq"))
        delta = self._write(rows.withColumn("__b", self._bucket(F.col(self.key))))
        for bucket, folder in delta.items():
            manifest["buckets"].setdefault(bucket, []).append(folder)
        full = {b: some for b, some in manifest["buckets"].items() if len(some) > self.compact}
        if full:
            merged = self._merged(self._read(full)).withColumn("__seq", F.lit(number).cast("long"))
            for bucket, folder in self._write(merged.withColumn("__b", self._bucket(F.col(self.key)))).items():
                manifest["buckets"][bucket] = [folder]
        if source is not None and batch is not None:
            manifest["sources"][source] = batch
        self._save(manifest | {"number": number})
        self._drop({f for b, f in delta.items() if b in full}, {f for b, f in delta.items() if b not in full})
        return number

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """The folders of one write, by bucket."""
        name = uuid.uuid4().hex
        rows.repartition("__b").write.partitionBy("__b").parquet(f"{self.path}/data/{name}")
        fs, at = file_system(self.spark, f"{self.path}/data/{name}")
        found = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
        return {x.split("=")[1]: f"{name}/{x}" for x in found if x.startswith("__b=")}

    # -- reading

    def _read(self, buckets: dict[str, list[str]]) -> DataFrame:
        schema = StructType([*self.schema.fields]).add("__seq", "long")
        paths = [f"{self.path}/data/{f}" for some in buckets.values() for f in some]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _merged(self, rows: DataFrame) -> DataFrame:
        rest = [f.name for f in self.schema.fields if f.name != self.key]
        newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__seq"))).alias(c) for c in rest]
        return rows.groupBy(self.key).agg(*newest).select(*[f.name for f in self.schema.fields])

    def read(self) -> DataFrame:
        """The newest version. What is written later is not in it."""
        return self._merged(self._read(self.manifest()["buckets"]))

    def get(self, keys: list) -> DataFrame:
        """The rows of some keys, from their buckets alone."""
        kind = self.schema[self.key].dataType
        asked = self.spark.createDataFrame([(k,) for k in keys], StructType().add(self.key, kind))
        wanted = {str(r.b) for r in asked.select(self._bucket(F.col(self.key)).alias("b")).distinct().collect()}
        some = {b: f for b, f in self.manifest()["buckets"].items() if b in wanted}
        return self._merged(self._read(some).where(F.col(self.key).isin(keys)))

    def folders(self) -> dict[str, int]:
        """How many files' folders each bucket has."""
        return {b: len(some) for b, some in self.manifest()["buckets"].items()}


def written_by_stream(table: KeyedTable, source: str):  # noqa: ANN201
    """A step for foreachBatch that upserts each micro-batch once; of several rows with a key the last by its JSON text counts."""
    from gazetta.streaming.stages import last_rows

    def step(batch: DataFrame, number: int) -> None:
        table.upsert(materialize(last_rows(batch, table.key)), source, number)

    return step
