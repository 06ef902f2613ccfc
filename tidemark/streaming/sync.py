"""A table that a stream is merged into, with the watermark of each source, resource and scope.

Rows lie in buckets of their key.  A commit writes anew the buckets that a micro-batch touches, and the
watermarks, to folders of its own, and then one manifest that names what is current; the manifest appears by
one rename, so rows and watermarks are committed together or not at all.  A batch that failed on its way left
folders that no manifest names; a batch that is replayed after its commit is told by its number and skipped.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.history import upsert

MARKS = "source string, resource string, scope string, watermark timestamp, rows long"


class SyncStore:
    """``by`` is the key, ``version`` the column of which the greatest wins; ``path`` is shared by driver and executors."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: list[str], version: str, buckets: int = 16):
        self.spark, self.path, self.schema, self.by, self.version, self.buckets = spark, path.rstrip("/"), schema, by, version, buckets
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def manifest(self) -> dict:
        """What is current: the number of the version, each stream's last batch, the folder of each bucket and of the watermarks."""
        if not self._fs.exists(self._at("manifests")):
            return {"version": 0, "batches": {}, "buckets": {}, "marks": None}
        newest = max(f.getPath().getName() for f in self._fs.listStatus(self._at("manifests")) if f.getPath().getName().startswith("v"))
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{newest}", wholetext=True).first()[0])

    def read(self) -> DataFrame:
        folders = sorted(set(self.manifest()["buckets"].values()))
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def watermarks(self) -> DataFrame:
        marks = self.manifest()["marks"]
        return self.spark.read.schema(MARKS).parquet(marks) if marks else self.spark.createDataFrame([], MARKS)

    def since(self, overlap_minutes: int = 10) -> DataFrame:
        """(source, resource, scope, since): where the next incremental read of each scope starts."""
        return self.watermarks().select("source", "resource", "scope", F.expr(f"watermark - interval {int(overlap_minutes)} minutes").alias("since"))

    def merge(self, batch: DataFrame, stream: str, number: int, source: str, resource: str, scope: Column, at: Column) -> bool:
        """Upsert a batch and move the watermarks of its scopes; False if this batch was committed before.

        A scope's watermark is the greatest event time seen; null times leave it where it was.
        """
        now = self.manifest()
        if now["batches"].get(stream, -1) >= number:
            return False
        commit = f"{self.path}/commits/{now['version'] + 1:010d}-{uuid.uuid4().hex}"
        names = [c.strip().split()[0] for c in self.schema.split(",")]
        place = F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")
        new = batch.select(*names, place.alias("__bucket"), scope.cast("string").alias("__scope"), at.alias("__at"))
        new.write.parquet(f"{commit}/batch")
        new = self.spark.read.parquet(f"{commit}/batch")
        touched = [r[0] for r in new.select("__bucket").distinct().collect()]  # numbers of buckets
        held = [now["buckets"][str(b)] for b in touched if str(b) in now["buckets"]]
        old = self.spark.read.schema(self.schema).parquet(*held) if held else self.spark.createDataFrame([], self.schema)
        merged = upsert(old, new.select(*names), self.by, self.version).withColumn("bucket", place)
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{commit}/rows")
        seen = new.groupBy(F.lit(source).alias("source"), F.lit(resource).alias("resource"), F.col("__scope").alias("scope")).agg(F.max("__at").cast("timestamp").alias("watermark"), F.count(F.lit(1)).alias("rows"))
        marks = self.watermarks().unionByName(seen).groupBy("source", "resource", "scope").agg(F.max("watermark").alias("watermark"), F.sum("rows").alias("rows"))
        marks.write.parquet(f"{commit}/marks")
        self._publish(now | {"version": now["version"] + 1, "batches": now["batches"] | {stream: number}, "buckets": now["buckets"] | {str(b): f"{commit}/rows/bucket={b}" for b in touched}, "marks": f"{commit}/marks"})
        return True

    def _publish(self, manifest: dict) -> None:
        """One file that appears whole; another writer's of the same version is an error."""
        self._fs.mkdirs(self._at("manifests"))
        draft, final = self._at(f"manifests/.draft-{uuid.uuid4().hex}"), self._at(f"manifests/v{manifest['version']:010d}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"another writer committed version {manifest['version']}")

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the last ``keep`` manifests names, and older manifests; returns how many folders went."""
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(self._at("manifests")) if f.getPath().getName().startswith("v"))
        kept = [json.loads(self.spark.read.text(f"{self.path}/manifests/{n}", wholetext=True).first()[0]) for n in names[-keep:]]
        used = {f.split("/commits/")[1].split("/")[0] for m in kept for f in [*m["buckets"].values(), m["marks"]] if f}
        gone = [f.getPath() for f in self._fs.listStatus(self._at("commits")) if f.getPath().getName() not in used]
        for p in [*gone, *[self._at(f"manifests/{n}") for n in names[:-keep]]]:
            self._fs.delete(p, True)
        return len(gone)


def follow(stream: DataFrame, store: SyncStore, checkpoint: str, name: str, source: str, resource: str, scope: Column, at: Column) -> None:
    """Merge all that a stream has into the store, a micro-batch at a time; run again, it goes on where it was."""
    merge = lambda batch, number: store.merge(batch, name, number, source, resource, scope, at)
    query = stream.writeStream.foreachBatch(lambda batch, number: merge(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
