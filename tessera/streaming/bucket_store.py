"""A table that upserts by copy on write: rows lie in buckets of a document or key, and a batch rewrites only the buckets it meets.

Folders under a path that all executors share:
  data/v=N/bucket=B     the rows of bucket B as of version N
  manifests/N.json      which version holds each bucket, and the last batch of each stream
A version counts once its manifest stands, which is put there whole and last; a lost writer's
folders are overwritten. The version before stays for those who still read it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.operators.catalog import upsert

BUCKETS = 256


class BucketStore:
    """Rows of one schema and key. group: the column that the buckets go by (by default the key), which the key determines."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id", group: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.group, self.buckets = spark, path.rstrip("/"), key, group or key, buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The newest version; -1 if there is none."""
        fs, p = self._path("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        """places: bucket to version; batches: stream to its last batch; buckets: their number."""
        v = self.version() if version is None else version
        if v < 0:
            return {"places": {}, "batches": {}, "buckets": self.buckets}
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/manifests/{v}.json").first()[0]
        return json.loads(text)

    def _folder(self, v: int, bucket: str) -> str:
        return f"{self.path}/data/v={v}/bucket={bucket}"

    def _rows(self, places: dict[str, int]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(self._folder(v, b) for b, v in sorted(places.items())))

    def read(self) -> DataFrame:
        return self._rows(self.manifest()["places"])

    def lookup(self, groups: list) -> DataFrame:
        """The rows of some documents (or keys): reads their buckets alone."""
        want = self.spark.createDataFrame([(g,) for g in groups], StructType([StructField(self.group, self.schema[self.group].dataType)]))
        held = {str(r.b) for r in want.select(self._bucket().alias("b")).distinct().collect()}
        rows = self._rows({b: v for b, v in self.manifest()["places"].items() if b in held})
        return rows.join(F.broadcast(want.distinct()), self.group, "left_semi").select(*self.schema.names)  # as many as were named

    def _bucket(self):
        return F.pmod(F.xxhash64(self.group), F.lit(self.buckets)).cast("int")

    def merge(self, new: DataFrame, replace: bool = False, stream: str | None = None, batch: int | None = None) -> bool:
        """Rows in place of those of the same key; with `replace` all rows of a document that `new` holds go first.

        A batch of a stream that was merged before changes nothing. False says that it was left out.
        """
        v, last = self.version(), self.manifest()
        if last["buckets"] != self.buckets:
            raise ValueError(f"the table has {last['buckets']} buckets")
        if stream is not None and batch is not None and last["batches"].get(stream, -1) >= batch:
            return False
        new = new.select(*self.schema.names).persist()  # read twice
        try:
            met = [str(r.b) for r in new.select(self._bucket().alias("b")).distinct().collect()]  # at most as many as there are buckets
            old = self._rows({b: at for b, at in last["places"].items() if b in met})
            rows = upsert(old, new, self.key, replace=self.group if replace else None)
            self._commit(rows, met, v + 1, last, stream, batch)
        finally:
            new.unpersist()
        return True

    def remove(self, gone: DataFrame) -> None:
        """Rows of these keys go (`gone`: key and group)."""
        v, last = self.version(), self.manifest()
        met = [str(r.b) for r in gone.select(self._bucket().alias("b")).distinct().collect()]
        old = self._rows({b: at for b, at in last["places"].items() if b in met})
        self._commit(old.join(gone.select(self.key).distinct(), self.key, "left_anti").select(*self.schema.names), met, v + 1, last, None, None)

    def _commit(self, rows: DataFrame, met: list[str], v: int, last: dict, stream: str | None, batch: int | None) -> None:
        fs, data = self._path(f"data/v={v}")
        fs.delete(data, True)
        rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/v={v}")
        names = [s.getPath().getName() for s in fs.listStatus(data)]
        places = {b: at for b, at in last["places"].items() if b not in met} | {n[7:]: v for n in names if n.startswith("bucket=")}
        batches = last["batches"] | ({stream: batch} if stream is not None and batch is not None else {})
        self._put(f"manifests/{v}.json", json.dumps({"places": places, "batches": batches, "buckets": self.buckets}))
        self._forget(v, places, last["places"])

    def _put(self, name: str, text: str) -> None:
        """A file that stands whole or not at all."""
        fs, p = self._path(name)
        _, part = self._path(name + ".part")
        out = fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(part, p):
            raise RuntimeError(f"another writer made {name}")

    def _forget(self, v: int, now: dict[str, int], before: dict[str, int]) -> None:
        """Folders that neither this version nor the one before names."""
        if v < 2:
            return
        for b, at in self.manifest(v - 2)["places"].items():
            if now.get(b) != at and before.get(b) != at:
                fs, p = self._path(f"data/v={at}/bucket={b}")
                fs.delete(p, True)
        fs, p = self._path(f"manifests/{v - 2}.json")
        fs.delete(p, False)

    def written(self) -> int:
        """Bytes of the rows that the newest version wrote."""
        fs, p = self._path(f"data/v={self.version()}")
        return fs.getContentSummary(p).getLength()
