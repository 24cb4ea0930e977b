"""A table whose buckets are replaced batch by batch, each batch wholly or not at all.

A commit writes the buckets that it changes as files of a new version beside the old ones, then
publishes a manifest: which version holds each bucket, and the last batch of each stream.
Readers see what the newest manifest names. A batch that is run twice finds its number there
and changes nothing; one that is killed half-way has published nothing, and its files are
written over by the next attempt. Buckets bound the manifest and what a batch rewrites; the two
newest manifests and the files that they name are kept, so that a reader that has begun can end.
One writer at a time.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "commit_bucket"


@dataclass
class Head:
    version: int = 0
    streams: dict[str, int] = field(default_factory=dict)
    buckets: dict[int, int] = field(default_factory=dict)


class CommittedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def _path(self, name: str) -> JavaObject:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self) -> JavaObject:
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, folder: str) -> list[int]:
        files, where = self._files(), self._path(folder)
        if not files.exists(where):
            return []
        names = [x.getPath().getName() for x in files.listStatus(where)]
        return sorted(int(n[1:].removesuffix(".json")) for n in names if n[0] == "v")

    def head(self) -> Head:
        """What the newest manifest says."""
        versions = self._versions("commits")
        if not versions:
            return Head()
        return self._manifest(versions[-1])

    def _manifest(self, version: int) -> Head:
        stream = self._files().open(self._path(f"commits/v{version}.json"))
        try:
            said = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Head(said["version"], said["streams"], {int(b): v for b, v in said["buckets"].items()})

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The committed rows, of all buckets or of some."""
        paths = [f"{self.path}/data/v{v}/{BUCKET}={b}" for b, v in self.head().buckets.items() if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows belong to."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())  # `buckets` at most

    def done(self, stream: str, batch: int) -> bool:
        return self.head().streams.get(stream, -1) >= batch

    def commit(self, rows: DataFrame, touched: list[int], stream: str, batch: int) -> bool:
        """Replace the touched buckets by ``rows``; False if the batch has been committed before."""
        head = self.head()
        if head.streams.get(stream, -1) >= batch:
            return False
        version, files = head.version + 1, self._files()
        typed = (x.split(" ", 1) for x in self.schema.split(", "))
        data = rows.select(*(F.col(name).cast(kind).alias(name) for name, kind in typed)).withColumn(BUCKET, self.bucket())
        data.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/data/v{version}")
        written = {int(x.getPath().getName().split("=")[1]) for x in files.listStatus(self._path(f"data/v{version}")) if "=" in x.getPath().getName()}
        now = {b: v for b, v in head.buckets.items() if b not in touched} | dict.fromkeys(written, version)
        self._publish(Head(version, head.streams | {stream: batch}, now))
        self._forget()
        return True

    def _publish(self, head: Head) -> None:
        files, draft, final = self._files(), self._path(f"drafts/v{head.version}.json"), self._path(f"commits/v{head.version}.json")
        out = files.create(draft, True)
        out.write(json.dumps({"version": head.version, "streams": head.streams, "buckets": head.buckets}).encode())
        out.close()
        files.mkdirs(self._path("commits"))
        if files.exists(final) or not files.rename(draft, final):
            raise RuntimeError(f"{self.path} has another writer")

    def _forget(self) -> None:
        """Delete the manifests before the last two, and the files that neither of these names."""
        kept = self._versions("commits")[-2:]
        named = {(b, v) for k in kept for b, v in self._manifest(k).buckets.items()}
        files = self._files()
        for version in self._versions("commits")[:-2]:
            files.delete(self._path(f"commits/v{version}.json"), False)
        for version in self._versions("data"):
            if version > kept[-1]:
                continue
            for x in files.listStatus(self._path(f"data/v{version}")):
                name = x.getPath().getName()
                if "=" in name and (int(name.split("=")[1]), version) not in named:
                    files.delete(x.getPath(), True)
            if not any(v == version for _, v in named):
                files.delete(self._path(f"data/v{version}"), True)
