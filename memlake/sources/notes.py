"""Notes as files: a sink that writes one per row (IO-5), and a scan that hashes a folder (IO-7).

Both reach files from tasks by URI, on any store that pyarrow knows (a shared mount, HDFS, S3,
GCS). The sink's tasks write to a staging folder; when all have ended their files are moved to
their places, and if one fails the staging folder goes and no note has changed. The scan lists
files without reading them and hashes each in parts of bounded size.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a file that are held at once, and files that are moved at once.
PART_BYTES = 1 << 20
MOVERS = 16
FORMAT = "memlake_notes"


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    if "://" not in uri:
        uri = re.sub(r"^(\w+):/", r"\1:///", uri) if re.match(r"^\w+:/", uri) else f"file://{uri}"
    return fs.FileSystem.from_uri(uri)


@dataclass
class Staged(WriterCommitMessage):
    """The notes of a task, by the name that they will have."""

    folder: str
    paths: list[str]


class NoteWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.run = root.rstrip("/"), f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        store, root = store_of(self.root)
        context = TaskContext.get()
        folder, paths = f"{self.run}/{context.partitionId()}-{context.taskAttemptId()}", []
        for row in iterator:
            path = posixpath.normpath(row.path)
            if path.startswith(("/", "..")):
                raise ValueError(f"a note outside the folder: {row.path}")
            staged = f"{root}/{folder}/{path}"
            store.create_dir(posixpath.dirname(staged))
            with store.open_output_stream(staged) as out:
                out.write(row.value.encode())
            paths.append(path)
        return Staged(folder, paths)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = store_of(self.root)
        staged = [(m.folder, path) for m in messages if m for path in m.paths]
        twice = len(staged) - len({path for _, path in staged})
        if twice:
            self.abort(messages)
            raise ValueError(f"{twice} notes have the path of another one")
        for folder in {posixpath.dirname(f"{root}/{path}") for _, path in staged}:
            store.create_dir(folder)
        with ThreadPoolExecutor(MOVERS) as movers:
            list(movers.map(lambda x: store.move(f"{root}/{x[0]}/{x[1]}", f"{root}/{x[1]}"), staged))
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        """Only what has been staged goes."""
        store, root = store_of(self.root)
        if store.get_file_info(f"{root}/{self.run}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.run}")


class Notes(DataSource):
    """The format of the sink: rows (path, value)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> NoteWriter:
        return NoteWriter(self.options["path"])


def export_notes(notes: DataFrame, root: str) -> None:
    """IO-5: one file for each row (path, value) below ``root``; files with these paths are replaced."""
    notes.sparkSession.dataSource.register(Notes)
    notes.select("path", "value").write.format(FORMAT).mode("append").save(root)


#: Files that a task hashes.
FILES_OF_TASK = 64


def hash_folder(spark: SparkSession, root: str) -> DataFrame:
    """IO-7: (path, size, sha256) of the files of a folder, read in parts, empty ones too; parts of a
    path that start with ``.`` or ``_`` are left out. The driver lists the names, as for any
    read of files."""
    store, base = store_of(root.rstrip("/"))
    listed = store.get_file_info(fs.FileSelector(base, recursive=True))
    names = [x.path.removeprefix(f"{base}/") for x in listed if x.type == fs.FileType.File]
    names = [n for n in names if not re.search("(^|/)[._]", n)]
    files = spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, -(-len(names) // FILES_OF_TASK)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, folder = store_of(root.rstrip("/"))
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                digest, size = hashlib.sha256(), 0
                with own.open_input_stream(f"{folder}/{path}") as stream:
                    while part := stream.read(PART_BYTES):
                        digest.update(part)
                        size += len(part)
                rows.append((path, size, digest.hexdigest()))
            columns = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["path", "size", "sha256"])

    return files.mapInArrow(run, "path string, size bigint, sha256 string")


def verify_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """IO-7: files that drift from the manifest's checksum, miss, are extra or leave the folder."""
    here, there = F.lit(True).alias("is_found"), F.lit(True).alias("is_pinned")
    m = manifest.select("path", F.col("sha256").alias("pinned"), there)
    problem = (
        F.when(F.col("path").rlike("(^/)|(^|/)\\.\\.(/|$)"), "path_escape").when(F.col("is_found").isNull(), "missing").when(F.col("is_pinned").isNull(), "extra")
        .when(~F.col("sha256").eqNullSafe(F.col("pinned")), "drift")
    )
    return found.select("path", "sha256", here).join(m, "path", "full_outer").select("path", problem.alias("problem")).filter("problem is not null")


def verify_folder(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """IO-7: what is wrong with the files of a folder by a manifest (path, sha256)."""
    return verify_manifest(hash_folder(spark, root).select("path", "sha256"), manifest)
