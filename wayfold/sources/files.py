"""Named files as a sink, with a manifest that a job's commit writes.

A row (path, content) becomes one file. A task writes each file under a name of its own and moves it to its place, so that a task that is run again
leaves one file, and lists its files in a part of the manifest. Only the commit names the parts that count: files of failed or repeated attempts that
stay behind are in no manifest, and readers go by the manifest. The driver sees a message for each task, never one for each file.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: The manifest's head, the folder of its parts, and where files are written before they are moved.
HEAD, PARTS, STAGING = "_manifest.json", "_manifest", "_staging"
ENTRY = "path string, bytes bigint, sha256 string"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system that ``folder`` (a path or URI) lies in, and its path there."""
    store, path = fs.FileSystem.from_uri(folder)
    return store, path.rstrip("/")


def _write(store: fs.FileSystem, path: str, content: bytes) -> None:
    with store.open_output_stream(path) as out:
        out.write(content)


def _exists(store: fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != fs.FileType.NotFound


def _checked(path: str) -> str:
    if not path or path.startswith(("/", "_", ".")) or ".." in path.split("/"):
        raise ValueError(f"not a relative path of a file: {path!r}")
    return path


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: the part of the manifest that lists it, and sums."""

    part: str | None = None
    files: int = 0
    bytes: int = 0


@dataclass
class FileWriter(DataSourceArrowWriter):
    folder: str
    overwrite: bool = False

    def __post_init__(self) -> None:
        store, root = opened(self.folder)
        if not self.overwrite and _exists(store, f"{root}/{HEAD}"):
            raise FileExistsError(f"there are files already: {self.folder}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.folder)
        attempt, lines, seen, made, total = uuid.uuid4().hex, [], set(), set(), 0
        for batch in iterator:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                name, data = _checked(path.as_py()), content.as_py()
                if name in seen:
                    raise ValueError(f"two rows for one file: {name}")
                seen.add(name)
                for needed in {f"{root}/{STAGING}", f"{root}/{name}".rpartition("/")[0]} - made:
                    store.create_dir(needed, recursive=True)
                    made.add(needed)
                staged = f"{root}/{STAGING}/{attempt}-{len(lines)}"
                _write(store, staged, data)
                store.move(staged, f"{root}/{name}")
                lines.append(json.dumps({"path": name, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}, sort_keys=True))
                total += len(data)
        if not lines:
            return Written()
        store.create_dir(f"{root}/{PARTS}", recursive=True)
        _write(store, f"{root}/{PARTS}/{attempt}.jsonl", ("\n".join(lines) + "\n").encode())
        return Written(f"{attempt}.jsonl", len(lines), total)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m and m.part]
        head = {"files": sum(m.files for m in done), "bytes": sum(m.bytes for m in done), "parts": sorted(m.part for m in done)}
        store, root = opened(self.folder)
        store.create_dir(root, recursive=True)
        staged = f"{root}/{HEAD}.{uuid.uuid4().hex}"
        _write(store, staged, (json.dumps(head, indent=2, sort_keys=True) + "\n").encode())
        store.move(staged, f"{root}/{HEAD}")  # from here on the new files count, all of them
        self._clear(store, f"{root}/{STAGING}")

    def abort(self, messages: list[Written | None]) -> None:
        """Parts go; without a head that names them, files that stay behind count for nothing."""
        store, root = opened(self.folder)
        for m in messages:
            if m and m.part and _exists(store, f"{root}/{PARTS}/{m.part}"):
                store.delete_file(f"{root}/{PARTS}/{m.part}")
        self._clear(store, f"{root}/{STAGING}")

    @staticmethod
    def _clear(store: fs.FileSystem, folder: str) -> None:
        if _exists(store, folder):
            store.delete_dir(folder)


class NamedFiles(DataSource):
    """``df.write.format("named_files").save(folder)`` of rows (path, content)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite)


def write_files(files: DataFrame, folder: str, *, overwrite: bool = False) -> DataFrame:
    """Writes each row (path, content) of ``files`` as a file below ``folder``; returns the manifest (path, bytes, sha256).

    Paths are relative and different. A folder that has a manifest is refused, unless ``overwrite``: then the new manifest takes its place
    when all files are there, and files that it doesn't name are left as they are.
    """
    spark = files.sparkSession
    spark.dataSource.register(NamedFiles)
    files.select("path", F.col("content").cast("binary").alias("content")).write.format("named_files").mode("overwrite" if overwrite else "append").save(folder)
    return manifest(spark, folder)


def head(folder: str) -> dict:
    """The manifest's head: numbers of files and bytes, and the parts that count."""
    store, root = opened(folder)
    with store.open_input_stream(f"{root}/{HEAD}") as f:
        return json.loads(f.read())


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of the files that the last commit named."""
    parts = head(folder)["parts"]
    if not parts:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).option("mode", "FAILFAST").json([f"{folder.rstrip('/')}/{PARTS}/{p}" for p in parts])


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of all files below ``folder`` but the manifest's, named there or not."""
    _, root = opened(folder)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    below = F.expr(f"substring(path, locate({json.dumps(root + '/')}, path) + {len(root) + 1})")
    return found.select(below.alias("path"), "content")


def faults(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, fault) of files that aren't what a manifest says: repeated (in the manifest), missing, unlisted, bytes or sha256, the first that holds."""
    one = listed.groupBy("path").agg(F.max("bytes").alias("bytes"), F.max("sha256").alias("sha256"), F.count(F.lit(1)).alias("n"))
    both = one.join(found.select("path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("digest")), "path", "full")
    fault = F.when(F.col("n") > 1, "repeated").when(F.col("size").isNull(), "missing").when(F.col("n").isNull(), "unlisted")
    fault = fault.when(F.col("size") != F.col("bytes"), "bytes").when(F.col("digest") != F.col("sha256"), "sha256")
    return both.select("path", fault.alias("fault")).filter("fault is not null")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the files that the manifest names; one that is missing or changed fails the plan by its path."""
    got = manifest(spark, folder).join(contents(spark, folder), "path", "left")
    whole = (F.length("content") == F.col("bytes")) & (F.sha2("content", 256) == F.col("sha256"))
    fail = F.raise_error(F.concat(F.when(F.col("content").isNull(), "missing file: ").otherwise("changed file: "), F.col("path"))).cast("boolean")
    return got.filter(F.when(F.coalesce(whole, F.lit(False)), F.lit(True)).otherwise(fail)).select("path", "content")
