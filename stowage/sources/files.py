"""Files as DataFrames, once or as a stream."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, modificationTime timestamp, length long, content binary"
#: Bytes of a file that are in memory at once.
CHUNK = 4 << 20


def scan_files(spark: SparkSession, paths: list[str], with_content: bool = True) -> DataFrame:
    """path, size and content of all files below the paths; a path that does not exist is an error, and empty files are skipped. Each file is one value, so files near 2 GB do not fit; hash_files() takes them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select("path", F.col("length").alias("size"), *(["content"] if with_content else []))


def stream_files(spark: SparkSession, path: str, per_batch: int = 10_000) -> DataFrame:
    """New files below path as a stream of path, size, content."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(path)
    return files.select("path", F.col("length").alias("size"), "content")


def relative_to(df: DataFrame, root: str, path_col: str = "path") -> DataFrame:
    """df with path relative to root, without a leading slash; a scheme before root is dropped."""
    at = F.locate(root.rstrip("/") + "/", F.col(path_col))
    return df.withColumn(path_col, F.when(at > 0, F.expr(f"substr({path_col}, locate('{root.rstrip('/')}/', {path_col}) + {len(root.rstrip('/')) + 1})")).otherwise(F.col(path_col)))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for path in batch.column("path").to_pylist():
            local = path.startswith("file:")
            fs, at = (LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if local else FileSystem.from_uri(quote(path, safe=":/"))
            digest = hashlib.sha256()
            with fs.open_input_stream(at) as file:
                while chunk := file.read(CHUNK):
                    digest.update(chunk)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("size"), pa.array(digests, pa.string())], ["path", "size", "sha256"])


def hash_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, size and sha256 of all files below the paths, of any size; like scan_files() it leaves out empty ones, which Spark's readers skip.

    Spark lists the files and deals them to tasks; a task reads a file CHUNK
    bytes at a time and folds them into the hash, so memory doesn't grow with
    the file. Files are opened by path: those of mounted file systems and the
    stores that pyarrow knows. content_keys_from_hash() makes the keys.
    """
    return scan_files(spark, paths, with_content=False).mapInArrow(_hashed, "path string, size long, sha256 string")
