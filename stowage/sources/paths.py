"""Names in folders of the file system that Spark uses: listing, marking, renaming and deleting, one small call each."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in the folder, sorted; none if it does not exist. Errors of the file system are errors."""
    fs, at = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def any_like(spark: SparkSession, pattern: str) -> bool:
    fs, at = _at(spark, pattern)
    return bool(fs.globStatus(at))


def mark(spark: SparkSession, path: str) -> bool:
    """Makes an empty file; False if there is one already."""
    fs, at = _at(spark, path)
    fs.mkdirs(at.getParent())
    return fs.createNewFile(at)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, at = _at(spark, old)
    to = _at(spark, new)[1]
    fs.mkdirs(to.getParent())
    if not fs.rename(at, to):
        raise OSError(f"{old} can't be renamed to {new}")


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where the session names none and runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="stowage-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
