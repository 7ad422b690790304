"""Incremental jobs over streams of rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stowage.operators import stores
from stowage.operators.inventory import upsert, write_inventory
from stowage.operators.leaves import LeafStore, commit, nodes
from stowage.operators.spec import TableSpec
from stowage.sources import paths


def is_stored(spark: SparkSession, path: str) -> bool:
    """Whether path holds any data file; errors of the file system are errors."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        return False
    found = files.listFiles(hadoop, True)
    while found.hasNext():
        if found.next().getPath().getName().endswith(".parquet"):
            return True
    return False


def _stored(batch: DataFrame, path: str) -> DataFrame | None:
    """What is stored at path, with the columns of all its files; None before anything is."""
    spark = batch.sparkSession
    return spark.read.option("mergeSchema", "true").parquet(path) if is_stored(spark, path) else None


def once(spark: SparkSession, ledger: str, label: str, work: Callable[[], object]) -> bool:
    """Does the work unless the ledger, a folder, has the label, and then records it; whether it was done."""
    if paths.exists(spark, f"{ledger}/{label}"):
        return False
    work()
    paths.mark(spark, f"{ledger}/{label}")
    return True


def stream_upsert(stream: DataFrame, path: str, spec: TableSpec, checkpoint: str, order_by: list[str], after: list[Callable[[DataFrame, int], None]] = ()) -> StreamingQuery:
    """Upserts each micro-batch into the inventory at path, then calls the steps in `after` on the same batch.

    Only the repositories that a batch touches are rewritten (stream_commit()
    writes no more than what came). A column that only the batch or only the
    store has is null in the other's rows. What is rewritten is first written
    beside the inventory, so no row is read from a folder that is being
    replaced. Which batch's rows and steps are done is recorded in the folder
    `{checkpoint}-ledger`: a batch that is run again after a failure goes on
    where it stopped. A step that fails before it is recorded is called again.
    """
    beside_all, ledger = f"{checkpoint.rstrip('/')}-rows", f"{checkpoint.rstrip('/')}-ledger"

    def rows_of(batch: DataFrame, batch_id: int) -> None:
        spark, held = batch.sparkSession, _stored(batch, path)
        if held is not None:
            held = held.join(batch.select("repo_uuid").distinct(), "repo_uuid", "left_semi")
        beside = f"{beside_all}/{batch_id}-{uuid.uuid4().hex}"
        upsert(held, batch, spec, order_by).write.parquet(beside)
        write_inventory(spark.read.parquet(beside), path)
        paths.delete(spark, beside)

    def apply(batch: DataFrame, batch_id: int) -> None:
        once(batch.sparkSession, ledger, f"{batch_id}.rows", lambda: rows_of(batch, batch_id))
        _steps(batch, batch_id, after, ledger)

    return _started(stream, apply, checkpoint)


def _steps(batch: DataFrame, batch_id: int, after: list[Callable[[DataFrame, int], None]], ledger: str) -> None:
    for i, step in enumerate(after):
        once(batch.sparkSession, ledger, f"{batch_id}.step{i}", lambda step=step: step(batch, batch_id))


def _started(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_commit(stream: DataFrame, store: LeafStore, checkpoint: str, order_by: list[str] = (), after: list[Callable[[DataFrame, int], None]] = (), name: str = "stream") -> StreamingQuery:
    """Commits each micro-batch to the store, then calls the steps in `after` on the same batch.

    A batch writes its own rows and no others, to the leaves of its keys, and
    the change of the tree above them; the state of a key is its stored row, so
    one that comes again, changes or goes (gone = true) changes counts and sums
    by what it changes. The commit's label, `{name}.{batch}`, is recorded in the
    same rename that makes its rows seen, so a batch that is run again is not
    committed again; its steps are recorded one by one in `{checkpoint}-ledger`.
    Streams into one store have different names.
    """
    ledger = f"{checkpoint.rstrip('/')}-ledger"

    def apply(batch: DataFrame, batch_id: int) -> None:
        commit(store, batch, order_by, f"{name}.{batch_id}")
        _steps(batch, batch_id, after, ledger)

    return _started(stream, apply, checkpoint)


def store_totals(store: LeafStore) -> DataFrame:
    """The roots of the store's tree: n_files and the sums of each repository, as of its last commit. No row is read."""
    return nodes(store, level=0).where("n_rows > 0").select("repo_uuid", F.col("n_rows").alias("n_files"), *store.sums)


def stream_stats(stream: DataFrame) -> DataFrame:
    """Running number of files and bytes by repository of a stream that brings each file once; use output mode complete or update. See store_totals() where files come again or go."""
    return stream.groupBy("repo_uuid").agg(F.count("*").alias("n_files"), F.sum("size").alias("total_bytes"))


def stream_insert_missing(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Adds the content of keys that the store at path lacks, each once; rows without a key are left out.

    The store itself is the state, so nothing grows in the stream. It lies in
    folders by the first digits of a key's storage path, and a batch is compared
    with the folders and parts that its keys are in.
    """

    def apply(batch: DataFrame, _: int) -> None:
        keyed = batch.where("file_key is not null")
        fresh = keyed.dropDuplicates(["file_key"])
        held = stores.stored_in_folders(batch.sparkSession, path, "file_key string", keyed)
        if held is not None:
            fresh = fresh.join(held.select("file_key"), "file_key", "left_anti").select(*batch.columns)
        stores.write_content(fresh, path)

    return _started(stream, apply, checkpoint)
