"""Moving files between inventories stored in leaves, at a cost that follows what differs and not what is held."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.operators import leaves, stores
from stowage.operators.leaves import LeafStore
from stowage.operators.move import move_summary, plan_wanted, require_content, wanted_rows
from stowage.sources import paths


def stored_content(store: LeafStore, path: str, keys: DataFrame | None = None) -> DataFrame:
    """file_key and content at path (see write_content), empty before anything is written; with keys only the folders that these lie in are listed."""
    held = stores.stored_in_folders(store.spark, path, "file_key string, content binary", keys)
    return stores.empty_content(store.spark) if held is None else held.select("file_key", "content")


def pull(frm: LeafStore, repo_frm: str, to: LeafStore, repo_to: str, src: DataFrame, dst_path: str, label: str = "", **options) -> DataFrame:
    """Gives repository repo_to of the store `to` what it lacks of repo_frm in `frm`; status and n_files of what was planned.

    Only leaves whose prints differ are read and only content folders that the
    moved keys lie in; where only conflicts are left, src is not read. The plan is written down, then the content that the
    folder at dst_path lacks, then one commit of the moved rows, so no row ever
    points at absent bytes, and a pull that breaks off can simply be run again:
    what has been copied is not copied twice. With a label that is committed
    already nothing is done and no rows are returned. src: file_key, content;
    options as for move_plan(): where, limit, ignore_missing, on_conflict. If
    bytes are nowhere the other rows are moved, then that is an error. Pushing
    is pulling with the sides exchanged.
    """
    spark = to.spark
    if label and leaves.committed(to, label):
        return spark.createDataFrame([], "status string, n_files long")
    mine, theirs = leaves.sides(frm, repo_frm, to, repo_to)
    folder, ignore = f"{to.path}/plans/{uuid.uuid4().hex}", options.pop("ignore_missing", False)
    wanted_rows(mine, theirs, to.spec, **options).write.parquet(f"{folder}/wanted")
    wanted = spark.read.parquet(f"{folder}/wanted")
    asked = wanted.where("status = 'take_right'").select("file_key")
    if asked.isEmpty():  # nothing to move: no store is asked
        plan = plan_wanted(wanted, asked, asked, to.spec, ignore)
    else:
        plan = plan_wanted(wanted, src.select("file_key"), stored_content(to, dst_path, asked).select("file_key"), to.spec, ignore)
    plan.write.parquet(f"{folder}/plan")
    plan = spark.read.parquet(f"{folder}/plan")
    summary = [tuple(r) for r in move_summary(plan).collect()]  # a row for each status
    copied = plan.where("status = 'copy'").select("file_key").distinct()
    if not copied.isEmpty():
        content = src.join(copied, "file_key", "left_semi").select("file_key", F.col("content").cast("binary").alias("content")).dropDuplicates(["file_key"])
        stores.write_content(content, dst_path)
    moved = plan.where("status in ('copy', 'record_only')").select(F.lit(repo_to).alias("repo_uuid"), *to.spec.keys, F.col("file_key").alias(to.spec.file_column))
    if any(status in ("copy", "record_only") for status, _ in summary):
        leaves.commit(to, moved, label=label)
    require_content(plan)
    paths.delete(spark, folder)
    return spark.createDataFrame(summary, "status string, n_files long")
