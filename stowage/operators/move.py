"""Transfers between repositories: what has to be done for each row, and doing it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.operators.diff import changes
from stowage.operators.inventory import upsert
from stowage.operators.spec import DatasetSpec, TableSpec
from stowage.operators.stores import MissingContent, insert_missing


def presence_status(rows: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """rows with in_src and in_dst: whether the stores hold their file key."""
    flag = lambda store, name: store.select("file_key").distinct().withColumn(name, F.lit(True))
    out = rows.join(flag(src, "in_src"), "file_key", "left").join(flag(dst, "in_dst"), "file_key", "left")
    return out.withColumn("in_src", F.coalesce("in_src", F.lit(False))).withColumn("in_dst", F.coalesce("in_dst", F.lit(False)))


def wanted_rows(frm: DataFrame, to: DataFrame, spec: TableSpec, base: DataFrame | None = None, where: list[str] = (), limit: int | None = None, on_conflict: str = "error") -> DataFrame:
    """file_key, keys and status (take_right or conflict) of each row that `to` needs from `frm`: a plan before any store is asked."""
    found = changes(frm, to, spec, base, where, on_conflict).withColumnRenamed(spec.file_column, "file_key")
    if limit is not None:
        first = found.where("status = 'take_right'").orderBy(*spec.keys).limit(limit)
        found = first.union(found.where("status = 'conflict'"))
    return found


def plan_wanted(found: DataFrame, src: DataFrame, dst: DataFrame, spec: TableSpec, ignore_missing: bool = False) -> DataFrame:
    """The plan of wanted_rows(), by what the stores hold."""
    absent = "skipped_missing" if ignore_missing else "error_missing"
    status = F.when(F.col("status") == "conflict", "conflict").when(F.col("in_dst"), "record_only").when(F.col("in_src"), "copy").otherwise(absent)
    return presence_status(found, src, dst).select("file_key", *spec.keys, status.alias("status"))


def move_plan(frm: DataFrame, to: DataFrame, src: DataFrame, dst: DataFrame, spec: TableSpec, base: DataFrame | None = None, where: list[str] = (), limit: int | None = None, ignore_missing: bool = False, on_conflict: str = "error") -> DataFrame:
    """file_key, keys and status of each row that `to` needs from `frm`.

    record_only: the destination store has the bytes; copy: the source store
    has them; else skipped_missing or error_missing. Rows in conflict raise, or
    with on_conflict='report' get status conflict and stay where they are. A
    limit is a total, taken in order of key. Content is never read here.
    """
    return plan_wanted(wanted_rows(frm, to, spec, base, where, limit, on_conflict), src, dst, spec, ignore_missing)


def move_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("status").agg(F.count("*").alias("n_files"))


def apply_content(plan: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """dst with the bytes of the plan's copy rows, each key once."""
    wanted = plan.where("status = 'copy'").select("file_key").distinct()
    return insert_missing(dst, src.join(wanted, "file_key", "left_semi"), "ignore")


def apply_rows(plan: DataFrame, inv: DataFrame, spec: TableSpec, to_uuid: str) -> DataFrame:
    """inv with the plan's copied and recorded rows under the destination repository."""
    moved = plan.where("status in ('copy', 'record_only')").select(F.lit(to_uuid).alias("repo_uuid"), *spec.keys, F.col("file_key").alias(spec.file_column))
    return upsert(inv.select("repo_uuid", *spec.keys, spec.file_column), moved, spec, [spec.file_column])


def require_content(plan: DataFrame) -> None:
    """Raises if the plan has rows whose bytes are nowhere; call it after the other rows are applied."""
    if first := plan.where("status = 'error_missing'").select("file_key").limit(1).collect():
        raise MissingContent(first[0]["file_key"])


def move_dataset(ds: DatasetSpec, inventories: dict[str, DataFrame], frm: str, to: str, src: DataFrame, dst: DataFrame, **options) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Plans and applies all tables of a dataset: new inventories, new destination content and one summary by table.

    Pulling is from a remote repository to the local one, pushing the other
    way. The summary has the rows whose bytes are missing; see require_content.
    """
    plans = {}
    for spec in ds.tables:
        inv = inventories[spec.name]
        side = lambda uuid, inv=inv, spec=spec: inv.where(F.col("repo_uuid") == uuid).select(*spec.columns)
        plans[spec.name] = move_plan(side(frm), side(to), src, dst, spec, **options)
    summary, new = None, {}
    for spec in ds.tables:
        plan = plans[spec.name]
        new[spec.name] = apply_rows(plan, inventories[spec.name], spec, to)
        dst = apply_content(plan, src, dst)
        one = move_summary(plan).select(F.lit(spec.name).alias("table"), "status", "n_files")
        summary = one if summary is None else summary.unionByName(one)
    return new, dst, summary
