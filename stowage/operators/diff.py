"""Differences and merges of the tables of two repositories. Tables here hold key columns and the file column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.operators.inventory import filter_rows
from stowage.operators.spec import TableSpec
from stowage.sources.paths import kept


class MergeConflict(Exception):
    """Keys whose content both sides changed, differently."""


def missing_rows(frm: DataFrame, to: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows of `frm` whose key `to` does not hold."""
    return frm.select(*spec.columns).join(to.select(*spec.keys), list(spec.keys), "left_anti").select(*spec.columns)


def _side(df: DataFrame, spec: TableSpec, name: str) -> DataFrame:
    return df.select(*spec.keys, F.col(spec.file_column).alias(name), F.lit(True).alias(f"{name}_there"))


def diff_tables(frm: DataFrame, to: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows that differ from version `frm` to version `to`: keys, diff_type, from_file_key, to_file_key."""
    both = _side(frm, spec, "from_file_key").join(_side(to, spec, "to_file_key"), list(spec.keys), "full")
    kind = F.when(F.col("from_file_key_there").isNull(), "added").when(F.col("to_file_key_there").isNull(), "removed").otherwise("modified")
    changed = F.col("from_file_key_there").isNull() | F.col("to_file_key_there").isNull() | ~F.col("from_file_key").eqNullSafe(F.col("to_file_key"))
    return both.where(changed).select(*spec.keys, kind.alias("diff_type"), "from_file_key", "to_file_key")


def merge_status(base: DataFrame | None, left: DataFrame, right: DataFrame, spec: TableSpec) -> DataFrame:
    """Every key of the three versions with base, left and right content, merged content and status.

    same: both sides agree; take_left or take_right: only that side changed;
    conflict: both changed, differently. Absence counts as content, so deleting
    an unchanged row deletes it, and deleting one that the other side edited is
    a conflict. Without a base every key is new.
    """
    both = _side(left, spec, "left").join(_side(right, spec, "right"), list(spec.keys), "full")
    if base is None:
        both = both.withColumn("base", F.lit(None).cast("string"))
    else:
        both = both.join(base.select(*spec.keys, F.col(spec.file_column).alias("base")), list(spec.keys), "full")
    a, b, o = F.col("left"), F.col("right"), F.col("base")
    status = F.when(a.eqNullSafe(b), "same").when(a.eqNullSafe(o), "take_right").when(b.eqNullSafe(o), "take_left").otherwise("conflict")
    merged = F.when(status == "take_right", b).when(status != "conflict", a)
    return both.select(*spec.keys, "base", "left", "right", merged.alias("merged"), status.alias("status"))


def conflicts(base: DataFrame | None, left: DataFrame, right: DataFrame, spec: TableSpec) -> DataFrame:
    return merge_status(base, left, right, spec).where("status = 'conflict'").select(*spec.keys, "base", "left", "right")


def _refused(status: DataFrame) -> DataFrame:
    """status, computed once; raises if there is a conflict in it."""
    status = kept(status)
    if first := status.where("status = 'conflict'").limit(1).collect():
        raise MergeConflict(f"for example {first[0].asDict()}")
    return status


def merge_tables(base: DataFrame | None, left: DataFrame, right: DataFrame, spec: TableSpec, on_conflict: str = "error") -> tuple[DataFrame, DataFrame]:
    """Merged rows and conflicts. With on_conflict='error' a conflict raises; with 'report' such keys are left out of the rows.

    To know that there is none the merge has to be made: its rows are then kept in the session's checkpoint folder.
    """
    status = merge_status(base, left, right, spec)
    status = _refused(status) if on_conflict == "error" else status
    bad = status.where("status = 'conflict'").select(*spec.keys, "base", "left", "right")
    rows = status.where("status <> 'conflict' and merged is not null").select(F.col("merged").alias(spec.file_column), *spec.keys)
    return rows, bad


def union_inventory(a: DataFrame, b: DataFrame, spec: TableSpec, on_conflict: str = "error") -> DataFrame:
    """All rows of two repositories."""
    return merge_tables(None, a, b, spec, on_conflict)[0]


def changes(frm: DataFrame, to: DataFrame, spec: TableSpec, base: DataFrame | None = None, where: list[str] = (), on_conflict: str = "error") -> DataFrame:
    """File column (of `frm`), keys and status of the rows that `to` takes from `frm`, and of conflicts, of one merge.

    With on_conflict='error' a conflict of any rows raises: the merge is made
    once, for all rows, and what differs is kept in the session's checkpoint
    folder. Else conditions on key columns are met before the merge, in each
    table's scan; those on the content after it.
    """
    wanted = F.expr("status = 'conflict' or status = 'take_right' and right is not null")
    on_keys, rest = key_conditions(spec, where)
    if on_conflict == "error":
        status = filter_rows(_refused(merge_status(base, to, frm, spec).where(wanted)), on_keys)
    else:
        status = merge_status(*(t if t is None else filter_rows(t, on_keys) for t in (base, to, frm)), spec).where(wanted)
    return filter_rows(status.select(F.col("right").alias(spec.file_column), *spec.keys, "status"), rest)


def diff_keys(frm: DataFrame, to: DataFrame, spec: TableSpec, base: DataFrame | None = None, where: list[str] = (), limit: int | None = None, on_conflict: str = "error") -> DataFrame:
    """Rows that `to` must get to hold what merging `frm` into it gives: file column and keys. limit takes the first by key.

    These are the rows of one merge whose content comes from `frm` (see changes), so nothing is joined a second time.
    """
    rows = changes(frm, to, spec, base, where, on_conflict).where("status = 'take_right'").drop("status")
    return rows if limit is None else rows.orderBy(*spec.keys).limit(limit)


def key_conditions(spec: TableSpec, where: list[str] = ()) -> tuple[list[str], list[str]]:
    """The conditions on key columns, and the others."""
    on_keys = [w for w in where if w.partition("=")[0] in spec.keys]
    return on_keys, [w for w in where if w not in on_keys]
