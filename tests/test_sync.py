"""Pulls between stored inventories."""

import os

import pytest
from pyspark.sql import functions as F

from stowage.operators import diff, leaves, stores, sync
from stowage.operators.leaves import LeafStore
from stowage.operators.spec import TableSpec

SPEC = TableSpec("files", ("path",))


def new(spark, path):
    return LeafStore(spark, str(path), SPEC, "path string, file_key string", 1)


def rows(spark, *items):
    return spark.createDataFrame(list(items), "repo_uuid string, path string, file_key string")


def held(s, repo):
    return {(r["path"], r["file_key"]) for r in leaves.read_leaves(s, repo_uuid=repo).collect()}


def bytes_of(spark, *keys):
    return spark.createDataFrame([(k, f"bytes of {k}".encode()) for k in keys], "file_key string, content binary")


def planned(df):
    return {r["status"]: r["n_files"] for r in df.collect()}


def test_pull_two_then_none_then_one(spark, tmp_path, monkeypatch):
    a, b, dst = new(spark, tmp_path / "a"), new(spark, tmp_path / "b"), f"{tmp_path}/dst"
    leaves.commit(a, rows(spark, ("R", "x", "k1"), ("R", "y", "k2")))
    src = bytes_of(spark, "k1", "k2", "k3")
    assert planned(sync.pull(a, "R", b, "L", src, dst, "first")) == {"copy": 2}
    assert held(b, "L") == {("x", "k1"), ("y", "k2")} and sync.stored_content(b, dst).count() == 2
    assert planned(sync.pull(a, "R", b, "L", src, dst)) == {} and len(leaves.paths.names(spark, f"{b.path}/commits")) == 1
    leaves.commit(a, rows(spark, ("R", "z", "k3"), ("R", "w", "k1")))
    assert planned(sync.pull(a, "R", b, "L", src, dst, "first")) == {}  # that label is done
    # breaks off after the bytes are there and before the rows are: the next one only records
    real = leaves.commit
    monkeypatch.setattr(leaves, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        sync.pull(a, "R", b, "L", src, dst, "second")
    monkeypatch.setattr(leaves, "commit", real)
    assert len(held(b, "L")) == 2
    assert planned(sync.pull(a, "R", b, "L", src, dst, "second")) == {"record_only": 2}
    assert held(b, "L") == held(a, "R") and sync.stored_content(b, dst).count() == 3


def test_conflicts_and_missing_bytes(spark, tmp_path):
    a, b, dst = new(spark, tmp_path / "a"), new(spark, tmp_path / "b"), f"{tmp_path}/dst"
    leaves.commit(a, rows(spark, ("R", "x", "k1"), ("R", "y", "other"), ("R", "z", "lost")))
    leaves.commit(b, rows(spark, ("L", "y", "k2")))
    with pytest.raises(diff.MergeConflict):
        sync.pull(a, "R", b, "L", bytes_of(spark, "k1"), dst)
    with pytest.raises(stores.MissingContent):
        sync.pull(a, "R", b, "L", bytes_of(spark, "k1"), dst, on_conflict="report")
    assert held(b, "L") == {("x", "k1"), ("y", "k2")}
    assert planned(sync.pull(a, "R", b, "L", bytes_of(spark, "k1"), dst, on_conflict="report", ignore_missing=True)) == {"conflict": 1, "skipped_missing": 1}


def test_rows_as_of_a_commit(spark, tmp_path):
    a = new(spark, tmp_path / "a")
    assert leaves.last_commit(a) == ""
    leaves.commit(a, rows(spark, ("R", "x", "k1")))
    was = leaves.last_commit(a)
    leaves.commit(a, rows(spark, ("R", "x", "k2"), ("R", "y", "k3")))
    assert {tuple(r)[1:] for r in leaves.read_leaves(a, as_of=was).collect()} == {("x", "k1")} and len(held(a, "R")) == 2


def test_content_is_not_read_where_nothing_is_to_move(spark, tmp_path):
    """The second pull finds a conflict alone: it asks no store. Content of many keys is one file a folder."""
    a, b, dst = new(spark, tmp_path / "a"), new(spark, tmp_path / "b"), f"{tmp_path}/dst"
    many = [("R", f"p{i}", f"k{i}") for i in range(1500)]
    leaves.commit(a, rows(spark, *many, ("R", "y", "other")))
    leaves.commit(b, rows(spark, ("L", "y", "k0")))
    assert planned(sync.pull(a, "R", b, "L", bytes_of(spark, *(k for _, _, k in many)).repartition(6), dst, on_conflict="report")) == {"copy": 1500, "conflict": 1}
    assert held(b, "L") == {(p, k) for _, p, k in many} | {("y", "k0")} and sync.stored_content(b, dst).count() == 1500
    assert len([f for _, _, names in os.walk(dst) for f in names if f.endswith(".parquet")]) <= 256
    unread = bytes_of(spark, "k1").withColumn("file_key", F.raise_error(F.lit("read")).cast("string"))
    assert planned(sync.pull(a, "R", b, "L", unread, dst, on_conflict="report")) == {"conflict": 1}
