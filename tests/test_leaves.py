"""Inventories stored in leaves: what a commit touches, what a diff and a look-up read, failures, compaction, streams."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from stowage.operators import diff, inventory, leaves, move
from stowage.operators.leaves import LeafStore
from stowage.operators.spec import TableSpec
from stowage.sources import paths
from stowage.streaming.jobs import store_totals, stream_commit, stream_upsert

SPEC = TableSpec("files", ("path",))
KIND = "repo_uuid string, path string, file_key string, gone boolean"


def rows(spark, *items):
    return spark.createDataFrame([(*i, False) if len(i) == 3 else i for i in items], KIND)


def store(spark, tmp_path, name="s", digits=2, **more):
    return LeafStore(spark, f"{tmp_path}/{name}", SPEC, "path string, file_key string", digits, **more)


def many(n, repo="r", key="k"):
    return [(repo, f"p{i}", f"{key}{i}") for i in range(n)]


def held(s):
    return {tuple(r) for r in leaves.read_leaves(s).select("repo_uuid", "path", "file_key").collect()}


def files(s):
    return {os.path.relpath(f, s.path) for f in glob.glob(f"{s.path}/rows/**/*.parquet", recursive=True)}


def files_read(df):
    return {f.rpartition("/rows/")[2] for f in df.inputFiles() if "/rows/" in f}


def test_a_key_touches_one_leaf_and_reads_equal_upserts(spark, tmp_path):
    s, rng = store(spark, tmp_path), random.Random(3)
    assert leaves.commit(s, rows(spark, *many(150)))
    before, want = files(s), {("r", f"p{i}"): f"k{i}" for i in range(150)}
    leaves.commit(s, rows(spark, ("r", "p7", "new")))
    want["r", "p7"] = "new"
    new = files(s) - before
    assert before <= files(s) and len(new) == 1
    for n in range(3):
        batch = [("r", f"p{rng.randrange(200)}", f"v{n}", rng.random() < 0.3) for _ in range(60)] + [("q", "p1", f"q{n}")]
        batch = list({(b[0], b[1]): b for b in batch}.values())
        leaves.commit(s, rows(spark, *batch))
        for b in batch:
            want[b[0], b[1]] = b[2]
            if b[3:] == (True,):
                del want[b[0], b[1]]
    assert held(s) == {(*k, v) for k, v in want.items()}


def test_the_last_of_a_commit_by_order_and_null_keys(spark, tmp_path):
    s = store(spark, tmp_path)
    df = spark.createDataFrame([("r", "a", "1", 1), ("r", "a", "2", 3), ("r", "a", "3", 2), ("r", None, "n", 1), ("r", "b", None, 1)], "repo_uuid string, path string, file_key string, _o0 int")
    leaves.commit(s, df, ["_o0"])
    assert held(s) == {("r", "a", "2"), ("r", None, "n"), ("r", "b", None)}


def test_nodes_are_prints_of_the_rows(spark, tmp_path):
    s = store(spark, tmp_path)
    leaves.commit(s, rows(spark, *many(100), *many(5, "q")))
    leaves.commit(s, rows(spark, *many(30, key="other"), ("r", "p50", None, True), ("q", "p1", "gone", True), ("q", "absent", "x", True)))
    now = leaves.read_leaves(s).withColumn("leaf", F.left(leaves.key_hash(SPEC), F.lit(2)))
    for level in range(3):
        by = now.withColumn("prefix", F.left("leaf", F.lit(level)))
        want = {tuple(r) for r in inventory.fingerprint(by, SPEC, ["repo_uuid", "prefix"]).collect()}
        got = {tuple(r) for r in leaves.nodes(s, level=level).where("n_rows <> 0 or print <> 0").select("repo_uuid", "prefix", "n_rows", "print").collect()}
        assert got == want


def test_a_diff_reads_only_leaves_that_differ(spark, tmp_path):
    a, b = store(spark, tmp_path, "a"), store(spark, tmp_path, "b")
    leaves.commit(a, rows(spark, *many(200)))
    leaves.commit(b, rows(spark, *many(200)))
    assert leaves.differing_leaves(a, "r", b, "r") == [] and leaves.stored_diff(a, "r", b, "r").count() == 0
    assert not files_read(leaves.sides(a, "r", b, "r")[0])
    leaves.commit(b, rows(spark, ("r", "p3", "changed"), ("r", "p4", None, True), ("r", "new", "n")))
    changed = leaves.leaves_of(a, rows(spark, ("r", "p3", ""), ("r", "p4", ""), ("r", "new", "")))
    assert leaves.differing_leaves(a, "r", b, "r") == sorted(changed)
    for side in leaves.sides(a, "r", b, "r"):
        read = {f.split("/")[0] for f in files_read(side)}
        assert read and read <= {f"leaf=l{c}" for c in changed}
    got = {tuple(r) for r in leaves.stored_diff(a, "r", b, "r").collect()}
    assert got == {("p3", "modified", "k3", "changed"), ("p4", "removed", "k4", None), ("new", "added", None, "n")}
    assert {tuple(r) for r in leaves.stored_missing(b, "r", a, "r").collect()} == {("n", "new")}


def test_stores_of_different_width_and_an_empty_one(spark, tmp_path):
    a, b, none = store(spark, tmp_path, "a", 1), store(spark, tmp_path, "b", 3), store(spark, tmp_path, "none", 2)
    leaves.commit(a, rows(spark, *many(50)))
    leaves.commit(b, rows(spark, *many(50), ("r", "x", "y")))
    assert {tuple(r) for r in leaves.stored_diff(a, "r", b, "r").collect()} == {("x", "added", None, "y")}
    assert leaves.stored_diff(none, "r", a, "r").count() == 50 and leaves.read_leaves(none).count() == 0
    leaves.commit(none, rows(spark))
    leaves.commit(none, rows(spark, ("r", "p0", "k0")))
    leaves.commit(none, rows(spark, ("r", "p0", None, True)))
    assert leaves.differing_leaves(none, "r", store(spark, tmp_path, "other"), "r") == []
    with pytest.raises(ValueError):
        store(spark, tmp_path, digits=5)


def test_a_few_keys_read_their_leaves_only(spark, tmp_path):
    s = store(spark, tmp_path)
    leaves.commit(s, rows(spark, *many(300), *many(300, "q")))
    keys = spark.createDataFrame([(f"p{i * 33}",) for i in range(11)], "path string")
    found = leaves.look_up(s, keys, "r")
    assert {(r["path"], r["file_key"], r["has_row"]) for r in found.collect()} == {(f"p{i * 33}", f"k{i * 33}" if i < 10 else None, i < 10) for i in range(11)}
    listed = leaves.read_versions(s, leaves.leaves_of(s, keys)).inputFiles()
    assert 0 < len(listed) <= 22 < len(files(s)) / 10
    plan = leaves.read_leaves(s, leaves.leaves_of(s, keys), "r")._jdf.queryExecution().executedPlan().toString()
    assert "(repo#" in plan.partition("PartitionFilters:")[2].partition("PushedFilters")[0]


def test_a_commit_that_breaks_off_is_not_seen_and_can_be_made_again(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path)
    leaves.commit(s, rows(spark, *many(20)), label="one")
    nodes = sorted(map(tuple, leaves.nodes(s).collect()))
    real = paths.rename
    monkeypatch.setattr(paths, "rename", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        leaves.commit(s, rows(spark, ("r", "p1", "half"), ("r", "q", "half")), label="two")
    monkeypatch.setattr(paths, "rename", real)
    assert ("r", "p1", "k1") in held(s) and len(held(s)) == 20 and sorted(map(tuple, leaves.nodes(s).collect())) == nodes
    assert not leaves.committed(s, "two") and not leaves.commit(s, rows(spark, ("r", "p1", "no")), label="one")
    leaves.compact(s)
    assert leaves.commit(s, rows(spark, ("r", "p1", "whole")), label="two") and ("r", "p1", "whole") in held(s) and len(held(s)) == 20
    assert leaves.nodes(s, "r", 0).first()["n_rows"] == 20


def test_compaction_changes_nothing_at_any_point(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path, digits=1)
    leaves.commit(s, rows(spark, *many(40)))
    leaves.commit(s, rows(spark, *[("r", f"p{i}", None, True) for i in range(0, 40, 3)]))
    leaves.commit(s, rows(spark, ("r", "p1", "again")))
    want, nodes = held(s), sorted(map(tuple, leaves.nodes(s).where("n_rows > 0").collect()))
    real, seen = paths.delete, []

    def delete(spark_, path):
        if len(seen) < 6:
            seen.append(held(s) == want)
        real(spark_, path)

    monkeypatch.setattr(paths, "delete", delete)
    done = leaves.compact(s)
    assert all(seen) and len(seen) == 6 and done
    assert held(s) == want and sorted(map(tuple, leaves.nodes(s).where("n_rows > 0").collect())) == nodes
    assert len(files(s)) == len({f.split("/")[1] for f in files(s)})
    leaves.commit(s, rows(spark, ("r", "p2", "later")))
    assert ("r", "p2", "later") in held(s)
    one = leaves.leaves_of(s, rows(spark, ("r", "p2", "")))
    assert leaves.compact(s) == one


def stream_of(spark, path):
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(path)


def test_a_batch_that_dies_between_commit_and_step_goes_on_where_it_stopped(spark, tmp_path):
    s, calls, fail = store(spark, tmp_path), [], [True]
    rows(spark, *many(20)).coalesce(1).write.parquet(f"{tmp_path}/in")

    def second(batch, i):
        calls.append(("second", i))
        if fail:
            fail.clear()
            raise RuntimeError("the machine is gone")

    steps = [lambda batch, i: calls.append(("first", i)), second]
    run = lambda: stream_commit(stream_of(spark, f"{tmp_path}/in"), s, f"{tmp_path}/c", after=steps).awaitTermination()
    with pytest.raises(Exception, match="gone"):
        run()
    committed = paths.names(spark, f"{s.path}/commits")
    run()
    run()
    assert paths.names(spark, f"{s.path}/commits") == committed and len(committed) == 1
    assert calls == [("first", 0), ("second", 0), ("second", 0)] and len(held(s)) == 20
    rows(spark, ("r", "p1", "x")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert calls[3:] == [("first", 1), ("second", 1)] and ("r", "p1", "x") in held(s)


def test_upserted_streams_have_the_same_ledger(spark, tmp_path):
    calls, fail = [], [True]
    rows(spark, *many(5)).drop("gone").coalesce(1).write.parquet(f"{tmp_path}/in")

    def step(batch, i):
        calls.append(batch.count())
        if fail:
            fail.clear()
            raise RuntimeError("the machine is gone")

    def run():
        stream = spark.readStream.schema(KIND).parquet(f"{tmp_path}/in").drop("gone")
        stream_upsert(stream, f"{tmp_path}/inv", SPEC, f"{tmp_path}/c", ["file_key"], [lambda b, i: calls.append("once"), step]).awaitTermination()

    with pytest.raises(Exception, match="gone"):
        run()
    run()
    assert calls == ["once", 5, 5] and spark.read.parquet(f"{tmp_path}/inv").count() == 5
    assert not os.listdir(f"{tmp_path}/c-rows")


def test_totals_take_back_what_goes_and_count_a_key_once(spark, tmp_path):
    spec = TableSpec("files", ("file_key",))
    s = LeafStore(spark, f"{tmp_path}/s", spec, "file_key string, size bigint", 1, ("size",))
    kind = "repo_uuid string, file_key string, size bigint, gone boolean"
    batches = [[("a", "x", 5, False), ("a", "y", 7, False), ("b", "x", 5, False)], [("a", "x", 5, False), ("a", "y", 9, False)], [("b", "x", 5, True), ("b", "never", 1, True)], [("b", "z", None, False)]]
    seen = []
    for b in batches:
        leaves.commit(s, spark.createDataFrame(b, kind))
        seen.append({tuple(r) for r in store_totals(s).collect()})
    assert seen == [{("a", 2, 12), ("b", 1, 5)}, {("a", 2, 14), ("b", 1, 5)}, {("a", 2, 14)}, {("a", 2, 14), ("b", 1, 0)}]


def test_buckets_need_no_exchange(spark, tmp_path):
    a, b = (inventory.write_bucketed(rows(spark, *many(n)).select(*SPEC.columns), SPEC, f"{tmp_path}/{n}", 4) for n in (30, 40))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for df in (diff.diff_tables(a, b, SPEC), diff.missing_rows(b, a, SPEC), diff.merge_status(None, a, b, SPEC)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert diff.diff_tables(a, b, SPEC).count() == 10


def test_a_plan_joins_the_sides_once(spark):
    frm, to = rows(spark, ("r", "a", "1"), ("r", "b", "2"), ("r", "c", "3")), rows(spark, ("l", "b", "other"))
    src, dst = (spark.createDataFrame([(k,)], "file_key string") for k in "13")
    plan = move.move_plan(frm, to, src, dst, SPEC, on_conflict="report")
    assert {tuple(r) for r in plan.collect()} == {("1", "a", "copy"), ("3", "c", "record_only"), ("2", "b", "conflict")}
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Join FullOuter") == 1
    assert [r["path"] for r in move.move_plan(frm, to, src, dst, SPEC, limit=1, on_conflict="report").orderBy("path").collect()] == ["a", "b"]
