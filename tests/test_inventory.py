import pytest
from pyspark.sql import functions as F

from stowage.operators import diff, inventory, move, stores
from stowage.operators.spec import DatasetSpec, TableSpec

SPEC = TableSpec("test_table", ("path",))
L, R = "local", "remote"


def inv(spark, rows):
    return spark.createDataFrame(rows, "repo_uuid string, path string, file_key string")


def side(df, repo):
    return df.where(F.col("repo_uuid") == repo)


def store(spark, keys):
    return spark.createDataFrame([(k, f"bytes of {k}") for k in keys], "file_key string, content string")


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_filters(spark):
    df = spark.createDataFrame([(1, "a=b"), (2, "c")], "id long, v string")
    assert as_set(inventory.filter_rows(df, ["v=a=b", "id=1"])) == {(1, "a=b")}
    with pytest.raises(ValueError, match="Invalid filter string"):
        inventory.filter_rows(df, ["nothing"])
    spec = TableSpec("t", ("id", "v"))
    assert df.where(inventory.key_predicate(spec, [2])).count() == 1
    assert df.where(inventory.key_predicate(spec, [])).count() == 2
    with pytest.raises(ValueError):
        inventory.key_predicate(spec, [1, 2, 3])


def test_upsert_last_wins_and_is_idempotent(spark):
    old = inv(spark, [(L, "p", "k0"), (R, "p", "r0"), (L, "q", "k1")])
    new = spark.createDataFrame([(L, "p", "k2", 1), (L, "p", "k3", 2), (L, "n", None, 1)], "repo_uuid string, path string, file_key string, n int")
    want = {(L, "p", "k3"), (R, "p", "r0"), (L, "q", "k1"), (L, "n", None)}
    once = inventory.upsert(old.withColumn("n", F.lit(9)), new, SPEC, ["n"])
    assert as_set(once.drop("n")) == want
    assert as_set(inventory.upsert(once, new, SPEC, ["n"]).drop("n")) == want
    assert as_set(inventory.upsert(None, new.where("false"), SPEC, ["n"])) == set()


def test_upsert_pads_columns_that_one_side_lacks(spark):
    old = spark.createDataFrame([(L, "a", "1", "kept"), (L, "b", "2", "replaced")], "repo_uuid string, path string, file_key string, note string")
    new = spark.createDataFrame([(L, "b", "3", 7), (L, "c", "4", 8)], "repo_uuid string, path string, file_key string, size int")
    got = {r["path"]: (r["file_key"], r["note"], r["size"]) for r in inventory.upsert(old, new, SPEC, ["size"]).collect()}
    assert got == {"a": ("1", "kept", None), "b": ("3", None, 7), "c": ("4", None, 8)}


def test_a_merge_that_must_not_conflict_is_made_once(spark):
    frm, to = inv(spark, [(R, "a", "k"), (R, "b", "k")]).drop("repo_uuid"), inv(spark, [(L, "a", "k")]).drop("repo_uuid")
    rows = diff.diff_keys(frm, to, SPEC)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and as_set(rows) == {("k", "b")}
    merged, bad = diff.merge_tables(None, to, frm, SPEC)
    assert "Join" not in merged._jdf.queryExecution().optimizedPlan().toString() and merged.count() == 2 and bad.count() == 0


def test_lookups_and_prefixes(spark):
    spec = TableSpec("t", ("source", "id"))
    held = spark.createDataFrame([(L, "s", 1, "k1"), (L, "s", 2, "k0"), (R, "z", 1, "k9")], "repo_uuid string, source string, id long, file_key string")
    keys = spark.createDataFrame([("s",), ("z",)], "source string")
    assert as_set(inventory.has_rows(keys, held, spec, L)) == {("s", True), ("z", False)}
    assert as_set(inventory.get_rows_by_key(keys, held, spec, L)) == {("s", "k0"), ("z", None)}
    assert inventory.read_rows(held, spec, L).columns == ["file_key", "source", "id"]


def test_stored_inventory_replaces_one_repository(spark, tmp_path):
    path = str(tmp_path / "inv")
    inventory.write_inventory(inv(spark, [(L, "a", "1"), (R, "b", "2")]), path)
    inventory.write_inventory(inv(spark, [(L, "c", "3")]), path)
    got = inventory.read_inventory(spark, path, "path string, file_key string, repo_uuid string")
    assert as_set(got.select("repo_uuid", "path", "file_key")) == {(L, "c", "3"), (R, "b", "2")}
    assert side(got, "absent").count() == 0


def test_diff_then_apply_leaves_no_diff(spark):
    a = inv(spark, [(L, "same", "k"), (L, "gone", "k1"), (L, "mod", "k2"), (L, "null", None)])
    b = inv(spark, [(R, "same", "k"), (R, "new", "k3"), (R, "mod", "k4"), (R, "null", None)])
    got = as_set(diff.diff_tables(a, b, SPEC))
    assert got == {("gone", "removed", "k1", None), ("new", "added", None, "k3"), ("mod", "modified", "k2", "k4")}
    assert diff.diff_tables(a, a, SPEC).count() == 0
    assert as_set(diff.missing_rows(b, a, SPEC)) == {("k3", "new")}


def test_three_way_merge(spark):
    t = lambda rows: spark.createDataFrame(rows, "path string, file_key string")
    base = t([("same", "0"), ("l", "0"), ("r", "0"), ("both", "0"), ("del", "0"), ("deledit", "0"), ("bothdel", "0")])
    left = t([("same", "0"), ("l", "L"), ("r", "0"), ("both", "L"), ("del", "0"), ("added", "L"), ("twice", "X")])
    right = t([("same", "0"), ("l", "0"), ("r", "R"), ("both", "R"), ("deledit", "R"), ("twice", "X")])
    rows, bad = diff.merge_tables(base, left, right, SPEC, "report")
    assert as_set(rows) == {("0", "same"), ("L", "l"), ("R", "r"), ("L", "added"), ("X", "twice")}
    assert {r["path"] for r in bad.collect()} == {"both", "deledit"}
    with pytest.raises(diff.MergeConflict):
        diff.merge_tables(base, left, right, SPEC)
    assert as_set(diff.union_inventory(left, left, SPEC)) == {(r[1], r[0]) for r in as_set(left)}


def move_once(spark, rows, src, dst, **options):
    new, dst, summary = move.move_dataset(DatasetSpec("d", (SPEC,)), {"test_table": rows}, R, L, src, dst, **options)
    return new["test_table"], dst, {r["status"]: r["n_files"] for r in summary.collect()}


def test_pull_two_then_none_then_one(spark):
    rows, src, dst = inv(spark, [(R, "a", "k1"), (R, "b", "k2")]), store(spark, ["k1", "k2", "k3"]), store(spark, [])
    rows, dst, n = move_once(spark, rows, src, dst)
    assert n == {"copy": 2} and as_set(side(rows, L)) == {(L, "a", "k1"), (L, "b", "k2")} and dst.count() == 2
    rows, dst, n = move_once(spark, rows, src, dst)
    assert n == {}
    rows, dst, n = move_once(spark, rows.union(inv(spark, [(R, "c", "k3")])), src, dst)
    assert n == {"copy": 1} and dst.count() == 3


def test_missing_file_is_an_error_after_the_rest_moved(spark):
    rows, src, dst = inv(spark, [(R, "a", "k1"), (R, "b", "lost")]), store(spark, ["k1"]), store(spark, [])
    plan = move.move_plan(side(rows, R).drop("repo_uuid"), side(rows, L).drop("repo_uuid"), src, dst, SPEC)
    assert as_set(move.apply_rows(plan, rows, SPEC, L).where("repo_uuid = 'local'")) == {(L, "a", "k1")}
    assert move.apply_content(plan, src, dst).count() == 1
    with pytest.raises(stores.MissingContent):
        move.require_content(plan)
    assert move_once(spark, rows, src, dst, ignore_missing=True)[2] == {"copy": 1, "skipped_missing": 1}


def test_held_bytes_are_recorded_not_copied(spark):
    rows, dst = inv(spark, [(R, "a", "k1")]), spark.createDataFrame([("k1", "other bytes")], "file_key string, content string")
    rows, dst, n = move_once(spark, rows, store(spark, ["k1"]), dst)
    assert n == {"record_only": 1} and as_set(dst) == {("k1", "other bytes")} and side(rows, L).count() == 1


def test_filters_limits_and_conflicts_of_a_move(spark):
    rows = inv(spark, [(R, p, "k") for p in "dcba"] + [(L, "d", "else")])
    frm, to = side(rows, R), side(rows, L)
    with pytest.raises(diff.MergeConflict):
        diff.diff_keys(frm, to, SPEC)
    assert [r["path"] for r in diff.diff_keys(frm, to, SPEC, limit=2, on_conflict="report").collect()] == ["a", "b"]
    plan = move.move_plan(frm, to, store(spark, ["k"]), store(spark, []), SPEC, where=["path=d"], on_conflict="report")
    assert as_set(plan) == {("k", "d", "conflict")}


def test_fingerprint_ignores_order(spark):
    rows = [(L, "a", "1"), (L, "b", None), (L, "c", "3")]
    prints = {tuple(inventory.fingerprint(inv(spark, r), SPEC).first()) for r in (rows, rows[::-1])}
    assert len(prints) == 1 and tuple(inventory.fingerprint(inv(spark, rows[:2]), SPEC).first()) not in prints


def test_layers(spark):
    one, two = store(spark, ["k1"]), spark.createDataFrame([("k1", "shadowed"), ("k2", "two")], "file_key string, content string")
    assert as_set(stores.layered_read([one, two])) == {("k1", "bytes of k1", 0), ("k2", "two", 1)}
    keys = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "file_key string")
    assert as_set(stores.layered_exists(keys, [one, two])) == {("k1", True), ("k2", True), ("k3", False)}
    answers = dict(as_set(stores.possibly_exists(keys, [one, two], [True, False])))
    assert answers["k1"] == "yes" and answers["k2"] == "maybe" and answers["k3"] in ("no", "maybe")
    first, second = stores.layered_write([one, two], two)
    assert first.count() == 2 and second is two
    with pytest.raises(FileExistsError):
        stores.insert_missing(one, two)
    with pytest.raises(Exception, match="no content for key k3"):
        stores.read_content(two, keys).collect()


def test_whereis(spark):
    repos = spark.createDataFrame([("local", "1"), ("remote", "2")], "name string, uuid string")
    held = spark.createDataFrame([("1", "k", 5), ("2", "k", 5), ("2", "r", 6)], "repo_uuid string, file_key string, size long")
    keys = spark.createDataFrame([("k",), ("r",), ("none",)], "file_key string")
    got = {r["file_key"]: [x["name"] for x in r["repos"]] for r in stores.whereis(keys, held, repos).collect()}
    assert got == {"k": ["local", "remote"], "r": ["remote"], "none": []}
    assert {r["file_key"]: len(r["repos"]) for r in stores.whereis(keys, held, repos, "local").collect()} == {"k": 1, "r": 0, "none": 0}
    assert as_set(stores.stat_keys(keys, held, "1")) == {("k", 5, True), ("r", None, False), ("none", None, False)}
    assert as_set(stores.replica_counts(held)) == {("k", 2), ("r", 1)}


def test_key_conditions_reach_the_scans(spark, tmp_path):
    spec = TableSpec("t", ("source", "id"))
    for name in "ab":
        spark.createDataFrame([("s", 1, name), ("z", 2, name)], "source string, id long, file_key string").write.parquet(f"{tmp_path}/{name}")
    a, b = (spark.read.parquet(f"{tmp_path}/{name}") for name in "ab")
    rows = diff.diff_keys(a, b.where("id > 1"), spec, where=["source=s", "file_key=a"], on_conflict="report")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(source,s)") == 2
    assert as_set(rows) == {("a", "s", 1)}
