"""Inventories stored in leaves, with a tree of prints over them.

A row's leaf is the first digits of its key's hash. A commit adds one file to
each leaf that its rows fall in and touches no other; the row of a key is that
of the last commit, and a row that is gone is kept as such until its leaf is
compacted. Above the leaves stands a tree with a node for each shorter prefix,
for each repository: number of rows, a print (the bitwise sum of the hashes of
all rows below, so a commit only adds what its keys change) and the sums of
some columns. Two stored inventories are compared from the root down, and only
leaves whose prints differ are read.

    rows/leaf=l3f/repo=r<uuid>/commit=c000000000007-<attempt>/   rows of a commit
    tree/commit=c000000000007-<attempt>/level=2/                 what it changes in nodes
    attempts/<commit>--<label>, commits/<commit>--<label>        empty files

A commit begins as a name in attempts and is whole once that name is moved to
commits: one rename, before which no reader sees its rows or nodes, and which
also records the label, so work that is done again after a failure is known to
be done. This takes a file system that renames atomically, and one writer at a
time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.operators import diff, inventory
from stowage.operators.spec import TableSpec
from stowage.sources import paths

#: Digits of a leaf at most: the driver holds the names of 16 ** DIGITS leaves.
DIGITS = 4


@dataclass(frozen=True)
class LeafStore:
    """schema: DDL of the key columns and all others but repo_uuid; sums: whole-number columns that nodes add up."""

    spark: SparkSession
    path: str
    spec: TableSpec
    schema: str
    digits: int = 2
    sums: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not 1 <= self.digits <= DIGITS:
            raise ValueError(f"a leaf has 1 to {DIGITS} digits")

    @property
    def columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    @property
    def values(self) -> list[str]:
        return [c for c in self.columns if c not in self.spec.keys]


def key_hash(spec: TableSpec) -> Column:
    """Hexadecimal digits that order keys by chance, the same in all inventories."""
    return F.md5(F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("\\N")) for k in spec.keys)).cast("binary"))


def _leaf(store: LeafStore) -> Column:
    return F.left(key_hash(store.spec), F.lit(store.digits))


def _pending(store: LeafStore) -> list[str]:
    """Commits that began and are not whole: running or broken off."""
    return [n.partition("--")[0] for n in paths.names(store.spark, f"{store.path}/attempts")]


def committed(store: LeafStore, label: str) -> bool:
    return any(n.partition("--")[2] == label for n in paths.names(store.spark, f"{store.path}/commits"))


def read_versions(store: LeafStore, leaves: list[str] | None = None) -> DataFrame:
    """Every version of every row of the leaves (all by default): leaf, repo, commit, repo_uuid, the store's columns, gone. Other leaves are not even listed."""
    held = paths.names(store.spark, f"{store.path}/rows")
    asked = None if leaves is None else set(leaves)
    wanted = [n for n in held if n.startswith("leaf=") and (asked is None or n.removeprefix("leaf=l") in asked)]
    schema = f"repo_uuid string, {store.schema}, gone boolean, leaf string, repo string, commit string"
    if not wanted:
        return store.spark.createDataFrame([], schema)
    files = store.spark.read.schema(schema).option("basePath", f"{store.path}/rows").parquet(*(f"{store.path}/rows/{n}" for n in wanted))
    pending = _pending(store)
    return files.where(~F.col("commit").isin(pending)) if pending else files


def last_commit(store: LeafStore) -> str:
    """The name of the last whole commit; empty before the first."""
    return max((n.partition("--")[0] for n in paths.names(store.spark, f"{store.path}/commits")), default="")


def read_leaves(store: LeafStore, leaves: list[str] | None = None, repo_uuid: str | None = None, as_of: str | None = None) -> DataFrame:
    """repo_uuid and the store's columns: each key's row of the last commit, without those gone.

    as_of: the rows as they were after that commit, for instance as the base of
    a merge. Leaves that were compacted since have lost it.
    """
    rows = read_versions(store, leaves)
    if as_of is not None:
        rows = rows.where(F.col("commit") <= as_of)
    if repo_uuid is not None:
        rows = rows.where(F.col("repo") == "r" + repo_uuid)
    last = rows.groupBy("repo_uuid", *store.spec.keys).agg(F.max(F.struct("commit", "gone", *store.values)).alias("v")).where("not v.gone")
    return last.select("repo_uuid", *(F.col(c if c in store.spec.keys else f"v.{c}").alias(c) for c in store.columns))


def _next(store: LeafStore) -> str:
    both = [n for f in ("attempts", "commits") for n in paths.names(store.spark, f"{store.path}/{f}")]
    number = 1 + max((int(n[1:13]) for n in both), default=0)
    return f"c{number:012d}-{uuid.uuid4().hex[:8]}"


def _deltas(store: LeafStore, name: str) -> DataFrame:
    """What the rows of a commit that is not whole yet change in each node: level, repo_uuid, prefix, n_rows, print and the sums."""
    new = store.spark.read.schema(f"repo_uuid string, {store.schema}, gone boolean, leaf string, repo string, commit string").option("basePath", f"{store.path}/rows").parquet(f"{store.path}/rows/leaf=*/repo=*/commit={name}")
    touched = [r["leaf"][1:] for r in new.select("leaf").distinct().collect()]  # 16 ** digits at most
    keys = ["repo_uuid", *store.spec.keys]
    old = read_leaves(store, touched).join(new.select(*keys), keys, "left_semi")
    signed = new.where("not gone").withColumn("sign", F.lit(1)).select(*keys, *store.values, "sign").union(old.withColumn("sign", F.lit(-1)).select(*keys, *store.values, "sign"))
    sums = [F.sum(F.col("sign") * F.coalesce(F.col(c), F.lit(0))).cast("bigint").alias(c) for c in store.sums]
    by_leaf = signed.groupBy("repo_uuid", _leaf(store).alias("l")).agg(F.sum("sign").alias("n_rows"), F.bit_xor(inventory.row_print(store.spec)).alias("print"), *sums)
    above = by_leaf.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(store.digits)))).withColumn("prefix", F.expr("left(l, level)"))
    return above.groupBy("level", "repo_uuid", "prefix").agg(F.sum("n_rows").alias("n_rows"), F.bit_xor("print").alias("print"), *(F.sum(c).alias(c) for c in store.sums))


def commit(store: LeafStore, rows: DataFrame, order_by: list[Column | str] = (), label: str = "") -> bool:
    """Adds or replaces rows by repository and key; rows with gone = true take the key away. False if the label is committed already.

    rows: repo_uuid, the store's columns and perhaps gone; others are left out
    and missing ones are null. Of rows with one key the last by order_by counts
    (ties: the greatest row).
    """
    if label and committed(store, label):
        return False
    spark, name = store.spark, _next(store)
    begun = f"{store.path}/attempts/{name}--{label}"
    paths.mark(spark, begun)
    like = spark.createDataFrame([], f"repo_uuid string, {store.schema}, gone boolean")
    padded = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema.fields), *(o.alias(f"_by{i}") if isinstance(o, Column) else F.col(o).alias(f"_by{i}") for i, o in enumerate(order_by)))
    padded = padded.withColumn("gone", F.coalesce("gone", F.lit(False)))
    new = inventory.upsert(None, padded, store.spec, [f"_by{i}" for i in range(len(order_by))]).select(*like.columns)
    placed = new.withColumns({"leaf": F.concat(F.lit("l"), _leaf(store)), "repo": F.concat(F.lit("r"), "repo_uuid"), "commit": F.lit(name)})
    placed.hint("rebalance", "leaf", "repo").write.mode("append").partitionBy("leaf", "repo", "commit").parquet(f"{store.path}/rows")
    if paths.any_like(spark, f"{store.path}/rows/leaf=*/repo=*/commit={name}"):
        _deltas(store, name).write.partitionBy("level").parquet(f"{store.path}/tree/commit={name}")
    paths.rename(spark, begun, f"{store.path}/commits/{name}--{label}")
    return True


def nodes(store: LeafStore, repo_uuid: str | None = None, level: int | None = None, parents: list[str] | None = None) -> DataFrame:
    """repo_uuid, level, prefix, n_rows, print and the sums of the tree's nodes: of one level, or below some nodes of the level above, if given."""
    spark = store.spark
    sums = "".join(f", {c} bigint" for c in store.sums)
    schema = f"repo_uuid string, prefix string, n_rows bigint, print bigint{sums}, commit string, level int"
    whole = [n.partition("--") for n in paths.names(spark, f"{store.path}/commits")]
    base, pending = max((name for name, _, label in whole if label == _COMPACT), default=""), _pending(store)
    held = [n for n in paths.names(spark, f"{store.path}/tree") if base <= n.removeprefix("commit=") and n.removeprefix("commit=") not in pending]
    if not held:
        return spark.createDataFrame([], schema).drop("commit")
    tree = spark.read.schema(schema).option("basePath", f"{store.path}/tree").parquet(*(f"{store.path}/tree/{n}" for n in held))
    if repo_uuid is not None:
        tree = tree.where(F.col("repo_uuid") == repo_uuid)
    if level is not None:
        tree = tree.where(F.col("level") == level)
    if parents is not None:
        tree = tree.where(F.expr("left(prefix, level - 1)").isin(parents))
    return tree.groupBy("repo_uuid", "level", "prefix").agg(F.sum("n_rows").alias("n_rows"), F.bit_xor("print").alias("print"), *(F.sum(c).alias(c) for c in store.sums))


def differing_leaves(a: LeafStore, repo_a: str, b: LeafStore, repo_b: str) -> list[str]:
    """Prefixes of the leaves (the shorter of the two stores' digits) in which the repositories' rows differ, found from the root down."""
    differ = [""]
    for level in range(min(a.digits, b.digits) + 1):
        parents = differ if level else None
        side = lambda s, r, n, level=level, parents=parents: nodes(s, r, level, parents).select("prefix", F.struct("n_rows", "print").alias(n))
        none = F.struct(F.lit(0).cast("bigint").alias("n_rows"), F.lit(0).cast("bigint").alias("print"))
        both = side(a, repo_a, "x").join(side(b, repo_b, "y"), "prefix", "full")
        differ = sorted(r["prefix"] for r in both.where(F.coalesce("x", none) != F.coalesce("y", none)).select("prefix").collect())
        if not differ:
            break
    return differ


def sides(a: LeafStore, repo_a: str, b: LeafStore, repo_b: str) -> tuple[DataFrame, DataFrame]:
    """Rows (file column, keys) of both repositories in the leaves that differ: what diffs, merges without a base and plans need. Equal leaves are not read."""
    differ, short = set(differing_leaves(a, repo_a, b, repo_b)), min(a.digits, b.digits)

    def side(store: LeafStore, repo: str) -> DataFrame:
        held = [n.removeprefix("leaf=l") for n in paths.names(store.spark, f"{store.path}/rows") if n.startswith("leaf=")]
        return read_leaves(store, [n for n in held if n[:short] in differ], repo).select(*store.spec.columns)

    return side(a, repo_a), side(b, repo_b)


def stored_diff(frm: LeafStore, repo_frm: str, to: LeafStore, repo_to: str) -> DataFrame:
    """As diff_tables() of the two repositories' rows."""
    return diff.diff_tables(*sides(frm, repo_frm, to, repo_to), frm.spec)


def stored_missing(frm: LeafStore, repo_frm: str, to: LeafStore, repo_to: str) -> DataFrame:
    """As missing_rows() of the two repositories' rows."""
    return diff.missing_rows(*sides(frm, repo_frm, to, repo_to), frm.spec)


def leaves_of(store: LeafStore, keys: DataFrame) -> list[str]:
    return [r["l"] for r in keys.select(_leaf(store).alias("l")).distinct().collect()]  # 16 ** digits at most


def look_up(store: LeafStore, keys: DataFrame, repo_uuid: str) -> DataFrame:
    """keys (all key columns) with has_row and the store's other columns, null where the repository has no such row. Only leaves of these keys are read."""
    names = list(store.spec.keys)
    held = read_leaves(store, leaves_of(store, keys), repo_uuid).drop("repo_uuid").withColumn("has_row", F.lit(True))
    return keys.join(held, names, "left").withColumn("has_row", F.coalesce("has_row", F.lit(False)))


_COMPACT = "compact"


def compact(store: LeafStore, least: int = 2) -> list[str]:
    """Rewrites each leaf that has `least` commits or more as one, without rows gone, and the tree's nodes as one; the leaves rewritten.

    The rewritten leaf and the tree are one commit. Older files go after it,
    from the oldest on: what is left then always reads the same, since a key's
    last version, or the mark that it is gone, goes last.
    """
    spark, pending = store.spark, set(_pending(store))
    parts: dict[str, set[str]] = {}
    for leaf in paths.names(spark, f"{store.path}/rows"):
        if leaf.startswith("leaf="):
            for repo in paths.names(spark, f"{store.path}/rows/{leaf}"):
                for c in paths.names(spark, f"{store.path}/rows/{leaf}/{repo}"):
                    parts.setdefault(leaf.removeprefix("leaf=l"), set()).add(c.removeprefix("commit="))
    many = sorted(leaf for leaf, cs in parts.items() if len(cs - pending) >= least)
    name = _next(store)
    begun = f"{store.path}/attempts/{name}--{_COMPACT}"
    tree = nodes(store).where("n_rows <> 0 or print <> 0")
    paths.mark(spark, begun)
    tree.write.partitionBy("level").parquet(f"{store.path}/tree/commit={name}")
    if many:
        rows = read_leaves(store, many).withColumns({"gone": F.lit(False), "leaf": F.concat(F.lit("l"), _leaf(store)), "repo": F.concat(F.lit("r"), "repo_uuid"), "commit": F.lit(name)})
        rows.hint("rebalance", "leaf", "repo").write.mode("append").partitionBy("leaf", "repo", "commit").parquet(f"{store.path}/rows")
    paths.rename(spark, begun, f"{store.path}/commits/{name}--{_COMPACT}")
    for leaf in many:
        for c in sorted(parts[leaf] - pending):
            for repo in paths.names(spark, f"{store.path}/rows/leaf=l{leaf}"):
                paths.delete(spark, f"{store.path}/rows/leaf=l{leaf}/{repo}/commit={c}")
    for n in paths.names(spark, f"{store.path}/tree"):
        if n.removeprefix("commit=") < name and n.removeprefix("commit=") not in pending:
            paths.delete(spark, f"{store.path}/tree/{n}")
    return many
