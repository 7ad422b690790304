"""Stores: what bytes each repository holds. Presence: repo_uuid, file_key, size. Content: file_key, content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions.keys import content_keys, parse_keys, shard_paths
from stowage.operators import bloom
from stowage.operators.bloom import BloomFilter
from stowage.operators.inventory import upsert
from stowage.operators.spec import TableSpec
from stowage.sources import paths


class MissingContent(Exception):
    """Keys without content in a store."""


def insert_missing(dst: DataFrame, new: DataFrame, on_exists: str = "error") -> DataFrame:
    """dst and the rows of new whose key it lacks, each key once; with on_exists='error' a held key raises."""
    if on_exists == "error" and (first := new.join(dst.select("file_key"), "file_key", "left_semi").select("file_key").limit(1).collect()):
        raise FileExistsError(first[0]["file_key"])
    fresh = new.select(*dst.columns).join(dst.select("file_key"), "file_key", "left_anti").select(*dst.columns)
    return dst.union(fresh.dropDuplicates(["file_key"]))


#: Digits of p1, the first part of a storage path, by which content lies in folders: 256 of them.
FOLDER_DIGITS = 2


def write_content(content: DataFrame, path: str, mode: str = "append") -> None:
    """Content as Parquet under folders by the first digits of its storage path.

    Rows are dealt by folder, so a write adds one file to each folder (or more
    where it has much for one) and not one from every task; they lie in order of
    the path's first part, so a reader of a few parts skips the rest.
    """
    placed = shard_paths(content).withColumn("folder", F.left("p1", F.lit(FOLDER_DIGITS)))
    placed.hint("rebalance", "folder").sortWithinPartitions("folder", "p1").write.mode(mode).partitionBy("folder").parquet(path)


def stored_in_folders(spark: SparkSession, path: str, schema: str, keys: DataFrame | None = None) -> DataFrame | None:
    """Rows of the content at path, with p1 and folder; None if there are none. With keys (file_key) only the folders that these lie in are listed, and only their parts read."""
    held = [n for n in paths.names(spark, path) if n.startswith("folder=")]
    parts: list[str] = []
    if keys is not None and held:
        parts = [r["p1"] for r in shard_paths(keys.select("file_key")).select("p1").distinct().collect()]  # 4,096 at most
        wanted = {f"folder={p[:FOLDER_DIGITS]}" for p in parts}
        held = [n for n in held if n in wanted]
    if not held:
        return None
    rows = spark.read.schema(f"{schema}, p1 string, folder string").option("basePath", path).parquet(*(f"{path}/{n}" for n in held))
    return rows if keys is None else rows.where("p1 in ('" + "', '".join(parts) + "')")  # one call; isin() makes a call for each


def read_content(content: DataFrame, keys: DataFrame, on_missing: str = "error") -> DataFrame:
    """file_key, content and found for each key; with on_missing='error' reading the content of an absent key raises."""
    held = content.select("file_key", "content", F.lit(True).alias("found"))
    out = keys.select("file_key").join(held, "file_key", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    if on_missing == "error":
        missing = F.raise_error(F.concat(F.lit("no content for key "), F.col("file_key")))
        out = out.withColumn("content", F.when(F.col("found"), F.col("content")).otherwise(missing.cast(dict(content.dtypes)["content"])))
    return out


def copy_keys(keys: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """dst with the content of those listed keys that it lacks and src holds."""
    return insert_missing(dst, src.join(keys.select("file_key").distinct(), "file_key", "left_semi"), "ignore")


def import_records(df: DataFrame, content_col: str, ext_col: str | None, spec: TableSpec | None = None, repo_uuid: str | None = None) -> tuple[DataFrame | None, DataFrame]:
    """Rows of the table (None without a spec) and content, each key once."""
    keyed = content_keys(df, content_col, ext_col)
    content = keyed.select("file_key", F.col(content_col).alias("content")).dropDuplicates(["file_key"])
    if spec is None:
        return None, content
    rows = keyed.select(F.lit(repo_uuid).alias("repo_uuid"), *spec.keys, F.col("file_key").alias(spec.file_column))
    return upsert(None, rows, spec, [spec.file_column]), content


def layered_read(stores: list[DataFrame]) -> DataFrame:
    """Each key's row from the first store that holds it, with its layer. A minimum per key, added up inside tasks first."""
    columns = stores[0].columns
    rest = [c for c in columns if c != "file_key"]
    all_rows = reduce(DataFrame.union, (s.select("file_key", F.struct(F.lit(i).alias("layer"), *rest).alias("v")) for i, s in enumerate(stores)))
    return all_rows.groupBy("file_key").agg(F.min("v").alias("v")).select("file_key", *(F.col(f"v.{c}").alias(c) for c in rest), F.col("v.layer").alias("layer"))


def layered_write(stores: list[DataFrame], new: DataFrame, on_exists: str = "ignore") -> list[DataFrame]:
    """Writes go to the first store."""
    return [insert_missing(stores[0], new, on_exists), *stores[1:]]


def layered_exists(keys: DataFrame, stores: list[DataFrame]) -> DataFrame:
    """keys with exists: some layer holds the key."""
    held = reduce(DataFrame.union, (s.select("file_key") for s in stores)).distinct().withColumn("exists", F.lit(True))
    return keys.join(held, "file_key", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def possibly_exists(keys: DataFrame, stores: list[DataFrame | BloomFilter], exact: list[bool], rate: float = 0.01) -> DataFrame:
    """keys with answer yes, maybe or no: that of the first layer that does not say no.

    An exact layer says yes or no. Another one, a store or a filter that was
    built of it, says maybe for every key that it holds, and of those it lacks
    for a share of `rate` (of a filter: its own rate). A null key is in no layer.
    """
    out, answers = keys, []
    for i, (store, sure) in enumerate(zip(stores, exact, strict=True)):
        name = f"_a{i}"
        if sure:
            out = out.join(store.select("file_key").distinct().withColumn(name, F.lit("yes")), "file_key", "left")
        else:
            out = bloom.probe(out, store if isinstance(store, BloomFilter) else bloom.build(store, rate), name).withColumn(name, F.when(F.col(name), "maybe"))
        answers.append(name)
    return out.withColumn("answer", F.coalesce(*answers, F.lit("no"))).drop(*answers)


def whereis(keys: DataFrame, presence: DataFrame, repos: DataFrame, repo: str | None = None) -> DataFrame:
    """file_key and repos: the (name, uuid) of each repository that holds it, in order of name; one repository if named."""
    known = repos if repo is None else repos.where((F.col("name") == repo) | (F.col("uuid") == repo))
    held = presence.join(known, presence["repo_uuid"] == known["uuid"]).select("file_key", "name", "uuid").distinct()
    asked = keys.select("file_key").distinct()
    one = F.when(F.col("uuid").isNotNull(), F.struct("name", "uuid"))
    return asked.join(held, "file_key", "left").groupBy("file_key").agg(F.array_sort(F.collect_list(one)).alias("repos"))


def stat_keys(keys: DataFrame, presence: DataFrame, repo_uuid: str) -> DataFrame:
    """keys with exists and size in one store; the size of a missing key is null."""
    held = presence.where(F.col("repo_uuid") == repo_uuid).groupBy("file_key").agg(F.max("size").alias("size"), F.lit(True).alias("exists"))
    return keys.join(held, "file_key", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def store_stats(presence: DataFrame, by: list[str] = ("repo_uuid",)) -> DataFrame:
    return presence.groupBy(*by).agg(F.count("*").alias("n_files"), F.sum("size").alias("total_bytes"))


def coverage(inv: DataFrame, spec: TableSpec) -> DataFrame:
    """For each repository, how many of all keys it holds; copy is total or partial."""
    held = inv.select("repo_uuid", *spec.keys).distinct()
    whole = held.select(*spec.keys).distinct().agg(F.count("*").alias("n_all"))  # one row
    each = held.groupBy("repo_uuid").agg(F.count("*").alias("n_held")).join(F.broadcast(whole), F.lit(True))
    return each.withColumn("share", F.col("n_held") / F.col("n_all")).withColumn("copy", F.when(F.col("n_held") == F.col("n_all"), "total").otherwise("partial"))


def replica_counts(presence: DataFrame) -> DataFrame:
    return presence.groupBy("file_key").agg(F.countDistinct("repo_uuid").alias("n_repos"))


def shared_keys(inv: DataFrame, file_column: str = "file_key") -> DataFrame:
    """File keys that more than one row uses."""
    return inv.groupBy(file_column).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def extension_variants(keys: DataFrame, key_col: str = "file_key") -> DataFrame:
    """Groups of keys of the same bytes under more than one extension."""
    parsed = parse_keys(keys.select(key_col).distinct(), key_col).where("well_formed")
    return parsed.groupBy("size", "sha256").agg(F.array_sort(F.collect_set(F.coalesce("ext", F.lit("")))).alias("exts")).where(F.size("exts") > 1)


def empty_content(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "file_key string, content binary")
