"""Inventories: which rows each repository holds (repo_uuid, key columns, file_key)."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.operators.spec import TableSpec


def filter_rows(df: DataFrame, where: list[str]) -> DataFrame:
    """Rows that meet every `column=value`, split at the first =; the value is cast to the column's type."""
    types = {f.name: f.dataType for f in df.schema.fields}
    for text in where:
        name, sign, value = text.partition("=")
        if not sign:
            raise ValueError(f"Invalid filter string: {text}")
        df = df.where(F.col(name) == F.lit(value).cast(types.get(name, "string")))
    return df


def key_predicate(spec: TableSpec, values: list) -> Column:
    """Equality on the leading key columns."""
    if len(values) > len(spec.keys):
        raise ValueError(f"{len(values)} values for {len(spec.keys)} key columns")
    return reduce(and_, (F.col(k) == F.lit(v) for k, v in zip(spec.keys, values, strict=False)), F.lit(True))


def of_repo(inv: DataFrame, repo_uuid: str) -> DataFrame:
    return inv.where(F.col("repo_uuid") == repo_uuid)


def read_rows(inv: DataFrame, spec: TableSpec, repo_uuid: str, where: list[str] = ()) -> DataFrame:
    """File column, then key columns, of one repository's rows. On a stored inventory only its folder is read."""
    return filter_rows(of_repo(inv, repo_uuid), list(where)).select(*spec.columns)


def has_rows(keys: DataFrame, inv: DataFrame, spec: TableSpec, repo_uuid: str) -> DataFrame:
    """keys (the leading key columns or all) with has_row."""
    names = [k for k in spec.keys if k in keys.columns]
    held = of_repo(inv, repo_uuid).select(*names).distinct().withColumn("has_row", F.lit(True))
    return keys.join(held, names, "left").withColumn("has_row", F.coalesce("has_row", F.lit(False)))


def get_rows_by_key(keys: DataFrame, inv: DataFrame, spec: TableSpec, repo_uuid: str) -> DataFrame:
    """keys (the leading key columns or all) with the file key; the least one if several rows fit, null if none."""
    names = [k for k in spec.keys if k in keys.columns]
    held = of_repo(inv, repo_uuid).groupBy(*names).agg(F.min(spec.file_column).alias(spec.file_column))
    return keys.join(held, names, "left")


def padded(df: DataFrame, like: DataFrame) -> DataFrame:
    """df with the columns of `like`, null where it has none."""
    return df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema.fields))


def upsert(inv: DataFrame | None, new: DataFrame, spec: TableSpec, order_by: list[Column | str]) -> DataFrame:
    """Insert or replace by repository and key. Of new rows with one key the last by order_by stays.

    A maximum over (is new, order, content) per key: it is added up inside
    tasks before the shuffle, so a key that is written over and over does not
    gather its rows. Ties in order_by go to the greatest row. A column that only
    one side has is null in the other's rows.
    """
    columns = ["repo_uuid", *spec.keys]
    if inv is not None:
        every = new.limit(0).unionByName(inv.limit(0), allowMissingColumns=True)
        order_by = [F.col(c) if isinstance(c, str) else c for c in order_by]
        inv, new = padded(inv, every), padded(new, every)
    rest = [c for c in new.columns if c not in columns]
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    ranked = new.select(*columns, F.struct(F.lit(1).alias("_new"), *(o.alias(f"_o{i}") for i, o in enumerate(order)), *rest).alias("_v"))
    if inv is not None:
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in new.select(*(o.alias(f"_o{i}") for i, o in enumerate(order))).schema.fields]
        ranked = inv.select(*columns, F.struct(F.lit(0).alias("_new"), *blank, *rest).alias("_v")).union(ranked)
    return ranked.groupBy(*columns).agg(F.max("_v").alias("_v")).select(*columns, *(F.col(f"_v.{c}").alias(c) for c in rest))


def write_inventory(inv: DataFrame, path: str) -> None:
    """Replaces the folders of the repositories that inv has rows of; others stay. inv must not be read from path.

    Rows are dealt by all their columns into ranges, so a large repository or source is many files and a small one few.
    """
    inv.repartitionByRange("repo_uuid", *[c for c in inv.columns if c != "repo_uuid"]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_uuid").parquet(path)


def read_inventory(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The stored inventory. With a schema, a folder without files reads as no rows."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def row_print(spec: TableSpec) -> Column:
    """60 bits of the hash of a row's file column and keys."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in spec.columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *fields).cast("binary")), 1, 15), 16, 10).cast("bigint")


def fingerprint(inv: DataFrame, spec: TableSpec, by: list[str] = ()) -> DataFrame:
    """n_rows and print: equal for tables with the same rows in any order. Added up inside tasks first."""
    return inv.groupBy(*by).agg(F.count("*").alias("n_rows"), F.bit_xor(row_print(spec)).alias("print"))


def write_bucketed(inv: DataFrame, spec: TableSpec, path: str, buckets: int) -> DataFrame:
    """Stores rows of one repository in buckets by key, each one sorted file, and returns them as Spark reads them: joins by key of tables with as many buckets exchange nothing.

    The table's name in the session's catalog is given up at once; its files stay at path.
    """
    spark, name = inv.sparkSession, f"stowage_{uuid.uuid4().hex}"
    inv.repartition(buckets, *spec.keys).write.format("parquet").bucketBy(buckets, *spec.keys).sortBy(*spec.keys).option("path", path).saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"drop table {name}")
    return rows
