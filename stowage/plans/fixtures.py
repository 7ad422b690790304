"""Inventories and stores derived from the given tables; the queries run on these."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions.keys import content_keys
from stowage.operators.spec import TableSpec
from stowage.sources import paths

SPEC = TableSpec("documents", ("source", "doc_id"))
ORDERS = TableSpec("orders", ("o_orderkey",), "o_orderstatus")
LINES = TableSpec("lineitem", ("l_orderkey", "l_linenumber"), "l_comment")
REPOS = [("a", "0000000a"), ("b", "0000000b"), ("c", "0000000c")]
UUID = dict(REPOS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder under the session's shared checkpoint folder."""
    return f"{paths.shared_folder(spark)}/{uuid.uuid4().hex}"


def keyed(spark: SparkSession, sf_dir: str, repo: str) -> DataFrame:
    """repo_uuid, source, doc_id, text, size, file_key of one repository.

    a: two thirds of the documents; b: half of them, some changed; c: a fifth.
    """
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text", "lang")
    if repo == "b":
        docs = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    keep = {"a": F.col("doc_id") % 3 != 0, "b": F.col("doc_id") % 2 == 0, "c": F.col("doc_id") % 5 == 0, "all": F.lit(True)}[repo]
    rows = content_keys(docs.where(keep), "text", "lang")
    return rows.select(F.lit(UUID.get(repo, "all")).alias("repo_uuid"), "source", "doc_id", "text", F.octet_length("text").cast("bigint").alias("size"), "file_key")


def inventory(spark: SparkSession, sf_dir: str, repos: str = "abc") -> DataFrame:
    out = None
    for r in repos:
        one = keyed(spark, sf_dir, r).select("repo_uuid", "source", "doc_id", "file_key")
        out = one if out is None else out.union(one)
    return out


def presence(spark: SparkSession, sf_dir: str, repos: str = "abc", lost: bool = False) -> DataFrame:
    """repo_uuid, file_key, size of what each store holds; with lost, repository a lacks some bytes of its rows."""
    out = None
    for r in repos:
        rows = keyed(spark, sf_dir, r)
        if lost and r == "a":
            gone = rows.where(F.col("doc_id") % 50 == 1).select("file_key").distinct()
            rows = rows.join(gone, "file_key", "left_anti")
        one = rows.select("repo_uuid", "file_key", "size").distinct()
        out = one if out is None else out.union(one)
    return out


def content(spark: SparkSession, sf_dir: str, repo: str) -> DataFrame:
    return keyed(spark, sf_dir, repo).select("file_key", F.col("text").alias("content")).dropDuplicates(["file_key"])


def repos(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REPOS, "name string, uuid string")


def order_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base, left and right versions of orders."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    base = rows.where(k % 11 != 0)
    left = base.where(k % 13 != 0).withColumn("o_orderstatus", F.when(k % 7 == 0, "L").otherwise(s))
    right = rows.where(k % 17 != 0).withColumn("o_orderstatus", F.when(k % 10 == 0, "R").otherwise(s))
    return base, left, right


CATEGORIES = ["itaku", "furaffinity", "ao3", "pixiv", "weasyl"]


def crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, category, subcategory, json: a record of each order."""
    k = F.col("o_orderkey").cast("string")
    pick = F.expr("element_at(array('itaku', 'furaffinity', 'ao3', 'pixiv', 'weasyl'), cast(o_orderkey % 5 as int) + 1)")
    sub = F.expr("case o_orderkey % 5 when 0 then if(o_orderkey % 2 = 0, 'post', 'image') when 1 then 'post' when 2 then if(o_orderkey % 4 = 0, 'tag', 'work') when 3 then 'artworks' else if(o_orderkey % 3 = 0, 'journal', 'submission') end")
    day, updated, added, of_file = (F.date_format(F.date_add("o_orderdate", n), "yyyy-MM-dd") for n in range(4))
    dated: Column = F.when(F.col("o_orderkey") % 6 == 0, "").otherwise(updated)
    text = F.concat(
        F.lit('{"id":'), k, F.lit(',"submitid":'), k, F.lit(',"num":2,"date":"'), day, F.lit('","date_updated":"'), dated, F.lit('","date_added":"'), added,
        F.lit('","title":"t'), k, F.lit('","views":7,"comments":3,"num_likes":5,"total_view":9,"favorites":1,"_private":true,"subcategory":"'), sub,
        F.lit('","user":{"name":"u","is_followed":false},"folders":[{"title":"f","num_posts":4},{"title":"g","num_posts":5}],"file":{"id":'), k, F.lit(',"date_added":"'), of_file, F.lit('","num_likes":1,"extension":"png"}}'),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", pick.alias("category"), sub.alias("subcategory"), text.alias("json"))


def listing(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """path and content of a made-up folder tree: one file for each page or document."""
    if kind == "pages":
        return table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1).alias("path"), F.col("html").alias("content"))
    docs = table(spark, sf_dir, "documents")
    if kind == "md5":
        source = F.expr("element_at(array('e621', 'Gelbooru', 'rule34', 'e6ai', 'danbooru.donmai.us', 'other'), cast(doc_id % 6 as int) + 1)")
        return docs.select(F.concat(F.lit("in/"), F.md5(F.col("text").cast("binary")), F.lit("."), source, F.lit("."), "lang").alias("path"), F.col("text").alias("content"))
    group = F.expr("element_at(array('images', 'image_metadata', 'posts', 'other'), cast(doc_id % 4 as int) + 1)")
    stamp = F.when(F.col("doc_id") % 3 == 0, "None").otherwise("2020-01-02 03_04")
    return docs.select(F.concat(F.lit("root/"), group, F.lit("/a/b/"), F.col("doc_id").cast("string"), F.lit("_"), stamp, F.lit(".txt")).alias("path"), F.col("text").alias("content"))


def versions_of_repo(spark: SparkSession, sf_dir: str, changed: bool) -> DataFrame:
    """Rows of repository a, or of a copy in which a few are changed, gone or new."""
    rows = inventory(spark, sf_dir, "a")
    if not changed:
        return rows
    k = F.col("doc_id")
    new = inventory(spark, sf_dir, "b").where(k % 119 == 0).withColumns({"repo_uuid": F.lit(UUID["a"]), "doc_id": k + 1_000_000_000})
    other = F.when(k % 101 == 0, F.concat("file_key", F.lit("2"))).otherwise(F.col("file_key"))
    return rows.where(k % 103 != 0).withColumn("file_key", other).union(new.select(*rows.columns))
