"""From file listings to keyed rows. A listing has path (relative to the scanned root) and, to get keys, content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.keys import content_keys, filter_extension, with_extension
from stowage.operators.inventory import upsert
from stowage.operators.spec import DatasetSpec, TableSpec

# Address of a file by the source in its name.
URL_TEMPLATES = {
    "e621": ("https://static1.e621.net/data/", True),
    "Gelbooru": ("https://img3.gelbooru.com/images/", True),
    "rule34": ("https://r34i.paheal-cdn.net/", False),
    "e6ai": ("https://static1.e6ai.net/data/", True),
    "danbooru.donmai.us": ("https://cdn.donmai.us/original/", True),
}


def _name(path_col: str) -> Column:
    return F.regexp_extract(path_col, r"([^/]*)$", 1)


def skip_files(files: DataFrame, predicate: Column | None = None) -> DataFrame:
    """Files for which the predicate does not hold; all without one."""
    return files if predicate is None else files.where(~F.coalesce(predicate, F.lit(False)))


def require_keys(df: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """Rows with some key column, and rejects without any."""
    some = F.coalesce(*(F.col(k).cast("string") for k in spec.keys)).isNotNull()
    return df.where(some), df.where(~some)


def directory_rows(files: DataFrame, table: str, prefix: str = "") -> DataFrame:
    """files with table and path_key: the prefix and a slash before the path."""
    path = F.regexp_replace("path", "^/+", "")
    return files.withColumn("table", F.lit(table)).withColumn("path_key", F.concat(F.lit(f"{prefix}/" if prefix else ""), path))


def md5_name_rows(files: DataFrame, table: str) -> DataFrame:
    """files with table and path_key: the file name up to its first dot."""
    return files.withColumn("table", F.lit(table)).withColumn("path_key", F.split(_name("path"), r"\.")[0])


def md5_name_urls(files: DataFrame) -> DataFrame:
    """files with url and error, from names like `md5.source.ext`."""
    parts = F.split(_name("path"), r"\.")
    md5, ext = parts[0], F.element_at(parts, -1)
    middle = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), ".")
    tail = F.concat(F.substring(md5, 1, 2), F.lit("/"), F.substring(md5, 3, 2), F.lit("/"), md5)
    url = F.lit(None).cast("string")
    for source, (start, dotted) in URL_TEMPLATES.items():
        fits = (middle == source) | F.startswith(middle, F.lit(source + "."))
        url = F.when(fits, F.concat(F.lit(start), tail, *([F.lit("."), ext] if dotted else []))).otherwise(url)
    error = F.when(F.size(parts) < 3, "invalid name").when(F.length(md5) != 32, "invalid md5").when(url.isNull(), "unknown source")
    return files.withColumn("error", error).withColumn("url", F.when(F.col("error").isNull(), url))


def crawl_layout_rows(files: DataFrame, source: str) -> DataFrame:
    """files with table, source, id, updated, part, error, from paths whose fourth part from the end names the kind and whose names are `id_updated.ext`."""
    segments = F.split("path", "/")
    kind = F.when(F.size(segments) >= 4, F.element_at(segments, -4))
    stem = F.regexp_extract(_name("path"), r"^(.*?)(\.[^.]*)?$", 1)
    df = files.withColumn("_stem", stem).withColumn("_kind", kind)
    table = F.when(F.col("_kind") == "images", "submissions").when(F.col("_kind").isin("image_metadata", "posts"), "metadata")
    number, updated = F.expr("if(instr(_stem, '_') > 1, try_cast(left(_stem, instr(_stem, '_') - 1) as bigint), null)"), F.expr("if(instr(_stem, '_') > 0, substr(_stem, instr(_stem, '_') + 1), null)")
    df = df.withColumns({"table": table, "source": F.when(F.col("_kind") == "posts", F.lit(source + "/posts")).otherwise(F.lit(source)), "id": number, "updated": F.when(updated == "None", "0").otherwise(updated)})
    df = df.withColumn("part", F.when(F.col("table") == "submissions", 1))
    error = F.when(F.col("table").isNull(), "unknown table").when(F.col("id").isNull() | F.col("updated").isNull(), "invalid name")
    return df.withColumn("error", error).drop("_stem", "_kind")


def _keyed(files: DataFrame, rows_fn: Callable[[DataFrame], DataFrame], skip: Column | None) -> DataFrame:
    kept = skip_files(filter_extension(with_extension(files, "path")), skip)
    return rows_fn(content_keys(kept, "content", "ext"))


def import_files(files: DataFrame, rows_fn: Callable[[DataFrame], DataFrame], ds: DatasetSpec, repo_uuid: str, skip: Column | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Rows of each table, and content, of a listing with content.

    Long extensions and skipped files are left out, keys computed, rows routed
    by rows_fn's column `table`; import_rejects() has what no table gets.
    Write the content first: then no row ever points at absent bytes.
    """
    keyed = _keyed(files, rows_fn, skip)
    rows = {}
    for spec in ds.tables:
        good = require_keys(keyed.where(F.col("table") == spec.name), spec)[0]
        named = good.select(F.lit(repo_uuid).alias("repo_uuid"), *spec.keys, F.col("file_key").alias(spec.file_column))
        rows[spec.name] = upsert(None, named, spec, [spec.file_column])
    return rows, keyed.select("file_key", "content").dropDuplicates(["file_key"])


def import_rejects(files: DataFrame, rows_fn: Callable[[DataFrame], DataFrame], ds: DatasetSpec, skip: Column | None = None) -> DataFrame:
    """path, table, file_key and reason of the files of a listing whose bytes are imported but that become a row of no table."""
    keyed = _keyed(files, rows_fn, skip)
    known = F.coalesce(F.col("table").isin([spec.name for spec in ds.tables]), F.lit(False))
    out = keyed.where(~known).withColumn("reason", F.lit("no such table"))
    for spec in ds.tables:
        bad = require_keys(keyed.where(F.col("table") == spec.name), spec)[1]
        out = out.union(bad.withColumn("reason", F.lit("no key")))
    return out.select("path", "table", "file_key", "reason")
