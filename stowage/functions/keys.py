"""Content keys: size, hash and extension of a file in one string, and where its bytes are stored.

A key is `SHA256E-s{bytes}--{sha256 in lower case}` and, unless the extension
is null or empty, a dot and the extension. All functions add columns to a
DataFrame with built-in functions, so they stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = "SHA256E-s"
KEY_PATTERN = r"^SHA256E-s(\d+)--([0-9a-f]{64})(?:\.(.+))?$"


def _key(size: Column, sha256: Column, ext: Column | None) -> Column:
    dotted = F.lit("") if ext is None else F.when(F.coalesce(ext, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("."), ext))
    return F.concat(F.lit(PREFIX), size.cast("bigint").cast("string"), F.lit("--"), sha256, dotted)


def content_key(content: str, ext: str | None = None) -> Column:
    """Key of a string (as UTF-8) or binary column; null for null content."""
    raw = F.col(content).cast("binary")
    return _key(F.octet_length(raw), F.sha2(raw, 256), None if ext is None else F.col(ext))


def content_keys(df: DataFrame, content_col: str, ext_col: str | None = None) -> DataFrame:
    return df.withColumn("file_key", content_key(content_col, ext_col))


def content_keys_from_hash(df: DataFrame, size_col: str, sha256_col: str, ext_col: str | None = None) -> DataFrame:
    """Keys of a listing with known sizes and hashes; no content is read."""
    return df.withColumn("file_key", _key(F.col(size_col), F.lower(sha256_col), None if ext_col is None else F.col(ext_col)))


def parse_keys(df: DataFrame, key_col: str = "file_key") -> DataFrame:
    """scheme, size, sha256, ext (null where absent), has_prefix (looks like a key) and well_formed (is one)."""
    part = lambda i: F.regexp_extract(key_col, KEY_PATTERN, i)
    formed = F.coalesce(F.col(key_col).rlike(KEY_PATTERN), F.lit(False))
    return df.withColumns({
        "scheme": F.when(formed, F.lit("SHA256E")), "size": F.when(formed, part(1).cast("bigint")), "sha256": F.when(formed, part(2)),
        "ext": F.when(formed & (part(3) != ""), part(3)), "has_prefix": F.coalesce(F.startswith(key_col, F.lit(PREFIX)), F.lit(False)), "well_formed": formed,
    })


def shard_paths(df: DataFrame, key_col: str = "file_key", legacy: bool = False) -> DataFrame:
    """p1, p2 (three hexadecimal digits each of the key's md5) and path; the legacy layout repeats the key as a folder."""
    digest = F.md5(F.col(key_col).cast("binary"))
    df = df.withColumns({"p1": F.substring(digest, 1, 3), "p2": F.substring(digest, 4, 3)})
    return df.withColumn("path", F.concat_ws("/", "p1", "p2", *([key_col] * (2 if legacy else 1))))


def resolve_paths(keys: DataFrame, listing: DataFrame, key_col: str = "file_key") -> DataFrame:
    """keys with layout (new, legacy or missing) and path, by what listing (column path) holds; the new layout comes first."""
    both = shard_paths(shard_paths(keys, key_col).withColumnRenamed("path", "_new"), key_col, legacy=True).withColumnRenamed("path", "_old")
    held = listing.select("path").distinct()
    found = both.join(held.select(F.col("path").alias("_new"), F.lit(True).alias("_is_new")), "_new", "left").join(held.select(F.col("path").alias("_old"), F.lit(True).alias("_is_old")), "_old", "left")
    layout = F.when(F.col("_is_new"), "new").when(F.col("_is_old"), "legacy").otherwise("missing")
    path = F.when(F.col("_is_new"), F.col("_new")).when(F.col("_is_old"), F.col("_old"))
    return found.withColumn("layout", layout).withColumn("path", path).select(*keys.columns, "layout", "path")


def verify_content(content: DataFrame, key_col: str = "file_key", content_col: str = "content") -> DataFrame:
    """content with verdict ok or mismatch: the key computed again, with the key's own extension, must be equal."""
    ext = F.regexp_extract(key_col, KEY_PATTERN, 3)
    again = content.withColumn("_ext", ext).withColumn("_again", content_key(content_col, "_ext"))
    return again.withColumn("verdict", F.when(F.col("_again").eqNullSafe(F.col(key_col)), "ok").otherwise("mismatch")).drop("_ext", "_again")


def check_size(presence: DataFrame, key_col: str = "file_key", size_col: str = "size") -> DataFrame:
    """presence with size_ok: the key's size is the actual one. Nothing is hashed."""
    named = F.regexp_extract(key_col, KEY_PATTERN, 1)
    return presence.withColumn("size_ok", F.coalesce(F.when(named != "", named.cast("bigint")) == F.col(size_col), F.lit(False)))


def with_extension(df: DataFrame, path_col: str, lower: bool = False) -> DataFrame:
    """ext: what follows the last dot of the last path segment, without the dot; null if none or only at its start."""
    name = F.regexp_extract(path_col, r"([^/]*)$", 1)
    ext = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    return df.withColumn("ext", F.when(ext != "", F.lower(ext) if lower else ext))


def filter_extension(df: DataFrame, max_len: int = 5, ext_col: str = "ext") -> DataFrame:
    """Rows whose extension has at most max_len characters or is absent."""
    return df.where(F.coalesce(F.length(ext_col), F.lit(0)) <= max_len)
