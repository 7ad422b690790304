"""Crawled metadata: JSON records with category, subcategory and json.

Records are handled as maps of variants, so nothing has to be known of their
fields but what the rules name; volatile fields go, the rest is stored with
its keys in order, so that equal records have equal content keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.keys import content_keys
from stowage.operators.inventory import of_repo
from stowage.operators.spec import CRAWL, TableSpec

# What each source supports and which of its fields change without the record changing.
SUBCATEGORIES = {
    "itaku": ["post", "posts", "image", "images"],
    "furaffinity": ["post"],
    "ao3": ["work", "tag", "search"],
    "pixiv": ["artworks", "user", "tags"],
    "weasyl": ["submission"],
}
VOLATILE = {
    "itaku": ["liked_by_you", "num_likes", "too_mature", "blacklisted", "bookmarked_by_you", "num_reshares", "num_comments", "is_thumbnail_for_video", "show_content_warning", "reshared_by_you", "image_lg", "num_too_mature_imgs", "folders.num_posts"],
    "furaffinity": ["comments", "favorites", "views"],
    "ao3": ["bookmarks", "comments", "likes", "views"],
    "pixiv": ["total_view", "total_bookmarks", "is_bookmarked", "is_muted", "seasonal_effect_animation_urls", "event_banners", "total_comments", "comment_access_control", "profile", "profile_publicity", "workspace", "restriction_attributes", "user.is_followed", "user.is_access_blocking_user"],
    "weasyl": ["owner_media", "comments", "favorites", "views", "favorited"],
}
SITES = {"itaku": "itaku.ee", "furaffinity": "furaffinity.net", "ao3": "archiveofourown.org", "pixiv": "pixiv.net", "weasyl": "weasyl.com"}
KEPT_OF_POST = ["category", "subcategory", "filename", "extension"]

_MAP, _LIST = "map<string,variant>", "array<map<string,variant>>"


def check_source(meta: DataFrame, rules: dict[str, list[str]] = SUBCATEGORIES, on_error: str = "raise") -> DataFrame:
    """meta of supported sources. Others raise when read, or with on_error='rejects' stay with an error text."""
    texts = F.create_map(*(F.lit(x) for c, s in rules.items() for x in (c, ", ".join(s))))
    known = F.coalesce(*(F.when(F.col("category") == c, F.col("subcategory").isin(s)) for c, s in rules.items()), F.lit(False))
    said = F.coalesce(F.concat(F.lit("subcategory must be one of "), F.element_at(texts, F.col("category"))), F.lit("category must be one of " + ", ".join(sorted(rules))))
    error = F.when(~known, said)
    if on_error == "rejects":
        return meta.withColumn("error", error)
    return meta.where(F.when(known, True).otherwise(F.raise_error(said).cast("boolean")))


def parsed(meta: DataFrame) -> DataFrame:
    """meta with fields, a map of variants; text that is no JSON object has none."""
    return meta.withColumn("fields", F.expr(f"coalesce(try_variant_get(try_parse_json(json), '$', '{_MAP}'), cast(map() as {_MAP}))"))


def _without(variant: str, path: list[str], depth: int = 0) -> str:
    """Expression: the variant without the path, in every element if it is a list."""
    k, v, x = f"k{depth}", f"v{depth}", f"x{depth}"
    cut = (lambda m: f"map_filter({m}, ({k}, {v}) -> {k} <> '{path[0]}')") if len(path) == 1 else (lambda m: f"transform_values({m}, ({k}, {v}) -> if({k} = '{path[0]}', {_without(v, path[1:], depth + 1)}, {v}))")
    return f"coalesce(to_variant_object({cut(f"try_variant_get({variant}, '$', '{_MAP}')")}), to_variant_object(transform(try_variant_get({variant}, '$', '{_LIST}'), {x} -> {cut(x)})), {variant})"


def _removed(fields: str, paths: list[str]) -> str:
    """Expression: the map without the paths (dots go down)."""
    top = [p for p in paths if "." not in p]
    out = f"map_filter({fields}, (k, v) -> k not in ({', '.join(repr(p) for p in top)}))" if top else fields
    for p in paths:
        if "." in p:
            first, *rest = p.split(".")
            out = f"transform_values({out}, (k, v) -> if(k = '{first}', {_without('v', rest)}, v))"
    return out


def _by_source(cases: dict[str, str], default: str) -> Column:
    return F.expr("case category " + " ".join(f"when '{c}' then {e}" for c, e in cases.items()) + f" else {default} end")


def remove_fields(meta: DataFrame, rules: dict[str, list[str]] = VOLATILE) -> DataFrame:
    """meta (with fields) without each source's volatile fields; absent ones are ignored."""
    return meta.withColumn("fields", _by_source({c: _removed("fields", p) for c, p in rules.items()}, "fields"))


def exclude_fields(meta: DataFrame, rules: dict[str, list[str]] = VOLATILE) -> DataFrame:
    """meta without private fields, subcategory and top-level volatile fields."""
    base = lambda more: f"map_filter(fields, (k, v) -> not startswith(k, '_') and k not in ({', '.join(repr(p) for p in ['subcategory', *more])}))"
    return meta.withColumn("fields", _by_source({c: base([p for p in ps if "." not in p]) for c, ps in rules.items()}, base([])))


def reshape(meta: DataFrame, kind: str, rules: dict[str, list[str]] = VOLATILE) -> DataFrame:
    """meta (with fields) in its source's stored form. kind: post (a record of a post) or file (of one file)."""
    cases = {c: _removed("fields", p) for c, p in rules.items()}
    if "itaku" in rules:
        if kind == "post":
            cases["itaku"] = _removed("fields", [*rules["itaku"], *(f"gallery_images.{p}" for p in rules["itaku"])])
        else:
            file = _removed(f"coalesce(try_variant_get(fields['file'], '$', '{_MAP}'), cast(map() as {_MAP}))", rules["itaku"])
            held = f"map_filter(fields, (k, v) -> (startswith(k, '_') or k in ({', '.join(map(repr, KEPT_OF_POST))})) and not array_contains(map_keys({file}), k))"
            cases["itaku"] = f"if(subcategory = 'post', map_concat({held}, {file}), {cases['itaku']})"
    if "weasyl" in rules:
        inner = cases["weasyl"]
        cases["weasyl"] = f"if(map_contains_key(fields, 'submitid'), transform_keys(map_filter({inner}, (k, v) -> k <> 'id'), (k, v) -> if(k = 'submitid', 'id', k)), {inner})"
    return meta.withColumn("fields", _by_source(cases, "fields"))


def field(name: str) -> Column:
    """A field as text; null if absent or empty."""
    return F.expr(f"nullif(try_variant_get(fields['{name}'], '$', 'string'), '')")


def _updated() -> Column:
    itaku = F.coalesce(field("date_edited"), field("date_added"))
    ao3 = F.coalesce(field("date_completed"), field("date_updated"), field("date"), F.lit("0"))
    return F.when(F.col("category") == "itaku", itaku).when(F.col("category") == "ao3", ao3).otherwise(field("date"))


def _site(files: bool) -> Column:
    sites = {**SITES, **({"itaku": "itaku.ee/images"} if files else {})}
    return F.element_at(F.create_map(*(F.lit(x) for kv in sites.items() for x in kv)), F.col("category"))


def _key(source: Column, when: Column | None = None) -> Column:
    key = F.struct(source.alias("source"), field("id").cast("bigint").alias("id"), _updated().alias("updated"))
    return key if when is None else F.when(when, key)


def submission_keys(meta: DataFrame) -> DataFrame:
    """meta with submission_key (source, id, updated, part) of each file record."""
    part = F.when(F.col("category") == "pixiv", field("num").cast("int")).otherwise(1)
    return meta.withColumn("submission_key", F.struct(_site(True).alias("source"), field("id").cast("bigint").alias("id"), _updated().alias("updated"), part.alias("part")))


def post_keys(meta: DataFrame) -> DataFrame:
    """meta with post_key (source, id, updated); null where the source has none."""
    return meta.withColumn("post_key", _key(_site(False), (F.col("category") != "itaku") | (F.col("subcategory") == "post")))


def file_metadata_keys(meta: DataFrame) -> DataFrame:
    """meta with file_metadata_key; only two sources have one."""
    return meta.withColumn("file_metadata_key", _key(_site(True), F.col("category").isin("itaku", "pixiv")))


def metadata_content(meta: DataFrame, rules: dict[str, list[str]] = VOLATILE) -> DataFrame:
    """meta with content (compact JSON, keys in order, a newline at the end) and its file_key."""
    shown = exclude_fields(meta, rules).withColumn("content", F.expr("concat(to_json(to_variant_object(fields)), '\n')"))
    return content_keys(shown.withColumn("_ext", F.lit("json")), "content", "_ext").drop("_ext")


def flag_known(meta: DataFrame, inv: DataFrame, spec: TableSpec, repo_uuid: str) -> DataFrame:
    """meta (with the key columns) with _skip = 1 where the inventory already has the key."""
    held = of_repo(inv, repo_uuid).select(*spec.keys).distinct().withColumn("_skip", F.lit(1))
    return meta.join(held, list(spec.keys), "left")


def import_crawl(posts: DataFrame, files: DataFrame, repo_uuid: str, inv: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Rows of submissions and metadata, and content, of crawled records.

    posts: category, subcategory, json; files: the same with file_key of the
    downloaded file. Unsupported records are left out (see check_source), and
    so are files, with their metadata, whose submission the inventory inv
    (submissions of all repositories) already has in this repository.
    """
    good = lambda df: parsed(check_source(df, on_error="rejects").where("error is null").drop("error"))
    post, file = reshape(good(posts), "post"), reshape(good(files), "file")
    if inv is not None:
        spec = CRAWL.table("submissions")
        asked = submission_keys(file).select("*", "submission_key.*")
        file = flag_known(asked, inv, spec, repo_uuid).where("_skip is null").select(*file.columns)
    held = submission_keys(file).select(F.lit(repo_uuid).alias("repo_uuid"), "submission_key.*", "file_key")
    described = metadata_content(post_keys(post).where("post_key is not null")).select("post_key.*", "file_key", "content")
    of_files = metadata_content(file_metadata_keys(file.drop("file_key")).where("file_metadata_key is not null")).select("file_metadata_key.*", "file_key", "content")
    meta = described.union(of_files)
    rows = {"submissions": held, "metadata": meta.select(F.lit(repo_uuid).alias("repo_uuid"), *CRAWL.table("metadata").keys, "file_key")}
    return rows, meta.select("file_key", "content").dropDuplicates(["file_key"])


def crawl_summary(rows: DataFrame) -> DataFrame:
    """One row: submission files, submission metadata, post metadata. rows: column kind."""
    one = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(k)
    return rows.agg(one("submission_files"), one("submission_metadata"), one("post_metadata"))
