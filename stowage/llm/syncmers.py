"""Document fingerprints from closed syncmers, with built-in functions only.

A k-mer is K consecutive words; its inner substrings are S consecutive words.
It is an anchor if the least of its inner substrings, by hash, is the first or
the last one. Whether a k-mer is an anchor depends on the k-mer alone, so an
edit disturbs anchors only where it overlaps them, and equal passages have
equal anchors wherever they stand. The fingerprint of a text is the least WIDTH
hashes of its anchors: all of them for a text of up to about 130 words, and
beyond that an even sample, of which likeness is estimated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import stored

#: Words of a k-mer, words of an inner substring, hashes of a fingerprint.
K, S, WIDTH = 5, 2, 64
_EDGE = "(g[i] <= least(g[i + 1], g[i + 2], g[i + 3]) or g[i + 3] < least(g[i], g[i + 1], g[i + 2]))"
_HASH = "cast(shiftright(xxhash64(g[i], g[i + 1], g[i + 2], g[i + 3]), 32) as int)"


def hashed_words(df: DataFrame, text: str) -> DataFrame:
    """df with g: a hash for each S=2 consecutive words, or, of a text of fewer than K words, one hash of them all."""
    words = F.expr(f"filter(split({text}, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')")
    df = df.withColumn("_w", F.transform(words, lambda w: F.xxhash64(w)))
    pairs = F.expr(f"transform(sequence(0, size(_w) - {S}), i -> xxhash64(_w[i], _w[i + 1]))")
    return df.withColumn("g", F.when(F.size("_w") >= K, pairs).when(F.size("_w") > 0, F.array(F.xxhash64("_w")))).drop("_w")


def _anchors(of_each: str, short: str) -> Column:
    some = F.expr(f"transform(filter(sequence(0, size(g) - {K - S + 1}), i -> {_EDGE}), i -> {of_each})")
    return F.when(F.size("g") >= K - S + 1, some).when(F.size("g") == 1, F.expr(f"array({short})")).otherwise(F.expr(f"slice(array({short}), 1, 0)"))


def syncmers(docs: DataFrame) -> DataFrame:
    """doc_id and anchors (position in words, hash) of each row, for positional matching."""
    rows = hashed_words(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text")
    return rows.select("doc_id", _anchors(f"struct(i as pos, {_HASH} as hash)", "struct(0 as pos, cast(shiftright(g[0], 32) as int) as hash)").alias("anchors"))


def matches(left: str, right: str) -> Column:
    """Positions of equal anchors of two anchor columns in one row: array of (left position, right position)."""
    return F.expr(f"flatten(transform({left}, a -> transform(filter({right}, b -> b.hash = a.hash), b -> struct(a.pos as left_pos, b.pos as right_pos))))")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the least WIDTH different anchor hashes of the text, ascending."""
    every = _anchors(_HASH, "cast(shiftright(g[0], 32) as int)")
    return hashed_words(df, text).withColumn(name, F.slice(F.sort_array(F.array_distinct(every)), 1, WIDTH)).drop("g")


def likeness(a: str, b: str) -> Column:
    """Share of common anchors (twice the common ones by all of both), estimated on the least WIDTH of the union; 1 for two empty fingerprints."""
    union = f"slice(sort_array(array_union({a}, {b})), 1, {WIDTH})"
    common = F.expr(f"size(array_intersect(array_intersect({a}, {b}), {union}))")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(2.0 * common / (F.expr(f"size({union})") + common))


def shown(fingerprint: str) -> Column:
    """Eight hexadecimal digits for each hash."""
    return F.expr(f"array_join(transform({fingerprint}, x -> lpad(hex(x & 4294967295), 8, '0')), '')")


def _neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, h, n, and the key of the document before (pid, ph) with half its length, by descending doc_id around the circle.

    Only ids, hashes and lengths are ordered: ranges of ids are dealt to tasks,
    and the ends of the ranges, one row for each task, are joined up.
    """
    ids = docs.groupBy("doc_id", "h").agg(F.min("n").alias("n"), F.count("*").alias("c"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    dealt = stored(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    one = F.struct("doc_id", "h", "n")
    inside = dealt.withColumn("before", F.lag(one).over(Window.partitionBy("part").orderBy(*order)))
    last = F.row_number().over(Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), F.col("h").desc()))
    lasts = dealt.withColumn("_r", last).where("_r = 1").select("part", one.alias("last"))  # a row for each task
    ring = Window.orderBy("part")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = lasts.select("part", F.coalesce(F.lag("last").over(ring), F.last("last").over(whole)).alias("carried"))
    joined = inside.join(F.broadcast(ends), "part").withColumn("before", F.coalesce("before", "carried"))
    return joined.select("doc_id", "h", "n", "c", F.col("before.doc_id").alias("pid"), F.col("before.h").alias("ph"), F.expr("before.n div 2").cast("int").alias("need"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """For each row: n_chars, its fingerprint, that of its edited text, and likenesses (array columns; see op6 for strings).

    The edited text has its last floor(n_chars / 2) code points replaced by as
    many first ones of the next document by descending doc_id. A null text is
    an empty one. Rows that repeat id and text are one document, given once for
    each row; rows that repeat an id alone follow each other by the hash of
    their texts; null ids come last. A lone document is its own next one. No
    rows give no rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumn("h", F.xxhash64("text"))
    plan = stored(_neighbours(keyed.select("doc_id", "h", F.char_length("text").cast("bigint").alias("n"))))
    repeats = plan.where("c > 1").limit(1).count() > 0
    # One shuffle of the texts serves both sides: a document's own row, and its beginning sent to the document before it.
    own = with_fingerprint(keyed, "text", "fp")
    same = (own["doc_id"].eqNullSafe(plan["doc_id"])) & (own["h"] == plan["h"])
    placed = own.join(plan, same).select(own["doc_id"], own["h"], "text", "fp", "n", "pid", "ph", "need")
    heads = placed.select(F.col("pid").alias("to_id"), F.col("ph").alias("to_h"), F.expr("left(text, need)").alias("head"), F.col("fp").alias("next_fp"))
    if repeats:
        heads = heads.dropDuplicates(["to_id", "to_h"])
    both = placed.join(heads, placed["doc_id"].eqNullSafe(heads["to_id"]) & (placed["h"] == heads["to_h"]))
    both = both.select("doc_id", F.col("n").alias("n_chars"), F.expr("concat(left(text, cast(n - n div 2 as int)), head)").alias("edited"), "fp", "next_fp")
    return with_fingerprint(both, "edited", "edited_fp")


def op6_syncmer_fingerprints(spark, sf_dir):
    rows = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown("fp").alias("fingerprint"), shown("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
    )
