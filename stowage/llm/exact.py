"""Exact duplicates by progressive refinement: length, then hash of a prefix, then hash of the whole text.

Lengths and prefix hashes are counted first. Only rows whose length and
prefix some other row may share have their whole text hashed, and only those
meet in a shuffle, as digests; a text never leaves its scan. Which lengths and
prefixes repeat is kept by slot, in tables of at most LENGTHS and PREFIXES
rows, so they can be broadcast whatever the input: rows that share a slot by
chance only go on to the next step, which is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import stored, table

#: Rows at most of the tables of repeated lengths and of repeated prefixes; characters of a prefix.
LENGTHS, PREFIXES, PREFIX = 1 << 16, 1 << 20, 256
#: A group that holds one in so many rows is joined by broadcast; there are no more such groups than that.
HOT = 1000


def normalised(text: str) -> Column:
    """The text with each run of blanks as one space; null counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.when(t.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(t, r"[\x20\x09-\x0D]+", " ")).otherwise(t)


def _slot(most: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(most))


def _repeated(keys: DataFrame, slot: str) -> DataFrame:
    return keys.groupBy(slot).agg(F.count("*").alias("n")).where("n > 1").select(slot)


def exact_groups(docs: DataFrame, carry: list[Column] = (), text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per row of docs: its id, keep_id, group_size, kept, then the columns of `carry`.

    Texts are equal when identical after each run of blanks (space, tab to
    carriage return) became one space; null counts as empty. Of equal texts
    the row with the least id stays, of rows that repeat an id one, and a row
    without an id only if none has one. keep_id is the id of the row that
    stays. An empty table gives no rows; columns of docs that `carry` does not
    name don't matter.
    """
    spark = docs.sparkSession
    norm = docs.select(F.col(id_column).alias("id"), normalised(text).alias("norm"), F.struct(F.lit(0).alias("_"), *carry).alias("carry"))
    sized = norm.withColumns({"size": F.octet_length("norm"), "start": F.xxhash64(F.left("norm", F.lit(PREFIX)))})
    slots = {"by_length": _slot(LENGTHS, "size"), "by_prefix": _slot(PREFIXES, "size", "start")}

    keys = stored(sized.select("size", "start")).select(*(c.alias(n) for n, c in slots.items()))
    lengths = F.broadcast(_repeated(keys, "by_length"))  # LENGTHS rows at most
    prefixes = stored(_repeated(keys.join(lengths, "by_length", "left_semi"), "by_prefix")).withColumn("again", F.lit(True))

    met = sized.withColumns(slots).join(F.broadcast(prefixes), "by_prefix", "left")  # PREFIXES rows at most
    digest = F.when(F.col("again"), F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    rows = stored(met.select("id", F.monotonically_increasing_id().alias("rid"), digest.alias("digest"), "carry"))

    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("keep")
    groups = stored(rows.where("digest is not null").groupBy("digest").agg(F.count("*").alias("group_size"), least).where("group_size > 1"))
    n_rows = rows.count()
    hot = F.broadcast(groups.where(F.col("group_size") * HOT >= n_rows))  # HOT groups at most
    rest = groups.where(F.col("group_size") * HOT < n_rows)

    known = rows.join(hot, "digest", "left")
    settled = known.where("group_size is not null or digest is null")
    others = known.where("group_size is null and digest is not null").drop("group_size", "keep").join(rest, "digest", "left")
    both = settled.select("id", "rid", "carry", "group_size", "keep").union(others.select("id", "rid", "carry", "group_size", "keep"))
    alone = F.col("group_size").isNull()
    out = both.select(
        F.col("id").alias(id_column), F.when(alone, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"), (alone | (F.col("keep.rid") == F.col("rid"))).alias("kept"), "carry.*",
    )
    return out.drop("_") if carry else out.select(id_column, "keep_id", "group_size", "kept")


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    digest = F.sha2(normalised("text").cast("binary"), 256).alias("text_sha256")
    return exact_groups(table(spark, sf_dir, "documents"), [digest])


OP11_SQL = r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256 FROM t JOIN g ON t.norm = g.norm"""
