"""Running counts of keys over repositories from theta sketches: small values of each repository, merged by batch.

A sketch keeps the 2 ** LG smallest hashes of the keys it has seen, so one of
fewer keys is exact, and a larger one has a relative standard error of about
1 / sqrt(2 ** LG). Keys can be dealt to parts by another hash, each with a
sketch of its own; counts are sums over parts. With parts_for() so many keys no
part is full and all counts are exact, at 8 bytes a key held, but for two keys
with the same 63-bit hash (n keys: a chance of about n ** 2 / 2 ** 64). All
sketches that are merged have the same number of parts. Merging takes a key that comes again for what it is, so a
batch can be merged twice; a key that goes away can't be taken out of a
sketch: store_totals() and the exact queries can do that.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base-2 logarithm of the hashes that a sketch keeps.
LG = 12


def error_of(lg: int = LG) -> float:
    """Relative standard error of the estimate of a sketch or of a union of them."""
    return 1 / math.sqrt(2**lg - 1)


def parts_for(n_keys: int, lg: int = LG) -> int:
    """Parts in which so many distinct keys, of all repositories, are counted exactly: half full on average (a full one is 2 ** (lg / 2) standard deviations off)."""
    return max(1, math.ceil(n_keys / 2 ** (lg - 1)))


def sketch_keys(inv: DataFrame, keys: list[str], lg: int = LG, parts: int = 1) -> DataFrame:
    """repo_uuid, part and sketch of the distinct keys of each repository. Sketches are added up inside tasks first. Null parts of a key count as values."""
    texts = [F.col(k).cast("string") for k in keys]
    key = F.concat_ws("|", *(F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("")) for t in texts))
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    return inv.groupBy("repo_uuid", part.alias("part")).agg(F.theta_sketch_agg(key, lg).alias("sketch"))


def merge_sketches(sketches: DataFrame, lg: int = LG) -> DataFrame:
    """One sketch a repository and part, of several batches."""
    return sketches.groupBy("repo_uuid", "part").agg(F.theta_union_agg("sketch", lg).alias("sketch"))


def _held(sketches: DataFrame) -> DataFrame:
    return sketches.groupBy("repo_uuid").agg(F.sum(F.theta_sketch_estimate("sketch")).alias("n_held"))


def approximate_coverage(sketches: DataFrame, lg: int = LG) -> DataFrame:
    """repo_uuid, n_held, n_all, share: as coverage(), estimated; of merged sketches."""
    parts = sketches.groupBy("part").agg(F.theta_union_agg("sketch", lg).alias("all"))
    whole = parts.agg(F.sum(F.theta_sketch_estimate("all")).alias("n_all"))  # one row
    return _held(sketches).join(F.broadcast(whole)).withColumn("share", F.col("n_held") / F.col("n_all"))


def approximate_shared(sketches: DataFrame, lg: int = LG) -> DataFrame:
    """left, right, n_both, n_either: for each two repositories, how many keys both and any of them hold, estimated; of merged sketches. The error of n_both is that of n_either."""
    a, b = (sketches.select("part", F.col("repo_uuid").alias(n), F.col("sketch").alias(f"_{n}")) for n in ("left", "right"))
    n_a, n_b = (_held(sketches).select(F.col("repo_uuid").alias(n), F.col("n_held").alias(f"_{n}")) for n in ("left", "right"))
    both, either = F.theta_sketch_estimate(F.theta_intersection("_left", "_right")), F.theta_sketch_estimate(F.theta_union("_left", "_right", lg))
    more = either - F.theta_sketch_estimate("_left") - F.theta_sketch_estimate("_right")
    met = a.join(b, "part").where("left < right").groupBy("left", "right").agg(F.sum(both).alias("_both"), F.sum(more).alias("_more"))
    pairs = n_a.join(n_b, F.col("left") < F.col("right")).join(met, ["left", "right"], "left")
    zero = F.lit(0).cast("bigint")
    return pairs.select("left", "right", F.coalesce("_both", zero).alias("n_both"), (F.col("_left") + F.col("_right") + F.coalesce("_more", zero)).alias("n_either"))
