"""Bloom filters of keys as small tables: built and merged by bitwise aggregates, probed by one join.

A filter is cut into blocks of 512 bits, eight whole numbers in a row. A key
belongs to one block and sets some of its bits there, all taken from its
SHA-256, so a probe is one row of a join and no filter is ever in one place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.sources import paths

BITS, WORD = 512, 64
#: Bits that a key can set at most: its hash has no more to choose them by.
HASHES = 16
WORDS = [f"w{i}" for i in range(BITS // WORD)]


@dataclass(frozen=True)
class BloomFilter:
    """words: block, w0 to w7; a block without keys has no row."""

    words: DataFrame
    blocks: int
    hashes: int


def false_rate(bits_per_key: float, hashes: int) -> float:
    """Chance that an absent key finds all its bits set. The number of keys in a block is Poisson distributed."""
    load, rate, chance = BITS / bits_per_key, 0.0, None
    for i in range(int(load + 12 * math.sqrt(load)) + 12):
        chance = math.exp(-load) if i == 0 else chance * load / i
        rate += chance * (1 - (1 - 1 / BITS) ** (hashes * i)) ** hashes
    return rate


def sizing(rate: float) -> tuple[float, int]:
    """Bits per key, in quarters, and bits that a key sets, so that the rate is held."""
    if not 0 < rate < 1:
        raise ValueError("a rate lies between 0 and 1")
    for quarters in range(4, 4 * BITS):
        best = min(range(1, HASHES + 1), key=lambda k: false_rate(quarters / 4, k))
        if false_rate(quarters / 4, best) <= rate:
            return quarters / 4, best
    raise ValueError(f"no filter of this kind holds a rate of {rate}")


def _placed(keys: DataFrame, column: str, blocks: int, hashes: int) -> DataFrame:
    """keys with block and the masks w0 to w7 of the bits that each key sets."""
    number = lambda at, n: F.conv(F.substring("_d", at, n), 16, 10).cast("bigint")
    rows = keys.withColumn("_d", F.sha2(F.col(column).cast("binary"), 256)).withColumn("block", number(1, 15) % blocks)
    rows = rows.withColumns({f"_p{i}": number(17 + 3 * i, 3) % BITS for i in range(hashes)})
    bit = lambda i, j: F.when(F.floor(F.col(f"_p{i}") / WORD) == j, F.expr(f"shiftleft(1L, cast(_p{i} % {WORD} as int))")).otherwise(F.lit(0).cast("bigint"))
    masks = {w: reduce(Column.bitwiseOR, (bit(i, j) for i in range(hashes))) for j, w in enumerate(WORDS)}
    return rows.withColumns(masks).drop("_d", *(f"_p{i}" for i in range(hashes)))


def build(keys: DataFrame, rate: float = 0.01, expected: int | None = None, column: str = "file_key") -> BloomFilter:
    """Filter of the keys, sized for `expected` distinct keys (those there are by default). Null keys are in no filter."""
    keys = keys.where(F.col(column).isNotNull()).select(column)
    per_key, hashes = sizing(rate)
    n = keys.distinct().count() if expected is None else expected
    blocks = max(1, math.ceil(n * per_key / BITS))
    return BloomFilter(_placed(keys, column, blocks, hashes).groupBy("block").agg(*(F.bit_or(w).alias(w) for w in WORDS)), blocks, hashes)


def merge(filters: list[BloomFilter]) -> BloomFilter:
    """Filter of all keys of filters that were sized alike."""
    first = filters[0]
    if any((f.blocks, f.hashes) != (first.blocks, first.hashes) for f in filters):
        raise ValueError("only filters of one size can be merged: build them with the same rate and expected number of keys")
    return BloomFilter(reduce(DataFrame.union, (f.words for f in filters)).groupBy("block").agg(*(F.bit_or(w).alias(w) for w in WORDS)), first.blocks, first.hashes)


def probe(keys: DataFrame, f: BloomFilter, name: str = "maybe", column: str = "file_key") -> DataFrame:
    """keys with a boolean: False if the filter can't have the key. Null keys are not in it."""
    mine = {w: f"_m{i}" for i, w in enumerate(WORDS)}
    asked = _placed(keys.select(column).where(F.col(column).isNotNull()).distinct(), column, f.blocks, f.hashes).withColumnsRenamed(mine)
    held = reduce(Column.__and__, (F.col(w).bitwiseAND(F.col(m)) == F.col(m) for w, m in mine.items()))
    found = asked.join(f.words, "block").where(held).select(column, F.lit(True).alias(name))
    return keys.join(found, column, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def write(f: BloomFilter, path: str) -> None:
    f.words.write.parquet(f"{path}/blocks={f.blocks}-hashes={f.hashes}")


def read(spark: SparkSession, path: str) -> BloomFilter:
    (name,) = (n for n in paths.names(spark, path) if n.startswith("blocks="))
    blocks, hashes = (int(x.partition("=")[2]) for x in name.split("-"))
    return BloomFilter(spark.read.parquet(f"{path}/{name}"), blocks, hashes)
