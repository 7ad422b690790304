"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Texts are handled in slices of about so many bytes, so that word lists stay small.
SLICE_BYTES = 2 << 20
#: A hot node's edges are dealt to so many tasks.
SALTS = 16
#: Edges of a graph that one task holds; more are dealt out.
EDGES = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where the session names none and runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="stowage-ckpt-"))
    return sc.getCheckpointDir()


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """From now on tasks hand Python so many rows at a time: 10,000 long texts, twice for each core, are too many for a small executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As durable(), but as a Parquet table, of which later steps read only the columns that they need."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text; one long text is a batch of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)
        pa.default_memory_pool().release_unused()  # workers stay; what a batch took goes back


def lowered(text: str) -> str:
    """text in lower case, character by character, so that places in it are places in text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    edges: columns u, v of one orderable type; self-loops, nulls, repeats and
    both directions are allowed. Returns node, root. Alternates the large-star
    and small-star steps until nothing changes: each step keeps at most one
    edge per input edge, minima are pre-aggregated before the shuffle, and the
    edges of a hot node are dealt to SALTS tasks. Up to EDGES edges, counted
    before each step, are one part: minima are window functions there and
    nothing is exchanged. Nothing is broadcast, so the driver holds no part of
    the graph. Empty input gives no rows.
    """
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS))
    every = F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)"))

    def lowest(pairs: DataFrame, few: bool) -> DataFrame:
        if few:
            return pairs.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
        mins = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), every.alias("s"))
        return pairs.withColumn("s", salt("v")).join(mins.hint("merge"), ["u", "s"])

    def edges_of(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
        """u, v: these pairs of columns of each row, in one pass over df."""
        each = F.explode(F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs)))
        return df.select(each.alias("e")).select("e.u", "e.v")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = durable(now)
    seen = mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        few, now = seen[0] <= EDGES, now.coalesce(1 + seen[0] // EDGES)  # more parts than there are stay
        large = lowest(edges_of(now, ("u", "v"), ("v", "u")), few).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")  # repeats go below
        small = edges_of(lowest(large, few), ("v", "m"), ("u", "m")).where("u <> v").distinct()
        now = durable(small)
        if (new := mark(now)) == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(roots.select("root", "root").distinct())
