"""Near-duplicate vectors by NN-descent.

Equal vectors are one node with a number of copies. A first neighbour graph
comes from small blocks of vectors that fall on the same sides of random
planes; it is then refined by joining neighbours of neighbours until an audit
against brute force, on a bounded sample of nodes, finds what it should. More
planes are drawn after a round that the audit does not pass; if the last one
does not reach LEAST either, that is an error. Links are the graph's edges at
or above the threshold.

A node whose whole list lies above the threshold is saturated: it may have
more links than the list holds. Its list is enlarged to its whole component
and to all other such components within reach; see `crowds`, which counts
those links without listing them. So a large group of near copies costs
neither pairs nor a long list.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import SALTS, connected_components, durable, stored
from stowage.llm.crowds import crowd_links
from stowage.llm.vectors import BLOCK, by_group, of_each_dim, unit_rows

THRESHOLD = 0.95
#: Length of the neighbour lists, least tables of random planes, rounds at most.
NEIGHBOURS, TABLES, ROUNDS = 8, 10, 6
#: Chance that a pair at the threshold shares no block.
MISS = 0.01
#: Nodes that the audit compares with all others, the recall at which refinement ends, and the least that is taken.
AUDIT, RECALL, LEAST = 512, 0.99, 0.9


def _signs(nodes: DataFrame, bits: int, tables: int, draw: int = 0) -> DataFrame:
    """nid, dim and for each table the side of `bits` random planes (their seed is fixed) as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            for part in of_each_dim(b):
                d = part.column("dim")[0].as_py()
                if d not in planes:
                    planes[d] = np.random.default_rng([d, draw]).standard_normal((d, bits * tables))
                p = planes[d]
                sides = (unit_rows(part.column("vec")) @ p > 0).reshape(-1, tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([part.column("nid"), part.column("dim"), pa.array(sides.tolist(), pa.list_(pa.int64()))], ["nid", "dim", "sides"])

    return nodes.select("nid", "dim", "vec").mapInArrow(run, "nid bigint, dim int, sides array<bigint>")


def _edges(src, dst, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(sim, pa.float64())], ["src", "dst", "sim"])


def _nearest(k: int) -> Callable:
    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if (n := rows.num_rows) < 2:
            return
        ids, x = rows["nid"].to_numpy(), unit_rows(rows["vec"])
        sims = x @ x.T
        np.fill_diagonal(sims, -2)
        m = min(k, n - 1)
        top = np.argpartition(-sims, m - 1, 1)[:, :m]
        yield _edges(np.repeat(ids, m), ids[top].ravel(), np.take_along_axis(sims, top, 1).ravel())

    return work


def _best(edges: DataFrame, k: int, by: str = "src") -> DataFrame:
    """The k best distinct edges of each node. A hub's edges are first ranked in SALTS parts, of which only the best go on."""
    flag = [F.max("old").alias("old")] if "old" in edges.columns else []
    one = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"), *flag)
    other = "dst" if by == "src" else "src"
    best = [F.desc("sim"), F.col(other)]
    if by == "dst":
        part = Window.partitionBy(by, "part").orderBy(*best)
        one = one.withColumn("part", F.pmod(F.xxhash64(other), F.lit(SALTS))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k).drop("part", "rank")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*best))).where(F.col("rank") <= k).drop("rank")


def first_graph(nodes: DataFrame, n: int, k: int, threshold: float = THRESHOLD, draw: int = 0) -> DataFrame:
    """src, dst, sim of the k nearest among the blocks of random partitions: as many as a pair at the threshold needs to share a block, but for MISS."""
    bits = max(1, min(30, round(math.log2(max(2, n / (BLOCK / 4))))))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    tables = max(TABLES, math.ceil(math.log(MISS) / math.log1p(-together))) if together < 1 else TABLES
    keys = _signs(nodes, bits, tables, draw).select("nid", "dim", F.posexplode("sides").alias("t", "side"))
    sizes = keys.groupBy("dim", "t", "side").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / BLOCK))
    dealt = keys.join(sizes, ["dim", "t", "side"]).withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("nid", "t"), F.col("parts"))).otherwise(F.lit(0)))
    dealt = dealt.select("nid", F.xxhash64("dim", "t", "side", "part").alias("block"), "dim").join(nodes.select("nid", "vec"), "nid")
    near = by_group(dealt.select("dim", "block", "nid", "vec"), ["dim", "block"], _nearest(max(3, k // 2)), "src bigint, dst bigint, sim double")
    return durable(_best(near, k).withColumn("old", F.lit(0)))


def refine(graph: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """One round of NN-descent: all pairs of a node's neighbours of which one is new are compared."""
    kth = graph.groupBy("src").agg(F.count("*").alias("n"), F.min("sim").alias("low")).select(F.col("src").alias("nid"), F.when(F.col("n") < k, -2.0).otherwise(F.col("low")).alias("low"))
    turned = graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim", "old")
    around = graph.select("src", "dst", "old").union(_best(turned, k).select("src", "dst", "old"))
    around = around.groupBy(F.col("src").alias("at"), F.col("dst").alias("nid")).agg(F.min("old").alias("old"))
    fresh = around.where("old = 0").select("at").distinct()
    around = around.join(fresh, "at", "left_semi").join(nodes.select("nid", "vec"), "nid").join(kth, "nid", "left")

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows < 2:
            return
        ids, old, low = rows["nid"].to_numpy(), rows["old"].to_numpy() > 0, rows["low"].to_numpy()
        x = unit_rows(rows["vec"])
        sims = x @ x.T
        np.fill_diagonal(sims, -3)
        a, b = np.nonzero((sims > np.where(np.isnan(low), -2, low)[:, None]) & ~(old[:, None] & old[None, :]))
        if len(a):
            yield _edges(ids[a], ids[b], sims[a, b])

    found = by_group(around.select("at", "nid", "vec", "old", "low"), ["at"], work, "src bigint, dst bigint, sim double")
    return durable(_best(graph.withColumn("old", F.lit(1)).union(found.withColumn("old", F.lit(0))), k))


def audit(graph: DataFrame, nodes: DataFrame, n: int, k: int, threshold: float, sample: int = AUDIT) -> float:
    """Share of the links of some nodes, as far as a list of k can hold them, that the graph has.

    Half of these nodes are any, half are such that the graph links with
    another, so that there is something to find where links are rare.
    """
    near = graph.where(F.col("sim") >= threshold)
    linked = near.select(F.col("src").alias("nid")).distinct()
    of = lambda df, m: df.where(F.pmod(F.xxhash64("nid", F.lit(n)), F.lit(1 << 50)) < int(min(1.0, sample / 2 / max(1, m)) * (1 << 50)))
    picked = of(nodes.select("nid"), n).union(of(linked, linked.count())).distinct()
    asked = nodes.join(picked, "nid", "left_semi").select("nid", "dim", "vec").toArrow()  # about `sample` rows
    by_dim = {d: (part["nid"].to_numpy(), unit_rows(part["vec"])) for d in set(asked["dim"].to_pylist()) for part in [asked.filter(pa.compute.equal(asked["dim"], d))]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for b in batches:
            for part in of_each_dim(b):
                if (d := part.column("dim")[0].as_py()) not in by_dim:
                    continue
                ids, q = by_dim[d]
                x, own = unit_rows(part.column("vec")), part.column("nid").to_numpy()
                for i in range(0, len(x), 2048):
                    hits = (q @ x[i : i + 2048].T >= threshold) & (ids[:, None] != own[None, i : i + 2048])
                    for j in np.flatnonzero(hits.any(1)):
                        sums[int(ids[j])] = sums.get(int(ids[j]), 0) + int(hits[j].sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], ["src", "n"])

    true = nodes.select("nid", "dim", "vec").mapInArrow(run, "src bigint, n bigint").groupBy("src").agg(F.least(F.sum("n"), F.lit(k)).alias("n"))
    have = near.groupBy("src").agg(F.count("*").alias("found"))
    got = true.join(have, "src", "left").agg(F.sum("n").alias("n"), F.sum(F.coalesce("found", F.lit(0))).alias("found")).first()
    return 1.0 if not got["n"] else got["found"] / got["n"]


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS) -> DataFrame:
    """vec_id, n_links, component_id, kept, audited_recall for each row. rows: vec_id, embedding.

    Vectors that are null, empty, zero or hold a null or non-finite component,
    and rows without a vec_id, link with nothing (n_links 0, own component).
    Vectors of different lengths never link. audited_recall is the share of
    known links that the audit found in the graph. Copies link with each other;
    repeated rows count as copies. Other columns are ignored; no rows give no rows.
    """
    vec = F.col("embedding")
    good = F.col("vec_id").isNotNull() & F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0), F.lit(False))
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").withColumn("vec", F.when(good, vec))
    nodes = rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = stored(nodes.withColumn("dim", F.size("vec")).withColumn("nid", F.monotonically_increasing_id()))
    n = nodes.count()
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not n:
        return alone.withColumn("kept", F.col("vec_id").isNotNull()).withColumn("audited_recall", F.lit(1.0))
    graph, recall = first_graph(nodes, n, k, threshold), 0.0
    for turn in range(ROUNDS):
        graph = refine(graph, nodes, k)
        recall = audit(graph, nodes, n, k, threshold)
        if recall >= RECALL:
            break
        more = first_graph(nodes, n, k, threshold, turn + 1)
        graph = durable(_best(graph.union(more.select(*graph.columns)), k))
    if recall < LEAST:
        raise RuntimeError(f"the neighbour graph finds {recall:.3f} of the links that its audit knows, less than {LEAST}")
    near = durable(graph.where(F.col("sim") >= threshold).select("src", "dst"))
    comps = durable(connected_components(near.select(F.col("src").alias("u"), F.col("dst").alias("v"))).select(F.col("node").alias("nid"), F.col("root").alias("comp")))
    full = near.groupBy(F.col("src").alias("nid")).agg(F.count("*").alias("n")).where(F.col("n") >= k)
    crowds = durable(full.join(comps, "nid").select("comp").distinct())
    few = comps.join(crowds, "comp", "left_anti").select("nid")
    pairs = near.union(near.select("dst", "src")).distinct().join(few.withColumnRenamed("nid", "src"), "src", "left_semi")
    linked = pairs.join(nodes.select(F.col("nid").alias("dst"), "copies"), "dst").groupBy(F.col("src").alias("nid")).agg(F.sum("copies").alias("linked"))
    members = comps.join(crowds, "comp", "left_semi").join(nodes, "nid").select(F.col("comp").alias("crowd"), "nid", "dim", "vec", "copies")
    if not crowds.isEmpty():
        inside, bonds = crowd_links(members, threshold)
        linked = linked.union(inside)
        merged = connected_components(bonds).select(F.col("node").alias("comp"), "root")
        comps = durable(comps.join(merged, "comp", "left").select("nid", F.coalesce("root", "comp").alias("comp")))
    whole = nodes.select("nid", "least", "copies", "vec").join(comps, "nid", "left").withColumn("comp", F.coalesce("comp", "nid")).join(linked, "nid", "left")
    whole = stored(whole.select("vec", "comp", "least", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")))
    lowest = whole.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = whole.join(lowest, "comp").select("vec", "n_links", "component_id")
    out = rows.where("vec is not null").join(named, "vec").select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))).withColumn("audited_recall", F.lit(recall))


def op5_embedding_near_dedup(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
