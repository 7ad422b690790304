"""Links of vectors whose neighbour lists are saturated, counted without listing them.

Of each crowd (a component of such vectors) the vectors within half the
threshold's angle of its mean are its core: they are all linked with one
another by the triangle inequality and become one unit, a ball. Every other
vector is a unit of radius 0. Units are compared in cells: a cell of more than
BLOCK units is split by some of them, pivots, each unit is at home with the
nearest pivot and a guest of those whose reach it is within, so that no
linked pair is separated, and a unit meets only what the triangle inequality
does not exclude. Balls that are neither wholly linked with a unit nor wholly
apart from it have their members compared, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import durable
from stowage.llm.vectors import BLOCK, MARGIN, by_group, of_each_dim, unit_rows

#: Pivots of a split: one for CLOSE units on average, PIVOTS at most. Few pivots have far units and rule little out.
PIVOTS, CLOSE = 4096, 16
#: Rows of a cell that one task splits, or compares with as many others, at once.
ROWS = 2048
#: A split that would give a cell's units more places on average is not made; the cell is compared in blocks.
SPREAD = 16
#: Splits of splits; what is still larger is compared in blocks.
LEVELS = 20
#: Angles this close to a bound do not decide for a whole ball.
_NEAR = 1e-6

_UNIT = "unit bigint, dim int, vec array<double>, r double, weight bigint, crowd bigint"
_FIELDS = ["unit", "dim", "vec", "r", "weight", "crowd"]
_IS_BALL = 1  # lowest bit of a unit's number


def _means(members: DataFrame) -> DataFrame:
    """crowd, mean: the direction of the sum of its unit vectors."""

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in of_each_dim(b):
                x = unit_rows(part.column("vec"))
                yield pa.RecordBatch.from_arrays([part.column("crowd"), pa.array(list(x), pa.list_(pa.float64()))], ["crowd", "unit"])

    sums = members.select("crowd", "dim", "vec").mapInArrow(norm, "crowd bigint, unit array<double>").select("crowd", F.posexplode("unit").alias("i", "x"))
    sums = sums.groupBy("crowd", "i").agg(F.sum("x").alias("x")).groupBy("crowd").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m"))
    size = F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + x["x"] * x["x"]))
    return sums.select("crowd", F.transform("m", lambda x: x["x"] / F.greatest(size, F.lit(1e-300))).alias("mean"))


def _placed(members: DataFrame, means: DataFrame, least: float) -> DataFrame:
    """members with cos, the cosine with their crowd's mean, and core, whether it is `least` or more."""
    kind = dict(members.dtypes)["vec"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in of_each_dim(b):
                cos = (unit_rows(part.column("vec")) * np.array(part.column("mean").to_pylist())).sum(1)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("crowd", "nid", "dim", "vec", "copies")), pa.array(cos), pa.array(cos >= least)], ["crowd", "nid", "dim", "vec", "copies", "cos", "core"])

    joined = members.join(means, "crowd").select("crowd", "nid", "dim", "vec", "copies", "mean")
    return joined.mapInArrow(place, f"crowd bigint, nid bigint, dim int, vec {kind}, copies bigint, cos double, core boolean")


def _angles(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1.0, 1.0))


def _chunks(n: int, size: int = 256) -> Iterator[slice]:
    return (slice(i, i + size) for i in range(0, n, size))


def _split(held: DataFrame, large: DataFrame, level: int, theta: float) -> tuple[DataFrame, DataFrame]:
    """The units of large cells in smaller ones, and the cells that it does not help.

    held: cell, home and a unit's columns; large: cell, n, homes of the cells to split.
    """
    inside = held.join(large, "cell")
    parts = F.ceil(F.col("n") / ROWS)
    wanted = F.least(F.lit(PIVOTS), F.ceil(F.col("homes") / CLOSE))
    drawn = F.pmod(F.xxhash64("unit", F.lit(level)), F.lit(1 << 30)) < F.lit(1 << 30) * wanted / F.col("homes")
    none = F.lit(None)
    rows = inside.select("cell", F.pmod(F.xxhash64("unit", F.lit(-level)), parts).alias("part"), none.cast("double").alias("reach"), F.lit(False).alias("pivot"), "home", *_FIELDS)
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part")
    pivots = inside.where(F.col("home") & drawn).select("cell", every, F.lit(True).alias("pivot"), none.cast("boolean").alias("home"), *_FIELDS)

    def nearest(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        pivot, home = rows["pivot"].to_numpy(), np.asarray(rows["home"].to_pylist(), dtype=object) == True  # noqa: E712
        mine = ~pivot & home
        if not pivot.any() or not mine.any():
            return
        names, x, r = rows["unit"].to_numpy()[pivot], unit_rows(rows["vec"]), rows["r"].to_numpy()[mine]
        cos = [(c.argmax(1), c.max(1)) for s in _chunks(len(r)) for c in [x[mine][s] @ x[pivot].T]]
        at, gap = names[np.concatenate([i for i, _ in cos])], _angles(np.concatenate([c for _, c in cos]))
        yield pa.RecordBatch.from_arrays([rows["cell"].combine_chunks()[: len(at)], pa.array(rows["unit"].to_numpy()[mine]), pa.array(at), pa.array(gap + r)], ["cell", "unit", "at", "reach"])

    first = pivots.withColumn("reach", none.cast("double")).select(*rows.columns)
    at = durable(by_group(rows.where("home").union(first), ["cell", "part"], nearest, "cell bigint, unit bigint, at bigint, reach double"))
    reach = at.groupBy("cell", F.col("at").alias("unit")).agg(F.max("reach").alias("reach"))
    second = pivots.join(reach, ["cell", "unit"]).select(*rows.columns)
    asked = rows.join(at.select("cell", "unit", "at"), ["cell", "unit"], "left").select(*rows.columns, "at")

    def within(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        pivot = rows["pivot"].to_numpy()
        mine = rows.filter(pa.array(~pivot))
        if not mine.num_rows:
            return
        names, reach, x, r = rows["unit"].to_numpy()[pivot], rows["reach"].to_numpy()[pivot], unit_rows(rows["vec"]), mine["r"].to_numpy()
        fits = [names[row] for s in _chunks(len(r)) for row in _angles(x[~pivot][s] @ x[pivot].T) <= reach[None, :] + (theta + _NEAR + r[s])[:, None]]
        count = sum(map(len, fits))
        wide = not len(names) or count > 4 * SPREAD * len(r)
        places = pa.nulls(len(r), pa.list_(pa.int64())) if wide else pa.array(fits, pa.list_(pa.int64()))
        columns = [mine[c].combine_chunks() for c in ("cell", "home", *_FIELDS, "at")]
        yield pa.RecordBatch.from_arrays([*columns, places], ["cell", "home", *_FIELDS, "at", "places"])

    where = durable(by_group(asked.union(second.withColumn("at", none.cast("bigint"))), ["cell", "part"], within, f"cell bigint, home boolean, {_UNIT}, at bigint, places array<bigint>"))
    wide = F.max(F.col("places").isNull()) | (F.sum(F.size("places")) > SPREAD * F.count("*"))
    poor = durable(where.groupBy("cell").agg(wide.alias("wide")).where("wide").select("cell"))
    split = where.join(poor, "cell", "left_anti").withColumn("place", F.explode("places"))
    return split.select(F.col("place").alias("cell"), (F.col("home") & (F.col("at") == F.col("place"))).alias("home"), *_FIELDS), poor


def cells(units: DataFrame, theta: float) -> DataFrame:
    """cell, home and a unit's columns: each unit is at home in one cell, in which everything is that may be linked with it."""
    held, done = units.select((-1 - F.col("dim")).cast("bigint").alias("cell"), F.lit(True).alias("home"), *_FIELDS), []
    for level in range(1, LEVELS + 1):
        sizes = durable(held.groupBy("cell").agg(F.count("*").alias("n"), F.count(F.when(F.col("home"), 1)).alias("homes")))
        large = sizes.where(F.col("homes") > BLOCK)
        if large.isEmpty():
            break
        done.append(held.join(sizes.where((F.col("homes") > 0) & (F.col("homes") <= BLOCK)), "cell", "left_semi"))
        split, poor = _split(held, large, level, theta)
        done.append(held.join(poor, "cell", "left_semi"))
        held = durable(split)
    return reduce(DataFrame.union, [*done, held])


def _blocks(asked: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """asked and given of each key, so that each of asked meets each of given in one (key, a, b) of about 2 ROWS rows at most."""
    count = lambda df, name: df.groupBy(key).agg(F.ceil(F.count("*") / ROWS).alias(name))
    sizes = count(asked, "outer").join(count(given, "inner"), key)
    id_ = "unit" if "unit" in asked.columns else "nid"
    own = lambda n: F.pmod(F.xxhash64(id_, F.lit(7)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    names = [c for c in asked.columns if c != key]
    a = asked.join(sizes, key).select(key, own("outer").alias("a"), every("inner").alias("b"), F.lit(True).alias("asks"), *names)
    b = given.join(sizes, key).select(key, every("outer").alias("a"), own("inner").alias("b"), F.lit(False).alias("asks"), *names)
    return a.union(b)


def _found(**columns) -> pa.RecordBatch:
    """Rows of unit, linked, u, v, mixed; what is not given is null."""
    n = len(next(iter(columns.values())))
    names = ["unit", "linked", "u", "v", "mixed"]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], pa.int64()) if c in columns else pa.nulls(n, pa.int64()) for c in names], names)


_FOUND = "unit bigint, linked bigint, u bigint, v bigint, mixed bigint"


def _bonds(hit: np.ndarray, mine: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    a, b = np.nonzero(hit & (mine[:, None] != other[None, :]))
    pairs = np.unique(np.stack([mine[a], other[b]], 1), axis=0)
    return _found(u=pairs[:, 0], v=pairs[:, 1])


def crowd_links(members: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """nid, linked (copies of other nodes linked to it), and edges u, v between crowds that are linked.

    members: crowd, nid, dim, vec, copies; a crowd's vectors have one length.
    """
    theta = math.acos(threshold)
    placed = durable(_placed(members, _means(members), math.cos(theta / 2) + MARGIN))
    core = placed.where("core")
    totals = core.groupBy("crowd").agg(F.sum("copies").alias("all"))
    inner = core.join(totals, "crowd").select("nid", (F.col("all") - F.col("copies")).alias("linked"))

    ball = (F.shiftleft("crowd", 1) + _IS_BALL).alias("unit")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min("cos")))).alias("r")
    balls = core.groupBy("crowd", "dim").agg(angle, F.sum("copies").alias("weight")).join(_means(members), "crowd").select(ball, "dim", F.col("mean").alias("vec"), "r", "weight", "crowd")
    points = placed.where("not core").select(F.shiftleft("nid", 1).alias("unit"), "dim", F.col("vec").cast("array<double>").alias("vec"), F.lit(0.0).alias("r"), F.col("copies").alias("weight"), "crowd")
    units = durable(balls.union(points))
    dealt = durable(cells(units, theta))

    def meet(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        asks, unit, r, weight, crowd = (rows[c].to_numpy() for c in ("asks", "unit", "r", "weight", "crowd"))
        if not asks.any() or asks.all():
            return
        x, solid, other = unit_rows(rows["vec"]), unit & _IS_BALL > 0, ~asks
        for s in _chunks(asks.sum()):
            mine = np.flatnonzero(asks)[s]
            cos = x[mine] @ x[other].T
            gap, radii = _angles(cos), r[mine][:, None] + r[other][None, :]
            any_ball, apart = solid[mine][:, None] | solid[other][None, :], unit[mine][:, None] != unit[other][None, :]
            hit = np.where(any_ball, gap + radii <= theta - _NEAR, cos >= threshold) & apart
            yield _found(unit=unit[mine], linked=hit @ weight[other])
            yield _bonds(hit, crowd[mine], crowd[other])
            first = ~solid[mine][:, None] | (unit[mine][:, None] < unit[other][None, :])
            a, b = np.nonzero(any_ball & apart & ~hit & (gap - radii <= theta + _NEAR) & solid[other][None, :] & first)
            yield _found(unit=unit[mine][a], mixed=unit[other][b])

    both = _blocks(dealt.where("home").drop("home"), dealt.drop("home"), "cell")
    met = durable(by_group(both, ["cell", "a", "b"], meet, _FOUND))

    of_unit = F.when(F.col("core"), F.shiftleft("crowd", 1) + _IS_BALL).otherwise(F.shiftleft("nid", 1)).alias("of")
    named = placed.select(of_unit, "nid", "dim", "vec", "copies", "crowd", "core")
    sums = met.where("linked > 0").groupBy(F.col("unit").alias("of")).agg(F.sum("linked").alias("linked"))
    whole = named.select("of", "nid").join(sums, "of").select("nid", "linked")
    unsure = met.where("mixed is not null").select(F.col("unit").alias("of"), F.col("mixed").alias("ball"))
    asked = named.join(unsure, "of").select("ball", "nid", "vec", "copies", "crowd")
    given = named.where("core").select(F.col("of").alias("ball"), "nid", "vec", "copies", "crowd").join(unsure.select("ball").distinct(), "ball", "left_semi")

    def members_meet(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        asks, nid, copies, crowd = (rows[c].to_numpy() for c in ("asks", "nid", "copies", "crowd"))
        if not asks.any() or asks.all():
            return
        x, back = unit_rows(rows["vec"]), 0
        for s in _chunks(asks.sum()):
            mine = np.flatnonzero(asks)[s]
            hit = x[mine] @ x[~asks].T >= threshold
            back = back + hit.T @ copies[mine]
            yield _found(unit=nid[mine], linked=hit @ copies[~asks])
            yield _bonds(hit, crowd[mine], crowd[~asks])
        yield _found(unit=nid[~asks], linked=back)

    in_balls = durable(by_group(_blocks(asked, given, "ball"), ["ball", "a", "b"], members_meet, _FOUND))
    hits = in_balls.where("linked > 0").select(F.col("unit").alias("nid"), "linked")
    linked = inner.union(whole).union(hits).groupBy("nid").agg(F.sum("linked").alias("linked"))
    bonds = met.where("u is not null").select("u", "v").union(in_balls.where("u is not null").select("u", "v")).distinct()
    return linked, bonds
