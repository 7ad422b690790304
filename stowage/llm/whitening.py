"""Whitening of vectors with Spark MLlib's BlockMatrix.

Entries become whole numbers, floor(SCALE * c), so counts, sums and deviations
are exact. The rows that fit the transform, each distinct vector once, are
centred, indexed and cut into distributed blocks; the transposed matrix times
the matrix is their scatter, of which the driver gets d x d numbers and
decomposes them. All rows, as blocks too, times the whitening matrix are the
projections.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import stored, table

SCALE = 256
#: Entries of a block, most row blocks (the driver holds a place for each), widest vectors (the driver holds their scatter), most lengths.
BLOCK, BLOCKS, WIDEST, KINDS = 1 << 19, 1 << 16, 4096, 64
#: An eigenvalue below this share of the trace, for each dimension, is rounding.
ROUNDING = 1e-13


def numbered(rows: DataFrame) -> DataFrame:
    """rows, written, with idx from 0 without gaps: a row's place in its task plus the rows of the tasks before."""
    kept = stored(rows.withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    sizes = sorted((r["task"], r["n"]) for r in kept.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect())  # a row for each task
    before = dict(zip([t for t, _ in sizes], np.cumsum([0, *(n for _, n in sizes)]).tolist(), strict=False))
    starts = F.broadcast(rows.sparkSession.createDataFrame(list(before.items()), "task long, before long"))
    place = (F.col("before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("idx")
    return kept.withColumn("task", task.cast("long")).join(starts, "task").select(*rows.columns, place)


def block_matrix(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    """rows (idx, values) as blocks of whole rows; an index that does not occur is a row of zeros."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col("idx").alias("index"), array_to_vector("values").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(rows_of_block(n, d), d)


def rows_of_block(n: int, d: int) -> int:
    return max(1, BLOCK // d, -(-n // BLOCKS))


def scatter(matrix: BlockMatrix, n: int, d: int) -> np.ndarray:
    """Transposed matrix times matrix. The rows are split between tasks, whose products are added up."""
    parts = -(-n // rows_of_block(n, d))
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(product, d, d).toLocalMatrix().toArray()


def whiten(vectors: DataFrame, components: int = 4, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """A row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or hold a null or an entry that is not finite are left out.
    Of the others each entry c becomes x = floor(256 c), and each distinct x fits the
    transform once: n of them, with sums S. Components are unit eigenvectors of
    their covariance (divisor n), numbered from 1 by falling eigenvalue e;
    whitened is (x - S/n) projected on one, over sqrt(e); explained is e over
    the sum of all e; deviation, the same for all components, is the sum of
    (n x - S)^2, exact (one that no long holds is an error). identity_error is
    the largest entry, without sign, of the covariance of whitened over the
    fitted vectors minus the identity. Components without variance (there are
    at most n - 1 with any) give no rows, so one distinct vector alone gives
    none. Vectors of several lengths are several fits. Repeated rows and ids,
    null ids and ties are rows like any other; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    good = F.expr(f"{vector} is not null and size({vector}) > 0 and forall({vector}, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    whole = F.expr(f"transform({vector}, c -> floor(cast(c as double) * {SCALE}))")
    rows = numbered(vectors.where(good).select(F.col(id_column).alias("id"), whole.alias("x")))
    kinds = sorted(r["d"] for r in rows.select(F.size("x").alias("d")).distinct().limit(KINDS + 1).collect())
    if len(kinds) > KINDS or kinds and kinds[-1] > WIDEST:
        raise ValueError(f"vectors of more than {KINDS} lengths or of more than {WIDEST} entries")
    out = None
    for d in kinds:
        one = _whitened(rows.where(F.size("x") == d), d, components)
        out = one if out is None else out.union(one)
    if out is None:
        out = spark.createDataFrame([], f"id {dict(vectors.dtypes)[id_column]}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_column)


def _whitened(rows: DataFrame, d: int, components: int) -> DataFrame:
    spark = rows.sparkSession
    first = stored(rows.groupBy("x").agg(F.min("idx").alias("idx")))  # each distinct vector once
    n = first.count()
    sums = [r["s"] for r in first.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s")).orderBy("i").collect()]  # d numbers
    total = rows.agg(F.max("idx")).first()[0] + 1
    mean = F.array(*(F.lit(s / n) for s in sums))
    centred = F.zip_with("x", mean, lambda x, m: x.cast("double") - m)

    covariance = scatter(block_matrix(first.select("idx", centred.alias("values")), total, d), total, d) / n
    e, v = np.linalg.eigh((covariance + covariance.T) / 2)
    e, v = e[::-1], v[:, ::-1]
    k = int((e[:components] > max(e.sum(), 0) * ROUNDING * d).sum())
    if not k:
        return spark.createDataFrame([], f"id {dict(rows.dtypes)['id']}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    matrix = spark.sparkContext.parallelize([((0, 0), DenseMatrix(d, k, (v[:, :k] / np.sqrt(e[:k])).flatten("F").tolist()))])
    projected = block_matrix(rows.select("idx", centred.alias("values")), total, d).multiply(BlockMatrix(matrix, d, k)).toIndexedRowMatrix().rows
    white = stored(projected.map(lambda r: (r.index, r.vector.toArray().tolist())).toDF("idx long, w array<double>"))

    ours = white.join(first.select("idx"), "idx", "left_semi")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    moments = ours.agg(*(F.avg(F.col("w")[i]) for i in range(k)), *(F.avg(F.col("w")[i] * F.col("w")[j]) for i, j in pairs)).first()
    error = max(abs(moments[k + q] - moments[i] * moments[j] - (i == j)) for q, (i, j) in enumerate(pairs))

    off = F.zip_with("x", F.array(*(F.lit(s).cast("long") for s in sums)), lambda x, s: F.lit(n).cast("long") * x - s)
    deviation = F.aggregate(off, F.lit(0).cast("long"), lambda a, x: a + x * x)
    explained = F.array(*(F.lit(float(x / e.sum())) for x in e[:k]))
    found = rows.select("id", "idx", deviation.alias("deviation")).join(white, "idx").select("id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return found.select("id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("i") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"))


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
