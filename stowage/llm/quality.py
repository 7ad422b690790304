"""Quality by weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document.
Expectation-maximisation over the counts of vote patterns (3 to the number of
labellers at most, whatever the corpus) estimates how often each labeller is
right, and so the chance that a document with given votes is good. These
posteriors, as fractional labels of every document, train a linear scorer over
hashed words, word endings and word lengths; a logistic curve fitted on a
histogram of its sums turns them into scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import stored, text_slices

BUCKETS = 1 << 16
FEATURES = BUCKETS + 256 + 32
#: Bins of the calibration histogram, over sums from -LIMIT to LIMIT.
BINS, LIMIT = 800, 8.0
LABELLERS = ("symbols", "sentence ends", "different words", "repeated lines", "capitals", "columns", "one word", "letters")

_CLASS = np.zeros(256, np.uint8)  # 0 letters and other scripts, 1 capitals, 2 blanks, 3 digits, 4 symbols
_CLASS[65:91], _CLASS[48:58] = 1, 3
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
_CLASS[[*range(0, 33), 127]] = 2


def votes(raw: bytes, words: list[bytes]) -> tuple[int, ...]:
    """1 good, 0 bad, -1 no vote, by labeller."""
    n = max(1, len(raw))
    letters, capitals, _, _, symbols = (np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=5) / n).tolist()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    many = len(words)
    pick = lambda x, good, bad: 1 if good else 0 if bad else -1
    ends = sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines))
    repeated = 1 - len(set(lines)) / max(1, len(lines))
    top = max(counts.values(), default=0) / max(1, many)
    return (
        pick(0, symbols < 0.06, symbols > 0.09),
        pick(0, ends > 0.9, ends < 0.5) if lines else 0,
        pick(0, len(counts) > 0.5 * many, len(counts) < 0.35 * many) if many >= 40 else -1,
        pick(0, repeated == 0 and len(lines) > 2, repeated > 0.3),
        pick(0, capitals < 0.08, capitals > 0.25),
        pick(0, False, raw.count(b"|") > 0.2 * max(1, many)),
        pick(0, top < 0.12, top > 0.25) if many >= 20 else -1,
        pick(0, letters + capitals > 0.72, letters + capitals < 0.6),
    )


def features(words: list[bytes]) -> np.ndarray:
    """Hashed word, last byte and length of each word."""
    n = len(words)
    out = np.empty((3, n), np.int64)
    out[0] = np.fromiter(map(crc32, words), np.int64, n) & (BUCKETS - 1)
    out[1] = np.fromiter((w[-1] for w in words), np.int64, n) + BUCKETS
    out[2] = np.minimum(np.fromiter(map(len, words), np.int64, n), 31) + BUCKETS + 256
    return out.ravel()


def label_model(counts: dict[tuple[int, ...], int], rounds: int = 200) -> dict[tuple[int, ...], float]:
    """Chance of good for each vote pattern, by expectation-maximisation from the majority vote.

    Each labeller has a rate of being right on good and on bad documents; a
    missing vote says nothing. Without patterns the result is empty.
    """
    if not counts:
        return {}
    patterns = sorted(counts)
    v, n = np.array(patterns), np.array([counts[p] for p in patterns], float)
    said, yes = v >= 0, v == 1
    p = (yes.sum(1) + 0.5) / (said.sum(1) + 1.0)
    for _ in range(rounds):
        good, bad = n * p, n * (1 - p)
        prior = np.clip(good.sum() / n.sum(), 0.02, 0.98)
        right = ((good[:, None] * yes).sum(0) + 4) / ((good[:, None] * said).sum(0) + 5)  # leaning to labellers that are right
        wrong = ((bad[:, None] * yes).sum(0) + 1) / ((bad[:, None] * said).sum(0) + 5)
        term = lambda q: np.where(yes, np.log(q), np.where(said, np.log1p(-q), 0)).sum(1)
        odds = np.log(prior / (1 - prior)) + term(np.clip(right, 1e-4, 1 - 1e-4)) - term(np.clip(wrong, 1e-4, 1 - 1e-4))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - p).max() < 1e-7:
            p = new
            break
        p = new
    return {k: float(x) for k, x in zip(patterns, p, strict=True)}


def _raws(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[bytes]]]:
    for t in batch.column("text").to_pylist():
        raw = (t or "").encode("utf-8", "replace")
        yield raw, raw.split()


def fit_labels(docs: DataFrame) -> dict[tuple[int, ...], float]:
    """Counts of vote patterns over all documents, added up in the tasks first, then the label model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in text_slices(batches):
            counts.update(votes(raw, words) for raw, words in _raws(b))
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in counts], pa.list_(pa.int32())), pa.array(list(counts.values()), pa.int64())], ["votes", "n"])

    got = docs.select("text").mapInArrow(run, "votes array<int>, n bigint").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    return label_model({tuple(r["votes"]): r["n"] for r in got})


def fit_scorer(docs: DataFrame, posterior: dict[tuple[int, ...], float]) -> np.ndarray:
    """Weight of each feature: log-odds of its share of the words of good and of bad documents, every document counted by its posterior.

    A document's words count by the square root of its length, so that long ones do not outweigh the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = np.zeros(FEATURES), np.zeros(FEATURES)
        for b in text_slices(batches):
            rows = [(features(words), posterior.get(votes(raw, words), 0.5)) for raw, words in _raws(b) if words]
            if rows:
                sizes = np.array([len(x) for x, _ in rows])
                every, share = np.concatenate([x for x, _ in rows]), np.repeat((sizes / 3) ** -0.5, sizes)
                p = np.repeat([p for _, p in rows], sizes)
                good += np.bincount(every, p * share, FEATURES)
                bad += np.bincount(every, (1 - p) * share, FEATURES)
        at = np.flatnonzero(good + bad)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(good[at]), pa.array(bad[at])], ["feature", "good", "bad"])

    sums = docs.select("text").mapInArrow(run, "feature int, good double, bad double").groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()  # FEATURES rows at most
    good, bad = np.full(FEATURES, 1.0), np.full(FEATURES, 1.0)
    good[sums["feature"].to_numpy()] += sums["good"].to_numpy()
    bad[sums["feature"].to_numpy()] += sums["bad"].to_numpy()
    return np.clip(np.log(good / good.sum()) - np.log(bad / bad.sum()), -6, 6)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1: good), weak_label (the votes' posterior) for each row's whole text.

    Null, empty and blank texts get the votes' posterior as their score.
    Repeated rows stay; other columns are ignored; no rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    posterior = fit_labels(docs)
    weights = fit_scorer(docs, posterior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            sums, weak = [], []
            for raw, words in _raws(b):
                weak.append(posterior.get(votes(raw, words), 0.5))
                sums.append(3 * float(weights[features(words)].mean()) if words else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sums, pa.float64()), pa.array(weak, pa.float64())], ["doc_id", "sum", "weak_label"])

    rows = stored(docs.mapInArrow(run, "doc_id bigint, sum double, weak_label double"))
    bins = rows.where("sum is not null").groupBy(F.floor((F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), "sum")) + LIMIT) * (BINS / 2 / LIMIT)).alias("bin")).agg(F.count("*").alias("n"), F.sum("weak_label").alias("good"))
    got = bins.toPandas()  # BINS + 1 rows at most
    a, k = _curve((got["bin"].to_numpy(float) + 0.5) * 2 * LIMIT / BINS - LIMIT, got["n"].to_numpy(float), got["good"].to_numpy(float))
    fitted = 1 / (1 + F.exp(-(F.lit(a) + F.lit(k) * F.col("sum"))))
    out = rows.withColumn("score", F.coalesce(fitted, "weak_label"))
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "weak_label")


def _curve(x: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve through good of n at x, by Newton's method with a small penalty."""
    if not len(x):
        return 0.0, 1.0
    w, z = np.zeros(2), np.column_stack([np.ones(len(x)), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2), z.T @ (good - n * p) - 0.1 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def op7_quality_classifier(spark, sf_dir):
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
