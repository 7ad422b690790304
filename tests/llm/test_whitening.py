import math

import numpy as np
import pytest

from stowage.llm import whitening
from stowage.llm.whitening import op13_embedding_whitening, whiten

KIND = "vec_id long, embedding array<float>, idx int"


def check(got, rows, components=4):
    """got against numpy on one machine: rows are (id, vector), all of one length."""
    good = [(k, v) for k, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for _, v in good], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    f = fit.astype(float) - (s / n).astype(float)
    e, v = np.linalg.eigh(f.T @ f / n)
    e, v = e[::-1], v[:, ::-1]
    k = sum(e[:components] > e.sum() * 1e-13 * len(e))
    assert len(got) == k * len(good)
    dev = ((n * x - s) ** 2).sum(axis=1)
    want = (x.astype(float) - (s / n).astype(float)) @ v[:, :k] / np.sqrt(e[:k])
    keys = [(i, j + 1, n, int(dev[r])) for r, (i, _) in enumerate(good) for j in range(k)]
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got) == sorted(keys)
    by = {(r["vec_id"], r["component"]): r for r in got}
    for j in range(k):
        ours = np.array([by[i, j + 1]["whitened"] for i, _ in good])
        sign = np.sign(ours @ want[:, j])
        np.testing.assert_allclose(ours * sign, want[:, j], atol=1e-8)
        assert abs(got and by[good[0][0], j + 1]["explained"] - e[j] / e.sum()) < 1e-9
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-6


@pytest.mark.parametrize("block", [1 << 19, 40])
def test_against_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK", block)
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(7, 7))
    rows = [(i, [float(c) for c in np.float32(rng.normal(size=7) @ mix + 2)]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)]  # copies fit once
    rows += [(2000, None), (2001, [1.0] * 6 + [None]), (2002, [float("nan")] + [1.0] * 6), (2003, [float("inf")] * 7), (2004, []), (2005, [-0.0] * 7), (2006, [-1e-9] * 7)]
    df = spark.createDataFrame([(*r, 1) for r in rows], KIND).repartition(5)
    check(whiten(df).collect(), rows)


def test_given_embeddings(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = op13_embedding_whitening(spark, sf)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got.collect(), rows)


def test_no_variance_few_rows_and_empty(spark):
    df = lambda rows: spark.createDataFrame([(*r, 1) for r in rows], KIND)
    assert whiten(df([])).count() == 0 and whiten(df([(1, None)])).count() == 0
    assert whiten(df([(1, [0.5, 0.5]), (2, [0.5, 0.5])])).count() == 0
    got = whiten(df([(1, [0.5, 0.5]), (2, [0.25, 0.5]), (2, [0.25, 0.5])])).collect()
    assert sorted((r["vec_id"], r["component"], abs(round(r["whitened"], 9))) for r in got) == [(1, 1, 1.0), (2, 1, 1.0), (2, 1, 1.0)]
    assert {r["explained"] for r in got} == {1.0}


def test_several_lengths_are_several_fits(spark):
    rng = np.random.default_rng(5)
    a = [(i, [float(c) for c in np.float32(rng.normal(size=3))]) for i in range(40)]
    b = [(100 + i, [float(c) for c in np.float32(rng.normal(size=5))]) for i in range(40)]
    got = whiten(spark.createDataFrame([(*r, 1) for r in a + b], KIND)).collect()
    check([r for r in got if r["vec_id"] < 100], a)
    check([r for r in got if r["vec_id"] >= 100], b)
