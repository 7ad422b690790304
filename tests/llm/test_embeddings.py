import numpy as np
import pytest

from stowage.llm import crowds
from stowage.llm.embeddings import near_vectors


def brute(ids, x, threshold=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= threshold
    root = list(range(len(ids)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in np.argwhere(np.triu(hit, 1)):
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {(ids[i], int(hit[i].sum()) - 1, least[find(i)]) for i in range(len(ids))}


def test_equals_brute_force_with_crowds_and_copies(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((250, 16))
    crowd = base[0] + 0.11 * rng.standard_normal((150, 16))  # more than a list holds, wide enough for vectors outside the core
    tight = base[1] + 0.02 * rng.standard_normal((40, 16))
    x = np.round(np.vstack([base, crowd, tight, base[2:12] + 0.03 * rng.standard_normal((10, 16)), base[:8], -base[5:7], 3 * base[20:24]]), 4)
    ids = [int(i) for i in rng.permutation(1000)[: len(x)]]
    bad = [(2001, None), (2002, []), (2003, [0.0] * 16), (2004, [float("nan")] * 16), (2005, [1.0, None] * 8), (2006, [float("inf")] + [0.0] * 15), (None, [1.0] * 16), (2007, [1.0, 2.0])]
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x, strict=True)] + [(i, v, None) for i, v in bad], "vec_id long, embedding array<double>, n_links int")
    got = near_vectors(rows).collect()
    want = brute(ids, x)
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None and r["vec_id"] < 2000} == want
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got if (r["vec_id"] or 0) >= 2000) == [(i, 0, i, True) for i in range(2001, 2008)]
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, False)]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors(empty).count() == 0
    assert near_vectors(spark.createDataFrame([(1, None), (1, None)], "vec_id long, embedding array<float>")).count() == 2


def test_lengths_crowds_and_ties_in_one_partition(spark):
    """Crowds of vectors of lengths 6, 7 and 10; tight groups within a wider one; a cosine of the threshold itself."""
    rng = np.random.default_rng(9)
    rows, want, at = [], set(), 0
    for dim in (6, 7, 10):
        centre = 4 * rng.standard_normal(dim)
        middles = centre + 0.16 * np.linalg.norm(centre) / np.sqrt(dim) * rng.standard_normal((4, dim))
        groups = [m + 0.004 * np.linalg.norm(m) * rng.standard_normal((12, dim)) for m in middles]
        tie = np.zeros((2, dim))
        tie[0, 0], tie[1, :2] = -20, (-19, np.sqrt(400 - 361))
        x = np.round(np.vstack([*groups, rng.standard_normal((60, dim)), tie]), 4)
        ids = list(range(at, at + len(x)))
        want |= brute(ids, x)
        rows += [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
        at += len(x)
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == want
    assert {r["audited_recall"] >= 0.9 for r in got} == {True}


def chain(n, rng, step=0.1, dim=5):
    """A crowd that is long and thin: each vector is a step from the one before, and links with those some steps away."""
    turn = np.cumsum(np.full(n, step / np.sqrt(dim)))
    x = np.stack([np.cos(turn * (i + 1) * 0.37) + 0.3 * i for i in range(dim)], 1)
    return x + 0.002 * rng.standard_normal((n, dim))


def test_long_crowds_split_in_cells_equal_brute_force(spark, monkeypatch):
    """A chain, a shell about a tight core and small crowds near one another, with cells so small that they are split many times."""
    monkeypatch.setattr(crowds, "BLOCK", 24)
    monkeypatch.setattr(crowds, "PIVOTS", 6)
    monkeypatch.setattr(crowds, "ROWS", 64)
    rng = np.random.default_rng(21)
    shell = np.array([9.0, -9, 9, -9, 9]) + 3.5 * rng.standard_normal((120, 5))
    tight = np.array([9.0, -9, 9, -9, 9]) + 0.3 * rng.standard_normal((90, 5))
    near = np.vstack([c + 0.5 * rng.standard_normal((15, 5)) for c in np.array([-9.0, 9, 9, 0, 0]) + 4 * rng.standard_normal((12, 5))])
    x = np.round(np.vstack([chain(400, rng), shell, tight, near]), 4)
    ids = [int(i) for i in rng.permutation(5000)[: len(x)]]
    got = near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == brute(ids, x)


@pytest.mark.parametrize("spread", [0, 1000])
def test_cells_hold_all_that_may_be_linked(spark, monkeypatch, spread):
    """Balls and points: every unit is at home once, beside all units that the triangle inequality allows; also where no split is made."""
    monkeypatch.setattr(crowds, "BLOCK", 16)
    monkeypatch.setattr(crowds, "PIVOTS", 5)
    monkeypatch.setattr(crowds, "SPREAD", spread)
    rng = np.random.default_rng(4)
    x = np.vstack([rng.standard_normal((150, 4)), chain(150, rng, dim=4)])
    r, theta = np.where(np.arange(300) % 7 == 0, 0.1, 0.0), 0.3
    rows = [(i, 4, v.tolist(), float(a), 1, i) for i, (v, a) in enumerate(zip(x, r, strict=True))]
    got = crowds.cells(spark.createDataFrame(rows, "unit long, dim int, vec array<double>, r double, weight long, crowd long"), theta).collect()
    beside = {}
    for row in got:
        beside.setdefault(row["cell"], set()).add(row["unit"])
    homes = [(row["unit"], row["cell"]) for row in got if row["home"]]
    assert sorted(u for u, _ in homes) == list(range(300))
    assert (len(beside) == 1) == (spread == 0)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    may = np.arccos(np.clip(u @ u.T, -1, 1)) <= theta + r[:, None] + r[None, :]
    assert all(set(np.flatnonzero(may[i]).tolist()) <= beside[c] for i, c in homes)
    assert len({(row["cell"], row["unit"]) for row in got}) == len(got)
