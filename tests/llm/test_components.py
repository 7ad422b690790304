import numpy as np
import pytest

from stowage.llm import common


def roots(edges):
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    return {(a, find(a)) for a in list(root)}


@pytest.mark.parametrize("held", [10, common.EDGES])
def test_one_part_and_many_equal_union_find(spark, monkeypatch, held):
    """A path, a hub, random pairs, loops, repeats and nulls: with all edges in one part and with exchanges."""
    monkeypatch.setattr(common, "EDGES", held)
    rng = np.random.default_rng(8)
    edges = [(i, i + 1) for i in range(1000, 1060)] + [(2000, 3000 + i) for i in range(80)] + [tuple(map(int, p)) for p in rng.integers(0, 300, (150, 2))]
    edges += [(5, 5), (None, 7), (8, None), *edges[:20], *((v, u) for u, v in edges[60:90])]
    got = common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {(r["node"], r["root"]) for r in got} == roots(edges)
    assert len({r["node"] for r in got}) == len(got)
