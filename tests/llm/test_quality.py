import math
import random
from zlib import crc32

import pytest

from stowage.llm.quality import features, fit_labels, fit_scorer, label_model, score, votes


def test_label_model_finds_the_good_labellers():
    rnd = random.Random(1)
    counts, truth = {}, {}
    for _ in range(20000):
        good = rnd.random() < 0.8
        v = tuple((good if rnd.random() < right else not good) * 1 if rnd.random() < 0.9 else -1 for right in (0.95, 0.9, 0.9, 0.6))
        counts[v] = counts.get(v, 0) + 1
        truth[v] = truth.get(v, 0) + good
    p = label_model(counts)
    gap = sum(abs(p[v] - truth[v] / n) * n for v, n in counts.items()) / 20000
    assert gap < 0.05
    assert label_model({}) == {}


def test_votes_and_features():
    words = b"These are plain words in a row. They all end quite well.".split()
    assert votes(b" ".join(words), words)[0] == 1
    assert votes(b"", [])[1] == 0 and votes(b"$$$ %%% &&&", [b"$$$", b"%%%", b"&&&"])[0] == 0
    assert len(features(words)) == 3 * len(words) and len(features([])) == 0


def test_scores(spark):
    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(300)]
    rows = []
    for i in range(200):
        w = rnd.sample(vocabulary, 60)
        rows.append((i, ". ".join(" ".join(w[j : j + 10]) for j in range(0, 60, 10)) + ".\nMore here.\nEnd.") if i % 5 else (i, " ".join(x + "***" for x in w)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "x"), (1, rows[1][1])], "doc_id long, text string").selectExpr("*", "text as score", "1 as predicted")
    got = score(docs).collect()
    assert len(got) == 204 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == (r["doc_id"] % 5 != 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 200)
    assert score(docs.where("false")).count() == 0


def plain_label_model(counts, rounds=200):
    """Expectation-maximisation by its formulas, one pattern and labeller at a time."""
    p = {v: (sum(x == 1 for x in v) + 0.5) / (sum(x >= 0 for x in v) + 1) for v in counts}
    total = sum(counts.values())
    for _ in range(rounds):
        prior = min(0.98, max(0.02, sum(n * p[v] for v, n in counts.items()) / total))
        rates = []
        for j in range(len(next(iter(counts)))):
            said = [(v, n) for v, n in counts.items() if v[j] >= 0]
            right = (sum(n * p[v] * v[j] for v, n in said) + 4) / (sum(n * p[v] for v, n in said) + 5)
            wrong = (sum(n * (1 - p[v]) * v[j] for v, n in said) + 1) / (sum(n * (1 - p[v]) for v, n in said) + 5)
            rates.append([min(1 - 1e-4, max(1e-4, r)) for r in (right, wrong)])
        new = {}
        for v in counts:
            good, bad = prior, 1 - prior
            for x, (right, wrong) in zip(v, rates, strict=True):
                if x >= 0:
                    good, bad = good * (right if x else 1 - right), bad * (wrong if x else 1 - wrong)
            new[v] = good / (good + bad)
        gap, p = max(abs(new[v] - p[v]) for v in p), new
        if gap < 1e-7:
            break
    return p


def test_whole_query_equals_plain_python(spark):
    """Pattern counts, posteriors, weights, sums and posteriors as scores against loops over words."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=rnd.randrange(2, 9))) for _ in range(200)]
    texts = [None, "", " \n", "x" * 5000, "ünï ünï çödé."]
    for i in range(120):
        w = rnd.choices(vocabulary, k=rnd.randrange(1, 90))
        texts.append(" ".join(w) + "." if i % 3 else "\n".join("|".join(w[j : j + 3]).upper() + "##" for j in range(0, len(w), 3)))
    texts.append(" ".join(rnd.choices(vocabulary, k=40_000)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    words = {i: (t or "").encode().split() for i, t in enumerate(texts)}
    said = {i: votes((t or "").encode(), words[i]) for i, t in enumerate(texts)}
    counts = {}
    for v in said.values():
        counts[v] = counts.get(v, 0) + 1
    posterior, want = fit_labels(docs), plain_label_model(counts)
    assert posterior.keys() == want.keys() and all(posterior[v] == pytest.approx(want[v], abs=1e-5) for v in want)

    sums = {}
    for i, ws in words.items():
        for w in ws:
            for f in (crc32(w) % 65536, 65536 + w[-1], 65536 + 256 + min(31, len(w))):
                good, bad = sums.get(f, (0, 0))
                p = posterior[said[i]]
                sums[f] = (good + p * len(ws) ** -0.5, bad + (1 - p) * len(ws) ** -0.5)
    weights = fit_scorer(docs, posterior)
    goods, bads = (sum(s[k] for s in sums.values()) + len(weights) for k in (0, 1))
    for f, (good, bad) in sums.items():
        assert weights[f] == pytest.approx(max(-6, min(6, math.log((1 + good) / goods) - math.log((1 + bad) / bads))), abs=1e-6)

    got = {r["doc_id"]: r for r in score(docs).collect()}
    assert len(got) == len(texts)
    assert all(got[i]["weak_label"] == pytest.approx(posterior[said[i]], abs=1e-9) for i in got)
    assert all(got[i]["score"] == got[i]["weak_label"] for i in got if not words[i])
    mean = {i: sum(weights[f] for f in features(ws)) / len(ws) for i, ws in words.items() if ws}
    line = [(mean[i], math.log(got[i]["score"] / (1 - got[i]["score"]))) for i in mean]
    (x0, y0), (x1, y1) = min(line), max(line)
    slope = (y1 - y0) / (x1 - x0)
    assert slope > 0 and all(y == pytest.approx(y0 + slope * (x - x0), abs=1e-4) for x, y in line)  # one logistic curve of the sums
    a, k = y0 - slope * x0, slope
    loss = lambda a, k: sum(math.log1p(math.exp(-(a + k * mean[i]))) + (1 - posterior[said[i]]) * (a + k * mean[i]) for i in mean) + 0.05 * (a * a + k * k)
    assert all(loss(a, k) <= loss(a + da, k + dk) + 0.05 for da in (-0.5, 0, 0.5) for dk in (-0.5, 0, 0.5))
