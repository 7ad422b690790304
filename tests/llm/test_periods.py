import hashlib
import random
import zlib

import pytest

from stowage.llm.periods import RunCatcher, op12_periodic_runs, periodic_runs, runs_of, with_made_runs
import numpy as np


def brute(words):
    """Every run by trying every period."""
    n, least = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                least.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in least.items())


def made(kind, rng):
    alphabet = [b"w%d" % i for i in range(rng.choice([1, 2, 3, 50]))]
    words = [rng.choice(alphabet) for _ in range(rng.randrange(60))]
    for _ in range(kind):
        unit = [rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64, 100]))]
        n = rng.randrange(2, 5) * len(unit) + rng.randrange(len(unit) + 1) + rng.choice([0, 0, 24])
        words += (unit * (n // len(unit) + 1))[:n] + [rng.choice(alphabet) for _ in range(rng.randrange(9))]
    return words


@pytest.mark.parametrize("seed", range(60))
def test_equals_brute_force_for_any_stretch(seed):
    rng = random.Random(seed)
    words = made(seed % 6, rng)
    want = brute(words)
    for stretch in (1, 2, 5, 64, 1 << 16):
        assert runs_of(words, stretch) == want


def test_runs_are_known_while_words_come():
    catcher, unit = RunCatcher(), np.arange(10)
    for i in range(3):
        assert catcher.runs() == []
        catcher.append(unit)
    assert catcher.runs() == [(0, 30, 10)]
    catcher.append(unit[:4])
    assert catcher.runs() == [(0, 34, 10)]
    catcher.append(np.array([99]))
    catcher.append(unit)
    assert catcher.runs() == [(0, 34, 10)]


def test_exact_ratio_and_a_divisor_is_the_period():
    assert runs_of([b"a"] * 23) == [] and runs_of([b"a"] * 24) == [(0, 24, 1)]
    assert runs_of([b"a", b"b"] * 100) == [(0, 200, 2)]
    assert runs_of([b"%d" % (i % 8) for i in range(24)]) == [(0, 24, 8)] and runs_of([b"%d" % (i % 9) for i in range(26)]) == []
    assert runs_of([b"x"] * 30_000) == [(0, 30_000, 1)]


def test_long_texts_hold_few_hashes():
    rng = random.Random(1)
    words = np.array([rng.randrange(1 << 40) for _ in range(100_000)] * 3)
    catcher = RunCatcher()
    for i in range(0, len(words), 1000):
        catcher.append(words[i : i + 1000])
    assert catcher.runs() == [(0, 300_000, 100_000)]
    assert sum(map(len, catcher.hashes)) < 6 * len(words)


def expected(doc_id, text):
    """The row of the contract, word by word."""
    words = (text or "").encode().split()
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = None
    for s, m, q in runs:
        if best is None or m * best[2] > best[1] * q:
            best = (s, m, q)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_plain_python(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, b" ".join(made(rng.randrange(4), rng)).decode() or None) for i in range(150)]
    rows += [(i, "  \t lead w　ide " + " ".join(rng.choice("ab") for _ in range(300)) + "\n") for i in range(150, 260)]
    rows += [(None, "a " * 40), (None, None), (7, ""), (7, "a " * 40), (300, "\x1c \x85 " * 30)]
    spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, text string, runs string, best int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((expected(*r) for r in rows), key=repr)
    assert sum(1 for r in got if r[1]) > 30


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in op12_periodic_runs(spark, sf).collect())
    assert got == sorted(expected(*r) for r in rows)


def test_empty_table_and_text(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs(with_made_runs(docs)).count() == 0
    row = periodic_runs(spark.createDataFrame([("k", "b " + "a " * 30 + "c")], "key string, body string"), "body", "key").first()
    assert (row["key"], row["collapsed"], row["best"].asDict()) == ("k", "b a c", {"start": 1, "length": 30, "period": 1})
