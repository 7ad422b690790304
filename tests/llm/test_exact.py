import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from stowage.llm import exact
from stowage.llm.exact import OP11_SQL, exact_groups, op11_exact_dedup


def brute(rows):
    """id, keep_id, group_size, kept by row number."""
    groups = {}
    for i, (k, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append((k is None, k or 0, i))
    out = []
    for text, members in groups.items():
        keep = min(members)
        out += [(rows[i][0], rows[keep[2]][0], len(members), i == keep[2], hashlib.sha256(text.encode()).hexdigest()) for _, _, i in members]
    return sorted(out, key=repr)


def run(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, digest string, rid int").repartition(parts)
    got = exact_groups(docs, [F.sha2(exact.normalised("text").cast("binary"), 256).alias("h")])
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_against_brute_force(spark):
    random.seed(4)
    long = "word　ü " * 60_000
    rows = [(5, "a b"), (3, "a \t\n b"), (4, "a b"), (9, ""), (8, None), (7, " "), (6, "\n\n"), (1, long), (2, long + " "), (10, long[:-1] + "x"), (11, "a"), (12, "b")]
    rows += [(100 + i, random.choice(["x", "y"]) * 300 + random.choice("ab") * random.randrange(3)) for i in range(200)]
    random.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_repeated_and_null_ids(spark):
    rows = [(None, "t"), (None, "t"), (4, "t"), (4, "t"), (2, "s"), (2, "s"), (None, "only"), (None, "none"), (None, "none")]
    got = run(spark, rows)
    assert got == brute(rows)
    assert sum(r[3] for r in got) == 4


@pytest.mark.parametrize("lengths, prefixes, hot", [(1, 1, 1000), (3, 2, 2), (1 << 16, 1 << 20, 1)])
def test_slots_and_hot_groups_change_nothing(spark, monkeypatch, lengths, prefixes, hot):
    monkeypatch.setattr(exact, "LENGTHS", lengths)
    monkeypatch.setattr(exact, "PREFIXES", prefixes)
    monkeypatch.setattr(exact, "HOT", hot)
    rows = [(i, f"text {i % 37 if i % 3 else 0} " + "z" * (i % 5)) for i in range(300)]
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_plain_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_groups(docs).count() == 0
    assert exact_groups(docs).columns == ["doc_id", "keep_id", "group_size", "kept"]


def test_no_python_and_no_text_in_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    plan = exact_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "norm" not in plan


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet/*.parquet'" if __import__("os").path.isdir(f"{sf}/documents.parquet") else f"create view documents as select * from '{sf}/documents.parquet'")
    found = con.execute(OP11_SQL)
    names = [d[0] for d in found.description]
    got = op11_exact_dedup(spark, sf)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(found.fetchall())
