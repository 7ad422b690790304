import hashlib
import random
import struct

import pytest
import xxhash

from stowage.llm.syncmers import fingerprints, likeness, matches, op6_syncmer_fingerprints, shown, syncmers
from pyspark.sql import functions as F


def test_edited_text_and_neighbours(spark):
    rows = [(9, "nine ünïcode words here and more of it all"), (7, "seven"), (3, None), (5, ""), (7, "another seven with a much longer text than before"), (2, "two two"), (2, "two two"), (None, "nobody 12345678")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h long")
    got = fingerprints(docs).select("doc_id", "n_chars", "edited", shown("fp").alias("f"), likeness("fp", "edited_fp").alias("e"), likeness("fp", "next_fp").alias("x")).collect()
    assert len(got) == len(rows)
    assert sum(r["n_chars"] for r in got) == sum(len(r[1] or "") for r in rows)
    nine = next(r for r in got if r["doc_id"] == 9)
    text = rows[0][1]
    half = len(text) // 2
    sevens = [rows[1][1], rows[4][1]]
    assert nine["edited"] in [text[: len(text) - half] + s[:half] for s in sevens]
    five = next(r for r in got if r["doc_id"] == 5)
    assert (five["edited"], five["e"], five["x"]) == ("", 1.0, 1.0)  # the next one, 3, is empty too
    last = next(r for r in got if r["doc_id"] is None)
    assert last["edited"] == "nobody 1" + text[:7]  # around to the first
    assert {r["edited"] for r in got if r["doc_id"] == 2} == {"two nob"[:4] + "nob"}
    assert fingerprints(docs.where("false")).count() == 0
    alone = fingerprints(docs.where("doc_id = 9")).first()
    assert alone["edited"] == text[: len(text) - half] + text[:half]


def test_anchors_are_context_free(spark):
    passage = "p q r s t u v w x y z aa bb cc dd ee ff gg hh"
    a, b = f"one two three {passage}", f"{passage} four five six seven"
    rows = spark.createDataFrame([(1, a, b)], "doc_id long, a string, b string")
    left, right = (syncmers(rows.select("doc_id", F.col(c).alias("text"))).select("doc_id", F.col("anchors").alias(c)) for c in "ab")
    found = left.join(right, "doc_id").select(matches("a", "b").alias("m")).first()["m"]
    assert len(found) >= 4 and {m["left_pos"] - m["right_pos"] for m in found} == {3}


def test_equals_plain_python(spark):
    """Anchors against the definition, with Spark's own hash of words and numbers."""
    texts = ["a b", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w1 w2 w3 w4 w5", "x " * 50]
    for text, row in zip(texts, syncmers(spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("1 as doc_id", "text")).collect(), strict=True):
        words = text.split()
        if len(words) < 5:
            assert [a["pos"] for a in row["anchors"]] == [0]
            continue
        pairs = [(r["x"]) for r in spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(words, words[1:]))], "i int, a string, b string").selectExpr("i", "xxhash64(xxhash64(a), xxhash64(b)) as x").orderBy("i").collect()]
        want = [i for i in range(len(words) - 4) if pairs[i] == min(pairs[i : i + 4]) or pairs[i + 3] < min(pairs[i : i + 3])]
        assert [a["pos"] for a in row["anchors"]] == want


def test_long_text(spark):
    text = " ".join(f"w{i}" for i in range(30000))
    row = fingerprints(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).select("n_chars", likeness("fp", "next_fp").alias("x"), shown("fp").alias("f")).first()
    assert (row["n_chars"], row["x"], len(row["f"]), len(hashlib.sha256(b"").hexdigest())) == (len(text), 1.0, 512, 64)


def plain_fingerprint(text):
    """The 64 least anchor hashes, by the definition."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def mixed(*longs):
        seed = 42
        for x in longs:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", x), seed)
        return signed(seed)

    words = [signed(xxhash.xxh64_intdigest(w, 42)) for w in text.encode().split()]
    if len(words) < 5:
        seed = 42
        for w in words:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", w), seed)
        return [signed(seed) >> 32] if words else []
    inner = [mixed(a, b) for a, b in zip(words, words[1:])]
    anchors = {mixed(*inner[i : i + 4]) >> 32 for i in range(len(words) - 4) if inner[i] == min(inner[i : i + 4]) or inner[i + 3] < min(inner[i : i + 3])}
    return sorted(anchors)[:64]


def plain_likeness(a, b):
    union = sorted({*a, *b})[:64]
    common = len(set(a) & set(b) & set(union))
    return 2 * common / (len(union) + common) if union else 1.0


def test_whole_query_equals_plain_python(spark, tmp_path):
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choices("abcdeéü", k=4)) for _ in range(300)]
    texts = {i * 7: " ".join(rnd.choices(vocabulary, k=rnd.choice([0, 1, 3, 4, 5, 20, 150, 400]))) for i in range(60)}
    texts |= {1: None, 2: "", 8: texts[7], 15: "x" * 3000, 16: "\t one\ntwo  three\r\x0b\x0cfour five six"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op6_syncmer_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(texts, reverse=True)
    assert sorted(got, reverse=True) == order
    hexes = lambda f: "".join(f"{x & 0xFFFFFFFF:08X}" for x in f).lower()
    for i, following in zip(order, [*order[1:], order[0]], strict=True):
        text, after = texts[i] or "", texts[following] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, other = map(plain_fingerprint, (text, edited, after))
        row = got[i]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (row["fingerprint"].lower(), row["edited_fingerprint"].lower()) == (hexes(own), hexes(changed))
        assert (row["near_edited"], row["near_next"]) == (pytest.approx(plain_likeness(own, changed)), pytest.approx(plain_likeness(own, other)))
