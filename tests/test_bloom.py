import pytest
from pyspark.sql import functions as F

from stowage.operators import bloom, stores


def keys(spark, n, prefix="k"):
    return spark.range(n).select(F.concat(F.lit(prefix), "id").alias("file_key"))


@pytest.mark.parametrize("rate", [0.1, 0.01, 0.001])
def test_rate_is_held_and_no_key_denied(spark, rate):
    f = bloom.build(keys(spark, 20_000), rate)
    assert bloom.probe(keys(spark, 20_000), f).where("not maybe").count() == 0
    wrong = bloom.probe(keys(spark, 40_000, "other"), f).where("maybe").count() / 40_000
    assert wrong <= rate * 1.15 + 0.0003 and wrong >= rate / 4
    per_key, _ = bloom.sizing(rate)
    assert per_key < 1.3 * 1.45 * -__import__("math").log2(rate) + 1


def test_merged_stored_and_sized_for_more(spark, tmp_path):
    a, b = bloom.build(keys(spark, 3000), 0.01, 6000), bloom.build(keys(spark, 3000, "b"), 0.01, 6000)
    bloom.write(bloom.merge([a, b]), str(tmp_path))
    both = bloom.read(spark, str(tmp_path))
    assert (both.blocks, both.hashes) == (a.blocks, a.hashes)
    whole = bloom.build(keys(spark, 3000).union(keys(spark, 3000, "b")), 0.01)
    assert {tuple(r) for r in both.words.collect()} == {tuple(r) for r in whole.words.collect()}
    with pytest.raises(ValueError):
        bloom.merge([a, bloom.build(keys(spark, 10), 0.01)])


def test_nulls_repeats_and_empty_filters(spark):
    asked = spark.createDataFrame([("k1", 1), ("k1", 2), (None, 3), ("z", 4)], "file_key string, w0 int")
    none = bloom.build(keys(spark, 0))
    assert bloom.probe(asked, none).where("maybe").count() == 0
    got = {r["w0"]: r["maybe"] for r in bloom.probe(asked, bloom.build(keys(spark, 5).union(spark.createDataFrame([(None,)], "file_key string")))).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}
    for rate in (0, 1, 1e-30):
        with pytest.raises(ValueError):
            bloom.sizing(rate)


def test_layers_take_filters(spark):
    held, exact = keys(spark, 100), keys(spark, 10, "e")
    got = stores.possibly_exists(keys(spark, 200).union(exact), [exact, bloom.build(held, 0.001)], [True, False])
    n = {r["answer"]: r["count"] for r in got.groupBy("answer").count().collect()}
    assert n["yes"] == 10 and 100 <= n["maybe"] <= 103 and n["no"] >= 97
