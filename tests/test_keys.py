import pytest

from stowage.functions import keys as K

HELLO = "SHA256E-s5--2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824.txt"
GOLDEN = [
    ("hello", "txt", HELLO),
    ("test", "txt", "SHA256E-s4--9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08.txt"),
    ("file_content_1", "txt", "SHA256E-s14--f17ac4b5e53ad9ea8b33b4c7914abb234e57c281c13ba580098dbb5d10ae0884.txt"),
    ("file_content_2", "txt", "SHA256E-s14--92d7f552b54125f4a8076811c310c671a21b1538842f36afbda91ba7534f21d2.txt"),
    ("file_content_1", "", "SHA256E-s14--f17ac4b5e53ad9ea8b33b4c7914abb234e57c281c13ba580098dbb5d10ae0884"),
    ("file_content_1", None, "SHA256E-s14--f17ac4b5e53ad9ea8b33b4c7914abb234e57c281c13ba580098dbb5d10ae0884"),
    (None, "txt", None),
]


def test_golden_keys(spark):
    rows = spark.createDataFrame(GOLDEN, "content string, ext string, want string")
    assert all(r["file_key"] == r["want"] for r in K.content_keys(rows, "content", "ext").collect())
    again = K.content_keys_from_hash(K.parse_keys(rows.where("want is not null"), "want"), "size", "sha256", "ext")
    assert all(r["file_key"] == r["want"] for r in again.collect())
    binary = K.content_keys(rows.selectExpr("cast(content as binary) content", "ext", "want"), "content", "ext")
    assert all(r["file_key"] == r["want"] for r in binary.collect())


@pytest.mark.parametrize("key,want", [(HELLO, "091/de9"), (GOLDEN[1][2], "ec6/0b4")])
def test_shards(spark, key, want):
    row = spark.createDataFrame([(key,)], "file_key string")
    assert K.shard_paths(row).first()["path"] == f"{want}/{key}"
    assert K.shard_paths(row, legacy=True).first()["path"] == f"{want}/{key}/{key}"


def test_parse(spark):
    rows = spark.createDataFrame([(HELLO,), ("SHA256E-s5--short",), ("MD5-s1--x",), (None,), (HELLO[:-4] + ".tar.gz",)], "file_key string")
    got = [tuple(r)[1:] for r in K.parse_keys(rows).collect()]
    assert got[0] == ("SHA256E", 5, HELLO[12:76], "txt", True, True)
    assert got[1][4:] == (True, False) and got[2][4:] == (False, False) and got[3][4:] == (False, False)
    assert got[4][3] == "tar.gz"


def test_resolve_verify_and_size(spark):
    keys = spark.createDataFrame([(g[2], g[0]) for g in GOLDEN[:4]], "file_key string, content string")
    listing = K.shard_paths(keys.limit(1)).select("path").union(K.shard_paths(keys.where("content in ('hello', 'test')"), legacy=True).select("path"))
    got = {r["content"]: r["layout"] for r in K.resolve_paths(keys, listing).collect()}
    assert got == {"hello": "new", "test": "legacy", "file_content_1": "missing", "file_content_2": "missing"}
    altered = keys.selectExpr("file_key", "if(content = 'test', 'tesT', content) as content", "octet_length(content) + if(content = 'hello', 1, 0) as size")
    assert {r["content"]: r["verdict"] for r in K.verify_content(altered).collect()} == {"hello": "ok", "tesT": "mismatch", "file_content_1": "ok", "file_content_2": "ok"}
    assert {r["content"]: r["size_ok"] for r in K.check_size(altered).collect()} == {"hello": False, "tesT": True, "file_content_1": True, "file_content_2": True}


def test_extensions(spark):
    rows = spark.createDataFrame([("a/b.TXT",), ("x.tar.gz",), (".bashrc",), ("d.d/none",), ("end.",), (None,), ("p.jpegxl",)], "path string")
    assert [r["ext"] for r in K.with_extension(rows, "path").collect()] == ["TXT", "gz", None, None, None, None, "jpegxl"]
    assert K.with_extension(rows, "path", lower=True).first()["ext"] == "txt"
    assert K.filter_extension(K.with_extension(rows, "path")).count() == 6
