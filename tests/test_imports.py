import os

import pytest
from pyspark.sql import functions as F

from stowage.operators import crawl, importing, stores
from stowage.operators.spec import CRAWL, DatasetSpec, TableSpec
from stowage.sources.files import relative_to, scan_files, stream_files
from stowage.streaming.jobs import stream_insert_missing, stream_stats, stream_upsert

FILES = DatasetSpec("d", (TableSpec("files", ("path_key",)),))


def test_scan_and_import_directory(spark, tmp_path):
    root = tmp_path / "import_data"
    (root / "00" / "12").mkdir(parents=True)
    (root / "00" / "12" / "a.txt").write_text("hello")
    (root / "b.longext").write_text("x")
    (root / "c").write_text("test")
    files = relative_to(scan_files(spark, [str(root)]), str(tmp_path))
    rows, content = importing.import_files(files, lambda f: importing.directory_rows(f, "files", "https://prefix"), FILES, "u")
    got = {r["path_key"]: r["file_key"] for r in rows["files"].collect()}
    assert set(got) == {"https://prefix/import_data/00/12/a.txt", "https://prefix/import_data/c"}
    assert got["https://prefix/import_data/00/12/a.txt"].endswith("b9824.txt") and content.count() == 2
    with pytest.raises(Exception):
        scan_files(spark, [str(tmp_path / "absent")]).count()


def test_md5_names(spark):
    md5 = "591785b794601e212b260e25925636fd"
    names = [f"{md5}.e621.txt", f"{md5}.rule34.x.png", "short.e621.txt", f"{md5}.txt", f"{md5}.nowhere.txt"]
    rows = spark.createDataFrame([(f"d/{n}",) for n in names], "path string")
    got = [(r["url"], r["error"]) for r in importing.md5_name_urls(rows).collect()]
    assert got[0] == (f"https://static1.e621.net/data/59/17/{md5}.txt", None)
    assert got[1] == (f"https://r34i.paheal-cdn.net/59/17/{md5}", None)
    assert [e for _, e in got[2:]] == ["invalid md5", "invalid name", "unknown source"]
    assert importing.md5_name_rows(rows, "t").first()["path_key"] == md5


def test_crawl_layout(spark):
    paths = ["r/images/a/b/12_None.txt", "r/posts/a/b/7_2020_x.json", "r/image_metadata/a/b/8_d.json", "r/zzz/a/b/8_d.json", "r/images/a/b/word.txt", "x.txt"]
    got = [tuple(r)[1:] for r in importing.crawl_layout_rows(spark.createDataFrame([(p,) for p in paths], "path string"), "s").collect()]
    assert got[0] == ("submissions", "s", 12, "0", 1, None)
    assert got[1] == ("metadata", "s/posts", 7, "2020_x", None, None)
    assert got[2][:4] == ("metadata", "s", 8, "d")
    assert [g[-1] for g in got[3:]] == ["unknown table", "invalid name", "unknown table"]


def test_rejects_of_an_import_are_listed(spark):
    files = spark.createDataFrame([("r/images/a/b/5_None.txt", "x"), ("r/other/a/b/6_None.txt", "y"), ("r/images/a/b/7_None.toolong", "z"), ("skip/images/a/b/8_None.txt", "w")], "path string, content string")
    layout = lambda f: importing.crawl_layout_rows(f, "site")
    bad = importing.import_rejects(files, layout, CRAWL, F.startswith("path", F.lit("skip"))).collect()
    assert [(r["path"], r["reason"]) for r in bad] == [("r/other/a/b/6_None.txt", "no such table")]
    keyless = lambda f: importing.directory_rows(f, "files").withColumn("path_key", F.lit(None).cast("string"))
    assert {r["reason"] for r in importing.import_rejects(files.limit(1), keyless, FILES).collect()} == {"no key"}


def test_records_and_rejects(spark):
    df = spark.createDataFrame([("p", "hello", "txt"), ("q", "hello", "txt"), (None, "x", "")], "path_key string, body string, ext string")
    rows, content = stores.import_records(df, "body", "ext", FILES.tables[0], "u")
    assert rows.count() == 3 and content.count() == 2
    assert stores.import_records(df, "body", "ext")[0] is None
    good, bad = importing.require_keys(df, FILES.tables[0])
    assert (good.count(), bad.count()) == (2, 1)
    assert importing.skip_files(df, F.col("path_key") == "p").count() == 2 and importing.skip_files(df).count() == 3


def meta(spark, rows):
    return crawl.parsed(spark.createDataFrame(rows, "category string, subcategory string, json string"))


def shown(df):
    return [r["j"] for r in df.selectExpr("to_json(to_variant_object(fields)) as j").collect()]


def test_remove_and_reshape(spark):
    post = meta(spark, [("itaku", "post", '{"id":1,"num_likes":2,"folders":[{"t":1,"num_posts":3}],"gallery_images":[{"id":5,"num_likes":1,"folders":{"num_posts":1}}]}')])
    assert shown(crawl.reshape(post, "post")) == ['{"folders":[{"t":1}],"gallery_images":[{"folders":{},"id":5}],"id":1}']
    file = meta(spark, [("itaku", "post", '{"id":1,"_p":2,"category":"itaku","extension":"x","file":{"id":9,"num_likes":3,"extension":"png"}}')])
    assert shown(crawl.reshape(file, "file")) == ['{"_p":2,"category":"itaku","extension":"png","id":9}']
    weasyl = meta(spark, [("weasyl", "submission", '{"submitid":4,"views":1}'), ("pixiv", "user", '{"user":{"is_followed":true,"n":1},"id":"3"}'), ("ao3", "work", "not json")])
    assert shown(crawl.reshape(weasyl, "post")) == ['{"id":4}', '{"id":"3","user":{"n":1}}', "{}"]


def test_keys_of_each_source(spark):
    j = '{"id":3,"date":"d0","date_updated":"","date_added":"d1","date_edited":"d2","num":2}'
    rows = meta(spark, [(c, s, j) for c, s in (("itaku", "post"), ("itaku", "image"), ("furaffinity", "post"), ("ao3", "work"), ("pixiv", "user"), ("weasyl", "submission"))] + [("ao3", "tag", '{"id":3}')])
    got = [tuple(r["submission_key"]) for r in crawl.submission_keys(rows).collect()]
    assert got == [("itaku.ee/images", 3, "d2", 1)] * 2 + [("furaffinity.net", 3, "d0", 1), ("archiveofourown.org", 3, "d0", 1), ("pixiv.net", 3, "d0", 2), ("weasyl.com", 3, "d0", 1), ("archiveofourown.org", 3, "0", 1)]
    assert [r["post_key"] and r["post_key"]["source"] for r in crawl.post_keys(rows).collect()][:2] == ["itaku.ee", None]
    assert [r["file_metadata_key"] is not None for r in crawl.file_metadata_keys(rows).collect()] == [True, True, False, False, True, False, False]


def test_import_crawl_and_errors(spark):
    posts = spark.createDataFrame([("furaffinity", "post", '{"id":1,"date":"d","views":3,"_x":1,"b":2,"a":1}'), ("furaffinity", "user", "{}")], "category string, subcategory string, json string")
    rows, content = crawl.import_crawl(posts, posts.withColumn("file_key", F.lit("k")), "u")
    assert [r["content"] for r in content.collect()] == ['{"a":1,"b":2,"date":"d","id":1}\n']
    assert [tuple(r) for r in rows["submissions"].collect()] == [("u", "furaffinity.net", 1, "d", 1, "k")]
    assert rows["metadata"].count() == 1
    with pytest.raises(Exception, match="subcategory must be one of post"):
        crawl.check_source(posts).collect()
    known = crawl.flag_known(rows["submissions"].select("source", "id", "updated", "part"), rows["submissions"], CRAWL.table("submissions"), "u")
    assert known.first()["_skip"] == 1


def test_streams(spark, tmp_path):
    files = tmp_path / "files"
    files.mkdir()
    (files / "a.txt").write_text("hello")
    (files / "b.txt").write_text("test!")
    got = stream_files(spark, str(files), 1).writeStream.format("memory").queryName("files_seen").option("checkpointLocation", str(tmp_path / "c0")).trigger(availableNow=True).start()
    got.awaitTermination()
    assert sorted(r["size"] for r in spark.sql("select size from files_seen").collect()) == [5, 5]

    spark.sparkContext.setCheckpointDir(str(tmp_path / "shared"))
    source, spec, kind = tmp_path / "rows", TableSpec("t", ("path",)), "repo_uuid string, path string, file_key string, n int"
    seen = []
    for i, batch in enumerate(([("u", "p", "k1", 1), ("v", "p", "k2", 1)], [("u", "p", "k3", 2), ("u", "q", "k1", 2)])):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(kind).parquet(str(source))
        stream_upsert(stream, str(tmp_path / "inv"), spec, str(tmp_path / "c1"), ["n"], [lambda b, i: seen.append(b.count())]).awaitTermination()
        stream_insert_missing(stream.select("file_key", F.col("path").alias("content")), str(tmp_path / "content"), str(tmp_path / "c2")).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "inv")).select("repo_uuid", "path", "file_key").collect()} == {("u", "p", "k3"), ("u", "q", "k1"), ("v", "p", "k2")}
    assert seen == [2, 2] and sorted(r["file_key"] for r in spark.read.parquet(str(tmp_path / "content")).collect()) == ["k1", "k2", "k3"]
    stats = stream_stats(spark.readStream.schema(kind).parquet(str(source)).withColumn("size", F.col("n").cast("bigint")))
    stats.writeStream.format("memory").queryName("stats_seen").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.sql("select * from stats_seen").collect()} == {("u", 3, 5), ("v", 1, 1)}


def test_a_batch_with_other_columns_loses_no_rows(spark, tmp_path):
    spec, path, source = TableSpec("t", ("path",)), str(tmp_path / "inv"), tmp_path / "rows"
    batches = [("n int", [("u", "a", "k1", 1), ("u", "b", "k2", 1)]), ("n int, more string", [("u", "c", "k3", 2, "x")]), ("n int", [("u", "b", "k4", 3)])]
    for i, (extra, rows) in enumerate(batches):
        kind = f"repo_uuid string, path string, file_key string, {extra}"
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{source}/{i}")
        stream_upsert(spark.readStream.schema(kind).parquet(f"{source}/{i}"), path, spec, str(tmp_path / f"c{i}"), ["n"]).awaitTermination()
    got = spark.read.parquet(path).select("path", "file_key", "n", "more").collect()
    assert {tuple(r) for r in got} == {("a", "k1", 1, None), ("b", "k4", 3, None), ("c", "k3", 2, "x")}
    twice = spark.createDataFrame([(None, "nobody"), ("k", "c"), ("k", "c")], "file_key string, content string")
    twice.coalesce(1).write.parquet(f"{source}/keys")
    for i in range(2):
        stream = spark.readStream.schema(twice.schema).parquet(f"{source}/keys")
        stream_insert_missing(stream, str(tmp_path / "content"), str(tmp_path / f"k{i}")).awaitTermination()
    assert [r["file_key"] for r in spark.read.parquet(str(tmp_path / "content")).collect()] == ["k"]


def test_stored_content_is_one_file_a_folder(spark, tmp_path):
    """Many tasks add few files: those of 2,000 keys lie in 256 folders; a later batch lists its own folders and adds what is new."""
    rows = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("file_key"), F.concat(F.lit("bytes "), "id").alias("content"))
    rows.union(rows).repartition(8).write.parquet(f"{tmp_path}/in/0")
    rows.union(rows.select(F.lit("new"), F.lit("bytes"))).where("file_key in ('k1', 'k2', 'new')").write.parquet(f"{tmp_path}/in/1")
    for i, most in enumerate((256, 257)):
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/{i}")
        stream_insert_missing(stream, f"{tmp_path}/content", f"{tmp_path}/c{i}").awaitTermination()
        assert len([f for _, _, names in os.walk(tmp_path / "content") for f in names if f.endswith(".parquet")]) <= most
    got = spark.read.parquet(f"{tmp_path}/content").select("file_key", "content").collect()
    assert {tuple(r) for r in got} == {(f"k{i}", f"bytes {i}") for i in range(2000)} | {("new", "bytes")} and len(got) == 2001
    asked = spark.createDataFrame([("k7",), ("new",)], "file_key string")
    held = stores.stored_in_folders(spark, f"{tmp_path}/content", "file_key string, content string", asked)
    assert {"k7", "new"} <= {r["file_key"] for r in held.collect()} and held.select("folder").distinct().count() <= 2
