"""Registered queries over the given tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowage.functions import keys as K
from stowage.operators import bloom, crawl, diff, importing, inventory, move, stores
from stowage.operators.spec import DatasetSpec, TableSpec
from stowage.plans.fixtures import CATEGORIES, LINES, ORDERS, REPOS, SPEC, UUID, content, crawled, keyed, listing, order_versions, presence, repos, table, work_folder
from stowage.plans.fixtures import inventory as rows_of
from stowage.sources.files import relative_to, scan_files, stream_files
from stowage.streaming.jobs import stream_insert_missing, stream_stats, stream_upsert

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

A, B, C = UUID["a"], UUID["b"], UUID["c"]
PATHS = TableSpec("files", ("path_key",))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _key(text: str, ext: str = "lang") -> str:
    return f"'SHA256E-s' || strlen({text}) || '--' || sha256({text}) || '.' || {ext}"


_ALL = f"""k AS (SELECT source, doc_id, text, lang, strlen(text)::BIGINT AS size, {_key("text")} AS file_key FROM documents),
a AS (SELECT '{A}' AS repo_uuid, source, doc_id, text, size, file_key FROM k WHERE doc_id % 3 <> 0),
bt AS (SELECT source, doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 2 = 0),
b AS (SELECT '{B}' AS repo_uuid, source, doc_id, text, strlen(text)::BIGINT AS size, {_key("text")} AS file_key FROM bt),
c AS (SELECT '{C}' AS repo_uuid, source, doc_id, text, size, file_key FROM k WHERE doc_id % 5 = 0),
inv AS (SELECT repo_uuid, source, doc_id, file_key FROM a UNION ALL SELECT repo_uuid, source, doc_id, file_key FROM b UNION ALL SELECT repo_uuid, source, doc_id, file_key FROM c),
pres AS (SELECT DISTINCT repo_uuid, file_key, size FROM (SELECT repo_uuid, file_key, size FROM a UNION ALL SELECT repo_uuid, file_key, size FROM b UNION ALL SELECT repo_uuid, file_key, size FROM c)),
repos(name, uuid) AS (VALUES {", ".join(f"('{n}', '{u}')" for n, u in REPOS)})"""
_WITH = f"WITH {_ALL} "


# Content keys


@query(_WITH + f"SELECT doc_id, file_key, 'SHA256E-s' || size || '--' || sha256(text) AS plain_key, file_key AS listed_key FROM k")
def content_keys(spark, sf_dir):
    docs = K.content_keys(table(spark, sf_dir, "documents"), "text", "lang")
    docs = docs.withColumns({"plain_key": K.content_key("text"), "_n": F.octet_length("text"), "_h": F.sha2(F.col("text").cast("binary"), 256), "_k": F.col("file_key")})
    return K.content_keys_from_hash(docs, "_n", "_h", "lang").select("doc_id", F.col("_k").alias("file_key"), "plain_key", F.col("file_key").alias("listed_key"))


@query(_WITH + ", v AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN replace(file_key, 'SHA256E', 'MD5') WHEN doc_id % 10 = 1 THEN left(file_key, 40) ELSE file_key END AS file_key FROM k) SELECT doc_id, CASE WHEN doc_id % 10 > 1 THEN 'SHA256E' END AS scheme, CASE WHEN doc_id % 10 > 1 THEN regexp_extract(file_key, 's([0-9]+)--', 1)::BIGINT END AS size, CASE WHEN doc_id % 10 > 1 THEN regexp_extract(file_key, '--([0-9a-f]+)', 1) END AS sha256, CASE WHEN doc_id % 10 > 1 THEN split_part(file_key, '.', 2) END AS ext, starts_with(file_key, 'SHA256E-s') AS has_prefix, doc_id % 10 > 1 AS well_formed FROM v")
def parse_keys(spark, sf_dir):
    rows = keyed(spark, sf_dir, "all")
    other = F.when(F.col("doc_id") % 10 == 0, F.regexp_replace("file_key", "SHA256E", "MD5")).when(F.col("doc_id") % 10 == 1, F.left("file_key", F.lit(40))).otherwise(F.col("file_key"))
    return K.parse_keys(rows.withColumn("file_key", other).select("doc_id", "file_key")).drop("file_key")


@query(_WITH + "SELECT doc_id, doc_id % 6 <> 0 AS size_ok FROM k")
def check_size(spark, sf_dir):
    rows = keyed(spark, sf_dir, "all").withColumn("size", F.when(F.col("doc_id") % 6 == 0, F.col("size") - 1).otherwise(F.col("size")))
    return K.check_size(rows).select("doc_id", "size_ok")


@query(_WITH + "SELECT doc_id, left(md5(file_key), 3) AS p1, substr(md5(file_key), 4, 3) AS p2, left(md5(file_key), 3) || '/' || substr(md5(file_key), 4, 3) || '/' || file_key AS path FROM k")
def shard_paths(spark, sf_dir):
    return K.shard_paths(keyed(spark, sf_dir, "all").select("doc_id", "file_key")).drop("file_key")


@query(_WITH + ", d AS (SELECT file_key, min(doc_id) AS i, left(md5(file_key), 3) || '/' || substr(md5(file_key), 4, 3) || '/' || file_key AS p FROM k GROUP BY file_key) SELECT file_key, CASE i % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'legacy' ELSE 'missing' END AS layout, CASE i % 4 WHEN 0 THEN p WHEN 1 THEN p || '/' || file_key END AS path FROM d")
def resolve_paths(spark, sf_dir):
    ids = keyed(spark, sf_dir, "all").groupBy("file_key").agg(F.min("doc_id").alias("i"))
    new = K.shard_paths(ids.where("i % 4 = 0")).select("path")
    old = K.shard_paths(ids.where("i % 4 = 1"), legacy=True).select("path")
    return K.resolve_paths(ids.select("file_key"), new.union(old))


@query(_WITH + "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'mismatch' ELSE 'ok' END AS verdict FROM k")
def verify_content(spark, sf_dir):
    rows = keyed(spark, sf_dir, "all").withColumn("content", F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")))
    return K.verify_content(rows).select("doc_id", "verdict")


@query("SELECT page_id, nullif(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^.+[.]([^.]+)$', 1), '') AS ext FROM pages")
def with_extension(spark, sf_dir):
    return K.with_extension(table(spark, sf_dir, "pages"), "url").select("page_id", "ext")


@query("SELECT page_id FROM pages WHERE length(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^.+[.]([^.]+)$', 1)) <= 3")
def extension_filter(spark, sf_dir):
    return K.filter_extension(K.with_extension(table(spark, sf_dir, "pages"), "url"), 3).select("page_id")


# Inventories


@query("WITH l AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS repo_uuid, l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS n FROM l) SELECT repo_uuid, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r WHERE n = 1")
def upsert_lww(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("repo_uuid", F.when(F.col("l_orderkey") % 2 == 0, "even").otherwise("odd"))
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    early = rows.where("l_shipdate < '1995-01-01'")
    first = inventory.upsert(None, early.select("repo_uuid", *LINES.keys, *order), LINES, order)
    late = rows.where("l_shipdate >= '1995-01-01'").select("repo_uuid", *LINES.keys, *order)
    return inventory.upsert(first, late, LINES, order).select("repo_uuid", *LINES.keys, "l_partkey", "l_suppkey")


@query(_WITH + "SELECT file_key, source, doc_id FROM a WHERE source = 'src3' AND doc_id IN (SELECT doc_id FROM a WHERE source = 'src3')")
def read_rows_where(spark, sf_dir):
    return inventory.read_rows(rows_of(spark, sf_dir), SPEC, A, ["source=src3"])


@query(_WITH + "SELECT DISTINCT source, doc_id, file_key FROM inv WHERE repo_uuid = '0000000b' AND source = 'src8'")
def key_prefix_lookup(spark, sf_dir):
    inv = inventory.of_repo(rows_of(spark, sf_dir), B)
    return inv.where(inventory.key_predicate(SPEC, ["src8"])).select("source", "doc_id", "file_key").distinct()


@query("SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber < 3) AS has_row FROM orders")
def has_rows(spark, sf_dir):
    inv = table(spark, sf_dir, "lineitem").where("l_linenumber < 3").select(F.lit(A).alias("repo_uuid"), F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    spec = TableSpec("lines", ("o_orderkey", "l_linenumber"))
    return inventory.has_rows(table(spark, sf_dir, "orders").select("o_orderkey"), inv, spec, A)


@query(_WITH + "SELECT d.source, d.doc_id, a.file_key FROM documents d LEFT JOIN a ON a.source = d.source AND a.doc_id = d.doc_id")
def get_rows_by_key(spark, sf_dir):
    return inventory.get_rows_by_key(table(spark, sf_dir, "documents").select("source", "doc_id"), rows_of(spark, sf_dir), SPEC, A)


@query(_WITH + "SELECT repo_uuid, source, doc_id, file_key FROM inv WHERE repo_uuid <> '0000000a' UNION ALL SELECT repo_uuid, source, doc_id, file_key FROM a WHERE doc_id % 2 = 0")
def write_inventory(spark, sf_dir):
    """Three repositories are stored, then one is replaced by half of its rows."""
    path, inv = work_folder(spark), rows_of(spark, sf_dir)
    inventory.write_inventory(inv, path)
    inventory.write_inventory(inv.where(f"repo_uuid = '{A}' and doc_id % 2 = 0"), path)
    return inventory.read_inventory(spark, path, "source string, doc_id bigint, file_key string, repo_uuid string").select("repo_uuid", "source", "doc_id", "file_key")


@query("SELECT o_orderstatus, count(*) AS n_rows, bit_xor(('0x' || substr(md5(coalesce(o_orderstatus, '\\N') || '|' || o_orderkey), 1, 15))::BIGINT) AS print FROM orders GROUP BY o_orderstatus")
def fingerprint(spark, sf_dir):
    return inventory.fingerprint(table(spark, sf_dir, "orders"), ORDERS, ["o_orderstatus"])


# Differences and merges


@query(_WITH + "SELECT file_key, source, doc_id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.source = a.source AND b.doc_id = a.doc_id)")
def missing_rows(spark, sf_dir):
    return diff.missing_rows(keyed(spark, sf_dir, "a"), keyed(spark, sf_dir, "b"), SPEC)


_DIFF = "d AS (SELECT coalesce(a.source, b.source) AS source, coalesce(a.doc_id, b.doc_id) AS doc_id, b.file_key AS from_file_key, a.file_key AS to_file_key FROM b FULL JOIN a ON a.source = b.source AND a.doc_id = b.doc_id)"


@query(_WITH + f", {_DIFF} SELECT source, doc_id, CASE WHEN from_file_key IS NULL THEN 'added' WHEN to_file_key IS NULL THEN 'removed' ELSE 'modified' END AS diff_type, from_file_key, to_file_key FROM d WHERE from_file_key IS DISTINCT FROM to_file_key")
def diff_tables(spark, sf_dir):
    return diff.diff_tables(keyed(spark, sf_dir, "b"), keyed(spark, sf_dir, "a"), SPEC)


@query(_WITH + f", {_DIFF} SELECT coalesce(to_file_key, from_file_key) AS file_key, source, doc_id FROM d WHERE from_file_key IS NULL OR to_file_key IS NULL OR from_file_key = to_file_key")
def union_inventory(spark, sf_dir):
    return diff.union_inventory(keyed(spark, sf_dir, "a"), keyed(spark, sf_dir, "b"), SPEC, "report")


_MERGE = "base AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 11 <> 0), l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'L' ELSE o_orderstatus END AS s FROM base WHERE o_orderkey % 13 <> 0), r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'R' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 17 <> 0), m AS (SELECT o_orderkey, base.o_orderstatus AS base, l.s AS l, r.s AS r, CASE WHEN l.s IS NOT DISTINCT FROM r.s THEN 'same' WHEN l.s IS NOT DISTINCT FROM base.o_orderstatus THEN 'take_right' WHEN r.s IS NOT DISTINCT FROM base.o_orderstatus THEN 'take_left' ELSE 'conflict' END AS status FROM base FULL JOIN l USING (o_orderkey) FULL JOIN r USING (o_orderkey))"


@query(f"WITH {_MERGE} SELECT o_orderkey, base, l AS \"left\", r AS \"right\", CASE status WHEN 'take_right' THEN r WHEN 'conflict' THEN NULL ELSE l END AS merged, status FROM m")
def merge_tables(spark, sf_dir):
    return diff.merge_status(*order_versions(spark, sf_dir), ORDERS)


@query(f"WITH {_MERGE} SELECT o_orderkey, CASE status WHEN 'take_right' THEN r ELSE l END AS o_orderstatus FROM m WHERE status <> 'conflict' AND CASE status WHEN 'take_right' THEN r ELSE l END IS NOT NULL")
def merged_rows(spark, sf_dir):
    return diff.merge_tables(*order_versions(spark, sf_dir), ORDERS, "report")[0]


@query(f"WITH {_MERGE} SELECT count(*) > 0 AS aborted FROM m WHERE status = 'conflict'")
def merge_abort(spark, sf_dir):
    """Whether a merge that must not meet conflicts is refused."""
    try:
        diff.merge_tables(*order_versions(spark, sf_dir), ORDERS)
        aborted = False
    except diff.MergeConflict:
        aborted = True
    return table(spark, sf_dir, "orders").limit(1).select(F.lit(aborted).alias("aborted"))


@query(f"WITH {_MERGE} SELECT o_orderkey, base, l AS \"left\", r AS \"right\" FROM m WHERE status = 'conflict'")
def merge_conflicts(spark, sf_dir):
    return diff.conflicts(*order_versions(spark, sf_dir), ORDERS)


@query(_WITH + f", {_DIFF} SELECT to_file_key AS file_key, source, doc_id FROM d WHERE from_file_key IS NULL AND source = 'src7' ORDER BY source, doc_id LIMIT 10")
def diff_keys_where_limit(spark, sf_dir):
    return diff.diff_keys(keyed(spark, sf_dir, "a"), keyed(spark, sf_dir, "b"), SPEC, where=["source=src7"], limit=10, on_conflict="report")


# Transfers

_PLAN = f"{_DIFF}, p AS (SELECT d.to_file_key AS file_key, d.source, d.doc_id, CASE WHEN from_file_key IS NOT NULL THEN 'conflict' WHEN EXISTS (SELECT 1 FROM b WHERE b.file_key = d.to_file_key) THEN 'record_only' WHEN d.to_file_key IN (SELECT file_key FROM a WHERE doc_id % 50 = 1) THEN '{{0}}' ELSE 'copy' END AS status FROM d WHERE to_file_key IS NOT NULL AND from_file_key IS DISTINCT FROM to_file_key)"


def _plan(spark, sf_dir, lost, **options):
    stores_of = presence(spark, sf_dir, "ab", lost)
    src, dst = (stores_of.where(F.col("repo_uuid") == u) for u in (A, B))
    return move.move_plan(keyed(spark, sf_dir, "a"), keyed(spark, sf_dir, "b"), src, dst, SPEC, on_conflict="report", **options)


@query(_WITH + ", " + _PLAN.format("copy") + " SELECT file_key, source, doc_id, status FROM p")
def move_plan(spark, sf_dir):
    return _plan(spark, sf_dir, False)


@query(_WITH + ", " + _PLAN.format("skipped_missing") + " SELECT file_key, source, doc_id, status FROM p")
def move_plan_missing(spark, sf_dir):
    return _plan(spark, sf_dir, True, ignore_missing=True)


@query(_WITH + ", " + _PLAN.format("error_missing") + " SELECT status, count(*) AS n_files FROM p GROUP BY status")
def move_summary(spark, sf_dir):
    return move.move_summary(_plan(spark, sf_dir, True))


@query(_WITH + ", " + _PLAN.format("copy") + f" SELECT '{B}' AS repo_uuid, source, doc_id, file_key FROM b UNION ALL SELECT '{B}', source, doc_id, file_key FROM p WHERE status <> 'conflict'")
def pull_apply(spark, sf_dir):
    rows, _, _ = move.move_dataset(DatasetSpec("d", (SPEC,)), {"documents": rows_of(spark, sf_dir, "ab")}, A, B, content(spark, sf_dir, "a"), content(spark, sf_dir, "b"), on_conflict="report")
    return inventory.of_repo(rows["documents"], B)


@query(_WITH + ", " + _PLAN.format("copy") + " SELECT file_key, content FROM (SELECT DISTINCT file_key, text AS content FROM b UNION SELECT DISTINCT p.file_key, a.text FROM p JOIN a ON a.file_key = p.file_key WHERE status = 'copy')")
def push_apply(spark, sf_dir):
    """Content of the destination store after a push."""
    _, store, _ = move.move_dataset(DatasetSpec("d", (SPEC,)), {"documents": rows_of(spark, sf_dir, "ab")}, A, B, content(spark, sf_dir, "a"), content(spark, sf_dir, "b"), on_conflict="report")
    return store


# Locating


@query(_WITH + ", q AS (SELECT DISTINCT file_key FROM a UNION SELECT 'SHA256E-s0--unknown') SELECT q.file_key, '[' || coalesce(string_agg('{\"name\":\"' || r.name || '\",\"uuid\":\"' || r.uuid || '\"}', ',' ORDER BY r.name), '') || ']' AS repos FROM q LEFT JOIN pres p ON p.file_key = q.file_key LEFT JOIN repos r ON r.uuid = p.repo_uuid GROUP BY q.file_key")
def whereis(spark, sf_dir):
    asked = keyed(spark, sf_dir, "a").select("file_key").union(spark.createDataFrame([("SHA256E-s0--unknown",)], "file_key string"))
    return stores.whereis(asked, presence(spark, sf_dir), repos(spark)).withColumn("repos", F.to_json("repos"))


@query(_WITH + f"SELECT k.doc_id, k.file_key, p.size, p.size IS NOT NULL AS \"exists\" FROM k LEFT JOIN pres p ON p.file_key = k.file_key AND p.repo_uuid = '{B}'")
def stat_keys(spark, sf_dir):
    return stores.stat_keys(keyed(spark, sf_dir, "all").select("doc_id", "file_key"), presence(spark, sf_dir), B)


@query(_WITH + "SELECT repo_uuid, count(*) AS n_files, sum(size)::BIGINT AS total_bytes FROM pres GROUP BY repo_uuid")
def store_stats(spark, sf_dir):
    return stores.store_stats(presence(spark, sf_dir))


@query(_WITH + ", n AS (SELECT count(*) AS n_all FROM (SELECT DISTINCT source, doc_id FROM inv)) SELECT repo_uuid, count(*) AS n_held, any_value(n_all) AS n_all, count(*) / any_value(n_all) AS share, CASE WHEN count(*) = any_value(n_all) THEN 'total' ELSE 'partial' END AS copy FROM (SELECT DISTINCT repo_uuid, source, doc_id FROM inv), n GROUP BY repo_uuid")
def coverage(spark, sf_dir):
    return stores.coverage(rows_of(spark, sf_dir), SPEC)


@query(_WITH + "SELECT file_key, count(DISTINCT repo_uuid) AS n_repos FROM pres GROUP BY file_key")
def replica_counts(spark, sf_dir):
    return stores.replica_counts(presence(spark, sf_dir))


@query(_WITH + "SELECT file_key, count(*) AS n_rows FROM inv GROUP BY file_key HAVING count(*) > 1")
def shared_keys(spark, sf_dir):
    return stores.shared_keys(rows_of(spark, sf_dir))


@query("SELECT strlen(text)::BIGINT AS size, sha256(text) AS sha256, 'md,txt' AS exts FROM documents GROUP BY text HAVING count(DISTINCT doc_id % 2) = 2")
def extension_variants(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("ext", F.when(F.col("doc_id") % 2 == 0, "txt").otherwise("md"))
    return stores.extension_variants(K.content_keys(docs, "text", "ext")).withColumn("exts", F.array_join("exts", ","))


# Stores


@query(_WITH + "SELECT file_key, size, min(layer)::INT AS layer FROM (SELECT file_key, size, 0 AS layer FROM a UNION ALL SELECT file_key, size, 1 FROM b UNION ALL SELECT file_key, size, 2 FROM c) GROUP BY file_key, size")
def layered_read(spark, sf_dir):
    return stores.layered_read([presence(spark, sf_dir, r).select("file_key", "size") for r in "abc"])


@query(_WITH + "SELECT doc_id, file_key IN (SELECT file_key FROM b UNION SELECT file_key FROM c) AS \"exists\" FROM k")
def layered_exists(spark, sf_dir):
    asked = keyed(spark, sf_dir, "all").select("doc_id", "file_key")
    return stores.layered_exists(asked, [presence(spark, sf_dir, r) for r in "bc"]).select("doc_id", "exists")


def bloom_sql(of: str, n: str, asked: str) -> str:
    """Common tables of a filter of the keys in `of`, sized for n keys: `maybe` has those keys of `asked` that it may hold."""
    per_key, hashes = bloom.sizing(0.01)
    bits = f"SELECT DISTINCT file_key, ('0x' || substr(sha256(file_key), 1, 15))::BIGINT % blocks AS block, ('0x' || substr(sha256(file_key), (17 + 3 * i)::INT, 3))::BIGINT % {bloom.BITS} AS bit FROM {{}} q, size_of, range({hashes}) r(i)"
    return f"""size_of AS (SELECT greatest(1, ceil({n} * {per_key} / {bloom.BITS}))::BIGINT AS blocks),
held AS (SELECT DISTINCT block, bit FROM ({bits.format(of)})), asked_bits AS ({bits.format(asked)}),
maybe AS (SELECT a.file_key FROM asked_bits a LEFT JOIN held h ON h.block = a.block AND h.bit = a.bit GROUP BY a.file_key HAVING bool_and(h.bit IS NOT NULL))"""


@query(_WITH + ", " + bloom_sql("c", "(SELECT count(DISTINCT file_key) FROM c)", "k") + " SELECT k.doc_id, CASE WHEN k.file_key IN (SELECT file_key FROM b) THEN 'yes' WHEN k.file_key IN (SELECT file_key FROM maybe) THEN 'maybe' ELSE 'no' END AS answer FROM k")
def possibly_exists(spark, sf_dir):
    asked = keyed(spark, sf_dir, "all").select("doc_id", "file_key")
    return stores.possibly_exists(asked, [presence(spark, sf_dir, r) for r in "bc"], [True, False]).select("doc_id", "answer")


@query(_WITH + "SELECT DISTINCT file_key, text AS content FROM (SELECT file_key, text FROM b UNION ALL SELECT file_key, text FROM a)")
def insert_missing(spark, sf_dir):
    return stores.insert_missing(content(spark, sf_dir, "b"), content(spark, sf_dir, "a"), "ignore")


@query(_WITH + "SELECT DISTINCT file_key, text AS content FROM (SELECT file_key, text FROM c UNION ALL SELECT file_key, text FROM a WHERE file_key IN (SELECT file_key FROM k WHERE doc_id % 4 = 0))")
def copy_keys(spark, sf_dir):
    listed = keyed(spark, sf_dir, "all").where("doc_id % 4 = 0").select("file_key")
    return stores.copy_keys(listed, content(spark, sf_dir, "a"), content(spark, sf_dir, "c"))


@query(_WITH + "SELECT k.doc_id, c.text AS content, c.text IS NOT NULL AS found FROM k LEFT JOIN (SELECT DISTINCT file_key, text FROM c) c ON c.file_key = k.file_key")
def read_content(spark, sf_dir):
    asked = keyed(spark, sf_dir, "all").select("doc_id", "file_key")
    got = stores.read_content(content(spark, sf_dir, "c"), asked.select("file_key").distinct(), "report")
    return asked.join(got, "file_key").select("doc_id", "content", "found")


@query(_WITH + "SELECT DISTINCT file_key, text AS content, left(md5(file_key), 3) AS p1 FROM c")
def write_content(spark, sf_dir):
    path = work_folder(spark)
    stores.write_content(content(spark, sf_dir, "c"), path)
    return spark.read.schema("file_key string, content string, p1 string").parquet(path).drop("folder")


@query(_WITH + f"SELECT '{A}' AS repo_uuid, source, doc_id, file_key FROM k")
def import_records(spark, sf_dir):
    return stores.import_records(table(spark, sf_dir, "documents"), "text", "lang", SPEC, A)[0]


# Files


def written_files(spark, sf_dir):
    """A folder with a text file for each page and task, written by Spark."""
    path = work_folder(spark)
    pages = table(spark, sf_dir, "pages").select(F.concat_ws(" ", F.col("page_id").cast("string"), F.md5(F.col("html").cast("binary"))).alias("value"), (F.col("page_id") % 7).alias("part"))
    pages.repartition("part").write.partitionBy("part").text(path)
    return path


def _lines(files):
    """The lines of files and their folder."""
    line = F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")
    rows = files.select(F.regexp_extract("path", "/part=([0-9]+)/", 1).cast("int").alias("part"), (F.octet_length("content") == F.col("size")).alias("whole"), line).where("line <> ''")
    return rows.select("part", "whole", F.split("line", " ")[0].cast("bigint").alias("page_id"), F.split("line", " ")[1].alias("digest"))


_FILES = "SELECT (page_id % 7)::INT AS part, true AS whole, page_id, md5(html) AS digest FROM pages"


@query(_FILES)
def scanned_files(spark, sf_dir):
    return _lines(scan_files(spark, [written_files(spark, sf_dir)]))


@query(_FILES)
def streamed_files(spark, sf_dir):
    path, out = written_files(spark, sf_dir), work_folder(spark)
    stream = _lines(stream_files(spark, path, 3))
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


# Imports


@query(f"WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path, html FROM pages), e AS (SELECT path, html, regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+[.]([^.]+)$', 1) AS ext FROM p), f AS (SELECT 'https://prefix/' || path AS path_key, max('SHA256E-s' || strlen(html) || '--' || sha256(html) || CASE WHEN ext = '' THEN '' ELSE '.' || ext END) AS file_key FROM e WHERE length(ext) <= 5 AND path NOT LIKE '%/fr/%' GROUP BY path) SELECT '{A}' AS repo_uuid, path_key, file_key FROM f")
def import_directory(spark, sf_dir):
    files = relative_to(listing(spark, sf_dir, "pages").withColumn("path", F.concat(F.lit("file:/scan/root/"), "path")), "/scan/root")
    rows, _ = importing.import_files(files, lambda f: importing.directory_rows(f, "files", "https://prefix"), DatasetSpec("d", (PATHS,)), A, F.contains("path", F.lit("/fr/")))
    return rows["files"]


@query(f"SELECT '{A}' AS repo_uuid, md5(text) AS path_key, max({_key('text')}) AS file_key FROM documents GROUP BY md5(text)")
def import_md5_name(spark, sf_dir):
    rows, _ = importing.import_files(listing(spark, sf_dir, "md5"), lambda f: importing.md5_name_rows(f, "files"), DatasetSpec("d", (PATHS,)), A)
    return rows["files"]


@query("""WITH m AS (SELECT md5(text) AS m, lang, ['e621', 'Gelbooru', 'rule34', 'e6ai', 'danbooru.donmai.us', 'other'][doc_id % 6 + 1] AS s FROM documents)
SELECT 'in/' || m || '.' || s || '.' || lang AS path, CASE WHEN s = 'other' THEN 'unknown source' END AS error,
CASE s WHEN 'e621' THEN 'https://static1.e621.net/data/' WHEN 'Gelbooru' THEN 'https://img3.gelbooru.com/images/' WHEN 'rule34' THEN 'https://r34i.paheal-cdn.net/' WHEN 'e6ai' THEN 'https://static1.e6ai.net/data/' WHEN 'danbooru.donmai.us' THEN 'https://cdn.donmai.us/original/' END || left(m, 2) || '/' || substr(m, 3, 2) || '/' || m || CASE WHEN s = 'rule34' THEN '' ELSE '.' || lang END AS url FROM m""")
def md5_name_urls(spark, sf_dir):
    return importing.md5_name_urls(listing(spark, sf_dir, "md5")).drop("content")


_CRAWL_LAYOUT = "p AS (SELECT doc_id, text, ['images', 'image_metadata', 'posts', 'other'][doc_id % 4 + 1] AS g FROM documents)"


@query(f"WITH {_CRAWL_LAYOUT} SELECT doc_id AS id, CASE WHEN g = 'images' THEN 'submissions' WHEN g <> 'other' THEN 'metadata' END AS \"table\", CASE WHEN g = 'posts' THEN 'site/posts' ELSE 'site' END AS source, CASE WHEN doc_id % 3 = 0 THEN '0' ELSE '2020-01-02 03_04' END AS updated, CASE WHEN g = 'images' THEN 1 END AS part, CASE WHEN g = 'other' THEN 'unknown table' END AS error FROM p")
def crawl_layout_rows(spark, sf_dir):
    return importing.crawl_layout_rows(listing(spark, sf_dir, "layout"), "site").drop("path", "content")


@query(f"WITH {_CRAWL_LAYOUT} SELECT '{A}' AS repo_uuid, CASE WHEN g = 'posts' THEN 'site/posts' ELSE 'site' END AS source, doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN '0' ELSE '2020-01-02 03_04' END AS updated, {_key('text', "'txt'")} AS file_key FROM p WHERE g IN ('image_metadata', 'posts')")
def import_crawl_layout(spark, sf_dir):
    rows, _ = importing.import_files(listing(spark, sf_dir, "layout"), lambda f: importing.crawl_layout_rows(f, "site"), crawl.CRAWL, A)
    return rows["metadata"]


@query(f"WITH {_CRAWL_LAYOUT} SELECT '{A}' AS repo_uuid, 'site' AS source, doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN '0' ELSE '2020-01-02 03_04' END AS updated, 1 AS part, {_key('text', "'txt'")} AS file_key FROM p WHERE g = 'images'")
def import_crawl_layout_submissions(spark, sf_dir):
    rows, _ = importing.import_files(listing(spark, sf_dir, "layout"), lambda f: importing.crawl_layout_rows(f, "site"), crawl.CRAWL, A)
    return rows["submissions"]


@query(f"""WITH {_CRAWL_LAYOUT} SELECT 'root/' || g || '/a/b/' || doc_id || '_' || CASE WHEN doc_id % 3 = 0 THEN 'None' ELSE '2020-01-02 03_04' END || '.txt' AS path, NULL::VARCHAR AS "table", {_key('text', "'txt'")} AS file_key, 'no such table' AS reason FROM p WHERE g = 'other'""")
def import_crawl_layout_rejects(spark, sf_dir):
    return importing.import_rejects(listing(spark, sf_dir, "layout"), lambda f: importing.crawl_layout_rows(f, "site"), crawl.CRAWL)


# Crawled metadata

_J = """j AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS later, strftime(o_orderdate + INTERVAL 2 DAY, '%Y-%m-%d') AS added, strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') AS of_file, ['itaku', 'furaffinity', 'ao3', 'pixiv', 'weasyl'][o_orderkey % 5 + 1] AS category,
CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'post' ELSE 'image' END WHEN 1 THEN 'post' WHEN 2 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'tag' ELSE 'work' END WHEN 3 THEN 'artworks' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'journal' ELSE 'submission' END END AS subcategory FROM orders)"""
_NAMES = "['_private', 'comments', 'date', 'date_added', 'date_updated', 'favorites', 'file', 'folders', 'id', 'num', 'num_likes', 'submitid', 'subcategory', 'title', 'total_view', 'user', 'views']"
_GONE = "CASE category WHEN 'itaku' THEN ['num_likes'] WHEN 'furaffinity' THEN ['comments', 'favorites', 'views'] WHEN 'ao3' THEN ['comments', 'views'] WHEN 'pixiv' THEN ['total_view'] ELSE ['comments', 'favorites', 'views'] END"


def _names():
    return F.array_join(F.array_sort(F.map_keys("fields")), ",")


@query(f"WITH {_J} SELECT o_orderkey, CASE WHEN subcategory = 'journal' THEN 'subcategory must be one of submission' END AS error FROM j")
def check_source(spark, sf_dir):
    return crawl.check_source(crawled(spark, sf_dir), on_error="rejects").select("o_orderkey", "error")


@query(f"WITH {_J} SELECT o_orderkey, array_to_string(list_filter(list_sort({_NAMES}), lambda x: NOT starts_with(x, '_') AND x <> 'subcategory' AND NOT list_contains({_GONE}, x)), ',') AS names FROM j")
def exclude_fields(spark, sf_dir):
    return crawl.exclude_fields(crawl.parsed(crawled(spark, sf_dir))).select("o_orderkey", _names().alias("names"))


@query(f"""WITH {_J} SELECT o_orderkey, array_to_string(list_filter(list_sort({_NAMES}), lambda x: NOT list_contains({_GONE}, x)), ',') AS names,
CASE WHEN category = 'itaku' THEN '[{{"title":"f"}},{{"title":"g"}}]' ELSE '[{{"num_posts":4,"title":"f"}},{{"num_posts":5,"title":"g"}}]' END AS folders, CASE WHEN category = 'pixiv' THEN '{{"name":"u"}}' ELSE '{{"is_followed":false,"name":"u"}}' END AS user FROM j""")
def remove_fields(spark, sf_dir):
    rows = crawl.remove_fields(crawl.parsed(crawled(spark, sf_dir)))
    return rows.select("o_orderkey", _names().alias("names"), F.expr("to_json(fields['folders'])").alias("folders"), F.expr("to_json(fields['user'])").alias("user"))


@query(f"""WITH {_J} SELECT o_orderkey, CASE WHEN category = 'itaku' AND subcategory = 'post' THEN '_private,date_added,extension,id,subcategory'
ELSE array_to_string(list_filter(list_sort({_NAMES}), lambda x: NOT list_contains({_GONE}, x) AND NOT (category = 'weasyl' AND x = 'submitid')), ',') END AS names FROM j""")
def reshape(spark, sf_dir):
    return crawl.reshape(crawl.parsed(crawled(spark, sf_dir)), "file").select("o_orderkey", _names().alias("names"))


_WHEN_POST = "CASE WHEN category = 'itaku' THEN added WHEN category = 'ao3' AND o_orderkey % 6 <> 0 THEN later ELSE day END"
_WHEN_FILE = f"CASE WHEN category = 'itaku' AND subcategory = 'post' THEN of_file ELSE {_WHEN_POST} END"


@query(f"WITH {_J} SELECT o_orderkey, CASE category WHEN 'itaku' THEN 'itaku.ee/images' WHEN 'furaffinity' THEN 'furaffinity.net' WHEN 'ao3' THEN 'archiveofourown.org' WHEN 'pixiv' THEN 'pixiv.net' ELSE 'weasyl.com' END AS source, o_orderkey AS id, {_WHEN_FILE} AS updated, CASE WHEN category = 'pixiv' THEN 2 ELSE 1 END AS part FROM j")
def submission_keys(spark, sf_dir):
    rows = crawl.submission_keys(crawl.reshape(crawl.parsed(crawled(spark, sf_dir)), "file"))
    return rows.select("o_orderkey", "submission_key.*")


@query(f"WITH {_J} SELECT o_orderkey, CASE category WHEN 'itaku' THEN 'itaku.ee' WHEN 'furaffinity' THEN 'furaffinity.net' WHEN 'ao3' THEN 'archiveofourown.org' WHEN 'pixiv' THEN 'pixiv.net' ELSE 'weasyl.com' END AS source, o_orderkey AS id, {_WHEN_POST} AS updated FROM j WHERE category <> 'itaku' OR subcategory = 'post'")
def post_keys(spark, sf_dir):
    rows = crawl.post_keys(crawl.reshape(crawl.parsed(crawled(spark, sf_dir)), "post"))
    return rows.where("post_key is not null").select("o_orderkey", "post_key.*")


@query(f"WITH {_J} SELECT o_orderkey, CASE category WHEN 'itaku' THEN 'itaku.ee/images' ELSE 'pixiv.net' END AS source, o_orderkey AS id, {_WHEN_FILE} AS updated FROM j WHERE category IN ('itaku', 'pixiv')")
def file_metadata_keys(spark, sf_dir):
    rows = crawl.file_metadata_keys(crawl.reshape(crawl.parsed(crawled(spark, sf_dir)), "file"))
    return rows.where("file_metadata_key is not null").select("o_orderkey", "file_metadata_key.*")


_CONTENT = """'{' || CASE WHEN category IN ('itaku', 'pixiv') THEN '"comments":3,' ELSE '' END || '"date":"' || day || '","date_added":"' || added || '","date_updated":"' || CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE later END || '",'
|| CASE WHEN category IN ('itaku', 'ao3', 'pixiv') THEN '"favorites":1,' ELSE '' END || '"file":{"date_added":"' || of_file || '","extension":"png","id":' || o_orderkey || ',"num_likes":1},"folders":'
|| CASE WHEN category = 'itaku' THEN '[{"title":"f"},{"title":"g"}]' ELSE '[{"num_posts":4,"title":"f"},{"num_posts":5,"title":"g"}]' END || ',"id":' || o_orderkey || ',"num":2,'
|| CASE WHEN category <> 'itaku' THEN '"num_likes":5,' ELSE '' END || CASE WHEN category <> 'weasyl' THEN '"submitid":' || o_orderkey || ',' ELSE '' END || '"title":"t' || o_orderkey || '",'
|| CASE WHEN category <> 'pixiv' THEN '"total_view":9,' ELSE '' END || '"user":' || CASE WHEN category = 'pixiv' THEN '{"name":"u"}' ELSE '{"is_followed":false,"name":"u"}' END
|| CASE WHEN category IN ('itaku', 'pixiv') THEN ',"views":7' ELSE '' END || '}' || chr(10)"""


@query(f"WITH {_J}, t AS (SELECT o_orderkey, {_CONTENT} AS content FROM j) SELECT o_orderkey, content, {_key('content', "'json'")} AS file_key FROM t")
def metadata_content(spark, sf_dir):
    rows = crawl.metadata_content(crawl.reshape(crawl.parsed(crawled(spark, sf_dir)), "post"))
    return rows.select("o_orderkey", "content", "file_key")


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 1 END AS _skip FROM orders")
def flag_known(spark, sf_dir):
    inv = table(spark, sf_dir, "lineitem").select(F.lit(A).alias("repo_uuid"), F.col("l_orderkey").alias("o_orderkey"))
    return crawl.flag_known(table(spark, sf_dir, "orders").select("o_orderkey"), inv, ORDERS, A)


def _source(itaku: str) -> str:
    return f"CASE category WHEN 'itaku' THEN '{itaku}' WHEN 'furaffinity' THEN 'furaffinity.net' WHEN 'ao3' THEN 'archiveofourown.org' WHEN 'pixiv' THEN 'pixiv.net' ELSE 'weasyl.com' END"


def _crawled_sql(files: str = "") -> str:
    """Metadata rows of all sources; files: a further condition on the files' records."""
    of_file = """CASE WHEN subcategory = 'post' AND category = 'itaku' THEN '{"date_added":"' || of_file || '","extension":"png","id":' || o_orderkey || '}' || chr(10) ELSE content END"""
    return f"""WITH {_J}, t AS (SELECT *, {_CONTENT} AS content FROM j WHERE subcategory <> 'journal'),
p AS (SELECT {_source('itaku.ee')} AS source, o_orderkey AS id, {_WHEN_POST} AS updated, content FROM t WHERE category <> 'itaku' OR subcategory = 'post'),
f AS (SELECT {_source('itaku.ee/images')} AS source, o_orderkey AS id, {_WHEN_FILE} AS updated, {of_file} AS content FROM t WHERE category IN ('itaku', 'pixiv'){files})
SELECT '{A}' AS repo_uuid, source, id, updated, {_key('content', "'json'")} AS file_key FROM (SELECT * FROM p UNION ALL SELECT * FROM f)"""


@query(_crawled_sql())
def import_crawl(spark, sf_dir):
    return crawl.import_crawl(*_records(spark, sf_dir), A)[0]["metadata"]


def _held(spark, sf_dir):
    """An inventory of submissions that has every third order, and others under another repository."""
    _, files = _records(spark, sf_dir)
    rows = crawl.import_crawl(files, files, A)[0]["submissions"]
    return rows.where("id % 3 = 0").union(rows.where("id % 3 = 1").withColumn("repo_uuid", F.lit(B)))


@query(_crawled_sql(" AND o_orderkey % 3 <> 0"))
def import_crawl_again(spark, sf_dir):
    """Metadata where some submissions are held already."""
    return crawl.import_crawl(*_records(spark, sf_dir), A, _held(spark, sf_dir))[0]["metadata"]


_RECORD = """'{"id":' || o_orderkey || ',"submitid":' || o_orderkey || ',"num":2,"date":"' || day || '","date_updated":"' || CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE later END || '","date_added":"' || added
|| '","title":"t' || o_orderkey || '","views":7,"comments":3,"num_likes":5,"total_view":9,"favorites":1,"_private":true,"subcategory":"' || subcategory || '","user":{"name":"u","is_followed":false},"folders":[{"title":"f","num_posts":4},{"title":"g","num_posts":5}],"file":{"id":' || o_orderkey
|| ',"date_added":"' || of_file || '","num_likes":1,"extension":"png"}}'"""


def _submissions_sql(more: str = "") -> str:
    return f"""WITH {_J}, t AS (SELECT *, {_RECORD} AS content FROM j WHERE subcategory <> 'journal'{more})
SELECT '{A}' AS repo_uuid, {_source('itaku.ee/images')} AS source, o_orderkey AS id, {_WHEN_FILE} AS updated, CASE WHEN category = 'pixiv' THEN 2 ELSE 1 END AS part, {_key('content', "'png'")} AS file_key FROM t"""


@query(_submissions_sql())
def import_crawl_submissions(spark, sf_dir):
    return crawl.import_crawl(*_records(spark, sf_dir), A)[0]["submissions"]


@query(_submissions_sql(" AND o_orderkey % 3 <> 0"))
def import_crawl_new_submissions(spark, sf_dir):
    return crawl.import_crawl(*_records(spark, sf_dir), A, _held(spark, sf_dir))[0]["submissions"]


def _records(spark, sf_dir):
    records = crawled(spark, sf_dir)
    return records.drop("o_orderkey"), K.content_keys(records.withColumn("_e", F.lit("png")), "json", "_e").select("category", "subcategory", "json", "file_key")


@query(f"WITH {_J} SELECT count(*) FILTER (subcategory <> 'journal') AS submission_files, count(*) FILTER (category IN ('itaku', 'pixiv')) AS submission_metadata, count(*) FILTER (subcategory <> 'journal' AND (category <> 'itaku' OR subcategory = 'post')) AS post_metadata FROM j")
def crawl_summary(spark, sf_dir):
    posts, files = (crawl.parsed(crawl.check_source(r, on_error="rejects").where("error is null")) for r in _records(spark, sf_dir))
    kind = lambda df, k: df.select(F.lit(k).alias("kind"))
    rows = kind(files, "submission_files").union(kind(crawl.file_metadata_keys(files).where("file_metadata_key is not null"), "submission_metadata"))
    return crawl.crawl_summary(rows.union(kind(crawl.post_keys(posts).where("post_key is not null"), "post_metadata")))


# Streams


def _stream(spark, sf_dir, name):
    """The table's files as a stream; a pattern, since a stream's path must else be a folder."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}[.]parquet")


@query("WITH r AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS repo_uuid, user_id, event_id, ts, event_type FROM r WHERE n = 1")
def stream_upsert_latest(spark, sf_dir):
    """Each user's last event, by upserting the stream of events."""
    path, spec = work_folder(spark), TableSpec("last", ("user_id",), "event_type")
    rows = _stream(spark, sf_dir, "events").select(F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("repo_uuid"), "user_id", "event_id", "ts", "event_type")
    stream_upsert(rows, f"{path}/rows", spec, f"{path}/checkpoint", ["ts", "event_id"]).awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("repo_uuid", "user_id", "event_id", "ts", "event_type")


@query("SELECT source AS repo_uuid, count(*) AS n_files, sum(strlen(text))::BIGINT AS total_bytes FROM documents GROUP BY source")
def stream_store_stats(spark, sf_dir):
    path = work_folder(spark)
    rows = _stream(spark, sf_dir, "documents").select(F.col("source").alias("repo_uuid"), F.octet_length("text").cast("bigint").alias("size"))

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(f"{path}/stats")

    stream_stats(rows).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/stats")


@query(_WITH + "SELECT DISTINCT file_key, text AS content FROM k")
def stream_insert(spark, sf_dir):
    path = work_folder(spark)
    rows = K.content_keys(_stream(spark, sf_dir, "documents"), "text", "lang").select("file_key", F.col("text").alias("content"))
    stream_insert_missing(rows, f"{path}/content", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/content").select("file_key", "content")


from stowage.plans import stored as _stored  # noqa: E402, F401  registers the queries of stored inventories
