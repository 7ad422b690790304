import duckdb

from stowage.llm.urls import OP2_SQL, RULES, judge, op2_url_filters

PAGES = [
    (1, "http://a.NET/x", None), (2, "http://net", None), (3, "https://m.example.net/en/5?q#z", None), (4, "http://example.com/de/1", "<p>"),
    (5, "http://notexample.com/de/1", None), (6, None, None), (7, "no scheme net/", None), (8, "http://x.org/fr/", None),
    (9, "http://alias.com/1#top", '<LINK href="http://example.com/de/2" rel="canonical">'),
    (10, "http://alias.com/2", '<meta http-equiv=refresh content="0; url=http://alias.com/1">'),
    (11, "http://alias.com/3", "<link rel='canonical' href='/1'>"),
    (12, "http://other.com/1", '<link rel="canonical" href="//b.net/q">'),
    (13, "http://other.com/2", '<link rel="canonical" href="http://other.com/1">'),
    (14, "http://c.org/fr/9", '<link rel="canonical" href="http://other.com/2">'),
    (15, "http://a.net:80/", None), (15, "http://a.net:80/", None), (None, "http://free.com", None),
    (16, "ftp://u@h.example.net/en/?a://b", None),
]


def test_judge(spark):
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, rule string, host string")
    got = judge(pages, spark.createDataFrame(RULES, "rule string, verdict string"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"] and got.count() == len(PAGES)
    found = {r["page_id"]: tuple(r)[1:] for r in got.collect()}
    assert found[1] == ("a.net", "/x", "net/", "block")
    assert found[2] == ("net", "", None, "allow")  # the path does not start with the rule's
    assert found[3] == ("m.example.net", "/en/5", "example.net/en/", "allow")
    assert found[4] == ("example.com", "/de/1", "example.com/de/", "block")
    assert found[5] == ("notexample.com", "/de/1", None, "allow")
    assert found[6] == found[7] == ("", "", None, "allow")
    assert found[8][2:] == ("org/fr/", "allow")
    assert found[9] == ("alias.com", "/1", None, "block") and found[10][3] == found[11][3] == "block"
    assert found[12][2:] == found[13][2:] == (None, "allow")  # a block and an explicit allow among the aliases
    assert found[15] == ("a.net:80", "/", None, "allow")
    assert found[None] == ("free.com", "", None, "allow")
    assert found[16] == ("u@h.example.net", "/en/", "example.net/en/", "allow")


def test_redirect_table_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://q.com/", None)], "page_id long, url string, html string")
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    moved = spark.createDataFrame([("http://q.com/", "http://mid.com/"), ("http://mid.com/", "http://z.net/"), (None, "http://q.com/")], "u string, v string")
    assert judge(pages, rules, moved).first()["verdict"] == "block"
    assert judge(pages.where("false"), rules).count() == 0


def test_query_and_its_sql_on_pages_with_edges(spark, tmp_path):
    """Links to and from urls in any case, chains, fragments, refreshes: the engine and the SQL carry the same decisions."""
    more = [(30, "http://ALIAS.com/c", '<link rel="canonical" href="http://EXAMPLE.com/de/9">'), (31, "http://alias.com/c#x", None), (32, "HTTP://alias.com/c", None), (33, "http://alias.com/C", None),
            (34, "http://far.com/1", '<link rel=canonical href="HTTP://ALIAS.COM/c#frag">'), (35, "HTTP://Far.com/1", None), (36, "http://rel.com/a", "<link rel='canonical' href='/B'>"), (37, "HTTP://REL.com/B", '<meta http-equiv="refresh" content="1;url=//c.net/k">')]
    rows = [(i, u, h) for i, u, h in PAGES if i is not None] + more
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    found = con.execute(OP2_SQL)
    names = [d[0] for d in found.description]
    got = {tuple(r[c] for c in names) for r in op2_url_filters(spark, str(tmp_path)).collect()}
    assert got == set(found.fetchall())
    verdicts = {r[0]: r[names.index("verdict")] for r in got}
    assert [verdicts[i] for i in (30, 31, 32, 33, 34, 35, 36, 37)] == ["block", "block", "block", "allow", "block", "block", "block", "block"]
