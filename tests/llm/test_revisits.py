from fenestra.llm import revisits as v
from pyspark.sql import functions as F

RECORD = "record_id bigint, url string, date bigint, kind string, status int, headers map<string,string>, digest string, extra string"


def test_canonical_urls(spark):
    pairs = {
        "HTTP://User@Example.COM:80": "http://example.com/", "https://a.b:443/x?b=2&a=1&&#frag": "https://a.b/x?a=1&b=2",
        "https://a.b:80/X": "https://a.b:80/X", "http://a.b/?": "http://a.b/", "not a url": None, None: None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in pairs], "u string").select("u", v.canonical_url(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == pairs


def resolved(spark, rows):
    return {r.record_id: r for r in v.resolve(spark.createDataFrame(rows, RECORD)).collect()}


def test_rules(spark):
    ok = lambda i, url, at, h, digest=None, status=200: (i, url, at, "response", status, h, digest, None)
    again = lambda i, url, at, h, digest=None: (i, url, at, "revisit", 304, h, digest, None)
    rows = [
        ok(1, "http://a/", 10, {"ETag": '"1"', "Content-Type": "t", "Date": "d1"}), ok(2, "http://a/", 20, {"etag": '"2"'}),
        ok(3, "http://a/", 20, {"etag": '"3"', "VARY": "y"}), ok(4, "http://a/", 25, {"etag": '"4"'}, status=500),
        again(11, "HTTP://A#f", 30, {"ETAG": 'W/"3"', "Date": "now", "Content-Type": "no"}), again(12, "http://a/", 20, {"etag": '"1"'}),
        again(13, "http://a/", 10, {}), again(14, "http://a/", 40, {"etag": '"2"'}), again(15, "http://a/", 40, None),
        ok(5, "http://b/", 1, {"last-modified": "m"}, "q"), again(21, "http://b/", 2, {"Last-Modified": "m"}),
        again(22, "http://b/", 2, {"Last-Modified": "n"}), again(23, "http://b/", 3, {}, "q"), again(24, "http://b/", 3, {}, "r"),
        again(31, None, 3, {}), again(32, "http://b/", None, {}), ok(6, None, 3, {}), ok(7, "http://b/", None, {}),
    ]
    got = resolved(spark, rows)
    assert {k: r.status for k, r in got.items()} == {
        11: "resolved", 12: "resolved", 13: "orphan", 14: "mismatch", 15: "unvalidated", 21: "resolved", 22: "mismatch", 23: "resolved",
        24: "mismatch", 31: "orphan", 32: "orphan"}
    assert (got[11].refers_to, got[12].refers_to, got[23].refers_to) == (3, 1, 5)
    assert got[11].headers == {"etag": 'W/"3"', "vary": "y", "date": "now"}
    assert got[12].headers == {"etag": '"1"', "content-type": "t", "date": "d1"}


def test_last_of_repeated_names(spark):
    df = spark.sql("select map('Vary', 'x', ' VARY', 'y', 'b', cast(null as string)) h, cast(null as map<string,string>) e")
    row = df.select(v.folded_headers(F.col("h")).alias("h"), v.folded_headers(F.col("e")).alias("e")).first()
    assert (row.h, row.e) == ({"vary": "y", "b": None}, {})


def test_one_url_over_many_pieces(spark):
    rows = [(i, "http://hot/", i, "response" if i % 7 == 0 else "revisit", 200, {"etag": str(i - i % 7)}, None, None) for i in range(2_000)]
    got = resolved(spark, rows)
    assert len(got) == sum(i % 7 > 0 for i in range(2_000))
    assert all(r.status == "resolved" and r.refers_to == i - i % 7 for i, r in got.items())


def test_empty_and_repeated(spark):
    assert resolved(spark, []) == {}
    rows = [(1, "http://a/", 1, "response", 200, {"etag": "x"}, None, None)] * 2 + [(2, "http://a/", 2, "revisit", 304, {"etag": "x"}, None, None)] * 2
    assert [r.refers_to for r in v.resolve(spark.createDataFrame(rows, RECORD)).collect()] == [1, 1]
