import datetime as dt

from verdigris.llm import url_filters as U

D = dt.date


def brute(url, day, entries):
    if not url or not day or "://" not in url:
        return "none", None
    rest = url.split("://", 1)[1].split("?")[0].split("#")[0]
    host, _, path = rest.partition("/")
    host = host.split("@")[-1].split(":")[0].rstrip(".").lower()
    labels = host.split(".")
    keys = [".".join(labels[i:]) for i in range(len(labels) - 1, -1, -1)]
    segments = [s for s in path.split("/") if s]
    keys += [host + "/" + "/".join(segments[:i]) for i in range(1, len(segments) + 1)]
    out = ("none", None)
    for key in keys if host else []:
        past = [(d, -U.PRIORITY[a], a) for p, a, d in entries if p and a in U.PRIORITY and d and p.lower().rstrip("/") == key and d <= day]
        if past and max(past)[2] != "remove":
            out = (max(past)[2], key)
    return out


ENTRIES = [
    ("example.org", "block", D(2024, 1, 10)), ("example.org", "remove", D(2024, 3, 1)), ("EXAMPLE.org", "block", D(2024, 5, 1)),
    ("good.example.org", "allow", D(2024, 1, 5)), ("a.example.org/x/", "block", D(2024, 1, 1)), ("a.example.org/x/y", "allow", D(2024, 2, 1)),
    ("tie.net", "remove", D(2024, 1, 1)), ("tie.net", "block", D(2024, 1, 1)), ("tie.net", "block", D(2024, 1, 1)),
    (None, "block", D(2024, 1, 1)), ("null.net", None, D(2024, 1, 1)), ("day.net", "block", None), ("odd.net", "praise", D(2024, 1, 1)), ("org", "allow", D(2024, 6, 1)),
]
URLS = [
    "http://example.org/", "https://Sub.Example.ORG:8080/p?q#f", "http://good.example.org", "http://a.example.org/x/y/z", "http://a.example.org/x", "http://a.example.org/xx",
    "http://notexample.org/", "http://tie.net/a", "http://user@tie.net./", "http://null.net", "http://day.net", "http://odd.net", "nonsense", "", None, "http:///path", "ftp://x.org/" + "s/" * 300,
]
DAYS = [D(2024, 1, 1), D(2024, 1, 10), D(2024, 2, 29), D(2024, 3, 1), D(2024, 7, 1), None]


def test_verdicts_match_brute_force(spark):
    rows = [(i, u, d, "shadow") for i, (u, d) in enumerate((u, d) for u in URLS for d in DAYS)] + [(0, URLS[0], DAYS[1], "again")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched date, pattern string")
    entries = spark.createDataFrame(ENTRIES, "pattern string, action string, day date")
    got = U.evaluate(captures, entries).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"page_id", "url", "fetched", "verdict", "pattern", "valid_from"}
    for r in got:
        assert (r.verdict, r.pattern) == brute(r.url, r.fetched, ENTRIES), r


def test_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://a.b", D(2024, 1, 1))], "page_id long, url string, fetched date")
    entries = spark.createDataFrame(ENTRIES, "pattern string, action string, day date")
    assert [r.verdict for r in U.evaluate(captures, entries.limit(0)).collect()] == ["none"]
    assert U.evaluate(captures.limit(0), entries).count() == 0


def test_sql_agrees(spark):
    import duckdb

    from verdigris.llm.queries import QUERIES, SQL

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    cursor = con.execute(SQL["op1_url_filters"])
    names = [c[0] for c in cursor.description]
    want = sorted((dict(zip(names, r)) for r in cursor.fetchall()), key=str)
    frame = QUERIES["op1_url_filters"](spark, d)
    got = sorted(({c: r[c] for c in names} for r in frame.collect()), key=str)
    assert sorted(frame.columns) == sorted(names) and got == want and {r["verdict"] for r in want} == {"block", "allow", "none"}


def test_clashing_names_and_odd_days(spark):
    rows = [(1, "http://ads.example.org/x", "2024-01-10", 1, 2, 3, 4, 5), (2, "http://ads.example.org/x", "soon", 1, 2, 3, 4, 5), (3, None, None, 1, 2, 3, 4, 5)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched string, u int, d int, best int, __URL int, __best_day int")
    entries = spark.createDataFrame([("example.org", "block", "2024-01-01"), ("example.org", "allow", "never")], "pattern string, action string, day string")
    got = {r.page_id: r for r in U.evaluate(captures, entries).collect()}
    assert [got[i].verdict for i in (1, 2, 3)] == ["block", "none", "none"]
    assert got[1].asDict() | {"verdict": 0, "pattern": 0, "valid_from": 0} == dict(zip(captures.columns, rows[0])) | {"verdict": 0, "pattern": 0, "valid_from": 0}


def test_urls_of_any_length_are_looked_up_at_listed_depths(spark):
    long = "http://deep.example.org/" + "a/" * 60_000
    wide = "http://" + "x." * 2_000 + "example.org/"
    captures = spark.createDataFrame([(1, long, D(2024, 1, 9)), (2, wide, D(2024, 1, 9)), (3, long + "b", D(2024, 1, 9)), (None, None, None)], "page_id long, url string, fetched date")
    entries = spark.createDataFrame([("deep.example.org/a/a/a", "allow", D(2024, 1, 1)), ("example.org", "block", D(2024, 1, 1)), ("deep.example.org/" + "a/" * 500, "block", D(2024, 1, 2))], "pattern string, action string, day date")
    got = {r.page_id: (r.verdict, len(r.pattern or "")) for r in U.evaluate(captures, entries).collect()}
    assert got == {1: ("block", 16 + 1000), 2: ("block", 11), 3: ("block", 16 + 1000), None: ("none", 0)}
