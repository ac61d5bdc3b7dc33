import duckdb
import pytest
from millrace.llm import catalog, links

URLS = [
    (1, "http://good.com/a", '<a href="http://mid.org/x">m</a> <A HREF=//lone.org>'),
    (2, "https://mid.org/b?x#y", "<a href='HTTPS://Far.org/'>f</a><a href='/own'>o</a>"),
    (3, "http://far.org", None), (4, "http://bad.net/es/1", ""),
    (5, "http://fan.org/p", '<a href="http://bad.net/es/2">b</a>'),
    (6, "http://fan2.org/p", '<a href="http://mid.org/">m</a><a href="http://good.com/">g</a>'),
    (7, "ftp://WWW.Example.com/en/", None), (8, "x://example.com/en/z", None), (9, "http://sub.example.com/en/q", None),
    (10, "http://example.com", None), (11, None, "<a href='http://mid.org'>x</a>"), (12, "no scheme", None),
    (13, "http://notexample.com/en/1?b", None), (14, "http://mix.net/fr/1", None), (15, "http://mix.net/en/1", None),
    (16, "http://mix.net/en/1", None), (16, "http://mix.net/en/1", None), (None, "http://a.net/es/", None)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows],
                                 "page_id bigint, url string, html string, host string, score string")


def test_rules_and_scores(spark):
    got = {r.page_id: r for r in links.filter_urls(pages(spark, URLS)).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("good.com", "/a", "com/", "allow")
    assert (got[2].path, got[3].path, got[11].host, got[12].path) == ("/b", "", "", "")
    assert got[7].rule == "www.example.com/en/" and got[8].rule == got[9].rule == "example.com/en/"
    assert got[10].rule is None and got[13].rule == "com/" and got[4].verdict == "block"
    # Trust runs along links and fades, distrust runs against them.
    assert got[1].trust > got[2].trust > got[3].trust > 0
    assert got[4].distrust > got[5].distrust > got[6].distrust == 0
    assert got[5].verdict == "block" and {got[i].verdict for i in (2, 3, 6, 11, 16)} == {"allow"}


def test_equal_to_sql(spark):
    connection = duckdb.connect()
    connection.execute("create table pages (page_id bigint, url varchar, html varchar)")
    connection.executemany("insert into pages values (?, ?, ?)", URLS)
    want = connection.execute(catalog.URL_SQL).to_arrow_table().to_pylist()
    got = links.filter_urls(pages(spark, URLS)).toArrow().to_pylist()
    order = lambda rows: sorted((sorted(r.items()) for r in rows), key=repr)
    assert order(got) == order(want)


def test_fixed_point_of_a_cycle(spark):
    """On a cycle of three hosts the scores have a closed form: damping returns after three steps."""
    table = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    judged = spark.createDataFrame([("a", "allow"), ("b", None), ("c", None)], "host string, verdict string")
    got = {r.host: r.trust / links.UNIT for r in links.host_scores(judged, table).collect()}
    whole = 0.15 / (1 - 0.85 ** 3)
    assert got == pytest.approx({"a": whole, "b": 0.85 * whole, "c": 0.85 ** 2 * whole}, abs=1e-7)
    with pytest.raises(RuntimeError, match="still move"):
        links.host_scores(judged, table, steps=20)


def test_brute_force_scores(spark):
    """The fixed point, by many steps in plain floats."""
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("d", "a"), ("c", "e")]
    table = spark.createDataFrame(edges, "src string, dst string")
    seeds = {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.5, "e": 0.0}
    judged = spark.createDataFrame([("a", "allow"), ("b", None), ("c", None), ("d", "allow"), ("d", None), ("e", "block")],
                                   "host string, verdict string")
    out = {s: [d for x, d in edges if x == s] for s in seeds}
    score = {h: 0.15 * v for h, v in seeds.items()}
    for _ in range(400):
        score = {h: 0.15 * seeds[h] + 0.85 * sum(score[s] / len(out[s]) for s in seeds if h in out[s]) for h in seeds}
    got = {r.host: r.trust / links.UNIT for r in links.host_scores(judged, table).collect()}
    assert got == pytest.approx(score, abs=1e-6)


def test_empty(spark):
    assert links.filter_urls(pages(spark, [])).count() == 0
    only = links.filter_urls(pages(spark, [(1, None, None)])).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in only] == [("", "", None, "allow")]
