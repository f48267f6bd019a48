import random

from helpers import rows_by_sql
from pyspark.sql import functions as F

from hearthlake.llm import queries, url_tree

PAGES = "page_id long, url string, html string, host string, template string, n long, key string"
LABELS = "number long, bad boolean"


def pages(spark, urls):
    """Pages with more columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, u, "", "h", "t", 1, "k") for i, u in urls], PAGES)


def judged(spark, urls, labels=(), rules=queries.URL_RULES, **more):
    rows = url_tree.filter_urls(pages(spark, urls), spark.createDataFrame(list(labels), LABELS), rules, **more)
    return {r.page_id: r for r in rows.collect()}


def plain_host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:end], rest[end:]
    stop = min((path.index(c) for c in "?#" if c in path), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path[:stop]


def plain_rule(host, path, rules):
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_hosts_paths_and_rules(spark):
    urls = [
        None, "", "no scheme/en/1", "http://EXAMPLE.com/en/1", "https://a.example.com/en/", "https://www.example.com/en/2?x=/es/", "https://m.www.example.com/en/3#t", "http://example.com",
        "http://example.com?q=/en/", "http://badexample.com/en/", "ftp://x.NET/es/1", "x://net/fr/", "http://net/de/", "http://net.org/es/", "http://user@example.com:80/en/1", "a://b://c/d", "://com/", "http:///en/", "http://ÄB.net/es/ü",
        "http://x.net/ES/1", "http://com/", "http://org/a\nb/c",
    ]
    got = judged(spark, list(enumerate(urls)))
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = plain_host_and_path(u)
        rule, verdict = plain_rule(host, path, queries.URL_RULES)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or "allow")
    tied = [("allow", "a.b", "/xy"), ("block", "a.b", "/xy"), ("allow", "b", "/xyz/")]
    assert judged(spark, [(1, "http://a.b/xyz/")], rules=tied)[1].verdict == "block"


def test_templates_wildcards_branches_and_purity(spark):
    urls, labels, n = [], [], 0
    for part, share in (("good", 0), ("fine", 0), ("bad", 9)):  # of ten
        for k in range(60):
            n += 1
            urls.append((n, f"http://site.org/{part}/{n}"))
            labels.append((n, k % 10 < share))
    for k in range(40):  # a name of its own each: a variable segment
        n += 1
        urls.append((n, f"http://blog.org/{''.join(chr(97 + int(c)) for c in str(n))}/post.html"))
    urls.append((n + 1, "http://deep.org/a/b/c/d/e/f"))
    got = judged(spark, urls, labels)
    by = {i: (r.template, r.verdict) for i, r in got.items()}
    assert by[1] == by[61] == ("site.org/{fine,good}/#", "allow") and by[121] == ("site.org/bad/#", "block")
    assert by[181] == ("blog.org/*/post.html", "allow")
    assert by[n + 1] == ("deep.org/*/*/*/*", "allow")
    site, rest = 18 * 3 / 60, url_tree  # 54 of 60 bad under /bad/, none of 120 beside it
    everywhere = (54 + 1) / (180 + 2)
    beside = (0 + rest.WEIGHT * everywhere) / (120 + rest.WEIGHT)
    assert abs(got[121].bad_share - (54 + rest.WEIGHT * beside) / (60 + rest.WEIGHT)) < 1e-12 and site == 0.9


def test_repeats_hot_keys_null_labels_and_empty_tables(spark):
    urls = [(7, "http://a.org/x/1")] * 3 + [(8, None)] * 2 + [(None, "http://a.org/x/2")] + [(100 + i, f"http://hot.org/p/{i}") for i in range(300)]
    labels = [(1, None), (2, True), (2, False), (None, True), (-5, True)]
    rows = url_tree.filter_urls(pages(spark, urls), spark.createDataFrame(labels, LABELS), queries.URL_RULES)
    assert rows.count() == len(urls)
    assert rows.filter("page_id = 7").count() == 3 and rows.filter("page_id = 8 and host = '' and path = ''").count() == 2
    assert rows.filter("page_id is null").count() == 1
    assert url_tree.filter_urls(pages(spark, urls).limit(0), spark.createDataFrame(labels, LABELS)).count() == 0
    numbers = spark.createDataFrame([("/en/17.html",), ("/a1/b",), ("/x",), ("",), ("/" + "9" * 30,)], "path string").select(url_tree.last_number(F.col("path")))
    assert [r[0] for r in numbers.collect()] == [17, 1, None, None, None]


def test_query_equals_its_sql_on_made_sites(spark, tmp_path):
    draw = random.Random(4)
    parts = ["en", "de", "Shop", "shop", "2024", "a-b", "", "ü", "*", "#", "{x}"]
    urls, labels = [], []
    for i in range(3000):
        host = draw.choice(["hot.org"] * 6 + [f"h{k}.example.com" for k in range(4)] + ["www.example.com", "s.net", "NET", ""])
        path = "".join("/" + (draw.choice(parts) if draw.random() < 0.7 else draw.choice([str(i), f"p{i}.html", "".join(draw.choice("abcdef") for _ in range(5))])) for _ in range(draw.randrange(7)))
        url = f"{draw.choice(['http', 'https'])}://{host}{path}{draw.choice(['', '?a=/1', '#b'])}" if draw.random() < 0.98 else draw.choice([None, "nothing"])
        urls.append((i, url, ""))
        if draw.random() < 0.6:
            bad = draw.random() < (0.9 if "/de" in path else 0.1)
            labels.append((i, 0 if bad else draw.choice([1, None]), draw.choice([0, None])))
    spark.createDataFrame(urls, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels + labels[:50], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.op11_url_filter(spark, str(tmp_path))
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert rows == rows_by_sql(queries.OP11_SQL, tmp_path, got.columns)
    names = {r[5] for r in rows}
    assert any("{" in t for t in names) and any(t.endswith("/**") or "**" in t for t in names) and {r[4] for r in rows} == {"allow", "block"}
    assert any(r[3] is None and r[4] == "block" for r in rows)


def test_copied_rows_are_not_broadcast_by_their_estimated_size(spark, monkeypatch):
    urls = [(i, f"http://h{i % 7}.org/{'abc'[i % 3]}/{i}") for i in range(210)]
    labels = [(i, i % 3 == 0) for i in range(210)]
    of_few = judged(spark, urls, labels)
    read = spark.createDataFrame([("a.org", "/x/1", 1), ("a.org", "/x", None)], "host string, path string, number long")
    paths = url_tree.masked_paths(read, spark.createDataFrame([(1, True)], LABELS))
    joins = lambda rows: rows._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")
    assert joins(paths) == 0 and {tuple(r) for r in paths.collect()} == {("a.org", "/x/#", 1, 1, 1), ("a.org", "/x", 1, 0, 0)}
    assert joins(url_tree.grow(paths)) > 0  # few paths, counted
    monkeypatch.setattr(url_tree, "FEW", 0)
    assert joins(url_tree.grow(paths)) == 0
    assert judged(spark, urls, labels) == of_few
