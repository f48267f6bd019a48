from hearthlake.llm import line_dedup

SCHEMA = "page_id long, url string, html string, host string, lines string"


def page(i, host, body):
    return (i, f"https://{host}/p/{i}", body, "x", "y")


def test_common_lines_of_a_site_go(spark):
    rows = [page(i, "a.example", f"<title>T {i}</title><script>var x='</p>'</script><nav>Menu &amp; more</nav><p>own {i}</p><p>own {i}</p>") for i in range(10)]
    rows += [page(100 + i, "B.example", f"<p>Menu & more</p><p>line {i}</p>") for i in range(3)]
    rows += [(200, None, "<p>x</p>", "x", "y"), (201, "https://c.example/", None, "x", "y"), (202, "https://c.example/", "", "x", "y"), page(203, "d.example", "<p>" + "long " * 50_000 + "</p>"), page(3, "a.example", rows[3][2])]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.page_id, r.host, r.n_lines, r.n_dropped, tuple(r.kept_lines)) for r in line_dedup.drop_boilerplate(pages).collect())
    assert len(got) == len(rows)
    by = {g[0]: g for g in got}
    assert by[0][1:] == ("a.example", 4, 1, ("T 0", "own 0", "own 0"))
    assert by[100][1:] == ("b.example", 2, 1, ("line 0",))
    assert by[200][1] == "" and by[201][2:] == (0, 0, ()) and by[203][2] == 1
    assert sum(g[0] == 3 for g in got) == 2
    assert line_dedup.drop_boilerplate(pages.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    pages = spark.createDataFrame([page(1, "a.example", "<p>x</p>")], SCHEMA)
    plan = line_dedup.drop_boilerplate(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
