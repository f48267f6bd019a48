"""Dictionary search, exact medians, running sums and map clusters against plain versions."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from hearthlake.operators import dictionary, incremental, prefix, quantiles, risk, spatial


def test_contained_entries_equal_the_search_of_every_entry(spark):
    draw = random.Random(1)
    word = lambda n: "".join(draw.choice("abä ") for _ in range(n))
    texts = [(i, word(draw.choice([0, 3, 40, 200]))) for i in range(120)] + [(200, None)]
    entries = [(i, word(draw.choice([1, 2, 4, 9]))) for i in range(60)] + [(100, ""), (101, None), (102, "ab"), (103, "ab")]
    want = sorted((i, e, t.index(k)) for i, t in texts if t for e, k in entries if k and k in t)
    rows, table = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame(entries, "entry long, key string")
    for chars in (dictionary.PART_CHARS, 40):
        got = dictionary.contained_pairs(rows, F.col("t"), table, chars)
        assert sorted(tuple(r) for r in got.select("id", "entry", "at").collect()) == want
    assert dictionary.contained_pairs(rows, F.col("t"), table.limit(0)).count() == 0
    assert dictionary.contained_pairs(rows.limit(0), F.col("t"), table).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def theta_area(rows, text, areas, least=4):
    """The plain version: every text with every name."""
    names = areas.select("name", "ord", F.explode(F.array_distinct(F.transform(F.array_append("aliases", F.col("name")), lambda a: F.lower(a)))).alias("key"))
    met = rows.withColumn("__t", F.nullif(spatial.clean_area(text), F.lit(""))).crossJoin(names)
    rank = F.struct(F.length("key"), -F.col("ord"), "key", "name")
    exact, part = F.col("__t") == F.col("key"), (F.length("key") >= least) & F.contains("__t", "key")
    return met.groupBy("id").agg(F.coalesce(F.max(F.when(exact, rank))["name"], F.max(F.when(part, rank))["name"]).alias("area"))


def test_areas_equal_the_theta_join(spark):
    draw = random.Random(2)
    some = lambda: " ".join(draw.choice(["nob", "hill", "noe", "valley", "the", "mission", "San Francisco", ", CA", "(soma)"]) for _ in range(draw.randrange(5)))
    rows = spark.createDataFrame([(i, some()) for i in range(300)] + [(400, None), (401, "soma")], "id long, t string")
    areas = spark.createDataFrame([("Nob Hill", 0, ["nob", "hill"]), ("Noe Valley", 1, ["noe", "valley"]), ("Mission", 2, ["the mission", "hill"]), ("SoMa", 2, ["soma"]), ("Somas", 2, ["soma"])], "name string, ord int, aliases array<string>")
    want = {r.id: r.area for r in theta_area(rows, F.col("t"), areas).collect()}
    got = spatial.match_area(rows, F.col("t"), areas)
    assert {r.id: r.area for r in got.collect()} == want and len(set(want.values())) >= 4
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [quantiles.FEW, 5])
def test_medians_equal_those_of_sorted_values(spark, few):
    draw = random.Random(3)
    rows = [("hot", draw.choice([draw.uniform(0, 1e6), draw.lognormvariate(0, 40), -1.5, 7.0])) for _ in range(3000)] + [("two", 1.0), ("two", 4.0), ("one", 9.0), ("same", 2.0), ("same", 2.0), ("none", None)] + [("odd", float(v)) for v in range(301)]
    counts = spark.createDataFrame(rows, "k string, value double").groupBy("k", "value").agg(F.count(F.lit(1)).alias("n"))
    groups: dict = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    got = {r.k: (r["median"], r.n) for r in quantiles.exact_medians(counts, ["k"], few).collect()}
    assert got == {k: (statistics.median(v), len(v)) for k, v in groups.items()}


def test_baselines_hold_no_values_in_a_buffer(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 5 > 0, F.concat(F.lit("a"), F.col("id") % 3)).alias("neighborhood"), (F.col("id") % 2).cast("double").alias("bedrooms"), (F.col("id") * 37 % 1009).cast("double").alias("price"))
    made = risk.baselines(df)
    plain = df.groupBy("neighborhood", "bedrooms").agg(F.median("price").alias("m"), F.count(F.lit(1)).alias("n")).filter("neighborhood is not null").unionByName(df.groupBy("bedrooms").agg(F.median("price").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("neighborhood", F.lit(None).cast("string")))
    key = lambda rows: sorted(((r[0] or "", *tuple(r)[1:]) for r in rows))
    assert key(made.select("area", "beds", "median_price", "n").collect()) == key(plain.select("neighborhood", "bedrooms", "m", "n").collect())
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "median" not in plan.replace("median_price", "").replace(" AS median", "").replace("median#", "") or "ObjectHashAggregate" not in plan


def test_running_sums_equal_one_window(spark):
    draw = random.Random(4)
    rows = [(draw.choice(["hot", "hot", "hot", "a", "b", None]), i, draw.choice([None, 1.0, 2.0, 5.0])) for i in range(2000)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at long, cost double")
    for keys in ([], ["k"]):
        sums, want = {}, {}
        for k, at, cost in sorted(rows, key=lambda r: r[1]):
            key = k if keys else "all"
            want[at] = sums.get(key, 0.0)
            sums[key] = want[at] + (cost or 0.0)
        made = prefix.running_before(df, keys, ["at"], "cost")
        assert {r["at"]: r.spent for r in made.collect()} == want
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
    capped = incremental.within_cap(df, [], ["at"], "cost", 100.0).filter("runs").agg(F.max("at")).first()[0]
    assert capped == max(at for at, spent in ({r["at"]: r.spent for r in prefix.running_before(df, [], ["at"], "cost").collect()}).items() if spent < 100)
    assert prefix.running_before(df.limit(0), ["k"], ["at"], "cost").count() == 0


def plain_clusters(points, zooms, radius=50, seed_order=None):
    """The greedy order node by node: points {id: (x, y)}; returns {(zoom, id): (centre, size)} and each zoom's nodes and their centres."""
    nodes = {i: (x, y, 1) for i, (x, y) in points.items()}
    owner = {i: i for i in points}
    out, levels = {}, []
    for zoom in sorted(zooms, reverse=True):
        r = radius / (512 * 2.0**zoom)
        of = {}
        for c in sorted(nodes, key=seed_order):
            if c in of:
                continue
            for n, (x, y, _) in nodes.items():
                dx, dy = x - nodes[c][0], y - nodes[c][1]
                if n not in of and dx * dx + dy * dy <= r * r:
                    of[n] = c
        levels.append((r, dict(nodes), of))
        groups = {}
        for n, c in of.items():
            groups.setdefault(c, []).append(nodes[n])
        owner = {i: of[n] for i, n in owner.items()}
        nodes = {c: (sum(x * w for x, _, w in g) / sum(w for *_, w in g), sum(y * w for _, y, w in g) / sum(w for *_, w in g), sum(w for *_, w in g)) for c, g in groups.items()}
        out |= {(zoom, i): (c, nodes[c][2]) for i, c in owner.items()}
    return out, levels


def test_map_clusters_equal_the_greedy_order(spark):
    from hearthlake.operators import map_clusters as mc

    draw = random.Random(5)
    rows = [(i, 37.75 + draw.gauss(0, 0.03), -122.45 + draw.gauss(0, 0.03)) for i in range(1500)] + [(2000 + i, 37.76, -122.44) for i in range(400)] + [(3000 + i, 37.7 + i * 0.0002, -122.5) for i in range(200)]  # a hot place and a street
    rows += [(5000, None, 1.0), (None, 37.7, -122.4), (0, rows[0][1], rows[0][2]), (6000, -89.9999, 179.0)]
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    got = mc.cluster_points(df, [13, 11, 10]).collect()
    x, y = mc.mercator(F.col("latitude"), F.col("longitude"))
    placed = {r.id: (r.x, r.y) for r in df.filter("id is not null and latitude is not null").select("id", x.alias("x"), y.alias("y")).collect()}
    turn = {r.id: r.t for r in df.filter("id is not null").select("id", F.xxhash64(F.lit(7), "id").alias("t")).collect()}
    want, levels = plain_clusters(placed, [13, 11, 10], seed_order=lambda i: (turn[i], i))
    assert {(r.zoom, r.id): (r.cluster, r.points) for r in got} == want and len(got) == 3 * len(placed)
    for r, nodes, of in levels:  # every node lies within the radius of its centre
        assert all((nodes[n][0] - nodes[c][0]) ** 2 + (nodes[n][1] - nodes[c][1]) ** 2 <= r * r for n, c in of.items())
    assert len({c for (z, _), (c, _) in want.items() if z == 10}) < len({c for (z, _), (c, _) in want.items() if z == 13})
    assert mc.cluster_points(df.limit(0), [10]).count() == 0
