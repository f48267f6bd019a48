import numpy as np
import pytest
from helpers import documents, words

from hearthlake.llm import mix


def water(sizes, weights, repeats):
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, open_, target = sum(sizes.values()), set(names), {}
    while True:
        left = total - sum(target.values())
        share = {n: left * w[n] / sum(w[x] for x in open_) for n in open_}
        over = [n for n in open_ if share[n] > repeats * sizes[n] + 1e-9]
        if not over:
            return target | share
        for n in over:
            target[n] = repeats * sizes[n]
            open_.remove(n)
        if not open_:
            return target


def test_targets_sizes_and_limits(spark):
    draw = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(draw.integers(0, 60))), ["b", "a", "c", None, "d", "ä"][i % 6] if i > 300 else "a") for i in range(600)]
    rows += [(1000, None, "empty"), (1001, "", "empty"), (1002, "w\t" * 9000, "c"), (5, rows[5][1], "a")]
    docs = documents(spark, rows)
    got = mix.mix_sources(docs).collect()
    assert len(got) == len(rows)
    size = {}
    for i, t, s in rows:
        size[s] = size.get(s, 0) + len(words(t))
    want = water(size, (1, 2, 3), 3)
    taken = {}
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, target in want.items():
        assert abs(taken[s] - target) <= 1, (s, taken[s], target)
    again = mix.mix_sources(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    mixed = mix.take_mix(docs)
    assert mixed.columns == docs.columns


def test_budget_is_met_exactly_where_lengths_allow():
    assert mix.fit_budget(np.array([3, 5]), np.array([4, 4]), 14).tolist() in ([3, 1],)
    assert (np.array([7, 9]) * mix.fit_budget(np.array([7, 9]), np.array([2, 2]), 8)).sum() == 7
    draw = np.random.default_rng(0)
    for _ in range(60):
        lengths = np.unique(draw.integers(1, 30, 5))
        counts = draw.integers(1, 5, len(lengths))
        budget = int(draw.integers(0, (lengths * counts).sum() + 1))
        reach = {0}
        for n, c in zip(lengths, counts):
            reach = {s + int(n) * k for s in reach for k in range(c + 1)}
        take = mix._subset(lengths, counts, budget)
        assert (take <= counts).all() and abs((take * lengths).sum() - budget) == min(abs(s - budget) for s in reach)


def test_large_groups_are_cut_and_empty_tables_work(spark, monkeypatch):
    monkeypatch.setattr(mix, "GROUP_ROWS", 10)
    docs = documents(spark, [(i, "one two three", "a") for i in range(95)] + [(200 + i, "w " * 50, "b") for i in range(3)])
    got = mix.mix_sources(docs).collect()
    assert len(got) == 98
    for s in ("a", "b"):
        assert abs(sum(r.taken for r in got if r.source == s) - next(r.target for r in got if r.source == s)) <= {"a": 1, "b": 25}[s]
    assert mix.mix_sources(docs.limit(0)).count() == 0


def test_ranges_choose_what_one_window_would(spark, monkeypatch):
    docs = documents(spark, [(i * 37 if i % 9 else None, " ".join(f"w{i % 50}" for _ in range(1 + i % 4)), "ab"[i % 2]) for i in range(700)])
    taken = []
    for rows in (10, 10**9):
        monkeypatch.setattr(mix, "GROUP_ROWS", rows)
        taken.append(sorted(((r.doc_id, r.size, r.taken) for r in mix.mix_sources(docs).collect()), key=repr))
    assert taken[0] == taken[1]


def test_rows_of_one_id_take_their_own_copies(spark):
    draw = np.random.default_rng(1)
    rows = [([1, 2, 3, None, None][i % 5], f"t{i} " * int(draw.integers(1, 9)), "abc"[i % 3]) for i in range(200)]
    docs = documents(spark, rows).withColumnRenamed("digest", "copies").withColumnRenamed("rank", "row")
    plan = mix.mix_sources(docs).collect()
    mixed = mix.take_mix(docs)
    assert mixed.columns == docs.columns
    got, want, count = {}, {}, {}
    for r in mixed.collect():
        got[r.source] = got.get(r.source, 0) + len(words(r.text))
        count[r.text] = count.get(r.text, 0) + 1
    for r in plan:
        want[r.source] = want.get(r.source, 0) + r.taken
    assert got == want and max(count.values()) <= 3
    assert mix.take_mix(docs.limit(0)).count() == 0


def test_very_long_documents_need_no_long_table(monkeypatch):
    monkeypatch.setattr(mix, "TABLE", 1 << 10)
    take = mix.fit_budget(np.array([3, 5, 50_000_000]), np.array([400, 400, 3]), 50_001_000)
    assert abs((np.array([3, 5, 50_000_000]) * take).sum() - 50_001_000) <= 2 and take[2] == 1
    assert mix.fit_budget(np.array([50_000_000]), np.array([4]), 60_000_000).tolist() == [1]
    assert mix.fit_budget(np.array([50_000_000]), np.array([4]), 90_000_000).tolist() == [2]
