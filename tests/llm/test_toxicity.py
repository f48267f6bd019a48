import random
import re
import zlib

import numpy as np
from helpers import documents
from pyspark.sql import functions as F

from hearthlake.llm import toxicity


def corpus(n=500, seed=9):
    draw = random.Random(seed)
    syllables = ["ba", "de", "ki", "lo", "mu", "ra", "se", "ti"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(draw.randint(5, 150))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w[draw.randrange(len(w))] = draw.choice(["gronk", "zwaf" + draw.choice(syllables)])
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus()
    docs = documents(spark, rows + [(9000, None, "s"), (9001, "", "s"), (9002, "ba de " * 30_000, "s"), (9003, "ba de " * 20_000 + "gronk zwafki gronk", "s"), (None, "ki lo", "s")])
    table = spark.createDataFrame(labels + [(1, None), (None, 1), (777777, 1)], "doc_id long, toxic int")
    net = toxicity.fit(docs, table)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, net).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()}
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(len(rows)))
    y = dict(labels)
    out = [i for i in y if got[i].held_out]
    right = np.mean([(got[i].score >= 0.3) == bool(y[i]) for i in out])
    assert right >= 0.93, right
    assert got[9003].score > 0.3 > got[9002].score  # the only toxic words stand at the end
    kept = toxicity.drop_toxic(docs, net)
    assert kept.columns == docs.columns
    again = toxicity.fit(docs.repartition(5), table)
    assert np.allclose([toxicity.train([], []).constant], 0.5) and np.allclose(again.p["out"], net.p["out"])


def test_gradients_match_differences():
    draw = np.random.default_rng(0)
    net = toxicity.Network.fresh(np.arange(1, 50, dtype=np.uint64))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, real = draw.normal(0, 1, (6, 7, toxicity.EMBED)), (draw.random((6, 7)) < 0.8).astype(float)
    y, w = (draw.random(6) < 0.5).astype(float), np.ones(6)

    def loss():
        z = net.run(x, real)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g, dx = net.gradients(x, real, y, w)
    for name in ("wf", "ub", "cf", "att", "out"):
        flat, grad = net.p[name].reshape(-1), np.asarray(g[name]).reshape(-1)
        for k in draw.integers(0, len(flat), 4):
            old = flat[k]
            flat[k] = old + 1e-3
            up = loss()
            flat[k] = old - 1e-3
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-3 - grad[k]) < 2e-3


def test_windows_cover_every_word():
    at, owner = toxicity.windows(np.array([0, 1, 32, 33, 200]))
    assert set(owner.tolist()) == {0, 1, 2, 3, 4}
    for i, (start, n) in enumerate(zip([0, 0, 1, 33, 66], [0, 1, 32, 33, 200])):
        assert set(at[owner == i].reshape(-1).tolist()) - {-1} == set(range(start, start + n))


def plain_score(net, text):
    """The score, word by word and without blocks."""
    from hearthlake.llm.pieces import PieceHash

    sig = lambda v: 1 / (1 + np.exp(-v))
    p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def embedded(word, kind):
        flat = np.array([ord(c) for c in word], dtype=np.uint32)
        row = int(net.rows(PieceHash(flat)(np.array([0]), np.array([len(flat)]), kind))[0])
        return p["embed"][row] if row else np.zeros(p["embed"].shape[1])

    found = re.findall("[a-z0-9\x80-\U0010ffff]+", text.lower())
    inputs = []
    for w in found:
        w = f" {w} "
        grams = [(w[i : i + n], n) for n in toxicity.GRAMS for i in range(len(w) - n + 1)]
        inputs.append(embedded(w, 1) + sum((embedded(g, n) for g, n in grams), np.zeros(toxicity.EMBED)) / max(1, len(grams)) ** 0.5)
    best, n = -np.inf, len(inputs)
    for first in range(0, max(1, n - (toxicity.WINDOW - toxicity.STRIDE)), toxicity.STRIDE):
        x = inputs[first : first + toxicity.WINDOW]
        states = [[None] * len(x), [None] * len(x)]
        for d, (name, order) in enumerate((("f", range(len(x))), ("b", range(len(x) - 1, -1, -1)))):
            h = np.zeros(toxicity.HIDDEN)
            for t in order:
                g, u, k = x[t] @ p["w" + name] + p["c" + name], h @ p["u" + name], toxicity.HIDDEN
                z, r = sig(g[:k] + u[:k]), sig(g[k : 2 * k] + u[k : 2 * k])
                h = h + (1 - z) * (np.tanh(g[2 * k :] + r * u[2 * k :]) - h)
                states[d][t] = h
        both = np.array([np.r_[a, b] for a, b in zip(*states)]).reshape(-1, 2 * toxicity.HIDDEN)
        weight = np.exp(both @ p["att"])
        best = max(best, ((weight / weight.sum()) @ both if len(x) else np.zeros(2 * toxicity.HIDDEN)) @ p["out"] + p["bias"][0])
    return sig(net.curve[0] * best + net.curve[1])


def test_scores_match_a_plain_network_in_every_layout(spark):
    rows, labels = corpus(240)
    net = toxicity.train([t for _, t, _ in rows], np.array([y for _, y in labels]))
    rows = rows[:40] + [(900, None, "s"), (901, "Zwaf GRONK, gronk\u00e9 \u4e16\u754c-a_b " * 40, "s"), (902, "x" * 5000, "s")]
    docs = documents(spark, rows)
    one = {r.doc_id: r.score for r in toxicity.score_documents(docs.coalesce(1), net).collect()}
    many = {r.doc_id: r.score for r in toxicity.score_documents(docs.repartition(13), net).collect()}
    assert one == many
    for i, t, _ in rows:
        assert abs(one[i] - plain_score(net, t or "")) < 2e-3, i


def test_few_labels_still_rank(spark):
    rows, labels = corpus(60, seed=4)
    train = [t for i, t, _ in rows if i % 3], np.array([y for i, y in labels if i % 3])
    net = toxicity.train(*train)
    held = [(t, y) for (i, t, _), (_, y) in zip(rows, labels) if i % 3 == 0]
    s, y = net.scores([t for t, _ in held]), np.array([y for _, y in held])
    assert np.mean(s[y == 1][:, None] > s[y == 0][None, :]) >= 0.75 and net.curve[0] >= toxicity.LEAST_SLOPE
    assert len(set(s.tolist())) > 5


def test_labels_that_contradict_and_ties_at_the_threshold(spark):
    rows, labels = corpus(80)
    docs = documents(spark, rows)
    both = spark.createDataFrame(labels + [(i, 1 - y) for i, y in labels[:8]] + labels[:5], "doc_id long, toxic int")
    net = toxicity.fit(docs, both)
    score = toxicity.score_documents(docs, net).orderBy("doc_id").first().score
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, net, threshold=score).select("doc_id").collect()}
    assert 0 not in kept and 0 in {r.doc_id for r in toxicity.drop_toxic(docs, net, threshold=score + 1e-6).select("doc_id").collect()}


def test_long_documents_do_not_end_the_sample(spark):
    rows, labels = corpus(40)
    docs = documents(spark, rows + [(5000 + k, "lo " * 5000, "s") for k in range(4)])
    table = spark.createDataFrame(labels + [(5000 + k, k % 2) for k in range(4)], "doc_id long, toxic int")
    net = toxicity.fit(docs, table, sample_chars=12_000)
    assert net.constant is None


def test_one_kind_of_label_gives_a_constant(spark):
    rows, _ = corpus(20)
    net = toxicity.fit(documents(spark, rows), spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score_documents(documents(spark, rows), net).collect()} == {0.0}
    assert toxicity.score_documents(documents(spark, rows).limit(0), net).count() == 0
