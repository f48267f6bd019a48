import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline
    from hearthlake.llm import exact_dedup, simhash, toxicity

    assert [n.split()[0] for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact", "SimHash", "mixing", "SentencePiece"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    net = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    want = {r.doc_id for r in toxicity.score_documents(docs, net).filter("score < 0.3").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, DATA)
        docs = docs.persist()
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            assert ids == want
        if k == 1:
            assert ids == {r.doc_id for r in exact_dedup.duplicate_groups(before).filter("kept").collect()}
        if k == 2:
            assert len(ids) == simhash.similar_components(before).select("component_id").distinct().count()
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] and sizes[4] == sizes[5]


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def made_corpus(spark, folder):
    """Documents with copies, near copies, nulls, blanks, repeated rows and ids, and labels of some."""
    import random

    draw = random.Random(9)
    prose = lambda n: " ".join(draw.choice("river stone light garden window letter morning paper winter music bridge harbour".split()) + str(draw.randrange(40)) for _ in range(n))
    rows, labels = [], []
    for i in range(90):
        toxic = i % 3 == 0
        text = prose(60) + (" you gronk zwaf idiot gronk" * 3 if toxic else "")
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    clean = [t for i, t in rows if i % 3]
    rows += [(200 + k, t.replace(" ", "  \n")) for k, t in enumerate(clean[:10])]  # equal but for blanks
    for k, t in enumerate(clean[10:30]):  # one word in a hundred differs, or one in ten
        w = t.split() * 2
        rows.append((300 + k, " ".join(w)))
        w[7] = "changed"
        rows.append((400 + k, " ".join(w)))
        far = list(w)
        far[::9] = ["far"] * len(far[::9])
        rows.append((500 + k, " ".join(far)))
    rows += [(600, None), (601, ""), (602, " \t\n"), (None, prose(20)), (None, None), (603, prose(30)), (603, prose(31)), (1, rows[1][1]), (700, "x" * 30_000)]
    sources = ["a", "b", None, "a", "a"]
    docs = [(i, t, "en", sources[k % 5], len(t or ""), "clash", 1.0) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, ids string, score double").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_run_equals_its_stages_done_plainly(spark, tmp_path):
    from collections import Counter

    import corpus_pipeline
    import numpy as np
    from helpers import components, words

    from hearthlake.llm import sentencepieces, toxicity

    made_corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    net = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    score = dict(zip(rows, net.scores([t or "" for _, t, _ in rows]), strict=True))
    rows = [r for r in rows if score[r] < 0.3]
    # Of equal texts, blanks aside, the longest, then the smallest id.
    groups = {}
    for r in rows:
        groups.setdefault("".join(words(r[1])), []).append(r)
    rows = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]
    # One of each component of texts whose sets of five-word shingles share 0.8.
    def shingles(text):
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t, _ in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    rows, sets = [rows[k] for k in order], [sets[k] for k in order]
    root = components(range(len(rows)), lambda a, b: bool(sets[a]) and bool(sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    kept = [r for k, r in enumerate(rows) if root[k] == k]
    assert len(kept) < len(rows) < len(groups) + 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.source) for r in got} <= {(i, s) for i, _, s in kept}
    # The mix: each source comes near its target, nothing is taken more than three times.
    size = Counter()
    for _, t, s in kept:
        size[s] += len(words(t))
    taken, times = Counter(), Counter()
    pieces = sentencepieces.load(sentencepieces.MODEL)
    back = sentencepieces.join_pieces(np.concatenate([np.array(r.ids, dtype=np.int64) for r in got]), np.cumsum([0, *(len(r.ids) for r in got)]), pieces)
    texts = {(i, s, t or "") for i, t, s in kept}
    for r, t in zip(got, back, strict=True):
        assert (r.doc_id, r.source, t) in texts and r.n_pieces == len(r.ids)
        taken[r.source] += len(words(t))
        times[(r.doc_id, r.source, t)] += 1
    assert max(times.values()) <= 3 and sum(size.values()) > 0
    from test_mix import water

    for s, target in water(dict(size), (1, 2, 3), 3).items():
        whole = min(int(target // size[s]), 3) if size[s] else 0
        rest = min(round(target - whole * size[s]), size[s]) if whole < 3 else 0
        sums = {0}  # of any choice of the source's documents
        for n in [len(words(t)) for _, t, x in kept if x == s]:
            sums |= {n + x for x in sums}
        nearest = min(abs(x - rest) for x in sums)
        assert abs(taken[s] - whole * size[s] - rest) == nearest, (s, taken[s], target)


def test_stages_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    made_corpus(spark, tmp_path / "full")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/full/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/none/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, f"{tmp_path}/none")
        assert out.count() == 0 and (k == 4 or out.columns == docs.columns)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
