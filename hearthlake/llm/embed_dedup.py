"""Embedding near-duplicates by a robust-pruned flat graph over overlapping shards.

1. Vectors of one label with equal components form one class; classes are what
   is indexed, every one of them.
2. The classes of a label are split into overlapping cluster shards: centroids
   are fitted on a bounded sample of each shard, a class goes to its nearest
   centroid and to the second one too if that is nearly as near, and shards are
   split again until none holds more than ``SHARD_ROWS``. Where that does not
   help, as in multiples of one vector, all pairs of chunks become shards.
3. Every shard gets a flat graph: candidates are the nearest classes of the
   shard, and robust pruning drops a candidate that a chosen one already covers.
4. The adjacency lists of all shards are united. A shard is searched together
   with the classes that its members' united lists name, wherever those were
   dealt.
5. Each class searches greedily from the shard's medoid and its own place. The
   search goes on from the best ``beam`` classes and from every class within
   ``slack`` of the threshold, so a dense neighbourhood is followed to its end.
6. What is found is verified by the cosine in double precision.
7. An audit compares a bounded sample of classes, one half of them drawn among
   those that have links, with all classes of their
   labels by brute force. If too many links are missing, the search is repeated
   with a wider beam and more slack, and if that does not help, all pairs of
   chunks of each label are compared, which misses none.

Defined results: a vector with a null label, a null, empty or zero vector, and one
with null or non-finite components links with nothing and is its own component;
vectors of different length do not link; vectors equal to each other link with
each other; a null vec_id counts in n_links of the others but is never the
smallest of a component; rows that repeat a vec_id count each; an empty table
gives no rows.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlake.operators.components import connected_components
from hearthlake.session import materialize

#: Classes that a shard may hold; samples that a centroid is fitted on; centroids of one split.
SHARD_ROWS, SAMPLE_PER_CENTROID, FANOUT = 2000, 64, 64
DEGREE, CANDIDATES, ALPHA = 16, 48, 1.2
#: Rows of a shard that are dealt to its centroids at a time.
DEAL_ROWS = 20_000
AUDIT_ROWS = 200
log = logging.getLogger(__name__)


def _unit(vectors) -> np.ndarray:
    """Unit vectors; scaled by their greatest component first, so that no square over- or underflows."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means."""
    draw = np.random.default_rng(seed)
    c = x[draw.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    alike = np.triu(c @ c.T > 1 - 1e-12, 1).any(axis=0)  # of centroids in one place the first is enough
    return c[~alike]


def assign(x: np.ndarray, c: np.ndarray, margin: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their centroids: the nearest one, and the second if it is within the margin."""
    sim = x @ c.T
    first = sim.argmax(axis=1)
    rows = np.arange(len(x))
    if len(c) == 1:
        return rows, first
    best = sim[rows, first].copy()
    sim[rows, first] = -np.inf
    second = sim.argmax(axis=1)
    also = np.flatnonzero(sim[rows, second] >= best - margin)
    return np.r_[rows, also], np.r_[first, second[also]]


def make_shards(classes: DataFrame, shard_rows: int = SHARD_ROWS, levels: int = 6) -> DataFrame:
    """Rows (shard, cid, vector): overlapping clusters within each label and vector length."""
    whole = classes.select(F.concat_ws("/", F.col("label").cast("string"), F.size("vector").cast("string")).alias("shard"), "cid", "vector")
    done = None
    for level in range(levels):
        sizes = materialize(whole.groupBy("shard").count())
        large = sizes.filter(F.col("count") > shard_rows)
        small = whole.join(sizes.filter(F.col("count") <= shard_rows).select("shard"), "shard", "left_semi")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return done
        parts = F.least(F.lit(FANOUT), F.ceil(F.lit(2) * F.col("count") / shard_rows)).cast("int")
        wanted = large.withColumn("parts", parts).withColumn("share", F.least(F.lit(1.0), 1.5 * F.col("parts") * SAMPLE_PER_CENTROID / F.col("count")))
        rows = whole.join(wanted.drop("count"), "shard")
        lot = F.pmod(F.xxhash64(F.lit(level), "cid"), F.lit(1_000_000)) < F.col("share") * 1_000_000

        def fit(group: pd.DataFrame) -> pd.DataFrame:
            c = fit_centroids(_unit(group["vector"]), int(group["parts"].iloc[0]))
            return pd.DataFrame({"shard": [group["shard"].iloc[0]], "centroids": [[list(map(float, v)) for v in c]]})

        # A sample holds about 1.5 * FANOUT * SAMPLE_PER_CENTROID rows at most, however large its shard is.
        fitted = rows.filter(lot).groupBy("shard").applyInPandas(fit, "shard string, centroids array<array<double>>")

        def deal(key: tuple, rows: pd.DataFrame, centroids: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(centroids):
                return pd.DataFrame({"shard": [], "cid": [], "vector": []})
            row, near = assign(_unit(rows["vector"]), np.array([np.asarray(v) for v in centroids["centroids"].iloc[0]]))
            some = rows.iloc[row]
            return pd.DataFrame({"shard": [f"{key[0]}.{k}" for k in near], "cid": some["cid"].to_numpy(), "vector": some["vector"].to_numpy()})

        # The rows of a large shard meet its centroids in parts of about ``DEAL_ROWS``; the centroids come once for each part.
        parted = wanted.withColumn("cuts", F.ceil(F.col("count") / DEAL_ROWS).cast("int")).select("shard", "cuts")
        some = whole.join(parted, "shard").withColumn("cut", F.pmod(F.xxhash64(F.lit(level), F.lit(1), "cid"), F.col("cuts"))).drop("cuts")
        met = fitted.join(parted, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut"), "centroids")
        whole = materialize(some.groupBy("shard", "cut").cogroup(met.groupBy("shard", "cut")).applyInPandas(deal, whole.schema))
    return done.unionByName(_chunk_pairs(whole, shard_rows))


def _chunk_pairs(shards: DataFrame, shard_rows: int) -> DataFrame:
    """Shards that centroids cannot split, such as multiples of one vector: every two chunks of one meet in a shard of their own."""
    parts = shards.groupBy("shard").count().select("shard", F.when(F.col("count") > shard_rows, F.ceil(2 * F.col("count") / shard_rows)).otherwise(1).alias("parts"))
    own = F.pmod(F.xxhash64(F.lit(9), "cid"), F.col("parts"))
    pairs = shards.join(parts, "shard").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    name = F.concat_ws("#", "shard", F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string"))
    return pairs.select(name.alias("shard"), "cid", "vector")


def prune(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA, block: int = 1000) -> list[np.ndarray]:
    """Robust-pruned neighbours of each row, edges in both directions."""
    n = len(x)
    k = min(candidates, n - 1)
    out: list[set[int]] = [set() for _ in range(n)]
    for a in range(0, n if k > 0 else 0, block):
        sim = x[a : a + block] @ x.T
        rows = np.arange(len(sim))
        sim[rows, rows + a] = -np.inf
        cand = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(sim, cand, axis=1)
        order = np.argsort(-near, axis=1, kind="stable")
        cand, near = np.take_along_axis(cand, order, axis=1), np.take_along_axis(near, order, axis=1)
        open_ = np.ones(cand.shape, dtype=bool)
        for _ in range(min(degree, k)):
            live = open_.any(axis=1)
            if not live.any():
                break
            pick = open_.argmax(axis=1)  # the nearest that is left
            chosen = cand[rows, pick]
            for i in np.flatnonzero(live):
                out[a + i].add(int(chosen[i]))
                out[chosen[i]].add(int(a + i))
            between = np.einsum("nd,nkd->nk", x[chosen], x[cand])
            open_ &= alpha * (1 - between) > (1 - near)
            open_[rows, pick] = False
    return [np.fromiter(s, np.int64, len(s)) for s in out]


def search(x: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, threshold: float, beam: int, slack: float) -> list[np.ndarray]:
    """Rows found within the threshold of each queried row, by range-expanding greedy search."""
    medoid = int((x @ x.mean(axis=0)).argmax())
    degree = np.array([len(near) for near in lists], dtype=np.int64)
    first = np.cumsum(degree) - degree
    flat = np.concatenate([np.zeros(0, dtype=np.int64), *lists])
    known, mark = np.zeros(len(x), dtype=bool), np.zeros(len(x), dtype=bool)
    out = []
    for q in queries.tolist():
        seen = np.array(sorted({medoid, q}), dtype=np.int64)
        known[seen] = True
        sims, expanded = x[seen] @ x[q], np.zeros(len(seen), dtype=bool)
        while True:
            bar = np.partition(sims, -beam)[-beam] if len(sims) > beam else -np.inf
            turn = ~expanded & (sims >= min(bar, threshold - slack))
            if not turn.any():
                break
            expanded |= turn
            count = degree[seen[turn]]
            place = np.repeat(first[seen[turn]] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            mark[flat[place]] = True
            fresh = np.flatnonzero(mark & ~known)
            mark[flat[place]] = False
            if fresh.size:
                known[fresh] = True
                seen, sims, expanded = np.r_[seen, fresh], np.r_[sims, x[fresh] @ x[q]], np.r_[expanded, np.zeros(len(fresh), dtype=bool)]
        known[seen] = False
        out.append(seen[(sims >= threshold) & (seen != q)])
    return out


def _all_pairs(classes: DataFrame, threshold: float, shard_rows: int) -> DataFrame:
    """All links, by comparing every two chunks of each label: the exact way, for what the graph cannot find."""
    labels = classes.select(F.concat_ws("/", F.col("label").cast("string"), F.size("vector").cast("string")).alias("shard"), "cid", "vector")
    pairs = _chunk_pairs(labels, shard_rows)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        cid, x = group["cid"].to_numpy(), _unit(group["vector"])
        i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        return pd.DataFrame({"src": np.minimum(cid[i], cid[j]), "dst": np.maximum(cid[i], cid[j])})

    return materialize(pairs.groupBy("shard").applyInPandas(compare, "src long, dst long").distinct())


def find_links(classes: DataFrame, threshold: float = 0.93, shard_rows: int = SHARD_ROWS, beam: int = 12, slack: float = 0.1, recall: float = 0.98, retries: int = 2) -> tuple[DataFrame, float]:
    """Rows (src, dst), src < dst, of classes (cid, label, vector) whose cosine reaches the threshold, and the audited recall."""
    shards = materialize(make_shards(classes, shard_rows))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        cid = group["cid"].to_numpy()
        lists = prune(_unit(group["vector"]))
        return pd.DataFrame({"cid": cid, "near": [cid[near] for near in lists]})

    graph = shards.groupBy("shard").applyInPandas(build, "cid long, near array<long>")
    united = materialize(graph.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    members = shards.select("shard", "cid").join(united, "cid")
    # The classes that a shard's members name; those that are not members come along to be found and passed through.
    named = members.select("shard", F.explode("near").alias("cid")).distinct().join(shards.select("shard", "cid"), ["shard", "cid"], "left_anti")
    place = members.select("shard", "cid", F.lit(True).alias("member")).unionByName(named.select("shard", "cid", F.lit(False).alias("member")))
    scene = materialize(place.join(united, "cid").join(classes.select("cid", "vector"), "cid"))

    def looker(width: int, room: float):
        def look(group: pd.DataFrame) -> pd.DataFrame:
            cid, x = group["cid"].to_numpy(), _unit(group["vector"])
            where = {c: i for i, c in enumerate(cid.tolist())}
            lists = [np.fromiter((where[c] for c in near if c in where), np.int64) for near in group["near"]]
            queries = np.flatnonzero(group["member"].to_numpy())
            found = search(x, lists, queries, threshold, width, room)
            i, j = np.repeat(queries, [len(f) for f in found]), np.concatenate([np.zeros(0, dtype=np.int64), *found])
            i, j = np.divmod(np.unique(np.minimum(i, j) * len(x) + np.maximum(i, j)), len(x))  # most are found from both ends
            return pd.DataFrame({"src": np.minimum(cid[i], cid[j]), "dst": np.maximum(cid[i], cid[j])})

        return look

    links = None
    for attempt in range(retries + 1):
        look = looker(beam * 2**attempt, slack * (1 + attempt))
        links = materialize(scene.groupBy("shard").applyInPandas(look, "src long, dst long").distinct())
        found = audit_recall(classes, links, threshold)
        log.info("links found: %.4f of the audited ones (beam %d)", found, beam * 2**attempt)
        if found >= recall:
            return links, found
    log.info("all chunks of a label are compared, as the audited recall stays below %.2f", recall)
    return _all_pairs(classes, threshold, shard_rows), 1.0


def audit_recall(classes: DataFrame, links: DataFrame, threshold: float = 0.93, rows: int = AUDIT_ROWS) -> float:
    """Share of the links of a bounded sample of classes that were found; brute force against all classes of their labels."""
    lot = [F.xxhash64(F.lit(3), "cid"), F.col("cid")]
    linked = classes.select("cid").join(links.select(F.col("src").alias("cid")).distinct(), "cid", "left_semi").orderBy(*lot).limit(rows // 2)
    others = classes.select("cid").orderBy(*lot).limit(rows - rows // 2)
    sample = classes.join(F.broadcast(linked.union(others).distinct()), "cid", "left_semi").toPandas()
    if not len(sample):
        return 1.0
    ids, labels = sample["cid"].to_numpy(), sample["label"].to_numpy()
    size = np.array([len(v) for v in sample["vector"]])
    units = {d: _unit(sample["vector"][size == d]) for d in set(size.tolist())}

    def compare(batches):
        for batch in batches:
            src, dst = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            length = batch["vector"].map(len).to_numpy()
            for d, u in units.items():
                mine = np.flatnonzero(length == d)
                if mine.size:
                    of = np.flatnonzero(size == d)
                    sim = _unit(batch["vector"].iloc[mine]) @ u.T
                    ok = (sim >= threshold) & (batch["label"].to_numpy()[mine][:, None] == labels[of][None, :]) & (batch["cid"].to_numpy()[mine][:, None] != ids[of][None, :])
                    a, b = np.nonzero(ok)
                    src.append(ids[of][b])
                    dst.append(batch["cid"].to_numpy()[mine][a])
            src, dst = np.concatenate(src), np.concatenate(dst)
            yield pd.DataFrame({"src": np.minimum(src, dst), "dst": np.maximum(src, dst)})

    truth = classes.select("cid", "label", "vector").mapInPandas(compare, "src long, dst long").distinct()
    found = truth.join(links.withColumn("found", F.lit(1)), ["src", "dst"], "left").agg(F.count(F.lit(1)), F.count("found")).first()
    return found[1] / found[0] if found[0] else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    good = rows.filter("usable")
    classes = good.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("members"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    links, _ = find_links(classes, threshold, **options)
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.join(classes.select(F.col("cid").alias("dst"), "members"), "dst").groupBy(F.col("src").alias("cid")).agg(F.sum("members").alias("others"))
    roots = connected_components(links).withColumnRenamed("id", "cid")
    named = classes.join(degree, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("component_id", "cid")).drop("component_id")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "root").select("label", "vector", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    linked = good.join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
