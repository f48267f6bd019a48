"""SimHash near-duplicate components, pruned by pivot distance tables.

A document's fingerprint is the bitwise majority over the XXH64 of its word
shingles. Two fingerprints link when they differ in ``radius`` bits at most.

Finding the links over all rows:

1. documents with equal fingerprints form one class, so only distinct
   fingerprints are compared;
2. a fingerprint is cut into ``radius + 2`` sections. Up to ``radius`` differing
   bits leave two sections alike, so fingerprints are dealt by every pair of
   sections; fingerprints that never share such a pair cannot link;
3. inside a bucket the pivot table holds the Hamming distances of every
   fingerprint to many reference fingerprints. By the triangle inequality two
   linked fingerprints differ by ``radius`` at most in every coordinate, so pairs
   with a larger maximum difference are discarded, and the exact distance
   decides about the rest;
4. a bucket reports a spanning forest of its links, not all its pairs, and
   connected components join the forests. A bucket above ``bucket_rows`` is cut
   into chunks, and each pair of chunks is a task of its own.

Section keys were added to the method: a pivot table alone tells which pairs to
discard, but only after all pairs have been formed.

``near_components`` is exact for a small radius. ``similar_components`` works on
wider fingerprints for a resemblance such as 0.8, where no small set of sections
must agree; there the buckets are seeded samples of the bits, as many as the
wanted recall needs at the given number of documents. A bounded sample of
fingerprints is compared with all of them; where too many pairs turn out to be
missing, samples are added and in the end all chunks are compared. What links there is only a
candidate: the texts of each group of candidates are compared by their sets of
shingles, and those that really resemble each other form the components.

Defined results: null and blank texts have the fingerprint zero; in
``near_components`` they link like any other, in ``similar_components`` they
resemble nothing; a null doc_id is never the smallest of its component, and a
component of null ids only has a null component_id; repeated rows repeat their
result; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import logging
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.workers import lean
from hearthlake.operators.components import connected_components, spanning
from hearthlake.session import materialize, shuffle_partitions, write_table

BITS = 64
#: Distinct fingerprints that one task compares at most.
BUCKET_ROWS = 20_000
#: Buckets up to this size are compared side by side, larger ones by a search of their own.
SMALL = 128
#: Shingles hashed at a time, which bounds the memory of a very long text.
BLOCK = 100_000
#: Texts of a candidate group that are compared in one task; a larger group becomes pairs of such chunks.
CHUNK_TEXTS = 256
#: Shingles of other texts that are looked up at a time.
LOOKUPS = 1 << 20
#: Classes that are audited against all.
AUDIT_ROWS = 200
#: Row numbers (8 bytes each) that are counted first and then broadcast; more of them meet the rows in a shuffle.
BROADCAST_ROWS = 1_000_000
log = logging.getLogger(__name__)


def _lane(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Another 64-bit hash for each hash; lane 0 is the hash itself."""
    if lane:
        hashes = (hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        hashes = hashes ^ (hashes >> np.uint64(32))
    return hashes


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of each word shingle of the lower-cased (A-Z only) text, in blocks."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes split at the six ASCII blanks only
    if not parts:
        return
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: max(1, len(parts) - words + 1)].tolist()
    ends = ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), BLOCK):
        yield np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + BLOCK], ends[i : i + BLOCK], strict=True)], dtype="<u8")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; empty for a blank text."""
    return np.unique(np.concatenate([np.zeros(0, dtype="<u8"), *shingle_hashes(text, words)]))


def majority(blocks: Iterable[np.ndarray], lanes: int = 1) -> np.ndarray:
    """The bits that more than half of the hashes have, 64 per lane."""
    votes, n = np.zeros(lanes * BITS, dtype=np.int64), 0
    with np.errstate(over="ignore"):
        for hashes in blocks:
            n += len(hashes)
            for lane in range(lanes):
                bits = np.unpackbits(_lane(hashes, lane).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                votes[lane * BITS : (lane + 1) * BITS] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > n, bitorder="little").view("<u8")


def fingerprint(text: str | None, words: int = 3, lanes: int = 1) -> np.ndarray:
    """Unsigned SimHash of the lower-cased (A-Z only) text, 64 bits per lane."""
    return majority(shingle_hashes(text, words), lanes)


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, f0, f1, ...): each lane as the signed long of the same bits."""
    names = [f"f{i}" for i in range(lanes)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = np.zeros((len(rows), lanes), dtype=np.uint64)
            for i, t in enumerate(rows.text):
                found[i] = fingerprint(t if isinstance(t, str) else None, words, lanes)
            yield pd.DataFrame({"doc_id": rows.doc_id} | {c: found[:, i].view(np.int64) for i, c in enumerate(names)})

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInPandas(run, "doc_id long, " + ", ".join(f"{c} long" for c in names))


def section_masks(radius: int) -> list[list[int]]:
    """Masks of each pair of the radius + 2 sections of one lane."""
    n = radius + 2
    edges = [round(i * BITS / n) for i in range(n + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    return [[a | b] for a, b in itertools.combinations(masks, 2)]


def sampled_masks(lanes: int, rows: int, rate: float, recall: float, seed: int = 42) -> list[list[int]]:
    """Masks of seeded bit samples for pairs that differ in a share ``rate`` of the bits at most.

    The width follows the number of rows, so that a bucket holds about a hundred
    unrelated fingerprints whatever that number is; the number of samples is what
    the recall then needs at that rate.
    """
    width = max(8, math.ceil(math.log2(max(rows, 2))) - 7)
    differ = math.floor(rate * lanes * BITS)
    alike = math.prod((lanes * BITS - differ - i) / (lanes * BITS - i) for i in range(width))  # all bits of a sample, drawn without repeats
    count = math.ceil(math.log(1 - recall) / math.log(1 - alike))
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        picked = draw.choice(lanes * BITS, width, replace=False)
        out.append([sum(1 << int(b % BITS) for b in picked if b // BITS == lane) for lane in range(lanes)])
    return out


def pivots(count: int = 16, lanes: int = 1) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random ones."""
    return np.array([[xxhash.xxh64_intdigest(f"pivot {i} {k}".encode(), 42) for k in range(lanes)] for i in range(count)], dtype=np.uint64)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances to the references, one row per fingerprint."""
    return np.stack([hamming(fps, r) for r in refs], axis=1)


def forest(fps: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that span the components of one bucket of distinct fingerprints.

    Each fingerprint is once the centre of a search among those not reached yet.
    """
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    left = np.arange(len(fps))
    links: list[tuple[int, int]] = []
    queue: list[int] = []
    while left.size:
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        c = queue.pop()
        a, b = np.searchsorted(table[left, 0], [table[c, 0] - radius, table[c, 0] + radius + 1])
        near = left[a:b]
        for j in range(1, table.shape[1]):
            if near.size < 64:
                break
            near = near[np.abs(table[near, j] - table[c, j]) <= radius]
        if near.size:
            near = near[np.abs(table[near] - table[c]).max(axis=1) <= radius]
            near = near[hamming(fps[near], fps[c]) <= radius]
        if near.size:
            links += [(int(order[c]), int(order[x])) for x in near]
            queue += near.tolist()
            left = left[~np.isin(left, near, assume_unique=True)]
    return links


def survivors(table: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs of rows of the pivot table differ by ``radius`` at most in all coordinates.

    Coordinates are looked at one by one until two of them in a row discard nothing.
    """
    left, idle = np.arange(len(a)), 0
    for k in range(table.shape[1]):
        column = table[:, k]
        near = np.abs(column[a[left]] - column[b[left]]) <= radius
        idle = idle + 1 if near.all() else 0
        if idle == 2 or not left.size:
            break
        left = left[near]
    return left


def _bucket_links(rows: np.ndarray, refs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the buckets of one sorted run of rows (bucket, cell, class, lanes...)."""
    n = len(rows)
    keys, ids, fps = rows[:, :2], rows[:, 2], np.ascontiguousarray(rows[:, 3:]).view(np.uint64)
    change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    starts, ends = np.r_[0, change], np.r_[change, n]
    size = ends - starts
    table = np.zeros((n, len(refs)), dtype=np.int16, order="F")
    several = np.flatnonzero(np.repeat(size > 1, size))
    table[several] = distance_table(fps[several], refs)
    first, second = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    # All buckets at once: each row with the one that stands d places further on.
    left = np.flatnonzero(np.repeat(size <= SMALL, size))
    after = np.repeat(ends, size)
    for d in range(1, SMALL):
        left = left[left + d < after[left]]
        if not left.size:
            break
        i = left[survivors(table, left, left + d, radius)]
        i = i[hamming(fps[i], fps[i + d]) <= radius]
        first.append(i)
        second.append(i + d)
    a, b = spanning(np.concatenate(first), np.concatenate(second), n)
    src, dst = [ids[a]], [ids[b]]
    for a, b in zip(starts[size > SMALL], ends[size > SMALL], strict=True):
        if links := forest(fps[a:b], table[a:b], radius):
            x, y = np.array(links).T
            src.append(ids[a:b][x])
            dst.append(ids[a:b][y])
    return np.concatenate(src), np.concatenate(dst)


def links_within(classes: DataFrame, masks: list[list[int]], radius: int, bucket_rows: int = BUCKET_ROWS, references: int = 16) -> DataFrame:
    """Rows (src, dst) over ``cid``: links that span the components which the buckets show."""
    spark, lanes = classes.sparkSession, len(masks[0])
    names = [f"f{i}" for i in range(lanes)]
    refs = pivots(references, lanes)
    signed = lambda m: m - (1 << 64) if m >> 63 else m

    def key(number: int, mask: list[int]) -> Column:
        return F.xxhash64(F.lit(number), *(F.col(c).bitwiseAND(F.lit(signed(m))) for c, m in zip(names, mask, strict=True) if m))

    dealt = classes.select("cid", *names, F.explode(F.array(*(key(i, m) for i, m in enumerate(masks)))).alias("bucket")).select("bucket", F.lit(0).cast("long").alias("cell"), "cid", *names)
    large = materialize(dealt.groupBy("bucket").count().filter(F.col("count") > bucket_rows))
    if not large.isEmpty():
        chunks = F.ceil(F.col("count") / bucket_rows)
        cut = dealt.join(large, "bucket").withColumn("own", F.pmod(F.xxhash64("cid"), chunks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
        cut = cut.select("bucket", (F.least("own", "other") * chunks + F.greatest("own", "other") + 1).alias("cell"), "cid", *names)
        dealt = dealt.join(large, "bucket", "left_anti").select("bucket", "cell", "cid", *names).unionByName(cut)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []  # rows of a bucket that may go on in the next batch

        def links(rows: np.ndarray) -> pd.DataFrame:
            src, dst = _bucket_links(rows, refs, radius)
            return pd.DataFrame({"src": src, "dst": dst})

        for batch in batches:
            rows = batch[["bucket", "cell", "cid", *names]].to_numpy(dtype=np.int64)
            if not len(rows):
                continue
            same = (rows[:, :2] == rows[-1, :2]).all(axis=1)
            last = len(rows) - int(same[::-1].argmin()) if not same.all() else 0
            if last:
                yield links(np.concatenate([*held, rows[:last]]))
                held = [rows[last:]]
            elif held and (held[0][0, :2] != rows[0, :2]).any():
                yield links(np.concatenate(held))
                held = [rows]
            else:
                held.append(rows)
        if held:
            yield links(np.concatenate(held))

    sorted_rows = dealt.repartition(shuffle_partitions(spark), "bucket", "cell").sortWithinPartitions("bucket", "cell")
    return sorted_rows.mapInPandas(run, "src long, dst long")


def near_components(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id. No link is missed."""
    prints = materialize(fingerprints(docs, words, 1, id_col, text_col))
    classes = materialize(prints.groupBy("f0").agg(F.min("doc_id").alias("least")).withColumn("cid", F.monotonically_increasing_id()))
    found = connected_components(links_within(classes, section_masks(radius), radius, bucket_rows), local_passes=3)
    rooted = classes.join(found.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.coalesce("component_id", "cid")).drop("component_id")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = prints.join(rooted.join(smallest, "root").select("f0", "component_id"), "f0")
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def difference_rate(resemblance: float) -> float:
    """Share of SimHash bits in which two sets of this Jaccard resemblance differ on average."""
    return math.acos(2 * resemblance / (1 + resemblance)) / math.pi


def set_prints(docs: DataFrame, words: int, lanes: int, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` as a table, each with a number of its own and a print of its set of shingles.

    The print has the size of the set, its SimHash f0, f1, ... and a digest of the whole set.
    """
    names = [f"f{i}" for i in range(lanes)] + ["s0", "s1"]

    def of_texts(texts: pd.Series) -> pd.DataFrame:
        found = np.zeros((len(texts), lanes + 3), dtype=np.uint64)
        for i, t in enumerate(texts):
            shingles = shingle_set(t if isinstance(t, str) else None, words)
            found[i, 0] = len(shingles)
            if len(shingles):
                blocks = (shingles[k : k + BLOCK] for k in range(0, len(shingles), BLOCK))
                found[i, 1 : lanes + 1] = majority(blocks, lanes)
                found[i, lanes + 1 :] = np.frombuffer(xxhash.xxh128_digest(shingles.tobytes()), dtype="<u8")
        return pd.DataFrame({c: found[:, k].view(np.int64) for k, c in enumerate(["size", *names])})

    @F.pandas_udf("size long, " + ", ".join(f"{c} long" for c in names))
    @lean
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return map(of_texts, batches)

    return write_table(docs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__print", prints(docs[text_col].cast("string"))))


def resembling(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that span the components of the given sets by their exact Jaccard similarity.

    Each set is once the centre of a search among those not reached yet.
    """
    size = np.array([len(x) for x in sets])
    left = np.arange(len(sets))
    links: list[tuple[int, int]] = []
    queue: list[int] = []
    while left.size:
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        c = queue.pop()
        able = left[np.minimum(size[left], size[c]) / np.maximum(size[left], size[c]) >= similarity]
        reached: list[int] = []
        part = np.cumsum(size[able]) // LOOKUPS
        for near in (able[part == k] for k in np.unique(part)):
            values = np.concatenate([sets[x] for x in near])
            at = np.searchsorted(sets[c], values)
            at[at == size[c]] = 0
            common = np.add.reduceat(sets[c][at] == values, np.cumsum(size[near]) - size[near], dtype=np.int64)
            reached += near[common / (size[near] + size[c] - common) >= similarity].tolist()
        if reached:
            links += [(c, x) for x in reached]
            queue += reached
            left = left[~np.isin(left, reached, assume_unique=True)]
    return links


def resembling_components(members: DataFrame, texts: DataFrame, words: int, similarity: float, chunk_texts: int = CHUNK_TEXTS) -> DataFrame:
    """Rows (id, component_id) over ``cid`` for what resembles another text of its ``group``.

    All pairs of a group are covered: a large group is cut into chunks, and each
    pair of chunks is a task of its own; only their results have to be united.
    """
    spark = members.sparkSession
    with_text = lambda rows: rows.join(texts, "__row").select("group", "cell", "cid", "t")
    whole = members.withColumn("cell", F.lit(0).cast("long"))
    large = materialize(members.groupBy("group").count().filter(F.col("count") > chunk_texts))

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, sets = None, [], []

        def links() -> pd.DataFrame:
            a, b = spanning(*np.array(resembling(sets, similarity), dtype=np.int64).reshape(-1, 2).T, len(ids))
            names = np.array(ids, dtype=np.int64)
            return pd.DataFrame({"src": names[a], "dst": names[b]})

        for batch in batches:
            for group, cell, cid, text in zip(batch["group"], batch["cell"], batch["cid"], batch["t"], strict=True):
                if (group, cell) != key:
                    if len(ids) > 1:
                        yield links()
                    key, ids, sets = (group, cell), [], []
                ids.append(cid)
                sets.append(shingle_set(text, words))
        if len(ids) > 1:
            yield links()

    def linked(rows: DataFrame) -> DataFrame:
        return rows.repartition(shuffle_partitions(spark), "group", "cell").sortWithinPartitions("group", "cell").mapInPandas(run, "src long, dst long")

    if large.isEmpty():
        return linked(with_text(whole)).toDF("id", "component_id")
    chunks = F.ceil(F.col("count") / chunk_texts)
    cut = members.join(large, "group").withColumn("own", F.pmod(F.xxhash64("cid"), chunks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    cut = with_text(cut.select("group", (F.least("own", "other") * chunks + F.greatest("own", "other")).alias("cell"), "cid", "__row"))
    return linked(with_text(whole.join(large, "group", "left_anti"))).toDF("id", "component_id").unionByName(connected_components(linked(cut), local_passes=3))


def audit_groups(classes: DataFrame, groups: DataFrame, radius: int, rows: int = AUDIT_ROWS, seed: int = 3) -> float:
    """Share of the pairs within the radius, of a bounded sample of classes with all classes, that lie in one candidate group.

    Half of the sample is drawn among the classes that have a group, as most others have no pair.
    """
    names = [c for c in classes.columns if c[0] == "f" and c[1:].isdigit()]
    lot = [F.xxhash64(F.lit(seed), "cid"), F.col("cid")]
    linked = groups.select(F.col("id").alias("cid")).orderBy(*lot).limit(rows // 2)
    others = classes.select("cid").orderBy(*lot).limit(rows - rows // 2)
    sample = classes.join(F.broadcast(linked.union(others).distinct()), "cid", "left_semi").select("cid", *names).toPandas()
    ids, fps = sample["cid"].to_numpy(np.int64), sample[names].to_numpy(np.int64).view(np.uint64)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            mine, all_fps = batch["cid"].to_numpy(np.int64), batch[names].to_numpy(np.int64).view(np.uint64)
            src, dst = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for i, f in zip(ids, fps, strict=True):
                hit = mine[(hamming(all_fps, f) <= radius) & (mine != i)]
                src.append(np.full(len(hit), i))
                dst.append(hit)
            yield pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst)})

    pairs = classes.select("cid", *names).mapInPandas(near, "src long, dst long")
    of = lambda end: groups.select(F.col("id").alias(end), F.col("component_id").alias(f"{end}_group"))
    met = pairs.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    found = met.agg(F.count(F.lit(1)), F.count_if(F.col("src_group") == F.col("dst_group"))).first()
    return found[1] / found[0] if found[0] else 1.0


def candidate_groups(classes: DataFrame, lanes: int, rate: float, radius: int, recall: float, bucket_rows: int, retries: int = 1) -> DataFrame:
    """Rows (id, component_id): groups of classes joined by pairs within the radius.

    The bit samples are audited. Where more pairs are missing than ``recall`` allows for,
    as many other samples are added; if that does not help, all chunks of classes are compared with each other.
    """
    rows, links = classes.count(), None
    for attempt in range(retries + 1):
        more = links_within(classes, sampled_masks(lanes, rows, rate, recall, 42 + attempt), radius, bucket_rows)
        links = materialize(more if links is None else links.unionByName(more))
        del more  # so that its shuffle can be given up
        groups = materialize(connected_components(links, local_passes=3))  # read several times
        share = audit_groups(classes, groups, radius)
        log.info("candidate pairs within %d bits found: %.4f of the audited ones (%d classes)", radius, share, rows)
        if share >= 1 - 2 * (1 - recall):
            return groups
    return connected_components(links_within(classes, [[0] * lanes], radius, bucket_rows), local_passes=3)


def _by_row(rows: DataFrame, numbers: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of whole rows with a table of row numbers; the rows stay where they are if the numbers are few."""
    return rows.join(F.broadcast(numbers) if numbers.count() <= BROADCAST_ROWS else numbers, "__row", how)


def _similar(docs: DataFrame, words: int, similarity: float, lanes: int, recall: float, id_col: str, text_col: str, bucket_rows: int, chunk_texts: int) -> tuple[DataFrame, DataFrame]:
    """The numbered rows of ``docs``, and for each row that isn't blank the first row of its component."""
    rate = difference_rate(similarity)
    loose = rate + 2 * math.sqrt(rate * (1 - rate) / (lanes * BITS))
    radius = math.floor(loose * lanes * BITS)
    names = [f"f{i}" for i in range(lanes)] + ["s0", "s1"]
    rows = set_prints(docs, words, lanes, id_col, text_col)
    prints = rows.select(F.col("__row").alias("row"), F.col(id_col).cast("long").alias("doc_id"), "__print.*").filter("size > 0").drop("size")
    # Equal sets form one class, named by its smallest id; its first row stands for its text.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    classes = materialize(prints.groupBy(*names).agg(first).withColumn("cid", F.monotonically_increasing_id()))
    found = candidate_groups(classes, lanes, loose, radius, recall, bucket_rows)
    members = materialize(classes.select("cid", F.col("first.row").alias("__row")).join(found.select(F.col("id").alias("cid"), F.col("component_id").alias("group")), "cid"))
    # Only the texts of candidates go through a shuffle.
    texts = _by_row(rows.select("__row", F.col(text_col).cast("string").alias("t")), members.select("__row"), "left_semi")
    same = materialize(resembling_components(members, texts, words, similarity, chunk_texts))
    rooted = classes.join(same.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.coalesce("component_id", "cid")).drop("component_id")
    named = rooted.drop("first").join(rooted.groupBy("root").agg(F.min("first").alias("first")), "root").select(*names, "first")
    return rows, prints.join(named, names).select("row", "first")


def similar_components(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = 4, recall: float = 0.99, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, chunk_texts: int = CHUNK_TEXTS
) -> DataFrame:
    """One row per document: doc_id and the component of texts that resemble each other.

    Texts link when the Jaccard similarity of their sets of shingles is at least
    the given one. Compared are the texts of each candidate group, whose
    fingerprints of 64 * lanes bits differ in no larger share of bits than sets
    of that similarity do on average, plus two standard errors.
    """
    rows, found = _similar(docs, words, similarity, lanes, recall, id_col, text_col, bucket_rows, chunk_texts)
    named = rows.select("__row", F.col(id_col).cast("long").alias("doc_id")).join(found, F.col("__row") == F.col("row"), "left")
    return named.select("doc_id", F.when(F.col("row").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))


def drop_near_duplicates(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = 4, recall: float = 0.99, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, chunk_texts: int = CHUNK_TEXTS
) -> DataFrame:
    """The rows of ``docs`` that come first in their component by id, with all their columns; blank texts stay."""
    rows, found = _similar(docs, words, similarity, lanes, recall, id_col, text_col, bucket_rows, chunk_texts)
    dropped = materialize(found.filter("row <> first.row").select(F.col("row").alias("__row")))
    return _by_row(rows, dropped, "left_anti").select(*docs.columns)
