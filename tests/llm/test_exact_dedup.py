import hashlib
import re

from helpers import documents
from pyspark.sql import functions as F

from hearthlake.llm import exact_dedup

LONG = "word " * 40_000


def plain(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    out = []
    for i, t, _ in rows:
        own = groups[norm(t)]
        keep = min(own, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((i, keep, len(own), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "a b", "s"), (2, "ab", "s"), (3, "a\tb ", None), (4, None, "s"), (5, "", "s"), (6, " \n", "s"), (7, LONG, "s"), (8, LONG + " ", "t"), (9, "ä b", "s"), (9, "ä b", "s"), (None, "ab", "s"), (-5, "zz", "s"), (2**62, "z z", "s"), (11, "a\x1cb", "s")]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_groups_match_plain_version(spark):
    assert rows_of(exact_dedup.duplicate_groups(documents(spark, ROWS))) == plain(ROWS)


def test_contents_are_compared_not_digests(spark):
    weak = lambda content: F.substring(F.sha2(content, 256), 1, 1)
    rows = ROWS + [(100 + i, f"text {i % 30}", "s") for i in range(120)]
    assert rows_of(exact_dedup.duplicate_groups(documents(spark, rows), digest=weak)) == plain(rows)


def test_empty_table_and_dropping(spark):
    docs = documents(spark, ROWS)
    assert exact_dedup.duplicate_groups(docs.limit(0)).count() == 0
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 6, 8, 9, 11, 2**62]


def test_rows_with_repeated_or_null_ids_are_dropped_one_by_one(spark):
    rows = [(1, "aaa", "s"), (2, "bbb", "s"), (2, "aaa", "s"), (None, "q", "s"), (None, "aaa", "s"), (None, "q ", "s"), (None, "q", "s"), (7, "z", "s"), (7, "z  ", "s"), (7, "z", "s")]
    kept = exact_dedup.drop_exact_duplicates(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(1, "aaa"), (2, "bbb"), (None, "q "), (7, "z  ")], key=repr)
    assert exact_dedup.drop_exact_duplicates(documents(spark, rows).withColumnRenamed("rank", "row")).columns[-1] == "row"
