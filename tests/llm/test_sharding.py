import zlib
from collections import Counter

import numpy as np
from helpers import documents

from hearthlake.llm import sharding


def test_permutation_and_its_inverse():
    for n in (1, 2, 3, 5, 17, 1000, 4097):
        p = sharding.permute(np.arange(n), n, 7)
        assert sorted(p.tolist()) == list(range(n))
        assert sharding.permute(p, n, 7, backward=True).tolist() == list(range(n))
        shard, slot = sharding.place(np.arange(n), n, 5, 7)
        assert sharding.row_at(shard, slot, n, 5, 7).tolist() == list(range(n))
    assert sharding.permute(np.arange(1000), 1000, 7).tolist() != sharding.permute(np.arange(1000), 1000, 8).tolist()
    assert np.abs(np.corrcoef(np.arange(4000), sharding.permute(np.arange(4000), 4000, 1))[0, 1]) < 0.06


def test_shards_are_even_and_reproducible(spark, tmp_path):
    rows = [(i * 3 % 501, f"text {i} ä", "s") for i in range(501)] + [(700, None, "s"), (701, "", "s"), (5, "other", "s"), (5, "other", "s"), (None, "n", "s"), (702, "x" * 200_000, "s")]
    docs = documents(spark, rows)
    got = sharding.shard_rows(docs).collect()
    assert sorted(r.row_number for r in got) == list(range(len(rows)))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    count = Counter(r.shard for r in got)
    assert set(count) <= set(range(24)) and max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    again = sharding.shard_rows(docs.repartition(7)).collect()
    key = lambda rs: sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in rs)
    assert key(got) == key(again)
    assert sharding.shard_rows(docs.limit(0)).count() == 0
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and set(docs.columns) < set(back.columns)


def plain_place(number, n, seed=20240229, rounds=6, shards=24):
    """Where a row number goes, with plain integers: a Feistel network over two halves, walked until it lands below n."""
    full = 2**64

    def scramble(x, key):
        x = (x + key) % full
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % full
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % full
        return x ^ (x >> 31)

    keys = [scramble((i + 1) * 0x9E3779B97F4A7C15 % full, seed) for i in range(rounds)]
    bits = 1
    while 4**bits < max(n, 2):
        bits += 1
    x = number
    while True:
        left, right = x >> bits, x & (2**bits - 1)
        for k in keys:
            left, right = right, left ^ (scramble(right, k) & (2**bits - 1))
        x = (right << bits) | left
        if x < n:
            return x % shards, x // shards


def test_query_puts_every_row_where_the_plain_permutation_does(spark, tmp_path):
    from hearthlake.llm import queries

    rows = [(i * 7 % 400, f"text {i} ä", "s") for i in range(400)] + [(None, "none", "s"), (401, None, "s"), (402, "", "s"), (5, "other", "s"), (403, "y" * 70_000, "s")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op10_sharding(spark, str(tmp_path))
    assert got.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    raw = [((t or "").encode(), i) for i, t, _ in rows]
    order = sorted((i is not None, i or 0, zlib.crc32(t), len(t)) for t, i in raw)
    want = [(i if known else None, size + 8, crc, "rows", *plain_place(k, len(rows)), None) for k, (known, i, crc, size) in enumerate(order)]
    assert sorted((tuple(r)[:7] for r in got.collect()), key=repr) == sorted(want, key=repr)
