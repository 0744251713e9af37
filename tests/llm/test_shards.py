import bisect
from collections import Counter, defaultdict

from llm_helpers import collected, crc, documents, prose, texts
from pyspark.sql import functions as F

from spendlens.llm.shards import find_splitters, histogram_shards


def test_shards_cover_all_rows_with_gapless_slots(spark):
    got = collected(histogram_shards(documents(spark), n_shards=4).select("doc_id", "text", "size", "shard", "slot"))
    want = sorted(((i, crc(t), len((t or "").encode()) + 1) for i, t in texts()), key=repr)
    assert sorted(((i, crc(t), s) for i, t, s, _, _ in got), key=repr) == want
    slots = defaultdict(list)
    for *_, shard, slot in got:
        slots[shard].append(slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(slots) <= set(range(4))


def test_near_equal_bytes_even_with_a_hot_text(spark):
    rows = [(i, prose(20, i % 200)) for i in range(2000)] + [(5000 + i, "hot copy " * 9) for i in range(1000)]
    got = histogram_shards(documents(spark, rows), n_shards=8).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = [r["s"] for r in got]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.02 * sum(sizes) / 8 + 2 * 400


def test_near_equal_bytes_even_with_repeated_rows(spark):
    rows = [(i, prose(20, i % 200)) for i in range(2000)] + [(None, "hot row " * 9)] * 1000 + [(77, "again and again " * 5)] * 1000
    got = collected(histogram_shards(documents(spark, rows), n_shards=8).select("doc_id", "text", "size", "shard", "slot"))
    assert Counter((i, t) for i, t, *_ in got) == Counter(rows)
    sizes, slots = Counter(), defaultdict(list)
    for _, _, size, shard, slot in got:
        sizes[shard] += size
        slots[shard].append(slot)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 8 + 2 * 400
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    # equal texts of a shard follow each other
    hot = {s: [x for _, t, _, shard, x in got if shard == s and t.startswith("hot row")] for s in sizes}
    assert all(max(x) - min(x) == len(x) - 1 for x in hot.values() if x) and sum(map(bool, hot.values())) > 1


def test_splitter_counts_are_exact(spark):
    rows = [(i * 7919 % 1000003, i * 104729 % 1000, 1 + i % 50) for i in range(3000)]
    rows = [(a << 43, b << 53, s) for a, b, s in rows]
    found = find_splitters(spark.createDataFrame(rows, "k1 long, k2 long, size long"), 5, 0.01, 1 << 30)
    keys = sorted(((a << 63) + b, s) for a, b, s in rows)
    only = [k for k, _ in keys]
    for k, bytes_below, rows_below in zip(found.keys, found.bytes_below, found.rows_below):
        n = bisect.bisect_left(only, k)
        assert rows_below == n and bytes_below == sum(s for _, s in keys[:n])


def test_empty_table(spark):
    assert collected(histogram_shards(documents(spark, []))) == []
