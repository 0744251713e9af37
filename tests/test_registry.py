"""Driver contract: entry() runs, every oracle key is a registered query, bindings are deterministic."""

import __spark_entry__ as E

from spendlens.operators.contract import logical_hash
from spendlens.plans.inputs import findings


def test_entry_and_keys(spark):
    df = E.entry(spark)
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


def test_logical_hash_partition_invariant(spark):
    sf = "/root/testdata/sf0.001"
    hashes = set()
    for parts in ("1", "4", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        f = findings(spark, sf).repartition(int(parts))
        hashes.add(tuple(logical_hash(f).first()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(hashes) == 1
