"""Writers under skew, drifting billing exports, exact ranks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spendlens.operators.rank import with_rank
from spendlens.sources import findings_io as io
from spendlens.sources.billing_scan import export_variants, scan_billing_export


def files_of(spark, root, where):
    rows = spark.read.parquet(root).where(where).groupBy(F.col("_metadata.file_path").alias("f")).count().collect()
    return [r["count"] for r in rows], {re.search(r"part-(\d+)-", r.f)[1] for r in rows}


@pytest.fixture
def small_partitions(spark):
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.shuffle.partitions": "6"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_hot_tenant_is_written_by_several_tasks(spark, tmp_path, small_partitions):
    n = 30_000
    rows = spark.range(n).select(
        F.when(F.col("id") < n // 3, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("tenant_id"),
        F.to_timestamp(F.lit("2024-01-05 10:00:00")).alias("run_ts"), F.sha2(F.col("id").cast("string"), 256).alias("finding_id"),
    ).repartition(12)
    io.write_findings(rows, str(tmp_path / "f"), rows_per_file=2_000)
    sizes, tasks = files_of(spark, str(tmp_path / "f"), "tenant_id = 'hot'")
    assert sum(sizes) == n // 3 and max(sizes) <= 2_000 and len(tasks) > 1
    assert spark.read.parquet(str(tmp_path / "f")).count() == n
    facts = rows.select("tenant_id", F.lit("2024-01").alias("billing_period"), F.lit("1").alias("account_id"), "finding_id")
    io.write_cost_facts(facts, str(tmp_path / "c"), rows_per_file=1_500)
    sizes, tasks = files_of(spark, str(tmp_path / "c"), "tenant_id = 'hot'")
    assert sum(sizes) == n // 3 and max(sizes) <= 1_500 and len(tasks) > 1
    # a later run replaces its own partitions only
    io.write_findings(rows.where("tenant_id = 'hot'").limit(10), str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).groupBy((F.col("tenant_id") == "hot").alias("hot")).count().orderBy("hot").collect() == [(False, n - n // 3), (True, 10)]


def test_billing_export_with_drift(spark, tmp_path):
    root = str(tmp_path / "export")
    write = lambda rows, cols, name: spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(f"{root}/{name}")
    write([("2024-01-03 00:00:00", "1", "eu-west-1", 1.5, "prod")], "line_item_usage_start_date string, line_item_usage_account_id string, product_region string, line_item_unblended_cost double, resource_tags_user_env string", "2024-01")
    # one folder whose files clash in a type, and one with other spellings and a zone only
    write([("2024-02-03 00:00:00", "2", "2.25")], "line_item_usage_start_date string, line_item_usage_account_id string, line_item_unblended_cost string", "2024-02")
    write([("2024-02-04 00:00:00", "2", 7)], "line_item_usage_start_date string, line_item_usage_account_id string, line_item_unblended_cost long", "2024-02")
    write([("2024-03-03 00:00:00", 3, "us-east-1b", "oops")], "USAGE_START_DATE string, linked_account_id long, availability_zone string, unblended_cost string", "2024-03/part")
    assert [(len(s.fields), len(p)) for s, p in export_variants(spark, root)] and len(export_variants(spark, root)) == 4
    facts = scan_billing_export(spark, root, "acme")
    got = {(r.billing_period, str(r.cost_primary)): r for r in facts.collect()}
    assert set(got) == {("2024-01", "1.500000"), ("2024-02", "2.250000"), ("2024-02", "7.000000"), ("2024-03", "None")}
    assert got["2024-01", "1.500000"].tags == {"env": "prod"} and got["2024-01", "1.500000"].region == "eu-west-1"
    assert got["2024-03", "None"].region == "us-east-1" and got["2024-03", "None"].account_id == "3"
    assert all(f"/export/{k[0]}" in r.source_file for k, r in got.items())
    with pytest.raises(Exception):
        scan_billing_export(spark, str(tmp_path / "nothing"), "acme")


def test_equal_schemas_are_one_scan(spark, tmp_path):
    root = str(tmp_path / "export")
    for month in ("01", "02", "03"):
        spark.createDataFrame([(f"2024-{month}-03 00:00:00", 1.0)], "usage_start_date string, unblended_cost double").write.parquet(f"{root}/{month}")
    assert [len(p) for _, p in export_variants(spark, root)] == [3]
    plan = scan_billing_export(spark, root, "acme")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_ranks_equal_a_window(spark, parts):
    draw = random.Random(parts)
    rows = [(draw.choice(["a", "b", None]) if draw.random() < 0.4 else "hot", draw.choice([None, 1, 2, 3, 5]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "t string, v int, id int")
    got = with_rank(df, [F.col("v").desc_nulls_last(), F.col("id")], ["t"], "r", partitions=parts)
    want = {}
    for t, v, i in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2])):
        want[i] = sum(1 for k in want if rows[k][0] == t) + 1
    assert {r.id: r.r for r in got.collect()} == want and got.columns == ["t", "v", "id", "r"]
    whole = with_rank(df, [F.col("id").desc()], name="r", partitions=parts)
    assert {r.id: r.r for r in whole.collect()} == {i: 600 - i for i in range(600)}
    assert with_rank(df.limit(0), [F.col("id")], ["t"]).collect() == []


def test_no_window_over_a_whole_tenant(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "t string, v int")
    plan = with_rank(df, [F.col("v")], ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan


def test_update_touches_its_buckets_only(spark, tmp_path):
    from spendlens.operators.history import latest_per_key
    from spendlens.operators.state_table import manifest, read_state, upsert_state

    root, keys = str(tmp_path / "state"), ["tenant_id", "workspace", "fingerprint"]
    cols = "tenant_id string, workspace string, fingerprint string, run_id string, run_ts timestamp, v int"
    frame = lambda rows: spark.createDataFrame(rows, cols)
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    first = [("t", "w", f"f{i}", "r1", day(1), i) for i in range(200)]
    assert manifest(spark, root) == (0, {})
    with pytest.raises(ValueError):
        read_state(spark, root)
    assert len(upsert_state(frame(first), root, keys, latest_per_key, buckets=16)) == 16
    before = manifest(spark, root)
    second = [("t", "w", "f3", "r2", day(2), 1000), ("t", "w", "new", "r2", day(2), 7), ("t", "w", "f9", "r0", day(0), -1), ("t", "w", None, "r2", day(2), 5)]
    touched = upsert_state(frame(second), root, keys, latest_per_key)
    after = manifest(spark, root)
    assert 1 <= len(touched) <= 4 and after[0] == before[0] + 1 and len(after[1]) == 16
    assert {b for b in range(16) if after[1][b] != before[1][b]} == set(touched)
    written = {r["bucket"] for r in spark.read.parquet(f"{root}/data/version=2").select("bucket").distinct().collect()}
    assert written == set(touched)
    order = lambda df: sorted((tuple(r) for r in df.select("fingerprint", "run_id", "v").collect()), key=repr)
    whole = latest_per_key(frame(first + second))
    assert order(read_state(spark, root)) == order(whole)
    upsert_state(frame(second), root, keys, latest_per_key)  # repeated
    assert order(read_state(spark, root)) == order(whole)
    assert upsert_state(frame([]), root, keys, latest_per_key) == []
    # an update that dies before its manifest changes nothing
    with pytest.raises(Exception):
        upsert_state(frame([("t", "w", "f1", "r9", day(9), 9)]), root, keys, lambda df: df.withColumn("v", F.raise_error(F.lit("lost")).cast("int")))
    assert order(read_state(spark, root)) == order(whole)
