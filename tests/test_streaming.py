"""Streaming ingest twin equals the batch ingest (presence and latest)."""

import tempfile

from spendlens.operators.history import latest_per_key, presence_rows
from spendlens.operators.state_table import read_state
from spendlens.plans.inputs import findings
from spendlens.streaming.ingest_stream import start_ingest_stream

SF = "/root/testdata/sf0.001"


def _rows(df, cols):
    return sorted(tuple(str(x) for x in r) for r in df.select(*cols).collect())


def test_stream_matches_batch(spark):
    root = tempfile.mkdtemp(prefix="spendlens-stream-")
    f = findings(spark, SF)
    # land the findings as two file drops
    f.where("run_id < 'run-1998'").write.parquet(f"{root}/in/drop1")
    q = start_ingest_stream(spark, f"{root}/in/*", f"{root}/presence", f"{root}/latest", f"{root}/ckpt", buckets=8)
    q.awaitTermination(300)
    f.where("run_id >= 'run-1998'").write.parquet(f"{root}/in/drop2")
    q = start_ingest_stream(spark, f"{root}/in/*", f"{root}/presence", f"{root}/latest", f"{root}/ckpt", buckets=8)
    q.awaitTermination(300)
    pres = spark.read.parquet(f"{root}/presence")
    lat = read_state(spark, f"{root}/latest")
    cols = ["tenant_id", "workspace", "run_id", "fingerprint", "finding_id", "estimated_monthly_savings"]
    batch_p = presence_rows(f)
    assert _rows(pres, cols) == _rows(batch_p, cols)
    assert _rows(lat, cols) == _rows(latest_per_key(batch_p), cols)


def test_sla_stream_equals_the_replay(spark, tmp_path):
    """Events in three drops, each out of order and one late by days, with a restart between them."""
    import datetime as dt
    import random

    import test_governance as tg

    from pyspark.sql import functions as F
    from spendlens.operators import governance as G
    from spendlens.streaming.sla_stream import ROCKSDB, sla_stream

    latest, events, extensions = tg.random_log(5, 12)
    rows = [("t", "w", e[3], "finding", e[4], e[5], e[6], None) for e in events] + [("t", "w", e[2], "extension", None, None, e[4], e[3]) for e in extensions]
    rows.sort(key=lambda r: r[6])
    cut = [rows[: len(rows) // 3], rows[len(rows) // 3 : 2 * len(rows) // 3], rows[2 * len(rows) // 3 :]]
    end = max(r[6] for r in rows) + dt.timedelta(days=400)
    cut.append([("t", "w", "beat", "finding", "open", None, end, None), ("t", "w", "beat", "finding", "open", None, end + dt.timedelta(days=1), None)])
    schema = "tenant_id string, workspace string, fingerprint string, source string, state string, snooze_until timestamp, event_ts timestamp, days int"
    frame = spark.createDataFrame([*latest, ("t", "w", "beat", "chk", "none", None, tg.T0)], tg.LATEST)
    days = G.resolve_sla_days(frame, G.default_policies(spark)).select("tenant_id", "workspace", "fingerprint", "sla_days", "detected_at").cache()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        for n, part in enumerate(cut):
            random.Random(n).shuffle(part)
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            keep = lambda batch, epoch: batch.write.mode("append").parquet(str(tmp_path / "out"))
            q = sla_stream(stream, days, delay="30 days").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
            assert q.awaitTermination(300) and q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    out = spark.read.parquet(str(tmp_path / "out"))
    newest = out.groupBy("tenant_id", "workspace", "fingerprint").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("tenant_id", "workspace", "fingerprint")]), "folded").alias("r")).select("tenant_id", "workspace", "fingerprint", "r.*")
    want = tg.replayed(spark, latest, events, extensions)
    got = {r.fingerprint: r for r in newest.collect() if r.fingerprint != "beat"}
    assert set(got) == set(want)
    for fp, w in want.items():
        assert {c: got[fp][c] for c in w.asDict()} == w.asDict()
