"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed to completion with the no-op sink (full plan, no
driver collect), once to warm up and then timed. The DuckDB oracle for the
same query is timed alongside as the single-node baseline when
BENCH_BASELINE=1 (single run each). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]

    from spendlens.plans.registry import load_all
    from spendlens.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(max(8, int(cpus) * 2)))))
    reg = load_all()
    heads = names or [n for n, e in reg.items() if e.headline]

    # warm the JVM and the parquet footers once
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("count(*)").collect()

    spark_times: dict[str, float] = {}
    for n in heads:
        df = reg[n].fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()  # warm-up (plan + JIT)
        ts = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            reg[n].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            ts.append(time.perf_counter() - t0)
        spark_times[n] = round(statistics.median(ts), 3)

    duck_times: dict[str, float] = {}
    if os.environ.get("BENCH_BASELINE", "0") != "1":
        heads_for_duck: list[str] = []
    else:
        heads_for_duck = heads
    try:
        if not heads_for_duck:
            raise StopIteration
        import duckdb

        from spendlens.sources.tables import TABLES

        con = duckdb.connect()
        con.execute(f"PRAGMA threads={int(cpus)}")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        for n in heads_for_duck:
            sql = reg[n].oracle
            if not sql:
                continue
            t0 = time.perf_counter()
            con.sql(sql).fetchall()
            duck_times[n] = round(time.perf_counter() - t0, 3)
    except StopIteration:
        pass
    except Exception as e:  # noqa: BLE001 - the baseline is informative only
        duck_times["error"] = str(e)[:200]

    sf = sf_dir.rsplit("sf", 1)[-1]
    out = {
        "metric": "headline_total",
        "value": round(sum(spark_times.values()), 3),
        "unit": "sec",
        "queries": spark_times,
        **({"duckdb_oracle_sec": duck_times} if duck_times else {}),
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
