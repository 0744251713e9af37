import hashlib

import corpus_pipeline as C
import pyarrow as pa
from llm_helpers import collected
from test_decontaminate import brute as contamination
from test_jaccard_forest import brute as classes

from spendlens.llm.pu_quality import column_features, train
from spendlens.llm.quality_rules import quality_rules

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force_on_the_rows_kept_before(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = collected(docs.select("doc_id", "text"))
    model = train(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    good = model.score(column_features(pa.array([t for _, t in rows], pa.string()))) >= C.QUALITY_THRESHOLD
    want = [r for r, g in zip(rows, good) if g]
    after = [want]
    passed = {r["doc_id"] for r in quality_rules(docs.where(docs.doc_id.isin([i for i, _ in want]))).where("kept").collect()}
    after.append([r for r in after[-1] if r[0] in passed])
    after.append([r for r, c in zip(after[-1], classes(after[-1])) if c[0] == c[1]])
    after.append([r for r, c in zip(after[-1], contamination(after[-1], bench)) if not c[2]])
    assert 0 < len(after[-1]) < len(after[0]) < len(rows)
    now = docs
    for (_, stage), expected in zip(C.STAGES[:-1], after):
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        assert sorted(r[0] for r in collected(now.select("doc_id"))) == sorted(r[0] for r in expected)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(C.tokenizer_path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in C.run(spark, SF).collect()}
    assert set(got) == {i for i, _ in after[-1]}
    for i, t in after[-1]:
        assert list(got[i]["ids"]) == tok.encode(t, add_special_tokens=False).ids
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_stage_list():
    assert len(C.STAGES) == 5 and C.ORACLE_SQL is None


def test_runs_again_in_the_same_session_and_on_odd_rows(spark, tmp_path):
    first = sorted(r["doc_id"] for r in C.run(spark, SF).select("doc_id").collect())
    assert sorted(r["doc_id"] for r in C.run(spark, SF).select("doc_id").collect()) == first
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0).selectExpr("*", "cast('x' as string) AS KEY", "1L AS size")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).collect() == []


def test_workers_keep_only_the_running_operators_caches():
    from spendlens.llm.common import begin, owned, process_cache

    begin("one")
    process_cache("tables")["x"] = 1
    begin("one")
    assert process_cache("tables") == {"x": 1}
    assert list(owned("two", lambda batches: (process_cache("tables").get("x"), *batches))([7])) == [None, 7]
