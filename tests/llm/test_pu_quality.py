import zlib

import numpy as np
import pyarrow as pa
from llm_helpers import collected, documents, prose, texts
from pyspark.sql import functions as F

from spendlens.llm.pu_quality import N_FEATURES, column_features, fit, held_out, quality_scores, train


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy_on_the_test_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 40 and np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_scores_are_those_of_the_model_for_every_row(spark):
    rows = texts()
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0, "k") for i in range(12)] + [(None, 1, 0, "k"), (3, None, 0, "k"), (4, 0, 0, "k")], "doc_id long, quality int, toxic int, KEY string")
    model = train(docs.select("doc_id", "text"), labels)
    want = model.score(column_features(pa.array([t for _, t in rows], pa.string())))
    got = collected(quality_scores(docs, labels))
    assert sorted(got, key=repr) == sorted([(i, held(i) if i is not None else True, float(s), int(s >= 0.3)) for (i, _), s in zip(rows, want)], key=repr)


def test_held_out_labels_do_not_matter(spark):
    docs = documents(spark, [(i, prose(40, i) if i % 4 else "bad bad bad " * 9) for i in range(60)])
    made = [(i, int(i % 4 != 0)) for i in range(60)]
    flipped = [(i, 1 - q if held(i) else q) for i, q in made]
    a, b = (train(docs.select("doc_id", "text"), spark.createDataFrame(x, "doc_id long, quality int")) for x in (made, flipped))
    assert a.prior == b.prior and all((x[0] == y[0]).all() for x, y in zip(a.nets, b.nets))


def test_held_out_rule(spark):
    rows = spark.range(200).select("id", held_out(F.col("id"))).collect()
    assert all(h == held(i) for i, h in rows)


def test_risk_separates_hidden_negatives():
    r = np.random.default_rng(0)
    good, bad = r.normal(1, 1, (3000, N_FEATURES)), r.normal(-1, 1, (900, N_FEATURES))
    model = fit(good[:1000], np.concatenate([good[1000:], bad]), 2000 / 2900)
    assert (model.score(good[1000:]) >= 0.3).mean() > 0.97 and (model.score(bad) < 0.3).mean() > 0.97


def test_no_positives_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = collected(quality_scores(documents(spark), none))
    assert len(got) == len(texts()) and {r[2] for r in got} == {0.5}
    assert collected(quality_scores(documents(spark, []), none)) == []


def test_features_do_not_depend_on_slices():
    rows = [t for _, t in texts()]
    whole = column_features(pa.array(rows, pa.string()))
    one = np.concatenate([column_features(pa.array([t], pa.string())) for t in rows])
    assert np.allclose(whole, one) and np.isfinite(whole).all()
