import numpy as np
from llm_helpers import prose
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from spendlens.llm.license_scan import _vectors
from spendlens.llm.softmax_fit import LocalLoss, fit_in_rounds, model_of, summed_loss

SIZE, WEIGHT = 128, 0.1


def made(spark):
    """Two small labels, and 2,000 rows of label 0 that share words with them."""
    given = [(float(1 + i % 2), f"released under {'aaa' if i % 2 else 'bbb'} {prose(3, i)}") for i in range(60)]
    known = _vectors(spark.createDataFrame(given, "label double, paragraph string"), SIZE).select("label", "vector").cache()
    rows = [(i, prose(8, 100 + i) + (" under aaa" if i % 97 == 0 else "")) for i in range(2000)]
    return known, _vectors(spark.createDataFrame(rows, "id long, paragraph string"), SIZE).select("id", "vector").cache()


def test_rounds_reach_the_fit_over_all_rows(spark):
    known, rows = made(spark)
    whole = known.withColumn("weight", F.lit(1.0)).unionByName(rows.select(F.lit(0.0).alias("label"), "vector", F.lit(WEIGHT).alias("weight")))
    want = LogisticRegression(featuresCol="vector", labelCol="label", weightCol="weight", family="multinomial", regParam=1e-3, maxIter=1000, tol=1e-12, standardization=False).fit(whole)

    def worst(rounds, part):
        got = fit_in_rounds(known, rows, 2000, WEIGHT, part, SIZE, 3, 1e-3, rounds=rounds, tol=1e-8)
        chances = [np.array([r.c for r in m.transform(rows).orderBy("id").select(vector_to_array("probability").alias("c")).collect()]) for m in (got, want)]
        return abs(chances[0] - chances[1]).max()

    assert worst(1, F.lit(True)) < 1e-3  # the same objective
    assert worst(1, F.col("id") % 4 == 1) > 0.02  # the part alone is another model
    assert worst(12, F.col("id") % 4 == 1) < 2e-3


def test_gradient_is_summed_over_every_row(spark):
    known, rows = made(spark)
    theta = np.random.default_rng(3).normal(size=(SIZE + 1, 3))
    model = model_of(spark, theta)
    assert np.allclose(model.coefficientMatrix.toArray(), theta[:-1].T) and np.allclose(model.interceptVector.toArray(), theta[-1])
    local = LocalLoss([r.vector.indices for r in rows.collect()], np.zeros(2000), np.ones(2000), SIZE)
    assert all(np.allclose(a, b) for a, b in zip(summed_loss(model, rows), local(theta)))
    step = 1e-6 * np.random.default_rng(4).normal(size=theta.shape)
    assert np.isclose(local(theta + step)[0] - local(theta - step)[0], 2 * (step * local(theta)[1]).sum(), rtol=1e-4)
