import math

import pytest
from llm_helpers import collected, documents, prose
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from spendlens.llm.license_scan import _quantile, _vectors, scan_corpus, scan_licences, train_scanner

LINES = {
    "MIT": ["Released under the MIT License.", "MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "Apache": ["Licensed under the Apache License, Version 2.0."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0."],
}


def test_families_unknown_and_plain_text(spark):
    rows, want = [], []
    for f, lines in LINES.items():
        for t in lines:
            rows.append((len(rows), prose(40, len(rows)) + "\n" + t + "\n\n" + prose(12, 50 + len(rows))))
            want.append((len(rows) - 1, 1, f))
    rows += [(100 + i, prose(60, 900 + i)) for i in range(60)] + [(200, None), (201, ""), (None, "x\nMIT License"), (203, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."), (204, prose(20_000, 5))]
    want += [(None, 1, "MIT"), (203, 0, "CC-BY-NC"), (203, 1, "CC-BY-NC")]
    docs = documents(spark, rows)
    got = collected(scan_licences(docs, train_scanner(docs, sample=300)).select("doc_id", "position", "family"))
    assert sorted((r for r in got if r[2] != "unknown"), key=repr) == sorted(want, key=repr)
    assert sum(r[2] == "unknown" for r in got) <= 2


def test_neighbours_of_known_families_are_unknown(spark):
    lines = ["Licensed under CC BY-NC-ND 4.0.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-ND 4.0.", "This work is licensed under the GNU Affero General Public License, version 3."]
    known = {"CC-BY": "Licensed under CC BY 4.0.", "CC-BY-SA": "Licensed under CC BY-SA 4.0.", "LGPL": "Released under the GNU Lesser General Public License, version 3.", "GPL": "Released under the GNU General Public License, version 3."}
    rows = [(i, prose(60, 900 + i)) for i in range(60)] + [(100 + i, t) for i, t in enumerate(lines)] + [(200 + i, t) for i, t in enumerate(known.values())]
    docs = documents(spark, rows)
    got = dict(collected(scan_licences(docs, train_scanner(docs, sample=300)).where("doc_id >= 100").select("doc_id", "family")))
    assert got == {100 + i: "unknown" for i in range(len(lines))} | {200 + i: f for i, f in enumerate(known)}


def test_empty_table(spark):
    docs = documents(spark, [])
    assert collected(scan_licences(docs, train_scanner(docs, sample=10))) == []


def test_every_ordinary_paragraph_is_fitted_or_calibrates(spark):
    """Far more paragraphs than ``sample``: half of them shape the model, all others the thresholds."""
    ordinary = [f"zq{i}x {prose(6, i)}" for i in range(400)]
    close = [f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software zr{i}x" for i in range(40)]
    rows = spark.createDataFrame([(t,) for t in ordinary + close], "paragraph string").withColumn("for_fit", F.pmod(F.shiftright(F.xxhash64("paragraph"), 7), F.lit(2)) == 0)
    rows = rows.where("NOT for_fit OR paragraph LIKE 'zq%'")  # only the calibration meets lines close to a licence
    docs = documents(spark, [(i, r.paragraph) for i, r in enumerate(rows.collect())])
    scanner = train_scanner(docs, sample=10)
    rows = scanner.model.transform(_vectors(rows, scanner.model.numFeatures)).select("for_fit", "vector", (1 - F.get(vector_to_array("probability"), F.lit(0))).alias("p")).collect()
    weights = scanner.model.coefficientMatrix.toArray()
    fitted, others = [r.vector.indices for r in rows if r.for_fit], sorted(r.p for r in rows if not r.for_fit)
    own = [[i for i in at if i not in set.intersection(*map(set, fitted))] for at in fitted]  # terms of all rows have no weight
    assert len(own) > 150 and all((abs(weights[:, at]).max(axis=0) > 0).all() for at in own)
    high = others[math.ceil(0.999 * len(others)) - 1]
    assert high > 0.5 and scanner.likely == pytest.approx(high, rel=1e-9) and scanner.doubtful == scanner.likely


def test_sample_bounds_the_weight_of_ordinary_paragraphs(spark):
    """A licence line is still found among thousands of ordinary lines that weigh ten rows."""
    docs = documents(spark, [(i, "\n".join(prose(8, 50 * i + k) for k in range(50))) for i in range(40)] + [(100, "Released under the MIT License.")])
    assert collected(scan_licences(docs, train_scanner(docs, sample=10)).where("doc_id = 100").select("family")) == [("MIT",)]


def test_quantile_is_exact(spark):
    for n in (1, 7, 1000, 30_000):
        values = spark.range(n).select(((F.col("id") * 7919) % n / 3.0).alias("p"))
        assert _quantile(values, 0.999) == sorted((i * 7919) % n / 3.0 for i in range(n))[math.ceil(0.999 * n) - 1]
    assert _quantile(spark.createDataFrame([], "p double"), 0.999) is None
    assert _quantile(spark.range(5000).select(F.lit(0.25).alias("p")), 0.999) == 0.25


def test_largest_values_give_the_quantile_of_all(spark):
    values = spark.range(1000).select((F.col("id") / 1000.0).alias("p"))
    assert _quantile(values.where("p >= 0.9"), 0.99, 1000) == _quantile(values, 0.99)
    assert _quantile(values.where("p >= 0.995"), 0.99, 1000) is None and _quantile(values.limit(0), 0.99, 0) is None


def test_own_scan_reports_what_a_second_scan_would(spark):
    """What the fit has judged is not judged again, yet every occurrence is reported: by rounds and at once."""
    close = [f"Permission is hereby granted, free of charge, to any person zr{i}x" for i in range(6)]
    rows = [(i, prose(30, i) + "\n" + close[i % 6] + "\n" + LINES["MIT"][i % 3] + "\n" + close[i % 6]) for i in range(150)] + [(None, close[0]), (900, None)]
    docs = documents(spark, rows)
    for at_once in (40, 20_000):
        scanner = train_scanner(docs, sample=20, at_once=at_once)
        want = collected(scan_licences(docs, scanner).select("doc_id", "position", "family", "predicted"))
        got = collected(scan_corpus(docs, sample=20, at_once=at_once).select("doc_id", "position", "family", "predicted"))
        assert sorted(got, key=repr) == sorted(want, key=repr)
        assert {(i, 2) for i in range(150) if i % 3 == 0} <= {r[:2] for r in got}
        ordinary = [r for r in got if r[1] in (1, 3)]
        assert len(ordinary) % 2 == 0 and {(i, 4 - p) for i, p, *_ in ordinary} == {r[:2] for r in ordinary}
