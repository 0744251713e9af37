import re

import __spark_entry__ as E


def test_one_query_per_operator_and_the_pipeline():
    names = E.queries()
    found = [int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))]
    assert sorted(found) == list(range(1, 14)) and "pipeline" in names
    assert {n for n in E.oracle_sql() if n.startswith("op")} == {"op1_url_filter", "op4_quality_rules", "op5_decontamination", "op6_warc_capture_index", "op12_importance_resampling"}
