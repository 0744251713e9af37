"""Findings are dealt to the writer's tasks while they are narrow."""

from conftest import SF001

from spendlens.plans import q_contract as Q
from spendlens.plans.inputs import findings


def test_stored_findings_do_not_move_wide(spark, monkeypatch):
    written = []
    store = Q.io.write_findings

    def watched(f, root, **kw):
        written.append((f, root, kw))
        store(f, root, **kw)

    monkeypatch.setattr(Q.io, "write_findings", watched)
    rows = Q.s6(spark, SF001).collect()
    [(f, root, kw)] = written
    assert kw == {"gather": False}
    node = f._jdf.queryExecution().optimizedPlan()
    while not node.nodeName().startswith("RebalancePartitions"):
        node = node.children().head()
    assert not any(f"{c}#" in node.output().mkString(",") for c in ("fingerprint", "finding_id", "dimensions", "scope"))
    plain = findings(spark, SF001)
    back = Q.io.read_written(spark, root, plain)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(back) == key(plain)
    assert sum(r.findings for r in rows) == plain.where("tenant_id = 'tenant-1'").count()
