"""The summary's pass carries categories and values alone, and decisions join the counts rather than the findings."""

from lakeaudit.operators import findings as fi
from lakeaudit.plans import registry
from lakeaudit.sources.policy import parse_policy
from lakeaudit.sources.trace import from_columns


def trace(spark, rows):
    return from_columns(spark.createDataFrame(rows, "event_no long, event_id string, timestamp string, layer string, content string").repartition(3))


def counted(df):
    return sorted((r["kind"], r["key"], r["n"]) for r in df.collect())


def test_registered_summary_is_lean(spark, monkeypatch):
    plans, real = [], fi.staged
    monkeypatch.setattr(fi, "staged", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, name))
    registry.audit_summary(spark, "/root/testdata/sf0.001").collect()
    assert len(plans) == 1 and plans[0].count("MapInArrow") == 1
    assert "Join" not in plans[0] and "content_path" not in plans[0] and "reason" not in plans[0] and "destinations" not in plans[0]


def test_same_counts_as_from_decided_findings(spark):
    rows = [(i, f"e{i}", "d", ["memory", "debug_log", "user_message", "elsewhere"][i % 4], f'{{"a": "CLM-SYN-000{i % 5}", "b": ["MBR-SYN-000{i % 3} at https://x.test/{i % 2}", "MBR-SYN-0000"]}}' if i % 3 else f"MBR-SYN-0001 555-013-000{i % 4}") for i in range(90)]
    for policy in (registry.POLICY, parse_policy({"version": 1, "categories": {"member_id": {"deny_layers": ["memory"], "redaction": "x"}}})):
        events = trace(spark, rows)
        want, got = counted(fi.summary(fi.find(events, policy, number=False))), counted(fi.summary(fi.seen(events), policy))
        assert got == want and ("total", "findings", sum(n for k, _, n in got if k == "layer")) in got
    assert counted(fi.summary(fi.seen(trace(spark, rows[:0])), registry.POLICY)) == [("total", "exposures", 0), ("total", "findings", 0), ("total", "high_risk", 0)]
