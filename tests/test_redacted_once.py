"""The redacted trace carries what it returns only, and redacts and finds its values in one pass."""

import pytest
from pyspark.sql import functions as F

from lakeaudit.operators import guard as g
from lakeaudit.plans.registry import POLICY
from lakeaudit.sources.trace import from_columns


def trace(spark, rows):
    return from_columns(spark.createDataFrame(rows, "event_no long, event_id string, timestamp string, layer string, content string").repartition(3))


def test_one_pass_carries_values_and_marks_alone(spark, monkeypatch):
    written, real = [], g.staged
    monkeypatch.setattr(g, "staged", lambda df, name: written.append(df) or real(df, name))
    long = "x; " * 400_000 + "Member ID: MBR-SYN-0007; é callback 555-013-7788."
    rows = [(1, "a", "d", "memory", "CLM-SYN-0001 é CLM-SYN-0001 and 555-013-7788"), (2, "b", "d", "memory", "zCLM-SYN-0001z 555-013-77889"), (3, "c", "d", "memory", None), (4, "d", "d", "debug_log", ""), (5, "e", "d", "memory", long)]
    out = {r["event_id"]: r["redacted_content"] for r in g.redact_trace(trace(spark, rows), POLICY, keep=["event_id"]).collect()}
    assert out == {"a": "[REDACTED_CLAIM_ID] é [REDACTED_CLAIM_ID] and [REDACTED_PHONE]", "b": "z[REDACTED_CLAIM_ID]z [REDACTED_PHONE]9", "c": None, "d": "", "e": "x; " * 400_000 + "Member ID: [REDACTED_MEMBER_ID]; é callback [REDACTED_PHONE]."}
    assert [d.columns for d in written] == [["event_id", "event_no", "__text", "__values"]]
    assert "SortAggregate" not in written[0]._jdf.queryExecution().executedPlan().toString()
    assert g.redact_trace(trace(spark, rows), POLICY).columns == [*trace(spark, rows).columns, "redacted_content"]


def test_same_text_as_the_guard(spark):
    rows = [(i, f"e{i}", "d", "memory", f"Claim review claim_id=CLM-SYN-{i:05} Member ID: MBR-SYN-{i % 7:05}. mail m{i % 3}@x.org at https://x.test/a{i % 5} DOB: 1990-01-0{1 + i % 9} {'é' * (i % 4)} ssn 123-45-678{i % 10}") for i in range(60)]
    events = trace(spark, rows)
    want = {r["event_id"]: r["redacted_text"] for r in g.guard(events, POLICY, text="content").collect()}
    marked, _ = g._marked(events, POLICY, ["event_id"], None)
    assert {r["event_id"]: r["__text"] for r in marked.collect()} == want
    assert marked.where(F.size("__values") != 6).isEmpty()


def test_unknown_layer(spark):
    with pytest.raises(Exception, match="unsupported layer vendor"):
        g.redact_trace(trace(spark, [(1, "a", "d", "vendor", "x")]), POLICY, keep=["event_id"]).collect()
