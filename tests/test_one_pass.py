"""Audit steps read their input, and find its candidates, once."""

import json
import random

from pyspark.sql import functions as F

from lakeaudit.functions.detect import settled
from lakeaudit.operators import findings as fi
from lakeaudit.plans import corpus
from lakeaudit.plans.fixtures import MAPPING
from lakeaudit.plans.registry import POLICY
from lakeaudit.sources.mapping import apply_mapping, counts
from lakeaudit.sources.trace import from_columns

from .test_rules_brute import plain

PASS = "MapInArrow"


def passes(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count(PASS)


def trace(spark, rows):
    return from_columns(spark.createDataFrame(rows, "event_no long, event_id string, timestamp string, layer string, content string").repartition(5))


def test_findings_are_written_once_and_numbered_in_order(spark, monkeypatch):
    written, real = [], fi.staged
    monkeypatch.setattr(fi, "staged", lambda df, name: written.append(name) or real(df, name))
    rng = random.Random(3)
    rows = [(rng.randrange(10**6) * 1000 + i, f"e{i}", "d", "memory", json.dumps({"a": ["CLM-SYN-0001", "MBR-SYN-0002"], "b": "fax: 555-013-7788"}) if i % 3 else "CLM-SYN-0003 x") for i in range(400)]
    got = [(r["event_no"], r["seg_no"], r["start"], r["finding_id"]) for r in fi.find(trace(spark, rows), POLICY).orderBy("finding_no").collect()]
    assert written == ["finding_no"] and [g[:3] for g in got] == sorted(g[:3] for g in got) and [g[3] for g in got] == [f"finding-{i:03d}" for i in range(1, len(got) + 1)]
    assert fi.find(trace(spark, rows[:0]), POLICY).count() == 0


def test_exposures_read_the_findings_once(spark):
    rows = [(i, f"e{i}", "d", ["memory", "debug_log"][i % 2], f"CLM-SYN-000{i % 3} and MBR-SYN-0001") for i in range(9000)]
    found = fi.find(trace(spark, rows), POLICY, number=False)
    whole, small = fi.exposures(found, number=False), fi.exposures(found, number=False, lists=False)
    assert passes(whole) == 1
    assert sorted(map(str, whole.select(small.columns).collect())) == sorted(map(str, small.collect()))
    lists = {r["value"]: r for r in whole.collect()}
    assert lists["MBR-SYN-0001"]["event_ids"] == [f"e{i}" for i in range(9000)] and lists["CLM-SYN-0001"]["event_ids"] == [f"e{i}" for i in range(1, 9000, 3)]
    assert fi.exposures(found, number=False, lists=["event_ids"]).columns == [*small.columns, "event_ids"]


def test_coverage_reads_the_content_once(spark, monkeypatch):
    seen, real = [], corpus.staged
    monkeypatch.setattr(corpus, "staged", lambda df, name: seen.append(passes(df)) or real(df, name))
    rows = [(1, "a", "d", "memory", json.dumps({"x": "Member ID: MBR-SYN-0001", "y": "MBR-SYN-0001"})), (2, "b", "d", "memory", "MBR-SYN-0001 555-013-7788"), (3, "c", "d", "debug_log", "none"), (4, "d", "d", "debug_log", None), (5, "e", "d", "memory", json.dumps({"phone": 5550137788}))]
    out = corpus.coverage(trace(spark, rows).withColumn("trace", F.lit("t")), POLICY).collect()
    raw = [settled(plain(r[4])) for r in rows if r[4]]
    assert seen == [1] and len(out) == 1
    r = out[0].asDict()
    assert (r["events"], r["findings"], r["exposures"]) == (5, 5, 3)
    kinds = [c["category"] for x in raw for c in x]
    assert r["categories"] == {k: kinds.count(k) for k in set(kinds)} and r["layers"] == {"memory": len(kinds), "debug_log": 0}


def test_diagnostics_convert_each_event_once(spark):
    line = lambda i: json.dumps({"id": f"e{i}", "timestamp": "t", "kind": "click", "component": {"name": "s", "path": "p"}, "messages": [{"content": "c"}]})
    lines = spark.createDataFrame([(i, i, line(i) if i else "{") for i in range(4)], "line_no long, event_no long, value string")
    out = counts(apply_mapping(lines, MAPPING))
    assert passes(out) == 1
    got = {(r["kind"], r["key"]): r["n"] for r in out.collect()}
    assert got[("total", "events")] == 3 and got[("layer", "user_message")] == 3 and got[("chosen", "event_id\tid")] == 3 and got[("path", "messages.0.content")] == 3
    assert [tuple(r) for r in counts(apply_mapping(lines.where("line_no = 0"), MAPPING)).collect()] == [("total", "events", 0)]
