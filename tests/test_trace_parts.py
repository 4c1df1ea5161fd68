import json
import os

import pytest

from lakeaudit import load_trace, write_trace, write_trace_parts
from lakeaudit.errors import TraceError


def lines(n):
    out = []
    for i in range(n):
        row = {"event_id": f"e{i}", "timestamp": "t", "layer": "memory", "content": f"é {i} " + "x" * (i % 50)}
        out.append(json.dumps(row | ({"source": {"type": "a", "path": "b"}} if i % 3 else {}) | ({"destinations": [{"layer": "model_input"}]} if i % 4 == 0 else {})))
        out += [""] * (i % 7 == 0) + ["  \t"] * (i % 11 == 0)
    return out


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("always", [False, True])
def test_parts_hold_the_bytes_of_the_single_file(spark, tmp_path, small_splits, always):
    (tmp_path / "t.jsonl").write_text("\n".join(lines(900)) + "\n")
    events = load_trace(spark, str(tmp_path / "t.jsonl"))
    write_trace(events, str(tmp_path / "one.jsonl"), always=always)
    write_trace_parts(events, str(tmp_path / "many"), always=always)
    parts = sorted(p for p in os.listdir(tmp_path / "many") if p.startswith("part-"))
    assert len(parts) > 1 and "_SUCCESS" in os.listdir(tmp_path / "many")
    assert "".join((tmp_path / "many" / p).read_text() for p in parts) == (tmp_path / "one.jsonl").read_text()
    again = load_trace(spark, str(tmp_path / "many")).orderBy("event_no")
    assert [(r["event_no"], r["content"]) for r in again.collect()] == [(r["event_no"], r["content"]) for r in events.orderBy("event_no").collect()]


def test_numbers_over_many_splits(spark, tmp_path, small_splits):
    rows = lines(700)
    rows[500:500] = ["", '{"event_id": 1}', '[]']
    (tmp_path / "t.jsonl").write_text("\n".join(rows))
    events = load_trace(spark, str(tmp_path / "t.jsonl"), strict=False)
    full = [(i + 1, x) for i, x in enumerate(rows) if x.strip()]
    got = events.orderBy("event_no").select("event_no", "line_no", "error").collect()
    assert [(r["event_no"], r["line_no"]) for r in got] == [(k + 1, n) for k, (n, _) in enumerate(full)]
    assert [(r["line_no"], r["error"]) for r in got if r["error"]] == [(502, "missing required field(s): timestamp, layer, content"), (503, "event must be an object")]
    with pytest.raises(TraceError, match="t.jsonl:502: missing required"):
        load_trace(spark, str(tmp_path / "t.jsonl"))


def test_no_line_is_shuffled(spark, tmp_path, small_splits):
    (tmp_path / "t.jsonl").write_text("\n".join(lines(300)))
    plan = load_trace(spark, str(tmp_path / "t.jsonl"), strict=False)._jdf.queryExecution().optimizedPlan().toString()
    above = [x for x in plan.splitlines() if "Window" in x and "value#" in x]
    assert not above


def test_empty_traces(spark, tmp_path):
    (tmp_path / "none.jsonl").write_text("\n \n")
    events = load_trace(spark, str(tmp_path / "none.jsonl"))
    assert events.count() == 0
    write_trace_parts(events, str(tmp_path / "out"))
    assert load_trace(spark, str(tmp_path / "out")).count() == 0
