import json

import pytest

from lakeaudit import stream_trace
from lakeaudit.streaming.audit import run_available, stream_findings

from .test_audit import P

GOOD = {"event_id": "e1", "timestamp": "t", "layer": "debug_log", "content": "Member ID: MBR-SYN-0001"}


def put(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    found = lambda: run_available(stream_findings(stream_trace(spark, str(tmp_path / "in")), P), str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
    seen = lambda: sorted((r["event_id"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    put(tmp_path / "in", "a.jsonl", GOOD, "", GOOD | {"event_id": "e2", "content": "none"})
    found()
    assert seen() == [("e1", "MBR-SYN-0001")]
    put(tmp_path / "in", "b.jsonl", GOOD | {"event_id": "e3"})
    found()
    assert seen() == [("e1", "MBR-SYN-0001"), ("e3", "MBR-SYN-0001")]


def test_strict_streams_stop_and_others_keep_faults(spark, tmp_path):
    put(tmp_path / "in", "a.jsonl", GOOD, "{", GOOD | {"layer": "nowhere"})
    run_available(stream_trace(spark, str(tmp_path / "in"), strict=False), str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
    faults = sorted(r["error"] or "" for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert faults[0] == "" and faults[1].startswith("invalid JSON") and faults[2].startswith("unsupported layer 'nowhere'")
    with pytest.raises(Exception, match="invalid JSON|unsupported layer"):
        run_available(stream_trace(spark, str(tmp_path / "in")), str(tmp_path / "strict"), str(tmp_path / "at2")).awaitTermination()
