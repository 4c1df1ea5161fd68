import json
from types import SimpleNamespace

import pytest
import yaml

import lakeaudit
from lakeaudit import cli
from lakeaudit.functions.detect import detect, settled, spans
from lakeaudit.functions.rules import RULES
from lakeaudit.operators.compliance import parse_compliance
from lakeaudit.plans import fixtures as fx
from lakeaudit.sources.policy import parse_policy
from lakeaudit.sources.trace import numbered_lines
from lakeaudit.streaming.audit import run_available, stream_findings

P = parse_policy(fx.POLICY)
ROW = {"event_id": "e1", "timestamp": "t", "layer": "debug_log", "content": "Member ID: MBR-SYN-0001"}


@pytest.fixture
def files(tmp_path):
    (tmp_path / "policy.yml").write_text(yaml.safe_dump(fx.POLICY))
    (tmp_path / "map.yml").write_text(yaml.safe_dump(fx.MAPPING))
    (tmp_path / "t.jsonl").write_text(json.dumps(ROW) + "\n\n" + json.dumps(ROW | {"event_id": "e2", "layer": "memory"}) + "\n")
    (tmp_path / "x.jsonl").write_text('{"kind":"click","created_at":"t","messages":[{"content":"MBR-SYN-0009"}],"component":{"path":"p"}}\n')
    return tmp_path


def test_exported_names():
    assert all(getattr(lakeaudit, n) for n in lakeaudit.__all__)


def test_text_functions(spark):
    found = lakeaudit.scan_text(spark, "Member ID: MBR-SYN-0001", "debug_log", P)
    assert lakeaudit.redact_text("Member ID: MBR-SYN-0001", found) == "Member ID: [REDACTED_MEMBER_ID]"
    given = [{"span": {"start": 2, "end": 4}, "redaction": {"suggested_value": "X"}}, {"start": 2, "end": 6, "redaction": "Y"}, {"start": 5, "end": 8, "redaction": "Z"}]
    assert lakeaudit.redact_text("0123456789", given) == "01Y6789"
    safe = lakeaudit.safe_decision(lakeaudit.guard_text(spark, "Member ID: MBR-SYN-0001", "debug_log", P))
    assert "findings" not in safe and "MBR-SYN" not in json.dumps(safe) and safe["has_violations"]


def test_compliance_projection(spark):
    request = spark.createDataFrame([("claim_id=CLM-SYN-00000001", "debug_log", "real_phi", "acme", "covered_ai", "ga-model-1", "production", "raw", "none", "web_search")], "text string, layer string, phi_status string, vendor string, service string, model string, environment string, logging string, storage string, feature string")
    row = lakeaudit.guard_compliance(request, P, parse_compliance(fx.COMPLIANCE)).first().asDict(recursive=True)
    assert "CLM-SYN" not in json.dumps(lakeaudit.decision_dict(row)) and "CLM-SYN" in json.dumps(lakeaudit.decision_dict(row, include_phi=True))
    assert row["should_block"] and lakeaudit.decision_dict(row)["context"]["vendor"] == "acme"
    with pytest.raises(Exception, match="unsupported phi_status"):
        lakeaudit.guard_compliance(request.drop("phi_status").selectExpr("*", "'odd' as phi_status"), P, parse_compliance(fx.COMPLIANCE)).collect()


def test_lines_of_many_splits_and_files(spark, tmp_path):
    for name, n in (("a.jsonl", 4000), ("b.jsonl", 700)):
        (tmp_path / name).write_text("".join("\n" if i % 7 == 3 else f"{name} {i}\r\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(i + 1, f"{name} {i}") for name, n in (("a.jsonl", 4000), ("b.jsonl", 700)) for i in range(n) if i % 7 != 3]
    assert [(r["line_no"], r["value"]) for r in sorted(rows, key=lambda r: r["event_no"])] == want
    assert sorted(r["event_no"] for r in rows) == list(range(1, len(want) + 1))


def test_commands(spark, files, capsys):
    at = lambda n: str(files / n)
    assert cli.main(["validate-trace", at("t.jsonl")]) == 0 and "ok: 2 events" in capsys.readouterr().out
    assert cli.main(["validate-mapping", at("map.yml")]) == 0
    assert cli.main(["--trace", at("t.jsonl"), "--policy", at("policy.yml"), "--json-report", at("r.json"), "--markdown-report", at("r.md"), "--redacted-trace", at("red.jsonl")]) == 0
    assert "2 candidates, 1 exposures, 1 violations" in capsys.readouterr().out and json.loads((files / "r.json").read_text())["summary"]["total_findings"] == 2
    assert "MBR-SYN" not in (files / "red.jsonl").read_text()
    assert cli.main(["convert-trace", "--input", at("x.jsonl"), "--mapping", at("map.yml"), "--stdout", "--output", at("c.jsonl"), "--diagnostics", at("d.json")]) == 0
    assert json.loads((files / "c.jsonl").read_text())["event_id"] == "ext_0001" and json.loads((files / "d.json").read_text())["total_events"] == 1
    assert cli.main(["scan-external-trace", "--input", at("x.jsonl"), "--mapping", at("map.yml"), "--policy", at("policy.yml")]) == 0


def test_corpus_report(spark, files, capsys):
    (files / "traces").mkdir()
    (files / "expect").mkdir()
    (files / "traces" / "t.jsonl").write_text((files / "t.jsonl").read_text())
    (files / "expect" / "t.yml").write_text(yaml.safe_dump({"trace": "t.jsonl", "expected": {"min_findings": 2, "required_categories": ["member_id"], "required_layers": ["memory"]}}))
    args = ["corpus-report", "--traces", str(files / "traces"), "--expectations", str(files / "expect"), "--policy", str(files / "policy.yml"), "--output", str(files / "out" / "report.json")]
    assert cli.main(args) == 0
    report = json.loads((files / "out" / "report.json").read_text())
    assert report["passed"] and report["total"] == {"events": 2, "findings": 2, "exposures": 1, "traces": 1, "categories": ["member_id"]}
    (files / "expect" / "t.yml").write_text(yaml.safe_dump({"trace": "t.jsonl", "expected": {"min_findings": 3}}))
    assert cli.main(args) == 1


def test_mapping_summary_and_conversion(spark, files):
    adapter = lakeaudit.TraceAdapter.from_mapping(str(files / "map.yml"))
    s = adapter.summary()
    assert s["content_fields"] == ["messages.0.content"] and s["layer_aliases"]["click"] == "user_message" and s["destination_count"] == 1 and s["metadata_fields"] == []
    lakeaudit.write_converted_trace(spark, str(files / "x.jsonl"), str(files / "map.yml"), str(files / "w.jsonl"))
    assert lakeaudit.load_trace(spark, str(files / "w.jsonl")).count() == 1


class Recogniser:
    def analyze(self, text, language, entities):
        return [SimpleNamespace(entity_type="PERSON", start=0, end=5, score=0.7), SimpleNamespace(entity_type="PERSON", start=3, end=99), SimpleNamespace(entity_type="OTHER", start=0, end=2)]


def test_recogniser(spark):
    df = spark.createDataFrame([("Anna  mbr-syn-0001 MBR-SYN-0001",)], "content string")
    got = detect(df, analyzer=Recogniser).first()["candidates"]
    assert [(c["category"], c["detector"], c["start"], c["end"]) for c in got] == [("name", "presidio", 0, 4), ("member_id", "regex", 6, 18), ("member_id", "regex", 19, 31)]


@pytest.mark.parametrize(
    ("category", "text", "value"),
    [
        ("address", "address: 12 Main Street, Apt 4", "12 Main Street, Apt 4"), ("address", "at 99 Old Mill Rd today", "99 Old Mill Rd"), ("address", "P.O. Box 1234", "P.O. Box 1234"),
        ("member_id", "seen MBR-SYN-12345 there", "MBR-SYN-12345"), ("claim_id", "seen CLM-SYN-4455 there", "CLM-SYN-4455"), ("ip_address", "to 10.0.0.255.", "10.0.0.255"), ("dob", "DOB: 1/2/1990", "1/2/1990"),
    ],
)
def test_rules(category, text, value):
    assert (category, value) in [(c["category"], c["value"]) for c in settled(spans(text))]


@pytest.mark.parametrize("text", ["10.0.0.256.1234", "MBR-SYN-12", "order 123-45-6789", "an address in Main Street", "boxed 12", "claimant 12"])
def test_near_misses(text):
    assert not [c for c in settled(spans(text)) if c["category"] not in ("ip_address",)], text
    assert len(RULES) == 25


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "e1", "debug_log", "Member ID: MBR-SYN-0001", "{}", "[]", None)], "event_no long, event_id string, layer string, content string, source string, destinations string, external_content_paths array<string>").write.mode("overwrite").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run_available(stream_findings(events, P), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [r["category"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["member_id"]
