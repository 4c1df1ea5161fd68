import json

import pytest

from lakeaudit.errors import MappingError, PolicyError, TraceError
from lakeaudit.functions.detect import detect, spans
from lakeaudit.operators.guard import guard, redact_trace
from lakeaudit.operators.segments import leaves
from lakeaudit.plans.fixtures import MAPPING, POLICY
from lakeaudit.plans.report import audit
from lakeaudit.project import check_project, init_project
from lakeaudit.sources.mapping import TraceAdapter, check_mapping
from lakeaudit.sources.policy import parse_policy
from lakeaudit.sources.trace import load_trace, write_trace

P = parse_policy(POLICY)


@pytest.mark.parametrize(
    ("text", "category", "value"),
    [
        ("Patient: Ana B. Cole", "name", "Ana B. Cole"),
        ("Member: Cole, Ana", "name", "Cole, Ana"),
        ("DOB: 1980-02-03", "dob", "1980-02-03"),
        ("service date 2026-01-02", "date", "2026-01-02"),
        ("call 555-013-7788 x12", "phone", "555-013-7788 x12"),
        ("mail a.b@c.org now", "email", "a.b@c.org"),
        ("SSN: XXX-XX-1234", "ssn", "XXX-XX-1234"),
        ("P.O. Box 123", "address", "P.O. Box 123"),
        ("ZIP 12345-6789", "zip_code", "12345-6789"),
        ("Member ID: MBR-SYN-0001", "member_id", "MBR-SYN-0001"),
        ("claim_id=CLM-SYN-0001", "claim_id", "CLM-SYN-0001"),
        ("MRN: A-12345", "mrn", "A-12345"),
        ("Policy No. AB-12", "policy_number", "AB-12"),
        ("group number 77AB", "group_number", "77AB"),
        ("Acct # 99-123", "account_number", "99-123"),
        ("License No. AB-123", "license_number", "AB-123"),
        ("VIN 1HGCM82633A", "vehicle_id", "1HGCM82633A"),
        ("Device ID: DEV-9", "device_id", "DEV-9"),
        ("see https://x.test/a?b", "url", "https://x.test/a?b"),
        ("at 192.0.2.7.", "ip_address", "192.0.2.7"),
    ],
)
def test_rules(text, category, value):
    assert (category, value) in {(s["category"], s["value"]) for s in spans(text)}


def test_merge_prefers_earlier_start_and_higher_confidence(spark):
    rows = [(1, "fax=555-013-7788"), (2, "https://x.test/MBR-SYN-8842"), (3, "é Member ID: MBR-SYN-0001"), (4, None), (5, "")]
    got = {r["id"]: [(c["category"], c["start"]) for c in r["candidates"]] for r in detect(spark.createDataFrame(rows, "id int, content string")).collect()}
    assert got == {1: [("phone", 4)], 2: [("url", 0)], 3: [("member_id", 13)], 4: [], 5: []}


def test_leaves():
    assert leaves('{"b":[1,true,null,""],"a":{"x.y":"t"}}') == [("$.b[0]", "1"), ("$.b[1]", "True"), ("$.a.x.y", "t")]
    for plain in ("{}", "[null]", "text", '{"a":1} x'):
        assert leaves(plain) == [(None, plain)]
    assert leaves('{"a":NaN,"a":1.0}') == [("$.a", "1.0")]


EVENTS = [
    {"event_id": "e1", "timestamp": "t", "layer": "user_message", "content": "Member ID: MBR-SYN-0001"},
    {"event_id": "e2", "timestamp": "t", "layer": "debug_log", "content": '{"m": "MBR-SYN-0001 | 555-013-0001"}', "source": {"type": "x"}},
    {"event_id": "e3", "timestamp": "t", "layer": "memory", "content": "saw mbr MBR-SYN-0001x and nothing"},
]


@pytest.fixture
def trace(tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text("\n".join(["", *map(json.dumps, EVENTS)]) + "\n")
    return str(p)


def test_audit_document(spark, trace):
    doc = audit(load_trace(spark, trace), P, mode="redacted").to_dict()
    assert doc["summary"]["total_findings"] == 3 and doc["summary"]["by_disposition"] == {"allowed": 1, "violation": 2}
    first = doc["boundary_exposures"][0]
    assert (first["category"], first["layers_seen"], first["worst_layer"], first["value"]) == ("member_id", ["user_message", "debug_log"], "debug_log", "[REDACTED_MEMBER_ID]")
    assert first["finding_ids"] == ["finding-001", "finding-002"] and first["sources"] == [{}, {"type": "x"}]
    assert "### finding-003" in audit(load_trace(spark, trace), P).to_markdown()


def test_redacted_trace_replaces_values_everywhere(spark, trace, tmp_path):
    out = redact_trace(load_trace(spark, trace), P)
    assert not [r for r in out.collect() if "MBR-SYN-0001" in r["redacted_content"]]
    write_trace(out, str(tmp_path / "o.jsonl"), always=True, content="redacted_content")
    assert json.loads((tmp_path / "o.jsonl").read_text().splitlines()[0])["source"] == {}


@pytest.mark.parametrize(("row", "message"), [("{", "invalid JSON"), ("[]", "must be an object"), ('{"event_id":"a"}', "missing required field"), ('{"event_id":"a","timestamp":"","layer":"x","content":""}', "unsupported layer"), ('{"event_id":"a","timestamp":"","layer":"memory","content":"","source":null}', "'source' must be an object")])
def test_strict_validation(spark, tmp_path, row, message):
    p = tmp_path / "t.jsonl"
    p.write_text("\n" + row + "\n")
    with pytest.raises(TraceError, match=f"t.jsonl:2: .*{message}"):
        load_trace(spark, str(p))


def test_guard_modes(spark):
    df = spark.createDataFrame([("claim_id=CLM-SYN-0001", "debug_log"), ("none", "memory")], "text string, layer string")
    blocked = guard(df, P, "block_on_violation").collect()
    assert [r["should_block"] for r in blocked] == [True, False] and blocked[0]["redacted_text"] == "claim_id=[REDACTED_CLAIM_ID]"
    with pytest.raises(ValueError, match="mode must be"):
        guard(df, P, "other")


def test_policy_faults():
    for raw in (None, {"version": 2}, {"version": 1, "categories": {"a": {}}}, {"version": 1, "categories": {"a": {"redaction": "x", "deny_layers": ["zzz"]}}}):
        with pytest.raises(PolicyError):
            parse_policy(raw)


def test_adapter(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"kind":"click","created_at":"t","messages":[{"content":"hi"}],"component":{"path":"p"}}\n\n{"id":"b","event_type":"view","timestamp":"t","messages":[{"content":{"z":1}}],"component":{"path":"p"}}\n')
    adapter = TraceAdapter(check_mapping(MAPPING))
    got = adapter.load(spark, str(p)).orderBy("event_no").collect()
    assert [(r["event_id"], r["line_no"], r["layer"], r["content"]) for r in got] == [("ext_0001", 1, "user_message", "user: hi"), ("b", 3, "rag_context", 'user: {"z": 1}')]
    assert adapter.diagnostics(spark, str(p))["generated_event_id_count"] == 1
    with pytest.raises(MappingError):
        check_mapping({"version": 1, "timestamp": "a..b", "layer": "l", "content": "c"})


def test_project(tmp_path):
    assert len(init_project(tmp_path)) == 3 and init_project(tmp_path) == []
    assert check_project(tmp_path / "x" if (tmp_path / "x").exists() else tmp_path).use_ner is False
