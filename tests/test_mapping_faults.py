import json

import pytest
import yaml

from lakeaudit import cli
from lakeaudit.errors import MappingError
from lakeaudit.operators.guard import scan
from lakeaudit.plans.report import escaped
from lakeaudit.sources.mapping import check_mapping, convert, counts, document, apply_mapping

from .test_audit import P

GOOD = {"version": 1, "timestamp": "t", "layer": "l", "content": "c"}
LAYER = "expected one of: debug_log, memory, model_input, rag_context, tool_output, user_message"


@pytest.mark.parametrize(
    ("change", "fault"),
    [
        (None, "mapping must be a YAML object"), ({"version": 2}, "mapping version must be 1"), ({"timestamp": ...}, "mapping must define timestamp"), ({"layer": ...}, "mapping must define layer"), ({"content": ...}, "mapping must define content"),
        ({"timestamp": None}, "timestamp is required"), ({"timestamp": ""}, "timestamp must not be empty"), ({"timestamp": "a..b"}, "timestamp has an empty path segment"), ({"timestamp": 3}, "timestamp must be a field string or object"),
        ({"timestamp": {}}, "timestamp must define field, fields, value, or default"), ({"timestamp": {"field": "a", "odd": 1, "also": 2}}, "timestamp has unsupported key(s): also, odd"), ({"timestamp": {"field": "a", "fallback": "x"}}, "timestamp has unsupported key(s): fallback"),
        ({"timestamp": {"field": "a", "fields": ["b"]}}, "timestamp must not define both field and fields"), ({"timestamp": {"field": 1}}, "timestamp.field must be a string"), ({"timestamp": {"fields": []}}, "timestamp.fields must be a non-empty array"),
        ({"timestamp": {"fields": ["a", ""]}}, "timestamp.fields[1] must not be empty"), ({"timestamp": {"value": 1}}, "timestamp.value must be a string"), ({"timestamp": {"default": None}}, "timestamp.default must be a string"), ({"timestamp": {"field": "a", "required": "no"}}, "timestamp.required must be a boolean"),
        ({"event_id": {"fallback_prefix": 1}}, "event_id.fallback_prefix must be a string"), ({"event_id": {"fallback": 1}}, "event_id.fallback must be a string"), ({"event_id": []}, "event_id must be a field string or object"),
        ({"layer": {"field": "a", "map": ["x"]}}, "layer.map must be an object"), ({"layer": {"field": "a", "map": {1: "memory"}}}, "layer.map keys must be strings"), ({"layer": {"field": "a", "map": {"x": "model_provider"}}}, f"layer.map[x] maps to unsupported layer 'model_provider'; {LAYER}"),
        ({"layer": {"value": "zzz"}}, f"layer maps to unsupported layer 'zzz'; {LAYER}"), ({"layer": {"field": "a", "map": {"x": 1}}}, "layer.map[x] must be a string"), ({"content": 5}, "content must be a field string or object"), ({"content": {"fields": []}}, "content must define field or non-empty fields"),
        ({"content": {"field": "a", "required": 1}}, "content.required must be a boolean"), ({"content": {"fields": [7]}}, "content.fields[0] must be a field string or object"), ({"content": {"fields": [{}]}}, "content.fields[0].field must be a string"),
        ({"content": {"fields": [{"field": "a", "label": 1}]}}, "content.fields[0].label must be a string"), ({"content": {"fields": [{"field": "a", "required": "x"}]}}, "content.fields[0].required must be a boolean"), ({"source": []}, "source must be an object"), ({"source": {"type": "a."}}, "source.type has an empty path segment"),
        ({"destinations": {}}, "destinations must be an array"), ({"destinations": ["x"]}, "destinations[0] must be an object"), ({"destinations": [{"layer": None}]}, "destinations[0].layer is required"), ({"destinations": [{"path": 4}]}, "destinations[0].path must be a field string or object"),
        ({"destinations": [{"layer": {"value": "zzz"}}]}, f"destinations[0].layer maps to unsupported layer 'zzz'; {LAYER.replace('model_input', 'model_input, model_provider')}"), ({"metadata": []}, "metadata must be an object"), ({"metadata": {"include": {}}}, "metadata.include must be an array"),
        ({"metadata": {"include": [1]}}, "metadata.include[0] must be a field string or object"), ({"metadata": {"include": [{"name": "x"}]}}, "metadata.include[0].field must be a string"), ({"metadata": {"include": [{"field": "a", "name": 1}]}}, "metadata.include[0].name must be a string"),
        ({"metadata": {"include": [{"field": "a", "required": 0}]}}, "metadata.include[0].required must be a boolean"), ({"metadata": {"constants": []}}, "metadata.constants must be an object"),
    ],
)
def test_faults(change, fault):
    mapping = change if change is None else {k: v for k, v in (GOOD | change).items() if v is not ...}
    with pytest.raises(MappingError) as e:
        check_mapping(mapping)
    assert str(e.value) == fault


@pytest.mark.parametrize("more", [{"event_id": None}, {"event_id": {"fallback_prefix": "x"}}, {"source": {"type": None, "odd": 1}}, {"source": None, "destinations": None, "metadata": None}, {"destinations": [{"path": None, "odd": 1}]}, {"odd": 1}, {"content": {"field": "c", "fields": []}}, {"layer": {"field": "l", "map": None}}])
def test_sound_mappings(more):
    assert check_mapping(GOOD | more) == GOOD | more


RAW = {"t": "now", "l": "memory", "c": "text", "n": 7, "f": 1.5, "yes": True, "null": None, "empty": "", "list": [{"x": "deep"}], "obj": {"b": 1, "a": [None]}}


def converted(more):
    return convert(RAW, check_mapping(GOOD | more), 4, 2)


@pytest.mark.parametrize(("field", "value"), [("n", "7"), ("f", "1.5"), ("yes", "True"), ("list.0.x", "deep")])
def test_scalars_become_text(field, value):
    assert converted({"event_id": field})[0]["event_id"] == value


@pytest.mark.parametrize("field", ["null", "list", "obj"])
def test_other_values_are_faults_even_if_optional(field):
    with pytest.raises(MappingError, match="source.type must resolve to a string or scalar"):
        converted({"source": {"type": {"field": field, "required": False}}})


def test_empty_strings():
    """Many fields pass an empty one over; a single empty field doesn't take the default."""
    assert converted({"timestamp": {"fields": ["empty", "t"]}})[0]["timestamp"] == "now"
    assert converted({"timestamp": {"fields": ["empty"], "default": "d"}})[0]["timestamp"] == "d"
    with pytest.raises(MappingError, match="timestamp is required"):
        converted({"timestamp": {"field": "empty", "default": "d"}})


def test_metadata():
    meta = converted({"metadata": {"include": ["n", "null", "nowhere", {"field": "obj", "name": "o"}, "t"], "constants": {"t": "constant", "external_line_number": 9}}})[0]["metadata"]
    assert meta == {"n": 7, "null": None, "o": {"b": 1, "a": [None]}, "t": "constant", "external_content_paths": ["c"], "external_format": "generic_jsonl", "external_line_number": 9}
    with pytest.raises(MappingError, match="missing field 'nowhere' for metadata.x"):
        converted({"metadata": {"include": [{"field": "nowhere", "name": "x", "required": True}]}})


def test_diagnostics_list_unused_paths_and_sorted_counts(spark):
    mapping = check_mapping(GOOD | {"content": {"fields": ["c", {"field": "z", "required": False}, {"field": "y", "required": False}, {"field": "z", "required": False}, {"field": "empty", "required": False}]}, "layer": {"fields": ["zz", "l"]}})
    lines = [(i, i, json.dumps(RAW | {"l": layer} | ({"y": "used"} if i == 2 else {}))) for i, layer in enumerate(["memory", "debug_log", "memory", "user_message"], 1)]
    doc = document(counts(apply_mapping(spark.createDataFrame(lines, "line_no long, event_no long, value string"), mapping)), mapping, "x")
    assert doc["optional_content_paths_never_used"] == ["z", "z", "empty"] and doc["content_paths_used"] == {"c": 4, "y": 1}
    assert list(doc["events_by_layer"].items()) == [("debug_log", 1), ("memory", 2), ("user_message", 1)] and doc["field_fallbacks"]["event_id"] == {"<generated>": 4}


def test_unknown_layer_is_refused(spark):
    with pytest.raises(Exception, match="unsupported layer nowhere"):
        scan(spark.createDataFrame([("x", "nowhere")], "text string, layer string"), P).collect()


def test_tables_escape_bars():
    assert escaped("a|b||") == "a\\|b\\|\\|"


def test_init_and_check_config(tmp_path, capsys):
    assert cli.main(["check-config", "--root", str(tmp_path)]) == 2 and "error:" in capsys.readouterr().err
    assert cli.main(["init", "--root", str(tmp_path)]) == 0 and capsys.readouterr().out.count("wrote ") == 3
    assert cli.main(["init", "--root", str(tmp_path)]) == 0 and capsys.readouterr().out == ""
    (tmp_path / "deep" / "er").mkdir(parents=True)
    assert cli.main(["check-config", "--root", str(tmp_path / "deep" / "er")]) == 0 and capsys.readouterr().out.startswith("ok: ")
    policy = tmp_path / ".lakeaudit" / "policy.yml"
    raw = yaml.safe_load(policy.read_text())
    policy.write_text(yaml.safe_dump(raw | {"version": 3}))
    assert cli.main(["check-config", "--root", str(tmp_path)]) == 2
    assert cli.main(["init", "--root", str(tmp_path), "--force"]) == 0 and cli.main(["check-config", "--root", str(tmp_path)]) == 0
    for text, fault in (("{", "invalid JSON"), ("[]", "'policy' must be"), ('{"policy": "p", "use_ner": 1}', "'use_ner' must be"), ('{"policy": "p", "compliance_policy": 1}', "'compliance_policy' must be")):
        (tmp_path / ".lakeaudit" / "config.json").write_text(text)
        capsys.readouterr()
        assert cli.main(["check-config", "--root", str(tmp_path)]) == 2 and fault in capsys.readouterr().err
