"""External JSON-lines logs under a declarative mapping (version 1), and diagnostics of a conversion."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MappingError
from ..functions.rules import DESTINATION_LAYERS, LAYERS
from .trace import _FIELDS, EVENT, canonical, numbered_lines, write_trace

SPEC_KEYS = {"field", "fields", "value", "default", "required", "map"}


class _Missing(Exception):
    """A path does not lead to a value."""


def at(raw: object, path: str) -> object:
    now = raw
    for part in path.split("."):
        if isinstance(now, dict) and part in now:
            now = now[part]
        elif isinstance(now, list) and part.isdigit() and int(part) < len(now):
            now = now[int(part)]
        else:
            raise _Missing(path)
    return now


def scalar(x: object, label: str) -> str:
    if not isinstance(x, (str, int, float)):
        raise MappingError(f"{label} must resolve to a string or scalar")
    return x if isinstance(x, str) else str(x)


def text_of(x: object) -> str:
    return "" if x is None else x if isinstance(x, str) else canonical(x)


def resolve(raw: dict, spec: object, label: str, fallback: str | None = None) -> tuple[str | None, str | None]:
    """(value, where it came from). Precedence: constant, path, default, fallback; a required one may not be missing."""
    if spec is None:
        return fallback, None
    if isinstance(spec, str):
        spec = {"field": spec}
    if "value" in spec:
        return spec["value"], "<value>"
    many = "fields" in spec
    for path in spec["fields"] if many else [spec["field"]] if "field" in spec else []:
        try:
            got = scalar(at(raw, path), label)
        except _Missing:
            continue
        if got or not many:
            return got, path
    if spec.get("default") is not None:
        return spec["default"], "<default>"
    if fallback is not None:
        return fallback, "<generated>"
    if spec.get("required", True) and (many or "field" in spec):
        paths = ", ".join(map(repr, spec["fields"] if many else [spec["field"]]))
        raise MappingError(f"missing any field for {label}: {paths}" if many else f"missing field {paths} for {label}")
    return None, None


def layer_of(raw: dict, spec: object, label: str, allowed: list[str], optional: bool = False) -> str | None:
    value, _ = resolve(raw, spec, label)
    if not value:
        if optional:
            return None
        raise MappingError(f"{label} is required")
    names = spec.get("map") or {} if isinstance(spec, dict) else {}
    value = str(names.get(value, value))
    if value not in allowed:
        raise MappingError(f"{label} mapped to unsupported layer {value!r}; expected one of: {', '.join(sorted(allowed))}")
    return value


def content_specs(spec: object) -> list[tuple[str, str, bool]]:
    """(path, label, required) of a content spec; a single field has no label and is required."""
    if isinstance(spec, str):
        return [(spec, "", True)]
    if "field" in spec:
        return [(spec["field"], "", True)]
    return [(f, f, True) if isinstance(f, str) else (f["field"], f.get("label", f["field"]) or "", f.get("required", True)) for f in spec["fields"]]


def content_of(raw: dict, spec: object) -> tuple[str, list[str]]:
    parts, paths, single = [], [], isinstance(spec, str) or "field" in spec
    for path, label, required in content_specs(spec):
        try:
            text = text_of(at(raw, path))
        except _Missing:
            if required:
                raise MappingError(f"missing field {path!r} for content") from None
            continue
        if text or single:
            paths.append(path)
            parts.append(f"{label}: {text}" if label else text)
    if not parts:
        raise MappingError("no content fields produced text")
    return "\n".join(parts), paths


def convert(raw: dict, m: dict, line_no: int, event_no: int) -> tuple[dict, dict[str, str]]:
    """(event, source of each value spec)."""
    chosen: dict[str, str] = {}

    def take(spec, label, fallback=None):
        value, _ = resolve(raw, spec, label, fallback)
        return value

    spec = m.get("event_id")
    prefix = spec.get("fallback_prefix", spec.get("fallback", "external_evt")) if isinstance(spec, dict) else "external_evt"
    event = {"event_id": take(spec, "event_id", f"{prefix}_{event_no:04d}"), "timestamp": take(m["timestamp"], "timestamp")}
    for k, v in event.items():
        if not v:
            raise MappingError(f"{k} is required")
    event["layer"] = layer_of(raw, m["layer"], "layer", LAYERS)
    event["content"], paths = content_of(raw, m["content"])
    wanted = m.get("source") or {}
    event["source"] = {k: v for k in ("type", "path") if k in wanted and (v := take(wanted[k], f"source.{k}"))}
    event["destinations"] = []
    for i, d in enumerate(m.get("destinations") or []):
        out = {}
        if "layer" in d:
            out["layer"] = layer_of(raw, d["layer"], f"destinations[{i}].layer", DESTINATION_LAYERS, optional=True)
            if out["layer"] is None:
                continue
        if "path" in d and (p := take(d["path"], f"destinations[{i}].path")):
            out["path"] = p
        if out:
            event["destinations"].append(out)
    meta, about = {}, m.get("metadata") or {}
    for item in about.get("include", []):
        item = {"field": item} if isinstance(item, str) else item
        try:
            meta[item.get("name", item["field"])] = at(raw, item["field"])
        except _Missing:
            if item.get("required", False):
                raise MappingError(f"missing field {item['field']!r} for metadata.{item.get('name', item['field'])}") from None
    meta |= about.get("constants", {})
    meta.setdefault("external_content_paths", paths)
    meta.setdefault("external_format", "generic_jsonl")
    meta.setdefault("external_line_number", line_no)
    event["metadata"] = meta
    for label, spec in value_specs(m):
        if where := selected(raw, spec, label):
            chosen[label] = where
    return event, chosen


def value_specs(m: dict) -> list[tuple[str, object]]:
    out = [(k, m.get(k)) for k in ("event_id", "timestamp", "layer")]
    out += [(f"source.{k}", m["source"][k]) for k in ("type", "path") if k in (m.get("source") or {})]
    return out + [(f"destinations[{i}].{k}", d[k]) for i, d in enumerate(m.get("destinations") or []) for k in ("layer", "path") if k in d]


def selected(raw: dict, spec: object, label: str) -> str | None:
    """Where diagnostics say a value came from; here null and "" count as absent."""

    def readable(path: str) -> bool:
        try:
            return at(raw, path) not in (None, "")
        except _Missing:
            return False

    if spec is None:
        return "<generated>" if label == "event_id" else None
    if isinstance(spec, str):
        return spec if readable(spec) else None
    if "value" in spec:
        return "<value>"
    for path in [spec["field"]] if "field" in spec else spec.get("fields", []):
        if readable(path):
            return path
    if "default" in spec:
        return "<default>"
    return "<generated>" if label == "event_id" else None


# --- fixed values: what makes a mapping faulty is told in these words -----------
_NO_STRING, _NO_BOOL, _NO_SPEC = "{0} must be a string", "{0} must be a boolean", "{0} must be a field string or object"
_EMPTY, _SEGMENT, _REQUIRED = "{0} must not be empty", "{0} has an empty path segment", "{0} is required"
_ODD_KEYS, _BOTH, _NO_FIELDS = "{0} has unsupported key(s): {1}", "{0} must not define both field and fields", "{0} must be a non-empty array"
_NOTHING, _LAYER = "{0} must define field, fields, value, or default", "{0} maps to unsupported layer {1!r}; expected one of: {2}"
# --- end of fixed values --------------------------------------------------------


def _path(x: object, label: str) -> Iterator[str]:
    if not isinstance(x, str):
        yield _NO_STRING.format(label)
    elif not x:
        yield _EMPTY.format(label)
    elif "" in x.split("."):
        yield _SEGMENT.format(label)


def _typed(spec: dict, names: Iterable[str], kind: type, label: str) -> Iterator[str]:
    yield from ((_NO_BOOL if kind is bool else _NO_STRING).format(f"{label}.{n}") for n in names if n in spec and not isinstance(spec[n], kind))


def _value(spec: object, label: str, *, bare: bool = False, more: tuple[str, ...] = (), layers: list[str] | None = None) -> Iterator[str]:
    """Faults of one value spec. bare: it may be null or say nothing about where the value is; more: further keys; layers: what it may lead to."""
    if spec is None and bare:
        return
    if spec is None:
        yield _REQUIRED.format(label)
    elif isinstance(spec, str):
        yield from _path(spec, label)
    elif not isinstance(spec, dict):
        yield _NO_SPEC.format(label)
    else:
        if odd := sorted(set(spec) - SPEC_KEYS - set(more)):
            yield _ODD_KEYS.format(label, ", ".join(odd))
        if {"field", "fields"} <= set(spec):
            yield _BOTH.format(label)
        if "field" in spec:
            yield from _path(spec["field"], f"{label}.field")
        many = spec.get("fields", [""])
        if not isinstance(many, list) or not many:
            yield _NO_FIELDS.format(f"{label}.fields")
        elif "fields" in spec:
            for i, x in enumerate(many):
                yield from _path(x, f"{label}.fields[{i}]")
        if not bare and not {"field", "fields", "value", "default"} & set(spec):
            yield _NOTHING.format(label)
        yield from _typed(spec, ("value", "default", "fallback_prefix", "fallback"), str, label)
        yield from _typed(spec, ("required",), bool, label)
        if layers:
            yield from _layers(spec, label, layers)


def _layers(spec: dict, label: str, layers: list[str]) -> Iterator[str]:
    """Faults of the layers that a spec names."""
    names = spec.get("map") or {}
    if not isinstance(names, dict):
        yield f"{label}.map must be an object"
        names = {}
    for where, x in [(label, spec[k]) for k in ("value",) if k in spec] + [(f"{label}.map[{k}]", v) for k, v in names.items()]:
        if where != label and not all(isinstance(k, str) for k in names):
            yield f"{label}.map keys must be strings"
        elif not isinstance(x, str):
            yield _NO_STRING.format(where)
        elif x not in layers:
            yield _LAYER.format(where, x, ", ".join(sorted(layers)))


def _parts(items: object, label: str, text: str, required: bool) -> Iterator[str]:
    """Faults of a list of paths, each a string or an object with a path, a text under some name and a required flag."""
    for i, x in enumerate(items):
        here = f"{label}[{i}]"
        if isinstance(x, str):
            yield from _path(x, here)
        elif not isinstance(x, dict):
            yield _NO_SPEC.format(here)
        else:
            yield from _path(x.get("field"), f"{here}.field")
            if not isinstance(x.get(text, ""), (str, type(None))):
                yield _NO_STRING.format(f"{here}.{text}")
            yield from _typed({"required": x.get("required", required)}, ("required",), bool, here)


def faults(m: object) -> Iterator[str]:
    """What is wrong with a mapping, in the order in which it is told."""
    if not isinstance(m, dict):
        yield "mapping must be a YAML object"
        return
    if m.get("version") != 1:
        yield "mapping version must be 1"
    yield from (f"mapping must define {k}" for k in ("timestamp", "layer", "content") if k not in m)
    yield from _value(m.get("event_id"), "event_id", bare=True, more=("fallback", "fallback_prefix"))
    yield from _value(m["timestamp"], "timestamp")
    yield from _value(m["layer"], "layer", layers=LAYERS)
    c = m["content"]
    if isinstance(c, str) or isinstance(c, dict) and "field" in c:
        yield from _path(c, "content") if isinstance(c, str) else _path(c["field"], "content.field")
        yield from _typed(c, ("required",), bool, "content") if isinstance(c, dict) else ()
    elif not isinstance(c, dict):
        yield _NO_SPEC.format("content")
    elif not isinstance(c.get("fields"), list) or not c["fields"]:
        yield "content must define field or non-empty fields"
    else:
        yield from _parts(c["fields"], "content.fields", "label", True)
    lists = {"source": (dict, "an object"), "destinations": (list, "an array"), "metadata": (dict, "an object")}
    yield from (f"{k} must be {what}" for k, (kind, what) in lists.items() if not isinstance(m.get(k), (kind, type(None))))
    for k in ("type", "path"):
        yield from _value((m.get("source") or {}).get(k), f"source.{k}", bare=True)
    for i, d in enumerate(m.get("destinations") or []):
        here = f"destinations[{i}]"
        if not isinstance(d, dict):
            yield f"{here} must be an object"
        else:
            yield from _value(d["layer"], f"{here}.layer", layers=DESTINATION_LAYERS) if "layer" in d else ()
            yield from _value(d.get("path"), f"{here}.path", bare=True)
    about = m.get("metadata") or {}
    if not isinstance(about.get("include", []), list):
        yield "metadata.include must be an array"
    yield from _parts(about.get("include", []), "metadata.include", "name", False)
    if not isinstance(about.get("constants", {}), dict):
        yield "metadata.constants must be an object"


def check_mapping(m: object) -> dict:
    """The mapping, if its shape is right; unknown keys beside those of value specs don't matter."""
    for fault in faults(m):
        raise MappingError(fault)
    return m


def load_mapping(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        try:
            return check_mapping(yaml.safe_load(f))
        except yaml.YAMLError as e:
            raise MappingError(f"{path}: invalid YAML: {e}") from e


def apply_mapping(lines: DataFrame, mapping: dict) -> DataFrame:
    """Events of JSON lines (line_no, event_no, value), with an error column and the chosen source of each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n, e, v in zip(*(b.column(c).to_pylist() for c in ("line_no", "event_no", "value")), strict=True):
                try:
                    raw = json.loads(v)
                    if not isinstance(raw, dict):
                        raise MappingError("input event must be an object")
                    x, chosen = convert(raw, mapping, n, e)
                    paths = x["metadata"]["external_content_paths"]
                    one = paths if isinstance(paths, list) and len(paths) == 1 and isinstance(paths[0], str) else None
                    rows.append((e, n, x["event_id"], x["timestamp"], x["layer"], x["content"], *(canonical(x[k]) for k in ("source", "destinations", "metadata")), one, None, list(chosen.items())))
                except json.JSONDecodeError as fault:
                    rows.append((e, n, *(None,) * 8, f"invalid JSON: {fault.msg}", None))
                except MappingError as fault:
                    rows.append((e, n, *(None,) * 8, str(fault), None))
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 7, pa.list_(pa.string()), pa.string(), pa.map_(pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 12, kinds, strict=True)], names=[*_FIELDS, "error", "chosen"])

    return lines.select("line_no", "event_no", "value").mapInArrow(run, EVENT + ", error string, chosen map<string,string>")


@dataclass(frozen=True)
class TraceAdapter:
    """One mapping, applied to files or lines."""

    mapping: dict

    @classmethod
    def from_mapping(cls, path: str) -> TraceAdapter:
        return cls(load_mapping(path))

    def load(self, spark: SparkSession, path: str) -> DataFrame:
        events = apply_mapping(numbered_lines(spark, path), self.mapping)
        first = events.where("error is not null").agg(F.min(F.struct("line_no", "error")).alias("e")).first()["e"]
        if first is not None:
            raise MappingError(f"{path}:{first['line_no']}: {first['error']}")
        return events.drop("error", "chosen")

    def diagnostics(self, spark: SparkSession, path: str) -> dict:
        return document(counts(apply_mapping(numbered_lines(spark, path), self.mapping)), self.mapping, path)

    def write(self, spark: SparkSession, path: str, output: str) -> None:
        write_trace(self.load(spark, path), output)

    def summary(self) -> dict:
        """What the mapping is set up to read."""
        m = self.mapping
        layer, metadata = m.get("layer"), m.get("metadata")
        included = metadata.get("include", []) if isinstance(metadata, dict) else []
        aliases = layer.get("map") if isinstance(layer, dict) else None
        return {
            "version": m["version"],
            "content_fields": [p for p, _, _ in content_specs(m["content"])],
            "metadata_fields": [x if isinstance(x, str) else str(x["field"]) for x in included if isinstance(x, str) or "field" in x],
            "layer_aliases": {str(k): str(v) for k, v in aliases.items()} if isinstance(aliases, dict) else {},
            "destination_count": len(m.get("destinations") or []),
        }


def counts(converted: DataFrame) -> DataFrame:
    """(kind, key, n): events, layers, destination layers, content paths and chosen sources."""
    ok = converted.where("error is null")
    row = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    some = lambda rows: F.coalesce(rows, F.array().cast("array<struct<kind:string,key:string>>"))
    dest = F.filter(F.from_json("destinations", "array<struct<layer:string>>"), lambda d: d["layer"].isNotNull())
    used = F.from_json(F.get_json_object("metadata", "$.external_content_paths"), "array<string>")
    said = F.concat(
        F.array(row("total", F.lit("events")), row("layer", F.col("layer"))), some(F.transform(dest, lambda d: row("destination", d["layer"]))),
        some(F.transform(used, lambda p: row("path", p))), some(F.transform(F.map_entries("chosen"), lambda e: row("chosen", F.concat_ws("\t", e["key"], e["value"])))),
    )
    # each event is converted once and says all that is counted of it
    found = ok.select(F.inline(said)).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))
    none = converted.sparkSession.createDataFrame([("total", "events", 0)], "kind string, key string, n long")  # the total of no events
    return found.unionByName(none).groupBy("kind", "key").agg(F.sum("n").alias("n"))


def document(table: DataFrame, mapping: dict, path: str) -> dict:
    by: dict[str, dict] = {}
    for r in sorted(table.collect()):  # a few rows for each layer, path and spec of the mapping
        by.setdefault(r["kind"], {})[r["key"]] = r["n"]
    chosen: dict[str, dict] = {}
    for key, n in by.get("chosen", {}).items():
        label, where = key.split("\t")
        chosen.setdefault(label, {})[where] = n
    paths = by.get("path", {})
    return {
        "schema_version": 1, "external_format": "generic_jsonl", "input_path": path, "mapping_version": mapping["version"],
        "total_events": by["total"]["events"], "events_by_layer": by.get("layer", {}), "destination_layers": by.get("destination", {}),
        "content_paths_used": paths, "optional_content_paths_never_used": [p for p, _, required in content_specs(mapping["content"]) if not required and p not in paths],
        "generated_event_id_count": chosen.get("event_id", {}).get("<generated>", 0), "field_fallbacks": chosen,
    }
