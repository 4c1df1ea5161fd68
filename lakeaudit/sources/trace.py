"""Traces: JSON lines in and out, with validation."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import TraceError
from ..functions.rules import DESTINATION_LAYERS, LAYERS

#: source, destinations and metadata are canonical JSON: their keys are open.
EVENT = "event_no long, line_no long, event_id string, timestamp string, layer string, content string, source string, destinations string, metadata string, external_content_paths array<string>"
_FIELDS = ["event_no", "line_no", "event_id", "timestamp", "layer", "content", "source", "destinations", "metadata", "external_content_paths"]


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True)


def problem(raw: object) -> str | None:
    """The first fault of a parsed row, in the fixed order of checks."""
    if not isinstance(raw, dict):
        return "event must be an object"
    if missing := [k for k in ("event_id", "timestamp", "layer", "content") if k not in raw]:
        return f"missing required field(s): {', '.join(missing)}"
    if not isinstance(raw["layer"], str):
        return "field 'layer' must be a string"
    if raw["layer"] not in LAYERS:
        return f"unsupported layer {raw['layer']!r}; expected one of: {', '.join(sorted(LAYERS))}"
    source = raw.get("source", {})
    if not isinstance(source, dict):
        return "field 'source' must be an object"
    for k in ("type", "path"):
        if k in source and not isinstance(source[k], str):
            return f"field 'source.{k}' must be a string"
    for k in ("event_id", "timestamp", "content"):
        if not isinstance(raw[k], str):
            return f"field {k!r} must be a string"
    there = raw.get("destinations", [])
    if not isinstance(there, list):
        return "field 'destinations' must be an array"
    for i, d in enumerate(there):
        if not isinstance(d, dict):
            return f"field 'destinations[{i}]' must be an object"
        for k in ("path", "layer"):
            if k in d and not isinstance(d[k], str):
                return f"field 'destinations[{i}].{k}' must be a string"
        if "layer" in d and d["layer"] not in DESTINATION_LAYERS:
            return f"unsupported destination layer {d['layer']!r}; expected one of: {', '.join(sorted(DESTINATION_LAYERS))}"
    if not isinstance(raw.get("metadata", {}), dict):
        return "field 'metadata' must be an object"
    return None


def event_row(raw: dict) -> tuple:
    meta = raw.get("metadata", {})
    paths = meta.get("external_content_paths")
    paths = paths if isinstance(paths, list) and len(paths) == 1 and isinstance(paths[0], str) else None
    return raw["event_id"], raw["timestamp"], raw["layer"], raw["content"], canonical(raw.get("source", {})), canonical(raw.get("destinations", [])), canonical(meta), paths


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, event_no, value) of the lines that are not blank; line numbers begin at 1 in each file and count blank lines, event numbers run over all files.

    No line moves: a line's place in its split is told by ids that grow with the rows of a
    task, taken before and after blank lines go, and what stands before a split by one row
    of counts for each. Any store that Spark reads will do, compressed files too.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = lines.where(F.col("value").rlike("(?U)\\S")).withColumn("own", F.monotonically_increasing_id())
    splits = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    full = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("m"), F.min("own").alias("own"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    line, event = before("n", Window.partitionBy("file").orderBy("block")) - F.col("at"), before("m", Window.orderBy("file", "block")) - F.col("own")
    starts = splits.join(full, ["file", "block"], "left").select("file", "block", line.alias("line"), event.alias("event"))
    return rows.join(starts, ["file", "block"]).select((F.col("at") + F.col("line") + 1).cast("long").alias("line_no"), (F.col("own") + F.col("event") + 1).cast("long").alias("event_no"), "value")


def parse(lines: DataFrame) -> DataFrame:
    """Events with an error column (null: valid). lines: line_no, event_no, value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n, e, v in zip(*(b.column(c).to_pylist() for c in ("line_no", "event_no", "value")), strict=True):
                try:
                    raw = json.loads(v)
                    fault = problem(raw)
                except ValueError as x:
                    raw, fault = None, f"invalid JSON: {getattr(x, 'msg', x)}"
                rows.append((e, n, *(event_row(raw) if fault is None else (None,) * 8), fault))
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 7, pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 11, kinds, strict=True)], names=[*_FIELDS, "error"])

    return lines.select("line_no", "event_no", "value").mapInArrow(run, EVENT + ", error string")


def load_trace(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """Events of a JSON-lines file; strict: the first fault is raised, else faulty rows keep an error column."""
    events = parse(numbered_lines(spark, path))
    if not strict:
        return events
    first = events.where("error is not null").agg(F.min(F.struct("line_no", "error")).alias("e")).first()["e"]
    if first is not None:
        raise TraceError(f"{path}:{first['line_no']}: {first['error']}")
    return events.drop("error")


def stream_trace(spark: SparkSession, folder: str, *, strict: bool = True) -> DataFrame:
    """Events of the files of JSON lines that come into a folder, as a stream.

    Numbers are null: they would depend on what came before. strict: a faulty line ends the
    query with its fault; else it stays, with an error column, for a quarantine.
    """
    null = F.lit(None).cast("long")
    lines = spark.readStream.text(folder).where(F.col("value").rlike("(?U)\\S"))
    events = parse(lines.select(null.alias("line_no"), null.alias("event_no"), "value"))
    if not strict:
        return events
    return events.withColumn("event_id", F.when(F.col("error").isNull(), F.col("event_id")).otherwise(F.raise_error(F.col("error")))).drop("error")


def from_columns(df: DataFrame) -> DataFrame:
    """A trace from any DataFrame with event_id, timestamp, layer and content; what else a trace needs is filled in."""
    have = set(df.columns)
    extra = {"event_no": F.monotonically_increasing_id(), "line_no": F.lit(None).cast("long"), "source": F.lit("{}"), "destinations": F.lit("[]"), "metadata": F.lit("{}"), "external_content_paths": F.lit(None).cast("array<string>")}
    return df.select(*[F.col(c) if c in have else extra[c].alias(c) for c in _FIELDS])


def json_lines(events: DataFrame, *, always: bool = False, content: str = "content") -> DataFrame:
    """(event_no, value): the JSON line of every event; empty source, destinations and metadata are left out (always: only metadata)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = []
            for r in b.to_pylist():
                row = {k: r[k] for k in ("event_id", "timestamp", "layer", "content")}
                for k in ("source", "destinations", "metadata"):
                    value = json.loads(r[k])
                    if value or (always and k != "metadata"):
                        row[k] = value
                lines.append(canonical(row))
            yield pa.RecordBatch.from_arrays([b.column("event_no"), pa.array(lines, pa.string())], names=["event_no", "value"])

    rows = events.select("event_no", "event_id", "timestamp", "layer", F.col(content).alias("content"), "source", "destinations", "metadata")
    return rows.mapInArrow(run, "event_no long, value string")


def write_trace_parts(events: DataFrame, path: str, **how) -> None:
    """Events as JSON lines in a folder: tasks write ranges of events, and the parts' names follow the events' order.

    Spark's commit puts the parts of finished tasks in place at the end, so a lost executor leaves no half of
    one. The folder must be new; load_trace reads it back in the same order.
    """
    width = max(1, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    json_lines(events, **how).repartitionByRange(width, "event_no").sortWithinPartitions("event_no").select("value").write.text(path)


def trace_lines(events: DataFrame, **how) -> Iterator[str]:
    """The JSON lines in order, a range of events at a time; tasks make them."""
    for r in json_lines(events, **how).orderBy("event_no").select("value").toLocalIterator():
        yield r["value"]


def write_trace(events: DataFrame, path: str, **how) -> None:
    """Events as one local file of JSON lines, streamed through the driver: for traces that one file can hold. Larger ones: write_trace_parts."""
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(x + "\n" for x in trace_lines(events, **how))
