"""Functions for one text or one file, over a session and a policy."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from .operators.compliance import SAFE
from .operators.guard import guard, redact_trace, scan
from .plans.report import AuditResult, audit
from .sdk import Auditor
from .sources.mapping import TraceAdapter
from .sources.policy import Policy
from .sources.trace import load_trace, write_trace


def _one(spark: SparkSession, text: str, layer: str) -> DataFrame:
    return spark.createDataFrame([(text, layer)], "text string, layer string")


def scan_text(spark: SparkSession, text: str, layer: str, policy: Policy, **how) -> list[dict]:
    return [f.asDict() for f in scan(_one(spark, text, layer), policy, **how).first()["findings"]]


def guard_text(spark: SparkSession, text: str, layer: str, policy: Policy, mode: str = "report_only", **how) -> dict:
    return guard(_one(spark, text, layer), policy, mode, **how).first().asDict(recursive=True)


def safe_decision(decision: Mapping) -> dict:
    """A guard's decision without the text and the found values."""
    return {k: decision[k] for k in (*SAFE, "redacted_text")}


def redact_text(text: str, findings: Iterable[Mapping]) -> str:
    """The text with given findings replaced; of overlapping ones the earliest, then the longest, counts.

    A finding has start, end and redaction, or the report's form: span with start and end, redaction with suggested_value.
    """
    spans = []
    for f in findings:
        at, mark = f.get("span", f), f["redaction"]
        spans.append((int(at["start"]), -int(at["end"]), str(mark["suggested_value"] if isinstance(mark, Mapping) else mark)))
    out, upto = [], 0
    for start, minus_end, mark in sorted(spans, key=lambda s: s[:2]):
        if start >= upto:
            out += [text[upto:start], mark]
            upto = -minus_end
    return "".join([*out, text[upto:]])


def audit_events(events: DataFrame, policy: Policy, **how) -> AuditResult:
    return audit(events, policy, **how)


def audit_trace(spark: SparkSession, path: str, policy: Policy, **how) -> AuditResult:
    return Auditor(spark, policy).audit_trace(path, **how)


def audit_external_trace(spark: SparkSession, path: str, mapping: str, policy: Policy, **how) -> AuditResult:
    return Auditor(spark, policy).audit_external_trace(path, mapping, **how)


def load_external_trace(spark: SparkSession, path: str, mapping: str) -> DataFrame:
    return TraceAdapter.from_mapping(mapping).load(spark, path)


def write_converted_trace(spark: SparkSession, path: str, mapping: str, output: str) -> None:
    TraceAdapter.from_mapping(mapping).write(spark, path, output)


def build_conversion_diagnostics(spark: SparkSession, path: str, mapping: str) -> dict:
    return TraceAdapter.from_mapping(mapping).diagnostics(spark, path)


def redacted_trace_events(events: DataFrame, policy: Policy) -> DataFrame:
    return redact_trace(events, policy)


def write_redacted_trace(events: DataFrame, policy: Policy, path: str) -> None:
    write_trace(redact_trace(events, policy), path, always=True, content="redacted_content")
