"""A facade over one policy and one session."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .operators.compliance import CompliancePolicy, guard_compliance
from .operators.guard import guard, redact_trace, scan
from .plans.report import AuditResult, audit
from .project import discover, load_project
from .sources.mapping import TraceAdapter
from .sources.policy import Policy, load_policy
from .sources.trace import load_trace


@dataclass(frozen=True)
class Auditor:
    spark: SparkSession
    policy: Policy
    policy_path: str = ""

    @classmethod
    def from_policy_file(cls, spark: SparkSession, path: str) -> Auditor:
        return cls(spark, load_policy(path), path)

    @classmethod
    def from_project(cls, spark: SparkSession, start: str = ".") -> Auditor:
        return cls.from_policy_file(spark, str(load_project(discover(start)).policy))

    def _one(self, text: str, layer: str) -> DataFrame:
        return self.spark.createDataFrame([(text, layer)], "text string, layer string")

    def scan(self, text: str, layer: str) -> list[dict]:
        return [f.asDict() for f in scan(self._one(text, layer), self.policy).first()["findings"]]

    def guard(self, text: str, layer: str, mode: str = "report_only") -> dict:
        return guard(self._one(text, layer), self.policy, mode).first().asDict(recursive=True)

    def guard_model_input(self, text: str, mode: str = "block_on_violation") -> dict:
        return self.guard(text, "model_input", mode)

    def redact_for_layer(self, text: str, layer: str) -> str:
        return self.guard(text, layer, "redact")["redacted_text"]

    def redact_for_log(self, text: str) -> str:
        return self.redact_for_layer(text, "debug_log")

    def audit_events(self, events: DataFrame, **how) -> AuditResult:
        return audit(events, self.policy, policy_path=self.policy_path, **how)

    def audit_trace(self, path: str, **how) -> AuditResult:
        return self.audit_events(load_trace(self.spark, path), trace_path=path, **how)

    def audit_external_trace(self, path: str, mapping: str, *, diagnostics_path: str | None = None, **how) -> AuditResult:
        adapter = TraceAdapter.from_mapping(mapping)
        if diagnostics_path:
            with open(diagnostics_path, "w", encoding="utf-8") as f:
                f.write(json.dumps(adapter.diagnostics(self.spark, path), indent=2, sort_keys=True) + "\n")
        return self.audit_events(adapter.load(self.spark, path), trace_path=path, **how)

    def redact_trace(self, events: DataFrame) -> DataFrame:
        return redact_trace(events, self.policy)

    def guard_compliance(self, requests: DataFrame, compliance: CompliancePolicy) -> DataFrame:
        return guard_compliance(requests, self.policy, compliance)
