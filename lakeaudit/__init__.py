"""A PySpark engine for auditing sensitive identifiers in application traces."""

from .api import (
    audit_events,
    audit_external_trace,
    audit_trace,
    build_conversion_diagnostics,
    guard_text,
    load_external_trace,
    redact_text,
    redacted_trace_events,
    safe_decision,
    scan_text,
    write_converted_trace,
    write_redacted_trace,
)
from .errors import AuditError, ConfigError, ConfigNotFound, MappingError, PolicyError, TraceError
from .operators.compliance import CompliancePolicy, decision_dict, guard_compliance, load_compliance
from .plans.corpus import corpus_report, write_corpus_report
from .plans.report import AuditResult
from .project import ProjectConfig, check_project, discover, init_project, load_project
from .sdk import Auditor
from .sources.mapping import TraceAdapter, load_mapping
from .sources.policy import Policy, load_policy
from .sources.trace import load_trace, stream_trace, write_trace, write_trace_parts

__all__ = [
    "AuditError", "AuditResult", "Auditor", "CompliancePolicy", "ConfigError", "ConfigNotFound", "MappingError", "Policy", "PolicyError", "ProjectConfig", "TraceAdapter", "TraceError",
    "audit_events", "audit_external_trace", "audit_trace", "build_conversion_diagnostics", "check_project", "corpus_report", "decision_dict", "discover", "guard_compliance", "guard_text", "init_project",
    "load_compliance", "load_external_trace", "load_mapping", "load_policy", "load_project", "load_trace", "redact_text", "redacted_trace_events", "safe_decision", "scan_text", "stream_trace",
    "write_converted_trace", "write_corpus_report", "write_redacted_trace", "write_trace", "write_trace_parts",
]
