"""Report documents: JSON and Markdown, assembled on the driver from small tables."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.findings import display, exposures, find, summary
from ..sources.policy import Policy


def escaped(value: str | None) -> str:
    """Text for a cell of a Markdown table."""
    return (value or "").replace("|", "\\|")


@dataclass
class AuditResult:
    """Findings and exposures as tables; documents on demand."""

    findings: DataFrame
    exposures: DataFrame
    trace_path: str = ""
    policy_path: str = ""
    mode: str = "raw"

    def summary(self) -> dict:
        out = {"by_disposition": {}, "by_layer": {}, "by_category": {}, "by_worst_disposition": {}}
        for r in summary(self.findings).collect():
            if r["kind"] == "total":
                out[{"findings": "total_findings", "exposures": "total_boundary_exposures", "high_risk": "high_risk_findings"}[r["key"]]] = r["n"]
            else:
                out[f"by_{r['kind']}"][r["key"]] = r["n"]
        return out

    @property
    def has_findings(self) -> bool:
        return not self.findings.isEmpty()

    @property
    def has_violations(self) -> bool:
        return not self.findings.where("disposition = 'violation'").isEmpty()

    def to_dict(self) -> dict:
        shown = display(self.mode)
        found, exposed = [], []
        for r in self.findings.withColumn("shown", shown).orderBy("finding_no").toLocalIterator():
            found.append({
                **{k: r[k] for k in ("finding_id", "event_id", "layer", "category", "value_hash", "content_path", "external_content_path", "confidence", "reason")},
                "value": r["shown"], "value_display": r["shown"], "span": {"start": r["start"], "end": r["end"]},
                "source": json.loads(r["source"]), "destinations": json.loads(r["destinations"]),
                "policy": {k: r[k] for k in ("disposition", "risk", "rule")}, "redaction": {"action": r["action"], "suggested_value": r["redaction"]},
            })
        for r in self.exposures.withColumn("shown", shown).orderBy("exposure_no").toLocalIterator():
            exposed.append({
                **{k: r[k] for k in ("exposure_id", "category", "value_hash", "finding_ids", "event_ids", "layers_seen", "content_paths_seen", "external_content_paths_seen", "first_seen_event_id", "worst_disposition", "worst_layer", "recommended_boundary_action")},
                "value": r["shown"], "value_display": r["shown"], "sources": [json.loads(x) for x in r["sources"]], "destinations": [json.loads(x) for x in r["destinations"]],
            })
        return {"schema_version": 3, "report_value_mode": self.mode, "finding_schema": "path-aware", "trace_path": self.trace_path, "policy_path": self.policy_path, "summary": self.summary(), "boundary_exposures": exposed, "findings": found}

    def to_markdown(self) -> str:
        return markdown(self.to_dict())

    def write_json(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(json.dumps(self.to_dict(), indent=2, sort_keys=True) + "\n")

    def write_markdown(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_markdown())


def audit(events: DataFrame, policy: Policy, *, mode: str = "raw", trace_path: str = "", policy_path: str = "", **how) -> AuditResult:
    display(mode)
    found = find(events, policy, **how)
    return AuditResult(found, exposures(found), trace_path, policy_path, mode)


def _table(head: list[str], rows: list[list[str]]) -> list[str]:
    return ["| " + " | ".join(r) + " |" for r in (head, ["---"] * len(head), *rows)]


def markdown(doc: dict) -> str:
    s, cell = doc["summary"], escaped
    top = [("Trace", f"`{doc['trace_path']}`"), ("Policy", f"`{doc['policy_path']}`"), ("Report value mode", f"`{doc['report_value_mode']}`"), ("Total PHI candidates", s["total_findings"]), ("Boundary exposures", s["total_boundary_exposures"]), ("Violations", s["by_disposition"].get("violation", 0)), ("Redaction required", s["by_disposition"].get("redact", 0)), ("High-risk candidates", s["high_risk_findings"])]
    out = ["# Trace Audit Report", "", *[f"- {k}: {v}" for k, v in top], "", "All findings are PHI candidates from a rule-based detector and require human review.", "", "## Boundary Exposures", ""]
    if not doc["boundary_exposures"]:
        return "\n".join([*out, "No boundary exposures found.", "", "## Findings", "", "No PHI candidates found.", ""])
    out += _table(["ID", "Category", "Value", "Layers Seen", "Worst Disposition", "Worst Layer", "Recommended Action"], [[e["exposure_id"], e["category"], f"`{cell(e['value_display'])}`", " -> ".join(e["layers_seen"]), e["worst_disposition"], e["worst_layer"], e["recommended_boundary_action"]] for e in doc["boundary_exposures"]])
    out += ["", "## Findings", "", *_table(["ID", "Event", "Layer", "Category", "Value", "Content Path", "Disposition", "Risk", "Redaction"], [[f["finding_id"], f["event_id"], f["layer"], f["category"], f"`{cell(f['value_display'])}`", f"`{cell(f['content_path'])}`", f["policy"]["disposition"], f["policy"]["risk"], f"`{f['redaction']['suggested_value']}`"] for f in doc["findings"]])]
    out += ["", "## Paths", ""]
    for f in doc["findings"]:
        lines = [f"Detector: {f['reason']} Confidence: {f['confidence']:.2f}.", f"Policy: {f['policy']['rule']}", f"Content path: `{f['content_path'] or ''}`", f"External content path: `{f['external_content_path'] or ''}`", f"Source: `{json.dumps(f['source'], sort_keys=True)}`", f"Destinations: `{json.dumps(f['destinations'], sort_keys=True)}`"]
        out += [f"### {f['finding_id']}", "", *[f"- {x}" for x in lines], ""]
    return "\n".join(out)
