"""Compliance decisions: may this text go to this service, under these conditions?"""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AuditError
from ..functions.rules import PHI_STATUSES
from ..sources.policy import Policy
from .guard import guard

# --- fixed values -----------------------------------------------------------
LOGGING, STORAGE = ["none", "metadata_only", "redacted_only"], ["none"]
PREVIEW = "preview|experimental|beta"
CONTEXT = {"phi_status": None, "vendor": None, "service": None, "endpoint": None, "model": None, "feature": None, "environment": "development", "region": "", "logging": "metadata_only", "storage": "none", "purpose": "model_call"}
REQUIRED = ["vendor", "service", "endpoint", "model", "feature", "environment", "logging", "storage"]
ACTIONS = {
    "phi_policy_violation": "Redact or remove PHI before using this context layer.",
    "unknown_service_profile": "Add an approved service profile before sending PHI.",
    "phi_status_not_allowed_for_service": "Use a service profile that explicitly allows this PHI status.",
    "phi_status_requires_baa_but_service_is_not_covered": "Use a BAA-covered service before sending PHI.",
    "phi_status_requires_baa_but_baa_is_not_confirmed": "Confirm that the BAA is executed for this service profile.",
    "model_matches_denied_pattern": "Switch to an approved GA model or redact PHI before the call.",
    "feature_denied_for_service": "Disable the denied feature or route to an approved service profile.",
    "feature_not_allowed_for_service": "Use a feature explicitly allowed for PHI in this service profile.",
    "logging_mode_not_allowed_for_phi": "Use metadata_only or redacted_only logging for PHI workflows.",
    "storage_mode_not_allowed_for_phi": "Use an approved storage mode for PHI workflows.",
    "environment_requires_redacted_logging": "Production PHI workflows must not use raw logging.",
}
# --- end of fixed values ----------------------------------------------------

LISTS = {"allowed_phi_status": [], "model_patterns": ["*"], "denied_model_patterns": [], "allowed_features": [], "denied_features": [], "allowed_logging": LOGGING, "allowed_storage": STORAGE}


@dataclass(frozen=True)
class CompliancePolicy:
    default_action: str
    requires_baa: dict[str, bool]
    environments: dict[str, dict]
    services: dict[str, dict]


def parse_compliance(raw: object, name: str = "policy") -> CompliancePolicy:
    def must(ok: bool, what: str) -> None:
        if not ok:
            raise AuditError(f"{name}: {what}")

    must(isinstance(raw, dict), "compliance policy must be a YAML object")
    must(raw.get("version") == 1, "compliance policy version must be 1")
    action = raw.get("default_action", "block")
    must(action in ("block", "allow"), "default_action must be 'block' or 'allow'")
    statuses, envs, services = raw.get("phi_statuses", {}), raw.get("environments", {}), raw.get("services", {})
    must(isinstance(statuses, dict) and bool(statuses), "compliance policy must define phi_statuses")
    for s, v in statuses.items():
        must(s in PHI_STATUSES, f"unsupported phi_status {s!r}")
        must(isinstance(v, dict), f"phi_status {s!r} must be an object")
        must(isinstance(v.get("requires_baa"), bool), f"phi_status {s!r} requires boolean requires_baa")
    must(isinstance(envs, dict), "environments must be an object")
    for e, v in envs.items():
        must(isinstance(e, str) and bool(e), "environment names must be non-empty strings")
        must(isinstance(v, dict), f"environment {e!r} must be an object")
        must(all(isinstance(v.get(f, False), bool) for f in ("require_redacted_logging", "require_audit")), f"environment {e!r} boolean fields are invalid")
    must(isinstance(services, dict) and bool(services), "compliance policy must define at least one service")
    full = {}
    for i, v in services.items():
        must(isinstance(i, str) and bool(i), "service profile ids must be non-empty strings")
        must(isinstance(v, dict), f"service profile {i!r} must be an object")
        for f in ("vendor", "service"):
            must(isinstance(v.get(f), str) and bool(v[f]), f"service profile {i!r} field {f!r} must be a non-empty string")
        for f in ("covered_service", "baa_executed"):
            must(isinstance(v.get(f), bool), f"service profile {i!r} field {f!r} must be a boolean")
        must(isinstance(v.get("allow_preview", False), bool), f"service profile {i!r} field 'allow_preview' must be a boolean")
        for f, d in LISTS.items():
            x = v.get(f, d)
            must(isinstance(x, list) and all(isinstance(y, str) and y for y in x), f"service profile {i!r} field {f!r} must be a string array")
        odd = sorted(set(v.get("allowed_phi_status", [])) - set(PHI_STATUSES))
        must(not odd, f"service profile {i!r} contains unsupported PHI status(es): {', '.join(odd)}")
        full[i] = LISTS | {"allow_preview": False, "deny_reason": "", "notes": ""} | v
    return CompliancePolicy(action, {s: v["requires_baa"] for s, v in statuses.items()}, envs, full)


def load_compliance(path: str) -> CompliancePolicy:
    with open(path, encoding="utf-8") as f:
        return parse_compliance(yaml.safe_load(f), str(path))


def glob(column: Column, patterns: list[str]) -> Column:
    """Whether the whole string fits one of the shell patterns, case counting."""
    def java(p: str) -> str:
        return re.sub(r"\\Z|\\z", "", fnmatch.translate(p)).replace("(?>", "(?:")

    return column.rlike("^(?:" + "|".join(java(p) for p in patterns) + ")\\z") if patterns else F.lit(False)


def match_service(policy: CompliancePolicy) -> Column:
    """The id of the first declared profile that fits vendor, service and model."""
    fits = [F.when((F.col("vendor") == p["vendor"]) & (F.col("service") == p["service"]) & glob(F.col("model"), p["model_patterns"]), F.lit(i)) for i, p in policy.services.items()]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def _service_rules(policy: CompliancePolicy, p: dict) -> list[Column]:
    has = lambda c, xs: F.col(c).isin(*xs) if xs else F.lit(False)
    lax = [s for s, v in policy.requires_baa.items() if not v]
    baa = ~has("phi_status", lax)
    raw_envs = [e for e, v in policy.environments.items() if v.get("require_redacted_logging")]
    denied = glob(F.col("model"), p["denied_model_patterns"])
    if not p["allow_preview"]:
        denied = denied | F.lower("model").rlike(PREVIEW)
    return [
        F.when(~has("phi_status", p["allowed_phi_status"]), "phi_status_not_allowed_for_service"),
        F.when(baa & F.lit(not p["covered_service"]), "phi_status_requires_baa_but_service_is_not_covered"),
        F.when(baa & F.lit(not p["baa_executed"]), "phi_status_requires_baa_but_baa_is_not_confirmed"),
        F.when(denied, "model_matches_denied_pattern"),
        F.when(has("feature", p["denied_features"]), "feature_denied_for_service"),
        F.when(F.lit(bool(p["allowed_features"])) & ~has("feature", p["allowed_features"]), "feature_not_allowed_for_service"),
        F.when(~has("logging", p["allowed_logging"]), "logging_mode_not_allowed_for_phi"),
        F.when(~has("storage", p["allowed_storage"]), "storage_mode_not_allowed_for_phi"),
        F.when(has("environment", raw_envs) & (F.col("logging") == "raw"), "environment_requires_redacted_logging"),
    ]


def guard_compliance(requests: DataFrame, policy: Policy, compliance: CompliancePolicy, **how) -> DataFrame:
    """requests (text, layer and the context's columns) with the guard's columns and the decision; missing context columns take their defaults."""
    for name, default in CONTEXT.items():
        if name not in requests.columns and default is not None:
            requests = requests.withColumn(name, F.lit(default or None).cast("string"))
        elif name not in requests.columns:
            requests = requests.withColumn(name, F.lit("unspecified" if name == "endpoint" else None).cast("string"))
    fault = F.coalesce(
        F.when(~F.coalesce(F.col("phi_status").isin(*PHI_STATUSES), F.lit(False)), F.concat(F.lit("unsupported phi_status "), F.coalesce("phi_status", F.lit("null")))),
        *[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"context field '{c}' must be non-empty")) for c in REQUIRED],
    )
    out = guard(requests.withColumn("phi_status", F.when(fault.isNotNull(), F.raise_error(fault).cast("string")).otherwise(F.col("phi_status"))), policy, "block_on_violation", **how)
    out = out.withColumn("service_id", match_service(compliance))
    none = F.array().cast("array<string>")
    rules = F.lit(None).cast("array<string>")
    for i, p in compliance.services.items():
        rules = F.when(F.col("service_id") == i, F.filter(F.array(*_service_rules(compliance, p)), lambda x: x.isNotNull())).otherwise(rules)
    unknown = F.array(F.lit("unknown_service_profile"))
    block, missing = F.lit(compliance.default_action == "block"), F.col("service_id").isNull()
    reasons = F.when(~F.col("has_phi"), none).when(missing & block, unknown).when(missing, none).otherwise(rules)
    out = out.withColumn("block_reasons", F.array_distinct(F.concat(F.when(F.col("should_block"), F.array(F.lit("phi_policy_violation"))).otherwise(none), reasons)))
    out = out.withColumn("warnings", F.when(missing & F.when(F.col("has_phi"), ~block).otherwise(block), unknown).otherwise(none))
    actions = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    out = out.withColumn("required_actions", F.array_distinct(F.transform("block_reasons", lambda r: F.element_at(actions, r))))
    env = lambda f: F.coalesce(*[F.when(F.col("environment") == e, F.lit(bool(v.get(f, False)))) for e, v in compliance.environments.items()], F.lit(False))
    audit = F.struct("has_phi", "finding_count", F.col("service_id").isNotNull().alias("service_matched"), "service_id", F.struct(env("require_redacted_logging").alias("require_redacted_logging"), env("require_audit").alias("require_audit")).alias("environment_policy"), F.lit("deterministic_policy").alias("decision_basis"))
    return out.withColumn("text_should_block", F.col("should_block")).withColumn("should_block", F.size("block_reasons") > 0).withColumn("compliance_allowed", F.size("block_reasons") == 0).withColumn("audit", audit)


#: Fields of a text decision that hold nothing of the text.
SAFE = ["layer", "mode", "finding_count", "categories", "has_phi", "has_redactions", "has_violations", "worst_disposition", "recommended_action", "should_block", "should_redact"]


def decision_dict(row: dict, *, include_phi: bool = False) -> dict:
    """A row of guard_compliance as nested dictionaries; the text and its findings only if asked for."""
    text = {k: row[k] for k in SAFE} | {"should_block": row["text_should_block"]}
    if include_phi:
        text |= {"text": row["text"], "findings": row["findings"], "redacted_text": row["redacted_text"]}
    context = {k: row[k] for k in dict.fromkeys([*CONTEXT, *REQUIRED, "phi_status", "layer"]) if k in row}
    kept = ("service_id", "compliance_allowed", "should_block", "block_reasons", "warnings", "required_actions", "redacted_text", "audit")
    return {"context": context, "text_decision": text} | {k: row[k] for k in kept}
