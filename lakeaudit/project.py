"""Project configuration: a JSON file that names the policies, found by walking up the folders."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from .errors import ConfigError, ConfigNotFound
from .functions.rules import CATEGORIES

FOLDER, FILE = ".lakeaudit", "config.json"


@dataclass(frozen=True)
class ProjectConfig:
    root: Path
    policy: Path
    compliance_policy: Path | None
    use_ner: bool


def default_policy() -> str:
    rows = [f"  {c}:\n    high_risk: true\n    deny_layers: [debug_log]\n    redact_layers: [model_input, rag_context, tool_output, memory]\n    redaction: \"[REDACTED_{c.upper()}]\"" for c in CATEGORIES]
    return "version: 1\ncategories:\n" + "\n".join(rows) + "\n"


_COMPLIANCE = """version: 1
default_action: block
phi_statuses:
  synthetic: {requires_baa: false}
  real_phi: {requires_baa: true}
environments:
  production: {require_redacted_logging: true}
services:
  example:
    vendor: example
    service: example_ai
    covered_service: false
    baa_executed: false
    allowed_phi_status: [synthetic]
"""


def init_project(root: str | Path, force: bool = False) -> list[Path]:
    """Write templates and configuration; existing files stay unless forced. Returns what was written."""
    home = Path(root) / FOLDER
    home.mkdir(parents=True, exist_ok=True)
    config = json.dumps({"policy": "policy.yml", "compliance_policy": "compliance.yml", "use_ner": False}, indent=2, sort_keys=True) + "\n"
    out = []
    for name, body in (("policy.yml", default_policy()), ("compliance.yml", _COMPLIANCE), (FILE, config)):
        if force or not (home / name).exists():
            (home / name).write_text(body, encoding="utf-8")
            out.append(home / name)
    return out


def discover(start: str | Path = ".") -> Path:
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if (folder / FOLDER / FILE).is_file():
            return folder / FOLDER / FILE
    raise ConfigNotFound(f"no {FOLDER}/{FILE} in {here} or above")


def load_project(path: str | Path) -> ProjectConfig:
    path = Path(path)
    if not path.is_file():
        raise ConfigNotFound(f"{path}: no such configuration")
    try:
        raw = json.loads(path.read_text(encoding="utf-8"))
    except ValueError as e:
        raise ConfigError(f"{path}: invalid JSON: {e}") from e
    if not isinstance(raw, dict) or not isinstance(raw.get("policy"), str) or not raw["policy"]:
        raise ConfigError(f"{path}: field 'policy' must be a non-empty string")
    other, ner = raw.get("compliance_policy"), raw.get("use_ner", False)
    if other is not None and not isinstance(other, str):
        raise ConfigError(f"{path}: field 'compliance_policy' must be a string")
    if not isinstance(ner, bool):
        raise ConfigError(f"{path}: field 'use_ner' must be a boolean")
    return ProjectConfig(path.parent, path.parent / raw["policy"], path.parent / other if other else None, ner)


def check_project(start: str | Path = ".") -> ProjectConfig:
    """The configuration, after its policies were read once."""
    from .operators.compliance import load_compliance
    from .sources.policy import load_policy

    config = load_project(discover(start))
    load_policy(str(config.policy))
    if config.compliance_policy:
        load_compliance(str(config.compliance_policy))
    return config
