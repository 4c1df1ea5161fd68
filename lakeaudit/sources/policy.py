"""Layer policies: YAML to a table of one row for each category and layer."""

from __future__ import annotations

from dataclasses import dataclass

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PolicyError
from ..functions.rules import LAYERS

DIM = "category string, layer string, disposition string, risk string, rule string, redaction string"


@dataclass(frozen=True)
class Policy:
    """categories: name to {high_risk, deny_layers, redact_layers, allow_layers, redaction}."""

    categories: dict[str, dict]

    def rows(self) -> list[tuple]:
        out = []
        for name, c in self.categories.items():
            risk = "high" if c.get("high_risk") else "standard"
            for layer in LAYERS:
                if layer in c.get("deny_layers", ()):
                    verdict, rule = "violation", f"{name} is denied in {layer}."
                elif layer in c.get("redact_layers", ()):
                    verdict, rule = "redact", f"{name} requires redaction in {layer}."
                else:
                    known = layer in c.get("allow_layers", ())
                    verdict, rule = "allowed", f"{name} is explicitly allowed in {layer}." if known else f"{name} has no layer-specific restriction for {layer}."
                out.append((name, layer, verdict, risk, rule, c["redaction"]))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """At most categories x layers rows: small enough to broadcast by construction."""
        return spark.createDataFrame(self.rows(), DIM)

    def lookup(self, category: Column, layer: Column) -> Column:
        """The decision as a struct, without a join."""
        pairs = [x for c, l, *rest in self.rows() for x in (F.lit(f"{c}|{l}"), F.struct(*[F.lit(v).alias(n) for n, v in zip(("disposition", "risk", "rule", "redaction"), rest, strict=True)]))]
        unknown = F.struct(F.lit("allowed").alias("disposition"), F.lit("unknown").alias("risk"), F.concat(F.lit("No policy configured for category '"), category, F.lit("'.")).alias("rule"), F.lit("[REDACTED]").alias("redaction"))
        return F.coalesce(F.element_at(F.create_map(*pairs), F.concat_ws("|", category, layer)), unknown) if pairs else unknown


def parse_policy(raw: object, name: str = "policy") -> Policy:
    if not isinstance(raw, dict):
        raise PolicyError(f"{name}: policy must be a YAML object")
    if raw.get("version") != 1:
        raise PolicyError(f"{name}: policy version must be 1")
    categories = raw.get("categories")
    if not isinstance(categories, dict) or not categories:
        raise PolicyError(f"{name}: policy must define at least one category")
    for key, c in categories.items():
        if not isinstance(key, str) or not key:
            raise PolicyError(f"{name}: category names must be non-empty strings")
        if not isinstance(c, dict):
            raise PolicyError(f"{name}: category {key!r} must be an object")
        for field, kind, what in (("description", str, "a string"), ("high_risk", bool, "a boolean")):
            if not isinstance(c.get(field, kind()), kind):
                raise PolicyError(f"{name}: category {key!r} field {field!r} must be {what}")
        if not isinstance(c.get("redaction"), str) or not c["redaction"]:
            raise PolicyError(f"{name}: category {key!r} must define a redaction string")
        for field in ("deny_layers", "redact_layers", "allow_layers"):
            layers = c.get(field, [])
            if not isinstance(layers, list) or not all(isinstance(x, str) for x in layers):
                raise PolicyError(f"{name}: category {key!r} field {field!r} must be a string array")
            if odd := sorted(set(layers) - set(LAYERS)):
                raise PolicyError(f"{name}: category {key!r} field {field!r} contains unsupported layer(s): {', '.join(odd)}; expected one of: {', '.join(sorted(LAYERS))}")
    return Policy(categories)


def load_policy(path: str) -> Policy:
    with open(path, encoding="utf-8") as f:
        try:
            return parse_policy(yaml.safe_load(f), str(path))
        except yaml.YAMLError as e:
            raise PolicyError(f"{path}: invalid YAML: {e}") from e
