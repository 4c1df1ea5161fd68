"""Coverage of a corpus of traces, held against expectations."""

from __future__ import annotations

import json
import os

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stage import staged
from ..operators.segments import segment_candidates
from ..sources.policy import Policy
from ..sources.trace import load_trace


def coverage(events: DataFrame, policy: Policy) -> DataFrame:
    """One row for each trace: events, findings, exposures, and candidates by category and layer. events: a trace column too.

    Categories and layers count candidates in the raw content; findings and
    exposures follow the segments. Layers without candidates count 0. The content is read once.
    """
    rows = segment_candidates(events.select("trace", "layer", "content"), raw=True)
    fact = lambda kind, layer=None, category=None, value=None: F.struct(F.lit(kind).alias("kind"), *[(F.lit(None).cast("string") if c is None else c).alias(n) for n, c in (("layer", layer), ("category", category), ("value", value))])
    facts = F.concat(F.array(fact("event", F.col("layer"))), F.transform("found", lambda c: fact("finding", None, c["category"], c["value"])), F.transform("raw", lambda c: fact("raw", F.col("layer"), c)))
    tally = rows.select("trace", F.explode(facts).alias("f")).groupBy("trace", "f.kind", "f.layer", "f.category", "f.value").agg(F.count(F.lit(1)).alias("n"))
    # a few rows for each trace from here on
    tally = staged(tally.groupBy("trace", "kind", "layer", "category").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("values")), "coverage")
    is_ = lambda kind, c: F.sum(F.when(F.col("kind") == kind, F.col(c)).otherwise(0))
    base = tally.groupBy("trace").agg(is_("event", "n").alias("events"), is_("finding", "n").alias("findings"), is_("finding", "values").alias("exposures"))
    entries = lambda key, n: F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, n))))
    by_category = tally.where("kind = 'raw'").groupBy("trace", "category").agg(F.sum("n").alias("count")).groupBy("trace").agg(entries("category", "count").alias("categories"))
    by_layer = tally.where("kind <> 'finding'").groupBy("trace", "layer").agg(is_("raw", "n").alias("n")).groupBy("trace").agg(entries("layer", "n").alias("layers"))
    out = base.join(by_category, "trace", "left").join(by_layer, "trace", "left")
    empty = F.create_map().cast("map<string,bigint>")
    return out.withColumn("categories", F.coalesce("categories", empty)).withColumn("layers", F.coalesce("layers", empty))


def evaluate(row: dict, expected: dict | None) -> dict:
    """Checks of one trace; without an expectation there is nothing to fail."""
    e = (expected or {}).get("expected", {})
    missing = sorted(set(e.get("required_categories", [])) - {k for k, n in row["categories"].items() if n})
    layers = sorted(set(e.get("required_layers", [])) - set(row["layers"]))
    ok = row["findings"] >= e.get("min_findings", 0) and row["findings"] <= e.get("max_findings", row["findings"]) and row["exposures"] >= e.get("min_boundary_exposures", 0)
    return {"passed": ok and not missing and not layers, "missing_categories": missing, "missing_layers": layers}


def corpus_report(spark: SparkSession, traces: str, expectations: str, policy: Policy) -> dict:
    names = sorted(n for n in os.listdir(traces) if n.endswith(".jsonl") and not n.startswith("invalid_"))
    wanted: dict[str, dict] = {}
    for n in sorted(os.listdir(expectations)):
        if n.endswith((".yml", ".yaml")):
            with open(os.path.join(expectations, n), encoding="utf-8") as f:
                x = yaml.safe_load(f)
            wanted[x["trace"]] = x
            wanted.setdefault(os.path.basename(x["trace"]), x)
    every = None
    for n in names:
        one = load_trace(spark, os.path.join(traces, n)).withColumn("trace", F.lit(os.path.join(traces, n)))
        every = one if every is None else every.unionByName(one)
    rows = [r.asDict() for r in coverage(every, policy).orderBy("trace").toLocalIterator()] if every is not None else []
    for r in rows:
        r |= evaluate(r, wanted.get(r["trace"], wanted.get(os.path.basename(r["trace"]))))
    total = {k: sum(r[k] for r in rows) for k in ("events", "findings", "exposures")}
    return {"traces": rows, "total": total | {"traces": len(rows), "categories": sorted({c for r in rows for c in r["categories"]})}, "passed": all(r["passed"] for r in rows)}


def write_corpus_report(report: dict, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(report, indent=2, sort_keys=True) + "\n")
