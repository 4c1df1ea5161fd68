import json
import random

import pytest
from pyspark.sql import functions as F

from lakeaudit.functions.rules import RANK
from lakeaudit.operators import findings as ops
from lakeaudit.sources.trace import from_columns

from .test_audit import P

LAYERS = ["user_message", "rag_context", "tool_output", "model_input", "memory", "debug_log"]


def trace(spark, n=160, seed=5):
    rng, rows = random.Random(seed), []
    for i in range(n):
        ids = [f"MBR-SYN-{rng.choice([1, 1, 1, 2, 3, 40 + i % 9]):04}" for _ in range(rng.randrange(4))]
        plain = " ".join(ids + [f"555-013-{rng.randrange(3):04}"] * rng.randrange(2))
        content = json.dumps({"a": {"b": plain}, "c": [x for x in ids]}) if rng.random() < 0.5 else plain
        there = [{"layer": "model_input", "path": f"p{rng.randrange(2)}"}] * rng.randrange(3)
        rows.append((i + 1, f"e{i % 150}", rng.choice(LAYERS), content, json.dumps({"type": rng.choice("xy")}), json.dumps(there), ["base"] if rng.random() < 0.3 else None))
    df = spark.createDataFrame(rows, "event_no long, event_id string, layer string, content string, source string, destinations string, external_content_paths array<string>")
    return from_columns(df.withColumn("timestamp", F.lit("t")))


def plain(rows):
    """Exposures from the definition, one finding after another."""
    seen = {}
    for r in rows:
        x = seen.setdefault((r["category"], r["value"]), {k: [] for k in ("finding_ids", "event_ids", "content_paths_seen", "external_content_paths_seen", "sources", "destinations", "layers_seen")} | {"first": r["event_id"], "worst": r, "n": 0})
        x["n"] += 1
        x["finding_ids"].append(r["finding_id"])
        for name, things in (("event_ids", [r["event_id"]]), ("content_paths_seen", [r["content_path"]]), ("external_content_paths_seen", [r["external_content_path"]]), ("sources", [r["source"]]), ("layers_seen", [r["layer"]]), ("destinations", [json.dumps(d) for d in json.loads(r["destinations"])])):
            x[name] += [t for i, t in enumerate(things) if t is not None and t not in x[name] and t not in things[:i]]
        if RANK[r["disposition"]] > RANK[x["worst"]["disposition"]]:
            x["worst"] = r
    order = sorted(seen, key=lambda k: (-RANK[seen[k]["worst"]["disposition"]], seen[k]["first"], *k))
    return {k: seen[k] | {"id": f"exposure-{i + 1:03}"} for i, k in enumerate(order)}


@pytest.mark.parametrize("part", [4096, 7])
def test_against_one_finding_after_another(spark, monkeypatch, part):
    monkeypatch.setattr(ops, "PART", part)
    found = ops.find(trace(spark), P)
    rows = sorted((r.asDict() for r in found.collect()), key=lambda r: r["finding_no"])
    assert [r["finding_no"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) > 150
    want = plain(rows)
    got = {(r["category"], r["value"]): r for r in ops.exposures(found).collect()}
    assert set(got) == set(want)
    for k, x in want.items():
        r = got[k]
        assert (r["exposure_id"], r["n_findings"], r["first_seen_event_id"], r["worst_disposition"], r["worst_layer"]) == (x["id"], x["n"], x["first"], x["worst"]["disposition"], x["worst"]["layer"])
        assert {n: r[n] if n != "destinations" else [json.dumps(json.loads(d)) for d in r[n]] for n in ("finding_ids", "event_ids", "content_paths_seen", "external_content_paths_seen", "sources", "destinations", "layers_seen")} == {n: x[n] for n in ("finding_ids", "event_ids", "content_paths_seen", "external_content_paths_seen", "sources", "destinations", "layers_seen")}


def test_parts_have_a_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(ops, "PART", 16)
    df = spark.range(200).select((F.col("id") + 1).alias("event_no"), F.concat(F.lit("e"), "id").alias("event_id"), F.lit("t").alias("timestamp"), F.lit("memory").alias("layer"), F.lit("MBR-SYN-0001").alias("content"))
    parts = ops.exposure_parts(ops.find(from_columns(df), P)).collect()
    assert max(len(r["finding_ids"]) for r in parts) <= 16 and sum(len(r["finding_ids"]) for r in parts) == 200
    small = ops.exposures(ops.find(from_columns(df), P, number=False), lists=False).collect()
    assert [(r["n_findings"], r["exposure_id"]) for r in small] == [(200, "exposure-001")] and "event_ids" not in small[0].asDict()


def test_summary_counts(spark):
    found = ops.find(trace(spark), P, number=False)
    rows, want = found.collect(), {}
    values = {}
    for r in rows:
        for kind in ("disposition", "layer", "category"):
            want[kind, r[kind]] = want.get((kind, r[kind]), 0) + 1
        values.setdefault((r["category"], r["value"]), []).append(r["disposition"])
        want["total", "high_risk"] = want.get(("total", "high_risk"), 0) + (r["risk"] == "high")
    for v in values.values():
        k = "worst_disposition", max(v, key=RANK.get)
        want[k] = want.get(k, 0) + 1
    want |= {("total", "findings"): len(rows), ("total", "exposures"): len(values)}
    assert {(r["kind"], r["key"]): r["n"] for r in ops.summary(found).collect()} == want
    nothing = ops.summary(found.limit(0)).collect()
    assert {(r["kind"], r["key"]): r["n"] for r in nothing} == {("total", x): 0 for x in ("findings", "high_risk", "exposures")}
