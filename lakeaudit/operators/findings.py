"""Findings, boundary exposures and summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import RANK
from ..functions.stage import staged
from ..sources.policy import Policy
from .segments import external_path, segment_candidates

#: Findings (or events) whose share of a value makes one row of its lists.
PART = 4096
CANDIDATE = ("category", "value", "start", "end", "confidence", "reason", "detector")
ORDER = ["event_no", "seg_no", "start", "end", "category"]


def _at() -> Column:
    """Where a finding stands in the trace."""
    return F.struct("event_no", "seg_no", "start", "end").alias("at")


def rank(disposition: Column) -> Column:
    return F.when(disposition == "violation", RANK["violation"]).when(disposition == "redact", RANK["redact"]).otherwise(RANK["allowed"])


def boundary_action(disposition: Column, layer: Column) -> Column:
    return F.when(disposition == "violation", F.concat(F.lit("Remove or redact before "), layer, F.lit("."))).when(disposition == "redact", F.concat(F.lit("Redact before "), layer, F.lit("."))).otherwise(F.lit("Review only; no policy boundary action required."))


def redaction_action(disposition: Column) -> Column:
    return F.when(disposition == "violation", "remove_or_redact_before_this_layer").when(disposition == "redact", "redact_before_this_layer").otherwise("review")


def _width(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _counted(ranged: DataFrame, part: str, name: str) -> DataFrame:
    """Rows whose parts follow each other, sorted within a task, with a running number from 1. They are written, and only the counts of the parts meet in one place."""
    ranged = staged(ranged.withColumn("__i", F.monotonically_increasing_id()), name)
    starts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.min("__i").alias("low"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(part, (before - F.col("low")).alias("shift"))
    return ranged.join(F.broadcast(starts), part).withColumn(name, F.col("__i") + F.col("shift") + 1).drop(part, "__i", "shift")


def numbered(df: DataFrame, order: list, name: str, *, cheap: bool = False) -> DataFrame:
    """df with a running number from 1 in the given order, without gathering rows in one task.

    Rows are ranged by the order; each range counts its rows, and a range's
    numbers begin after those before it. Only the counts meet in one place. The rows
    are written before they are ranged, since ranging samples them first (cheap: they
    come from a shuffle, whose files serve both readings, or from a plain reading of a table), and after, since the bounds are random.
    """
    df = df if cheap else staged(df, name)
    ranged = df.repartitionByRange(_width(df), *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    return _counted(ranged, "__p", name)


def find(events: DataFrame, policy: Policy, *, number: bool = True, analyzer: Callable[[], object] | None = None) -> DataFrame:
    """One row for each finding: candidates of each segment under the policy.

    Numbers: the ranges of events come from quantiles of event_no, which are read without the content, so candidates
    are found once and written once, before the policy's columns are added.
    """
    events = events.select("event_no", "event_id", "layer", "content", "source", "destinations", "external_content_paths")
    if number:
        width = _width(events)
        bounds = events.approxQuantile("event_no", [i / width for i in range(1, width)], 0.25 / width)
        cuts = np.array(sorted({int(x) for x in bounds}), np.int64)
        parts = segment_candidates(events, analyzer=analyzer, cuts=cuts).where(F.size("found") > 0).repartitionById(width, "part")
    else:
        parts = segment_candidates(events, analyzer=analyzer)
    found = parts.withColumn("c", F.explode("found")).withColumn("content_path", F.col("c.content_path"))
    rows = found.select("event_no", "c.seg_no", "event_id", "layer", "content_path", external_path().alias("external_content_path"), "source", "destinations", *[f"c.{n}" for n in CANDIDATE], *(["part"] if number else []))
    if number:
        rows = _counted(rows.sortWithinPartitions(*ORDER), "part", "finding_no")
    dim = F.broadcast(policy.table(events.sparkSession))
    rows = rows.join(dim, ["category", "layer"], "left")
    rows = rows.withColumn("rule", F.coalesce("rule", F.concat(F.lit("No policy configured for category '"), "category", F.lit("'."))))
    rows = rows.fillna({"disposition": "allowed", "risk": "unknown", "redaction": "[REDACTED]"})
    rows = rows.withColumn("value_hash", value_hash()).withColumn("action", redaction_action(F.col("disposition")))
    return rows.withColumn("finding_id", F.format_string("finding-%03d", "finding_no")) if number else rows


def seen(events: DataFrame, *, analyzer: Callable[[], object] | None = None) -> DataFrame:
    """(category, value, layer) of each finding: what counts need, and all that the pass over the content carries."""
    parts = segment_candidates(events.select("layer", "content"), analyzer=analyzer, fields=["category", "value"])
    return parts.select("layer", F.inline("found")).select("category", "value", "layer")


def value_hash() -> Column:
    return F.concat(F.lit("sha256:"), F.sha2("value", 256))


def display(mode: str) -> Column:
    """The value as a report shows it: raw, redacted or hashed."""
    if mode not in ("raw", "redacted", "hashed"):
        raise ValueError(f"unsupported report value mode {mode!r}; expected one of: hashed, raw, redacted")
    return F.col({"raw": "value", "redacted": "redaction", "hashed": "value_hash"}[mode])


LISTS = ("finding_ids", "event_ids", "content_paths_seen", "external_content_paths_seen", "sources", "destinations")


def _parts(findings: DataFrame, lists: Sequence[str], more: Sequence[str] = ()) -> tuple[DataFrame, dict[str, Column]]:
    """Findings gathered for each (category, value, part), in their order, as s; and the lists that s gives."""
    named = "finding_id" in findings.columns
    part = F.floor(F.col("finding_no" if "finding_no" in findings.columns else "event_no") / PART).alias("part")
    own = F.col("finding_id") if named else F.lit(None).cast("string")
    once = lambda c: F.array_compact(F.array_distinct(F.col(f"s.{c}")))
    objects = F.array_distinct(F.flatten(F.transform(F.array_distinct(F.col("s.destinations")), lambda d: F.from_json(d, "array<string>"))))
    every = {
        "finding_ids": (own.alias("finding_id"), F.array_compact("s.finding_id")), "event_ids": (F.col("event_id"), once("event_id")), "content_paths_seen": (F.col("content_path"), once("content_path")),
        "external_content_paths_seen": (F.col("external_content_path"), once("external_content_path")), "sources": (F.col("source"), once("source")), "destinations": (F.col("destinations"), objects),
    }
    fields = [every[n][0] for n in LISTS if n in lists] + [F.col(c) for c in more if not (c == "event_id" and "event_ids" in lists)]
    rows = findings.groupBy("category", "value", part).agg(F.array_sort(F.collect_list(F.struct(_at(), *fields))).alias("s"))
    return rows, {n: every[n][1] for n in LISTS if n in lists}


def exposure_parts(findings: DataFrame) -> DataFrame:
    """What was seen of each (category, value), in rows of a bounded size: (category, value, part, and lists in the order of the findings).

    A part holds what PART consecutive findings (without numbers: the findings of PART
    consecutive events) have of a value, so a value in a third of all findings
    has many rows of one size and no task gathers it. Lists: finding_ids, event_ids, content_paths_seen,
    external_content_paths_seen, sources, destinations (both as JSON); each thing once for a part.
    """
    rows, lists = _parts(findings, LISTS)
    return rows.select("category", "value", "part", *[c.alias(n) for n, c in lists.items()])


def exposures(findings: DataFrame, *, number: bool = True, lists: bool | Sequence[str] = True) -> DataFrame:
    """One row for each (category, value), with the worst finding, counts and what was seen, in the order in which it was first seen.

    lists: what was seen as the reports show it, in one row, joined from parts of a value, so findings are read and
    moved once and a value in a third of all findings is gathered in many tasks first; or the names of the lists that are wanted. Without them, rows come
    from one row for each value and layer, and every row is small (see exposure_parts for the lists). Findings without
    numbers (find with number=False) have no finding_ids.
    """
    names = [n for n in LISTS if lists is True or n in (lists or ())]
    if names:
        rows, seen = _parts(findings, names, ["event_id", "layer", "disposition", "redaction"])
        worst = F.array_min(F.transform("s", lambda x: F.struct((-rank(x["disposition"])).alias("r"), x["at"].alias("at"), x["disposition"].alias("disposition"), x["layer"].alias("layer"))))
        first = F.get("s", F.lit(0))
        rows = rows.select("category", "value", "part", F.size("s").alias("n"), F.struct(first["at"].alias("at"), first["event_id"].alias("event_id"), first["redaction"].alias("redaction")).alias("first"), worst.alias("worst"), F.array_distinct("s.layer").alias("layers_seen"), *[c.alias(n) for n, c in seen.items()])
        out = rows.groupBy("category", "value").agg(F.sum("n").alias("n_findings"), F.min("first").alias("first"), F.min("worst").alias("worst"), F.array_sort(F.collect_list(F.struct("part", "layers_seen", *names))).alias("p"))
        whole = lambda c: F.flatten(F.col(f"p.{c}"))
        shown = [(whole(c) if c == "finding_ids" else F.array_distinct(whole(c))).alias(c) for c in names]
        layers = F.array_distinct(whole("layers_seen")).alias("layers_seen")
    else:
        by = findings.groupBy("category", "value", "layer").agg(
            F.count(F.lit(1)).alias("n"), F.min(_at()).alias("at"), F.min(F.struct(_at(), "event_id", "redaction")).alias("first"), F.min(F.struct((-rank(F.col("disposition"))).alias("r"), _at(), "disposition", "layer")).alias("worst"),
        )
        out = by.groupBy("category", "value").agg(F.sum("n").alias("n_findings"), F.transform(F.array_sort(F.collect_list(F.struct("at", "layer"))), lambda x: x["layer"]).alias("layers_seen"), F.min("first").alias("first"), F.min("worst").alias("worst"))
        shown, layers = [], F.col("layers_seen")
    worst, layer = F.col("worst.disposition"), F.col("worst.layer")
    out = out.select(
        "category", "value", value_hash().alias("value_hash"), "n_findings", layers, F.col("first.event_id").alias("first_seen_event_id"), F.col("first.redaction").alias("redaction"),
        worst.alias("worst_disposition"), layer.alias("worst_layer"), boundary_action(worst, layer).alias("recommended_boundary_action"), F.col("worst.r").alias("__r"), *shown,
    )
    if number:
        # with lists the rows are written first, so that sampling for the ranges gathers no list twice
        out = numbered(out, ["__r", "first_seen_event_id", "category", "value"], "exposure_no", cheap=not names).withColumn("exposure_id", F.format_string("exposure-%03d", "exposure_no"))
    return out.drop("__r")


def summary(findings: DataFrame, policy: Policy | None = None) -> DataFrame:
    """(kind, key, n): total, high_risk, exposures, and counts by disposition, layer, category and worst_disposition.

    One pass over the findings: a stored row for each value, layer and decision has all that the counts need. policy:
    findings come without a decision (see seen), which then joins these rows rather than all findings.
    """
    decided = [] if policy else ["disposition", "risk"]
    tally = staged(findings.groupBy("category", "value", "layer", *decided).agg(F.count(F.lit(1)).alias("n")), "tally")
    if policy:
        dim = F.broadcast(policy.table(findings.sparkSession).select("category", "layer", "disposition", "risk"))
        tally = tally.join(dim, ["category", "layer"], "left").fillna({"disposition": "allowed", "risk": "unknown"})
    small = tally.groupBy("disposition", "layer", "category", "risk").agg(F.sum("n").alias("n"))
    sets = small.groupingSets([["disposition"], ["layer"], ["category"]], "disposition", "layer", "category").agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "disposition").when(F.col("g") == 5, "layer").otherwise("category")
    by = sets.select(kind.alias("kind"), F.coalesce("disposition", "layer", "category").alias("key"), "n")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    totals = F.array(F.struct(F.lit("findings").alias("key"), zero("n").alias("n")), F.struct(F.lit("high_risk").alias("key"), zero(F.when(F.col("risk") == "high", F.col("n"))).alias("n")))
    high = small.agg(totals.alias("t")).select(F.lit("total").alias("kind"), F.inline("t"))
    # a value's worst decision as a number, which can be gathered by hashing
    values = tally.groupBy("category", "value").agg(F.max(rank(F.col("disposition"))).alias("r")).groupBy("r").count()
    named = F.element_at(F.create_map(*[F.lit(x) for name, r in RANK.items() for x in (r, name)]), F.col("r"))
    worst = values.select(F.lit("worst_disposition").alias("kind"), named.alias("key"), F.col("count").alias("n"))
    all_ = values.agg(zero("count").alias("n")).select(F.lit("total").alias("kind"), F.lit("exposures").alias("key"), "n")
    return by.union(high).union(worst).union(all_)
