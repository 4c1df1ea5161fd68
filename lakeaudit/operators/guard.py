"""Guards: scan, redact and decide for texts, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bulk
from ..functions.detect import detect
from ..functions.rules import LAYERS
from ..functions.spans import replaced
from ..functions.stage import spread, staged
from ..sources.policy import Policy
from .dictionary import replace_values
from .findings import boundary_action, redaction_action

MODES = ("report_only", "redact", "block_on_violation")


def _known(layer: str) -> Column:
    """The layer; an unknown one is an error."""
    return F.when(F.col(layer).isin(*LAYERS), F.col(layer)).otherwise(F.raise_error(F.concat(F.lit("unsupported layer "), F.coalesce(F.col(layer), F.lit("null")))))


def scan(df: DataFrame, policy: Policy, *, text: str = "text", layer: str = "layer", analyzer: Callable[[], object] | None = None) -> DataFrame:
    """df with findings: array of decided candidates of the whole text. An unknown layer is an error."""
    out = detect(spread(df.withColumn("__layer", _known(layer))), text, "__c", analyzer)

    def decided(x):
        c, d = x["c"], x["d"]
        return F.struct(*[c[f].alias(f) for f in ("category", "value", "start", "end", "confidence", "reason")], *[d[f].alias(f) for f in ("disposition", "risk", "rule", "redaction")], redaction_action(d["disposition"]).alias("redaction_action"))

    # the policy is looked up once for each candidate
    looked = F.transform("__c", lambda c: F.struct(c.alias("c"), policy.lookup(c["category"], F.col("__layer")).alias("d")))
    return out.withColumn("findings", F.transform(looked, decided)).drop("__c", "__layer")


def guard(df: DataFrame, policy: Policy, mode: str = "report_only", *, text: str = "text", layer: str = "layer", analyzer: Callable[[], object] | None = None) -> DataFrame:
    """df with findings, redacted_text and the decision's flags."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of: {', '.join(MODES)}")
    out = scan(df, policy, text=text, layer=layer, analyzer=analyzer)
    out = replaced(out, text, "findings", lambda f: f["redaction"], "redacted_text")
    out = out.withColumn("has_phi", F.size("findings") > 0).withColumn("has_redactions", F.col("redacted_text") != F.col(text)).withColumn("has_violations", F.exists("findings", lambda f: f["disposition"] == "violation"))
    worst = F.when(F.col("has_violations"), "violation").when(F.exists("findings", lambda f: f["disposition"] == "redact"), "redact").otherwise("allowed")
    out = out.withColumn("worst_disposition", worst)
    action = F.when(F.col("has_phi"), boundary_action(F.col("worst_disposition"), F.col(layer))).otherwise("No PHI candidates found.")
    out = out.withColumn("recommended_action", action).withColumn("mode", F.lit(mode))
    out = out.withColumn("should_block", F.col("has_violations") & F.lit(mode == "block_on_violation")).withColumn("should_redact", F.col("has_redactions") & F.lit(mode == "redact"))
    return out.withColumn("finding_count", F.size("findings").cast("long")).withColumn("categories", F.array_sort(F.array_distinct(F.col("findings.category"))))


def _marked(events: DataFrame, policy: Policy, keep: list[str], analyzer: Callable[[], object] | None) -> tuple[DataFrame, list[str]]:
    """(keep, event_no, __text, __values): the content with its spans replaced, and each value that it holds, once; and the marks. One pass, which carries nothing else.

    A value comes with its number among the event's findings and the number of its mark in one long: number * marks + mark.
    """
    marks = sorted({"[REDACTED]", *(c["redaction"] for c in policy.categories.values())})
    mark_of = {name: marks.index(c["redaction"]) for name, c in policy.categories.items()}
    plain = marks.index("[REDACTED]")
    rows = events.select(*dict.fromkeys([*keep, "event_no"]), F.col("content").alias("__content"), _known("layer").alias("__layer"))
    kept = rows.columns[:-2]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("__text", T.StringType()), T.StructField("__values", T._parse_datatype_string("array<struct<value:string,place:bigint>>"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = analyzer() if analyzer else None
        for batch in batches:
            for part, texts in bulk.read(batch, "__content"):
                yield one(part, texts, engine)

    def one(part: pa.RecordBatch, texts: list, engine: object) -> pa.RecordBatch:
        owner, found = bulk.found_in(texts, engine)
        first = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        values, starts, ends, kinds = (found.field(c).to_pylist() for c in ("value", "start", "end", "category"))
        out, own, places, sizes = [], [], [], [0]
        for text, a, b in zip(texts, first[:-1], first[1:], strict=True):
            text = str(text, "utf-8") if isinstance(text, pa.Buffer) else text
            if a < b:
                cut, at, seen = [], 0, set()
                for i in range(a, b):
                    mark = mark_of.get(kinds[i], plain)
                    cut += text[at : starts[i]], marks[mark]
                    at = ends[i]
                    if values[i] not in seen:
                        seen.add(values[i])
                        own.append(values[i])
                        places.append((i - a) * len(marks) + mark)
                text = "".join(cut) + text[at:]
            out.append(text)
            sizes.append(len(own))
        held = pa.StructArray.from_arrays([pa.array(own, pa.string()), pa.array(places, pa.int64())], names=["value", "place"])
        return pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(out, pa.string()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), held)], names=schema.names)

    return spread(rows).mapInArrow(run, schema), marks


def redact_trace(events: DataFrame, policy: Policy, *, analyzer: Callable[[], object] | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """events with redacted_content: spans replaced, then every value found anywhere in the trace. keep: the columns of events that are wanted.

    The dictionary (value: redaction of its first finding; longer values first, ties by first
    finding) stays a table. Texts meet it by the hashes of their windows (see ``dictionary``), so neither the
    driver nor a task holds it, and a text is read against the values that it may hold alone. event_no is unique.
    """
    keep = list(events.columns if keep is None else keep)
    rows, marks = _marked(events, policy, keep, analyzer)
    done = staged(rows, "guarded")
    # an event gives a value once, so the least event_no decides; numbers alone are gathered, which can be done by hashing
    no = F.coalesce("event_no", F.lit(-(2**63))).alias("no")
    found = done.select(no, F.inline("__values")).groupBy("value").agg(F.min("no").alias("no"), F.min_by("place", "no").alias("place"))
    rank = F.struct((-F.length("value")).alias("short"), F.col("no").alias("event"), F.floor(F.col("place") / len(marks)).alias("i"))
    mark = F.get(F.array(*map(F.lit, marks)), (F.col("place") % len(marks)).cast("int"))
    texts = done.select("event_no", F.col("__text").alias("text")).where("text is not null")
    again = replace_values(texts, found.select("value", mark.alias("redaction"), rank.alias("rank")))
    if again is None:
        return done.select(*keep, F.col("__text").alias("redacted_content"))
    out = done.join(again.withColumnRenamed("text", "__again"), "event_no", "left")
    return out.select(*keep, F.coalesce("__again", "__text").alias("redacted_content"))
