"""The stateless stages under Structured Streaming (an extension: the audited tools work on whole files)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.findings import find
from ..operators.guard import guard
from ..sources.policy import Policy


def stream_findings(events: DataFrame, policy: Policy) -> DataFrame:
    """Findings without running numbers of a streaming trace."""
    return find(events, policy, number=False)


def stream_guard(events: DataFrame, policy: Policy, mode: str = "redact") -> DataFrame:
    return guard(events, policy, mode, text="content")


def stream_summary(events: DataFrame, policy: Policy) -> DataFrame:
    """Running counts by layer, category and disposition, for update or complete mode; state holds only these keys."""
    return stream_findings(events, policy).groupBy("layer", "category", "disposition").agg(F.count(F.lit(1)).alias("n"))


def run_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what has come so far as Parquet, exactly once for each checkpoint."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
