"""Spans of a text in arrays: running values and replacement in steps that grow with the spans, not with their square."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of a piece of a text; doublings that reach over any array.
PIECE, DOUBLINGS = 1024, 31


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running values of an array under an associative function: each takes in what stands 1, 2, 4, ... places before, so n values need n log n steps."""
    shifts = F.array(*[F.lit(1 << i) for i in range(DOUBLINGS)])
    return F.aggregate(shifts, values, lambda s, k: F.when(k >= F.size(s), s).otherwise(F.transform(s, lambda x, i: F.when(i >= k, combine(x, F.get(s, i - k))).otherwise(x))))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """The text between two code points, from its pieces; a substring of the whole text would walk it from its begin."""
    a, b = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    first, last = F.get(pieces, a), F.coalesce(F.get(pieces, b), F.lit(""))
    across = F.concat(F.substring(first, start % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, a + 2, b - a - 1), ""), F.substring(last, F.lit(1), end % PIECE))
    return F.when(start >= end, F.lit("")).when(a == b, F.substring(first, start % PIECE + 1, end - start)).otherwise(across)


def replaced(df: DataFrame, text: str, spans: str, mark: Callable[[Column], Column], out: str) -> DataFrame:
    """df with a column out: the text with its spans (in order of start) replaced by their marks; spans that overlap are replaced as one, by the first one's mark.

    Without spans the text stays; a null text stays null. The names __pieces and __ends are reserved.
    """
    some = F.size(spans) > 0
    df = df.withColumn("__pieces", F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))).withColumn("__ends", F.when(some, running(F.transform(spans, lambda x: x["end"]), F.greatest)))
    ends, pieces = F.col("__ends"), F.col("__pieces")
    before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
    parts = F.transform(spans, lambda x, i: F.when(x["start"] >= before(i), F.concat(_cut(pieces, before(i), x["start"]), mark(x))))
    rest = _cut(pieces, F.element_at(ends, -1), F.length(text))
    return df.withColumn(out, F.when(some, F.concat(F.array_join(parts, ""), rest)).otherwise(F.col(text))).drop("__pieces", "__ends")
