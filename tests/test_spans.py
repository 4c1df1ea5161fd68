import random
import time

import pytest
from pyspark.sql import functions as F

from lakeaudit.functions.spans import PIECE, replaced, running
from lakeaudit.operators.guard import guard

from .test_audit import P

SPANS = "array<struct<start:int,end:int,mark:string>>"


def plain(text, spans):
    out, at = "", 0
    for a, b, m in spans:
        if a >= at:
            out += text[at:a] + m
        at = max(at, b)
    return out + text[at:]


def test_replacement_against_a_plain_loop(spark):
    rng, rows = random.Random(7), [(0, None, []), (1, "", []), (2, "whole", [(0, 5, "X")]), (3, "é🙂" * PIECE, [(PIECE, PIECE + 1, "a"), (PIECE + 1, 2 * PIECE, "b")])]
    for i in range(4, 60):
        text = "".join(rng.choice("aé🙂\n") for _ in range(rng.choice([5, 60, 3 * PIECE, 3 * PIECE + 1])))
        cut = [sorted(rng.sample(range(len(text) + 1), 2)) for _ in range(rng.randrange(40))]
        rows.append((i, text, sorted((a, b, f"<{k}>") for k, (a, b) in enumerate(cut) if a < b)))
    df = spark.createDataFrame(rows, f"id int, text string, s {SPANS}")
    got = {r["id"]: r["o"] for r in replaced(df, "text", "s", lambda x: x["mark"], "o").collect()}
    assert got == {i: t if t is None else plain(t, s) for i, t, s in rows}


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64, 1000])
def test_running_sums(spark, n):
    df = spark.createDataFrame([([i % 13 for i in range(n)],)], "v array<int>")
    assert df.select(running(F.col("v"), lambda a, b: a + b)).first()[0] == [sum(k % 13 for k in range(i + 1)) for i in range(n)]


def test_time_grows_with_the_spans(spark):
    """Four times as many findings in one text: about four times the time, not sixteen."""

    def took(n):
        df = spark.createDataFrame([("MBR-SYN-0001 é " * n, "memory")], "text string, layer string").repartition(1)
        begun = time.time()
        out = guard(df, P).select("redacted_text", "finding_count").first()
        assert out["finding_count"] == n and out["redacted_text"] == "[REDACTED_MEMBER_ID] é " * n
        return time.time() - begun

    took(100)
    few, many = min(took(10_000) for _ in range(2)), min(took(40_000) for _ in range(2))
    assert many < 8 * few + 2
