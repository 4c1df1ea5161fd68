import re
import time

import pytest

from lakeaudit.llm import secretscan


@pytest.mark.parametrize("n", [3, 1000])
def test_many_spans_in_one_text(spark, n):
    text = "é token=abcdef12 client_id=xyz9 🙂\n" * n
    row = secretscan.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    want = [(m.start(), m.end(), "assign") for m in re.finditer(r"token=\S+", text)]
    assert [(s["start"], s["end"], s["kind"]) for s in row["base"]] == want and row["n_assign"] == n
    ids = [(m.start(), m.end(), "identifier") for m in re.finditer(r"client_id=\S+", text)]
    assert [(s["start"], s["end"], s["kind"]) for s in row["found"]] == sorted(want + ids)
    assert secretscan.redact(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()["text"] == "é [SECRET] [SECRET] 🙂\n" * n


def test_time_grows_with_the_spans(spark):
    """Four times the spans in one text: about four times the time, not sixteen."""

    def took(n):
        df = spark.createDataFrame([(1, "word token=abcdef12345 \n" * n)], "doc_id int, text string").repartition(1)
        begun = time.time()
        assert secretscan.redact(df).first()["text"] == "word [SECRET] \n" * n
        return time.time() - begun

    took(100)
    few, many = min(took(10_000) for _ in range(2)), min(took(40_000) for _ in range(2))
    assert many < 8 * few + 2
