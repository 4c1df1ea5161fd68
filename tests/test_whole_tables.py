import pytest
from lakeaudit.plans.registry import QUERIES


@pytest.mark.parametrize(("name", "value"), [("detect_email", "jo@example.org"), ("detect_ip", "192.0.2.7")])
def test_documents_of_every_language(spark, tmp_path, name, value):
    noun = "email" if name == "detect_email" else "IP"
    rows = [(i, f"{noun} {value} x", lang) for i, lang in enumerate(["en", "de", "fr", None])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {(r["doc_id"], r["n"]) for r in QUERIES[name](spark, str(tmp_path)).collect()} == {(i, 1) for i in range(4)}


@pytest.mark.parametrize("name", ["content_segments", "external_paths"])
def test_segments_of_every_order(spark, tmp_path, name):
    orders = spark.createDataFrame([(i, 7, "1996-01-02") for i in range(1, 12)], "o_orderkey long, o_custkey long, o_orderdate string")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    out = QUERIES[name](spark, str(tmp_path)).collect()
    assert {r["event_no"] for r in out} == set(range(1, 12)) and len(out) == 66
