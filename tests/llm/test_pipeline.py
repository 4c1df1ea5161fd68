import corpus_pipeline
from pyspark.sql import functions as F

from .test_operators import docs, words


def test_stages_take_effect(spark, tmp_path):
    base = words(1, 100)
    long = words(2, 60)
    texts = [base, base + " extra", "first\n" + long + "\nmore " + words(3, 30), "other\n" + long + "\nmore " + words(4, 30), "my password = hunter22 " + words(5, 40), None, "", "12345 !!", *[words(i, 30) for i in range(10, 40)]]
    path = str(tmp_path / "documents.parquet")
    docs(spark, texts).withColumn("n_chars", F.length("text").cast("long")).write.parquet(path)
    now = spark.read.parquet(path)
    columns, seen = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r.asDict() for r in now.collect()}
        assert name == "best_fit_packing" or now.columns == columns
    assert set(seen["language_id"]) == set(range(len(texts))) - {5, 6, 7}
    assert long in seen["line_dedup"][2]["text"] and long not in seen["line_dedup"][3]["text"]
    assert 0 in seen["near_dedup"] and 1 not in seen["near_dedup"] and 10 in seen["near_dedup"]
    assert "hunter22" not in seen["secret_scan"][4]["text"] and "[SECRET]" in seen["secret_scan"][4]["text"]
    assert set(seen["best_fit_packing"]) == set(seen["secret_scan"])
