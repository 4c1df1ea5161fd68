import hashlib

from lakeaudit.llm import segmentation
from lakeaudit.llm.queries import PIECES, QUERIES
from pyspark.sql import functions as F

from .test_operators import docs, words

TEXTS = ["hello world, this  is\n\na t\u00e9st \u2460", "\u65e5\u672c \U0001f600 x", " lead and trail ", words(1, 200), "", None]


def test_query_decodes_every_rank(spark, tmp_path):
    docs(spark, TEXTS).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op7_nbest"](spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(range(len(TEXTS)))
    for r in out:
        assert r["round_trip"] and r["text_sha256"] == hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest()


def test_decode_all(spark):
    encoded = segmentation.encode(docs(spark, TEXTS), PIECES, n_best=1)
    got = {r["doc_id"]: r["text"] for r in segmentation.decode_all(encoded, PIECES).collect()}
    assert got == {i: t or "" for i, t in enumerate(TEXTS)}
    assert segmentation.decode_all(encoded.withColumn("ids", F.lit(None).cast("array<int>")), PIECES).first()["text"] == ""
