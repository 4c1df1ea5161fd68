"""The neighbour pass of op6 moves packed texts only."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from lakeaudit.llm import imatch


def test_packed_texts_come_back(spark):
    rng = random.Random(1)
    texts = ["", "a", "é🙂\n" * 3, *[" ".join(rng.choice(["lorem", "ipsum", "dolor", "señor"]) for _ in range(400)) for _ in range(30)]]
    batch = pa.RecordBatch.from_arrays([pa.array([*range(len(texts) - 1), None], pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "h", "text"])
    (out,) = imatch._pack(SimpleNamespace(value=np.array([4, 9])))(iter([batch]))
    assert imatch._unpacked(out["size"], out["packed"]).to_pylist() == texts
    assert out["part"].to_pylist()[:12] == [0] * 5 + [1] * 5 + [2] * 2 and out["part"][-1].as_py() == 0
    assert sum(len(p) for p in out["packed"].to_pylist()) < 0.4 * sum(map(len, texts))


def test_no_text_in_the_exchange(spark):
    docs = spark.createDataFrame([(i, f"word{i % 5} other text {i}" if i % 4 else None) for i in range(40)], "doc_id long, text string")
    out = imatch.compare_with_next(docs, imatch.lexicon(docs))
    sorts = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Sort [" in line]
    assert sorts and all("packed" in line and "text" not in line for line in sorts)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == 40 and rows[0]["n_chars"] == 0 and rows[7]["n_chars"] == len("word2 other text 7")
