"""Every stage of the pipeline against a plain version of it, each on its own input."""

import random

import corpus_pipeline
import duckdb
import numpy as np
from lakeaudit.llm import langid, linedup, packing, secretscan
from pyspark.sql import functions as F

from .test_models_brute import grams
from .test_operators import components, docs, words
from .test_secret_links import brute


def table(spark, path):
    r, texts = random.Random(4), []
    passage = "\n".join(words(900 + i, 20) for i in range(4))
    for i in range(70):
        t = words(i, r.choice([1, 5, 30, 200])) + "\n" + words(i + 500, r.choice([3, 60]))
        if i % 6 == 1:
            t = texts[i - 1] + " tail"
        if i % 9 == 2:
            t += "\n" + passage + "\n" + words(i + 700, 9)
        if i % 10 == 3:
            t += f"\nclient_id: user{i} password=hunter{i:04} https://host.example.test/p"
        texts.append(t)
    texts += [None, "", "12345 !!", passage, words(3000, 5000), texts[4], texts[4]]
    rows = docs(spark, texts).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")))
    rows = rows.unionByName(rows.where("doc_id = 9"))  # a row that repeats
    rows.write.parquet(path)


def rejected(model, text):
    g = grams(text)
    z = (model.logits[g].astype(float).sum(axis=0) / max(1, len(g)) + model.bias) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return not any(c.isalpha() for c in text or "") or p.max() < model.reject_below


def marked(text):
    out, at = "", 0
    for start, _, _, end in brute(text)[1]:
        if start >= at:
            out += text[at:start] + secretscan.MARK
        at = max(at, end)
    return out + text[at:]


def test_stages_against_plain_versions(spark, tmp_path):
    table(spark, str(tmp_path / "documents.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before = sorted((r["doc_id"], r["text"]) for r in now.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())
        model = langid.fit(now, F.lit(True)) if name == "language_id" else None
        if name == "line_dedup":
            now.dropDuplicates(["doc_id"]).toPandas().to_parquet(tmp_path / "one.parquet")
            with duckdb.connect() as c:
                c.execute(f"create view documents as select * from '{tmp_path}/one.parquet'")
                lines = {d: (n, t) for d, n, t in c.execute(f"select doc_id, n_removed, text from ({linedup.ORACLE})").fetchall()}
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        after = sorted((r["doc_id"], r["text"]) for r in now.collect()) if name != "best_fit_packing" else None
        seen[name] = before, after
        if name == "language_id":
            assert after == [(d, t) for d, t in before if not rejected(model, t)]
        if name == "line_dedup":
            assert {d for d, _ in after} == {d for d, _ in before if lines[d][0] == 0 or lines[d][1].strip(" ")}
            own = [(d, t) for d, t in after if d != 9]  # the row that repeats is a copy of itself
            assert own == [(d, lines[d][1]) for d, _ in own]
        if name == "near_dedup":
            one = dict(before)
            ids = sorted(one)
            group = components([one[d] for d in ids], 5, 80)[1]
            assert after == [(d, one[d]) for k, d in enumerate(ids) if group[k] == k]
        if name == "secret_scan":
            assert after == [(d, marked(t)) for d, t in before] and any(secretscan.MARK in t for _, t in after)
    out = now.toPandas()
    size = {d: len(t.split()) for d, t in seen["best_fit_packing"][0]}
    assert out.groupby("doc_id")["length"].sum().to_dict() == size and set(size) == set(out["doc_id"])
    for _, bin_ in out[out["bin"] >= 0].groupby(["shard", "bin"]):
        assert bin_["length"].sum() <= packing.CAPACITY and bin_["source"].is_unique and bin_["cluster"].is_unique
        assert bin_.sort_values("offset")["offset"].tolist() == [0, *bin_.sort_values("offset")["length"].cumsum().tolist()[:-1]]
