from collections import defaultdict

from lakeaudit.llm import packing
from lakeaudit.llm.queries import QUERIES

from .test_operators import words


def test_near_copies_share_no_bin(spark, tmp_path):
    base, other = words(1, 100).split(), words(2, 100).split()
    near = lambda w, i: " ".join([*w[:i], f"new{i}", *w[i + 1 :]])
    rows = [(i, near(base, 7 * i), f"s{i}") for i in range(4)] + [(4, "\u00c9 " + " ".join(other), "s4"), (5, "\u00e9  " + " ".join(other).upper(), "s5"), (6, words(3, 50), "s6")]
    rows += [(None, near(base, 60), "s7"), (None, near(base, 60), "s8")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op9_packing"](spark, str(tmp_path)).collect()
    bins = defaultdict(list)
    for r in out:
        bins[r["shard"], r["bin"]].append(r["source"])
    assert len(out) == len(rows) and sum(r["length"] for r in out) == sum(len(t.split()) for _, t, _ in rows)
    near_copies, copies = {"s0", "s1", "s2", "s3", "s7", "s8"}, {"s4", "s5"}
    assert all(len(near_copies & set(b)) <= 1 and len(copies & set(b)) <= 1 for b in bins.values())


def test_equal_rows_are_dealt_to_many_shards(spark, monkeypatch):
    """Copies of one row, null ids too: shards of the planned size, and every row packed."""
    monkeypatch.setattr(packing, "SHARD", 256)
    rows = [(7, "a b c d", "s")] * 3000 + [(None, "a b c d", "s")] * 1000
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for near in (None, (5, 80)):
        out = packing.pack(df, capacity=16, near=near).toPandas()
        assert len(out) == 4000 and out.groupby("shard").size().max() < 400 and out["shard"].nunique() >= 14
        assert (out.groupby(["shard", "bin"]).size() == 1).all()  # one source: one to a bin
