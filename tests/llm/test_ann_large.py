import numpy as np

from lakeaudit.llm import ann


def test_recall_ties_and_visited_share(spark):
    """Over more rows than the sample holds, with groups of copies: exact scores, ties by id, recall and what is visited."""
    r = np.random.default_rng(4)
    n, d, k = 3 * ann.SAMPLE, 16, 20
    x = r.normal(size=(200, d))[r.integers(200, size=n)] + 0.4 * r.normal(size=(n, d))
    for lo in range(0, 2000, 50):
        x[r.choice(n, 30, replace=False)] = x[lo]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    asked = [*range(0, 4000, 100)]
    got = ann.search(frame, frame.where("vec_id < 4000 and vec_id % 100 = 0"), k=k).orderBy("query_id", "rank").collect()
    by: dict = {}
    for row in got:
        by.setdefault(row["query_id"], []).append((row["score"], row["vec_id"]))
    hit = 0
    for q in asked:
        s = (x * x[q]).sum(axis=1)
        top = [i for i in np.lexsort((np.arange(n), -s)) if i != q][:k]
        assert all(s[i] == score for score, i in by[q]) and by[q] == sorted(by[q], key=lambda p: (-p[0], p[1])) and len(by[q]) == k
        hit += len(set(top) & {i for _, i in by[q]})
    assert hit >= 0.9 * k * len(asked)
    index = ann.MultiIndex(x[: ann.SAMPLE], np.arange(ann.SAMPLE), k, ann.codes(n))
    cells = index.cells(x)
    counts = np.bincount(cells, minlength=index.codes**2)
    visited = np.mean([counts[index.walk(x[q], q, counts > 0)].sum() / n for q in asked])
    print("visited", visited, "recall", hit / k / len(asked), "codes", index.codes)
    assert visited < 0.25


def test_repeated_ids_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (1, [1.0, 5.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(frame, frame.where("vec_id = 0"), k=20).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)]
