import corpus_pipeline
from lakeaudit.llm import jaccard

from .test_operators import components, words


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def near(w, i):
    return " ".join([*w[:i], f"new{i}", *w[i + 1 :]])


def test_two_texts_of_one_id(spark):
    a, b = words(1, 200).split(), words(2, 200).split()
    rows = [(1, " ".join(a)), (2, " ".join(a)), (2, " ".join(b)), (3, near(b, 100))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_rows_without_id(spark):
    a, b = words(1, 200).split(), words(2, 200).split()
    rows = [(1, " ".join(a)), (None, near(a, 100)), (None, near(b, 50)), (None, near(b, 150)), (None, near(b, 150)), (None, None)]
    out = jaccard.near_duplicates(frame(spark, rows)).collect()
    assert all(r["n_shingles"] == 196 for r in out if r["text"]) and len(out) == 6
    kept = [r["text"] for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()]
    assert len(kept) == 3 and " ".join(a) in kept and None in kept


def test_low_similarity_against_brute_force(spark):
    a = words(1, 300).split()
    texts = [" ".join(a[:n]) for n in (300, 90, 28, 9)] + [" ".join(words(9, 200).split() + a[:100])]
    got = jaccard.near_duplicates(frame(spark, enumerate(texts)), k=1, percent=28).orderBy("doc_id").collect()
    sizes, of = components(texts, 1, 28)
    assert [r["component_id"] for r in got] == of and [r["n_shingles"] for r in got] == sizes
    assert len(jaccard.levels(100, 30)) > 2
