import random

import pytest

from lakeaudit.llm import jaccard

from .test_operators import components, docs, words


def corpus():
    """Chains and families around the threshold, a passage in most texts, copies, short texts, one long text."""
    r, texts = random.Random(8), []
    passage = words(50, 40)
    for f in range(4):
        base = words(60 + f, 60 + 25 * f).split()
        for _ in range(18):
            for _ in range(r.randrange(4)):
                base = list(base)
                base[r.randrange(len(base))] = f"n{r.random()}"
            texts.append(" ".join(base) + (" " + passage if r.random() < 0.7 else ""))
    texts += [passage + " " + words(200 + i, r.randrange(1, 30)) for i in range(30)]
    texts += [words(300, 6), words(300, 6) + " x", words(301, 5), words(301, 5), "a b", "a b", "a b c", words(302, 3000), words(302, 3000) + " end"]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize(("k", "percent", "hot", "block", "dense"), [(5, 80, 16, 512, 4), (5, 80, 3, 4, 4), (3, 90, 2, 2, 0), (2, 60, 4, 8, 0)])
def test_rest_against_brute_force(spark, monkeypatch, k, percent, hot, block, dense):
    """Large buckets, their sets without spare words and blocks of pairs are reached by small limits."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "DENSE", dense)
    texts = corpus()
    got = jaccard.components_of(docs(spark, texts).repartition(3), k=k, percent=percent).orderBy("id").collect()
    sizes, of = components(texts, k, percent)
    assert [r["n"] for r in got] == sizes
    assert [r["component"] for r in got] == of
    assert len(set(of)) < len(of) - 20


def test_words_suffice():
    """Any partner of a set finds it in one band with more words than they can differ in."""
    for percent in (28, 60, 80, 90, 100):
        for a in range(1, 400):
            own = jaccard.levels(a, percent)[0]
            for b in range(a, 100 * a // percent + 1):
                assert own in jaccard.levels(b, percent) and own[1] > jaccard.bound(percent, a, b) and own[2] >= own[1]


def test_sketches_fold():
    import numpy as np

    h = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    wide, narrow = (jaccard.parities((h & np.uint64(64 * w - 1)).astype(np.int64), w) for w in (16, 4))
    assert (jaccard.folded_together([wide.tobytes(), narrow.tobytes()]) == narrow).all()
