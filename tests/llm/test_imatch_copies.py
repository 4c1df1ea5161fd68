import numpy as np
import pyarrow as pa
from lakeaudit.llm import imatch

from .test_operators import docs, words


def test_a_text_in_a_third_of_the_rows(spark):
    """Copies push a text's terms out of no band: it stays like its edited form."""
    shared = [f"w{i}" for i in range(300)]
    text = lambda seed: " ".join(shared[i] for i in np.random.default_rng(seed).permutation(300)[:60])
    hot = text(999) + " " + words(7, 60)
    texts = [hot if i % 3 == 0 else text(i) for i in range(90)]
    frame = docs(spark, texts)
    got = {r["doc_id"]: r for r in imatch.compare_with_next(frame, imatch.lexicon(frame)).collect()}
    edited = [got[i]["near_edited"] for i in range(3, 90, 3)]
    assert min(edited) > 0 and np.mean(edited) > np.mean([got[i]["near_next"] for i in range(3, 90, 3)]) + 0.1


def test_few_lexicon_terms_on_one_side():
    import pyarrow as pa

    base = words(1, 60).split()
    prints = imatch.Fingerprints(np.zeros(0, np.uint64))
    band = next(iter(imatch.term_sets(pa.array([" ".join(words(2, 9).split())]))))[0]
    some = imatch.Fingerprints(np.sort(band))
    a, b = " ".join(base), " ".join(base[:50] + words(2, 9).split())
    none, one = some.parts(pa.array([a, b]))
    assert not none[0] and one[0] and imatch.likeness(imatch.render(none), imatch.render(one)) > 0.3
    assert imatch.likeness(*map(imatch.render, prints.parts(pa.array([a, b])))) == imatch.likeness(imatch.render(none), imatch.render(one))


def test_lexicon_counts_distinct_texts_once(spark, monkeypatch):
    texts = [words(i % 9, 30 + i % 9) for i in range(20)] + [words(40 + i, 30) for i in range(20)] + [None, None, "", ""]
    frame = docs(spark, texts).select("doc_id", "text")
    seen = {}
    for t in {t or "" for t in texts}:
        for own, _ in imatch.term_sets(pa.array([t], pa.large_string())):
            for x in own:
                seen[int(x)] = seen.get(int(x), 0) + 1
    total = len(set(texts))  # null and empty text are two texts without terms
    want = sorted(x for x, n in seen.items() if max(2.0, 0.05 * total) <= n <= max(2.0, 0.3 * total))
    for marks in (imatch.MARKS, 64):
        monkeypatch.setattr(imatch, "MARKS", marks)
        assert [int(x) for x in imatch.lexicon(frame, rare=0.05, common=0.3)] == want and want
    assert len(imatch.lexicon(frame.where("false"))) == 0


def test_counts_of_rare_terms_stay_in_their_tasks():
    """A run sends what may reach the band, and of what is known all of it."""
    texts = pa.record_batch([pa.array([f"often rare{i} w{i % 2}" for i in range(100)])], names=["text"])
    (every,), (likely,) = list(imatch._frequencies(iter([texts]))), list(imatch._frequencies(iter([texts]), 0.05))
    assert every.num_rows == 103 and sorted(likely["n"].to_pylist()) == [50, 50, 100]
    own = likely["term"].to_numpy()
    marks = np.unique((own & (imatch.MARKS - 1)) >> 6)
    bits = np.array([np.bitwise_or.reduce([1 << (int(x) & 63) for x in own if (x & (imatch.MARKS - 1)) >> 6 == w]) for w in marks]).astype(np.uint64).view(np.int64)
    (known,) = list(imatch._frequencies(iter([texts]), known=(marks, bits, imatch.MARKS - 1)))
    assert set(own.tolist()) <= set(known["term"].to_pylist()) and known.num_rows < 10
