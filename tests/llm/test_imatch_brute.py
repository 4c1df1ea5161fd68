import numpy as np
import pyarrow as pa

from lakeaudit.llm import imatch
from lakeaudit.llm import textkernel as tk

from .test_operators import EDGES, docs, words

M64 = 2**64 - 1


def mix(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M64
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M64
    return h ^ (h >> 31)


def sequence_hash(terms):
    total = 0
    for i, t in enumerate(terms):
        total += mix(t * int(tk.MIX[2]) & M64) * pow(tk.BASE, i, 2**64)
    return mix(total & M64) | 1 if terms else 0


def brute(text, lexicon):
    every = sorted({int(x) for own, _ in imatch.term_sets(pa.array([text], pa.large_string())) for x in own})
    out = []
    for terms, large in (([t for t in every if t in lexicon], imatch.LARGE), (every, 0)):
        out.append(sequence_hash(terms))
        out += [sequence_hash([t for t in terms if mix(t ^ int(tk.MIX[5])) >> 2 * c & 3]) for c in range(large)]
        for k, of in enumerate(imatch.KINDS):
            out += [sequence_hash([t for t in terms if mix(t ^ int(tk.MIX[6])) >> 12 * k & of - 1 == e]) for e in range(imatch.EACH)]
    return out


def test_fingerprints_and_likeness_against_brute_force(spark):
    texts = [*EDGES, *[words(i % 12, 90) + " " + words(50 + i, 25) for i in range(40)], words(99, 4000)]
    frame = docs(spark, texts).select("doc_id", "text")
    lexicon = imatch.lexicon(frame, rare=0.02, common=0.5)
    assert len(lexicon) > 100
    got = {r["doc_id"]: r for r in imatch.compare_with_next(frame, lexicon).collect()}
    known = {int(x) for x in lexicon}
    parts = [np.array(brute(t or "", known), np.uint64) for t in texts]
    for i, t in enumerate(texts):
        following = i - 1 if i else len(texts) - 1
        changed = np.array(brute(imatch.edited(t or "", texts[following] or ""), known), np.uint64)
        row = got[i]
        own, edit, other = (imatch.render(p) for p in (parts[i], changed, parts[following]))
        assert row["fingerprint"] == own and row["edited_fingerprint"] == edit
        assert row["near_edited"] == imatch.likeness(own, edit) and row["near_next"] == imatch.likeness(own, other)
        same = [[int(x) for x in p[: 1 + imatch.LARGE]] for p in (parts[i], changed, parts[following])]
        verdict = [same[0] == o or any(x and x == y for x, y in zip(same[0], o, strict=True)) for o in same[1:]]
        for given, said, o in zip(("duplicate_edited", "duplicate_next"), verdict, (edit, other), strict=True):
            assert row[given] == (own == o if not same[0][0] else said)
    printed = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprint(frame, lexicon).collect()}
    assert printed == {i: r["fingerprint"] for i, r in got.items()}


def test_likeness_estimates_common_terms():
    r = np.random.default_rng(2)
    for size in (6, 40, 400, 4000):
        for share in (0.0, 0.3, 0.6, 0.9):
            found = []
            for _ in range(40):
                terms = r.integers(1, 2**63, size).astype(np.uint64)
                both, rest = int(share * size), size - int(share * size)
                a, b = terms[: both + rest // 2], np.r_[terms[:both], terms[both + rest // 2 :]]
                x, y = (np.hstack([imatch.hashes(np.sort(t), np.zeros(len(t), np.int64), 1, c) for c in (imatch.LARGE, 0)])[0] for t in (a, b))
                found.append(imatch.likeness(imatch.render(x), imatch.render(y)))
            assert abs(np.mean(found) - int(share * size) / size) < 0.12


def test_duplicates_share_a_large_subset():
    terms = np.sort(np.random.default_rng(3).integers(1, 2**63, 60).astype(np.uint64))
    show = lambda t: imatch.render(np.hstack([imatch.hashes(t, np.zeros(len(t), np.int64), 1, k) for k in (imatch.LARGE, 0)])[0])
    a, c = show(terms), show(terms[::2])
    assert imatch.duplicates(a, a) and not imatch.duplicates(a, c)
    assert sum(imatch.duplicates(a, show(np.delete(terms, i))) for i in range(60)) > 25


def test_ranges_stay_bounded(spark, monkeypatch):
    frame = docs(spark, [words(i, 40) for i in range(50)]).select("doc_id", "text")
    lexicon = imatch.lexicon(frame, rare=0.02, common=0.5)
    whole = sorted(imatch.compare_with_next(frame, lexicon).collect())
    monkeypatch.setattr(imatch, "RANGES", 2)
    assert sorted(imatch.compare_with_next(frame, lexicon).collect()) == whole
