"""The models' features and scores, and packing, against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from lakeaudit.llm import langid, packing, quality
from pyspark.sql import functions as F

from .test_operators import EDGES, docs, words

TEXTS = [*EDGES, "Ça va? très bien 12", "a1b2 ###,, x", words(3, 300)]


def grams(text):
    """Bucket of each gram of the folded bytes of a text."""
    data = [int(langid._FOLD[b]) for b in (text or "").encode()]
    out = []
    for order in langid.ORDERS:
        for i in range(len(data) - order + 1):
            key = 0
            for b in data[i : i + order]:
                key = (key * 0x01000193 + b * 0x9E3779B1) % 2**32
            h = (key ^ key >> 15) * 0x85EBCA6B % 2**32
            out.append((h >> 32 - langid.BUCKET_BITS) + langid._TABLE * (order - 1))
    return out


def test_language_probabilities(spark):
    r = np.random.default_rng(5)
    rows = max(langid.ORDERS) * langid._TABLE + 1
    logits = np.vstack([r.normal(0, 3, (rows - 1, 3)), np.zeros((1, 3))]).astype(np.float32)
    model = langid.LanguageModel(("aa", "bb", "cc"), logits, np.array([0.1, 0.0, -0.1]), 1.7, 0.4)
    got = {x["doc_id"]: x for x in langid.predict(docs(spark, TEXTS), model).collect()}
    for i, t in enumerate(TEXTS):
        g = grams(t)
        z = (logits[g].astype(float).sum(axis=0) / max(1, len(g)) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        lettered = any(c.isalpha() for c in t or "")
        assert got[i]["lang_pred"] == (model.languages[p.argmax()] if lettered else "und")
        assert np.isclose(got[i]["score"], p.max() if lettered else 0.0, atol=1e-5)
        assert got[i]["rejected"] == (not lettered or p.max() < 0.4)


def buckets(text):
    """Token buckets: runs of letters, of digits, of other characters."""
    runs = re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z\x80-\xff0-9\x20\x09-\x0d]+", (text or "").encode())
    return [int(b[0]) for run in runs for b, _ in quality.tokens(pa.array([run.decode("utf-8", "surrogateescape")], pa.large_string()))]


def test_word_vectors_and_pooling(spark):
    frame = docs(spark, TEXTS).repartition(3)
    total = np.zeros((quality.BUCKETS, quality.DIM))
    own = [buckets(t) for t in TEXTS]
    for b in own:
        for i, w in enumerate(b):
            for j in range(max(0, i - quality.WINDOW), min(len(b), i + quality.WINDOW + 1)):
                if j != i:
                    total[w, quality._PLACE[b[j]]] += quality._SIGN[b[j]]
    unit = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    used = np.abs(unit).sum(axis=1) > 0
    want = unit - unit[used].mean(axis=0) * used[:, None]
    vectors = quality.word_vectors(frame)
    assert np.allclose(vectors, want)
    for row in quality.pool(frame, vectors).collect():
        v, b = np.frombuffer(row["vector"], np.float32), own[row["id"]]
        x = want[b] if b else np.zeros((1, quality.DIM))
        assert np.allclose(v, np.r_[x.mean(axis=0), (x**2).mean(axis=0)], atol=1e-4)


def test_packing_against_plain_best_fit(spark):
    r = random.Random(2)
    n, capacity = 600, 100
    length = sorted((r.randint(1, 60) for _ in range(n)), reverse=True)
    source = [r.choice(["hot"] * 5 + [None, "s1", "s2", "s3"]) for _ in range(n)]
    cluster = [r.choice([None, *range(150)]) for _ in range(n)]
    bins, offsets = packing.pack_shard(np.array(length), source, cluster, capacity)
    room: list[int] = []
    held: list[tuple[set, set]] = []
    for i in range(n):
        free = lambda b: room[b] >= length[i] and (source[i] is None or source[i] not in held[b][0]) and (cluster[i] is None or cluster[i] not in held[b][1])  # noqa: B023, E731
        fits = [b for b in range(len(room)) if free(b)]
        if fits:
            least = min(room[b] for b in fits)
            assert bins[i] in [b for b in fits if room[b] == least]  # the tightest compatible bin; ties may go to any
        else:
            assert bins[i] == len(room)
            room.append(capacity)
            held.append((set(), set()))
        b = int(bins[i])
        assert offsets[i] == capacity - room[b]
        room[b] -= length[i]
        held[b][0].add(source[i])
        held[b][1].add(cluster[i])
    assert len(room) == bins.max() + 1
    out = packing.pack(docs(spark, [words(i, r.randint(0, 900)) for i in range(60)]), capacity=300).collect()
    by: dict = {}
    for x in out:
        by.setdefault((x["shard"], x["bin"]), []).append(x)
    for (_, b), pieces in by.items():
        pieces.sort(key=lambda x: x["offset"])
        if b >= 0:
            assert all(x["offset"] + x["length"] == y["offset"] for x, y in zip(pieces, pieces[1:], strict=False)) and pieces[0]["offset"] == 0 and pieces[-1]["offset"] + pieces[-1]["length"] <= 300
            assert len({x["source"] for x in pieces}) == len(pieces)


def test_shards_follow_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 4)
    out = packing.pack(docs(spark, [words(1, 4000)]), capacity=100)
    assert out.select(F.countDistinct("shard")).first()[0] > 3 and out.count() == 40
