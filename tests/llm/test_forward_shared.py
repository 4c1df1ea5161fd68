"""op7's forward pass settles what sorted words share once."""

import random

from lakeaudit.llm import segmentation as sg


def vocabulary(pieces):
    return sg.Vocabulary({p: (i, s) for i, (p, s) in enumerate(pieces.items())}, list(range(1000, 1256)), [*pieces]).prepare()


def paths(word, voc):
    """(score, cuts) of every path."""
    if not word:
        return [(0.0, [0])]
    out = []
    for a in range(len(word)):
        piece = voc.pieces.get(word[a:])
        if piece or a == len(word) - 1:
            out += [(s + (piece[1] if piece else voc.unknown), [*cuts, len(word)]) for s, cuts in paths(word[:a], voc)]
    return out


def test_every_prefix_of_any_order_of_words():
    rng = random.Random(2)
    pieces = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))): -float(rng.randrange(1, 9)) for _ in range(40)}
    voc = vocabulary(pieces)
    words = ["".join(rng.choice("abcx") for _ in range(rng.randrange(0, 9))) for _ in range(150)]
    for order in (words, sorted(words)):
        for word, (best, back, last, loss) in zip(order, sg.forward_each(order, voc), strict=True):
            for n in range(1, len(word) + 1):
                every = sorted((s for s, _ in paths(word[:n], voc)), reverse=True)
                piece = voc.pieces.get(word[back[n] : n])
                assert best[n] == every[0] and last[n] == (piece[0] if piece else -1)
                assert best[n] == best[back[n]] + (piece[1] if piece else voc.unknown)
                # of equal last pieces the longest
                ends = [a for a in range(n) if (p := voc.pieces.get(word[a:n])) or a == n - 1 if best[a] + (p[1] if p else voc.unknown) == best[n]]
                assert back[n] == min(ends)
            every = sorted((s for s, _ in paths(word, voc)), reverse=True)
            assert loss == (every[0] - every[1] if len(every) > 1 else float("inf"))


def test_learning_does_shared_beginnings_once():
    class Counted(dict):
        gets = 0

        def get(self, *a):
            Counted.gets += 1
            return super().get(*a)

    voc = vocabulary({"a": -1.0, "ab": -1.5, "b": -2.0, "c": -3.0})
    voc.trie = Counted(voc.trie)
    seg = sg.Segmenter(voc, 3)
    words = {"ab" * 20 + c + d for c in "abc" for d in "abc"}
    seg.learn(words)
    assert Counted.gets <= 40 + 3 + 9 and len(seg.at) == 9
    assert [round(s, 6) for s, _ in seg.segment(["ab" * 20 + "ab"])] == [-31.5, -33.0, -33.0]
