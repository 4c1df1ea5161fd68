"""Finding candidates in bulk gives what each text alone gives."""

import random

from lakeaudit.functions import bulk
from lakeaudit.functions.detect import settled
from lakeaudit.functions.rules import RULES, STARTS

from .test_rules_brute import FOUND, ODD, plain


def test_bulk_against_each_text_alone():
    rng = random.Random(5)
    assert len(STARTS) == len(RULES)
    for _ in range(60):
        texts = []
        for _ in range(60):
            odd = ODD if rng.random() < 0.2 else ["\0", "(", "+1", "1", "\n"]
            parts = [rng.choice(FOUND + odd + ["".join(rng.choices("aZ09 .,:-/@#()+1pPoO\0'", k=rng.randrange(9)))]) for _ in range(rng.randrange(8))]
            text = rng.choice(["", " ", "\t", ", "]).join(p if rng.random() < 0.7 else p.swapcase() for p in parts)
            texts.append(text if rng.random() < 0.95 else None)
        owner, found = bulk.found_in(texts)
        got = [[] for _ in texts]
        for i, c in zip(owner.tolist(), found.to_pylist(), strict=True):
            got[i].append(c)
        assert got == [settled(plain(t)) if t else [] for t in texts]


def test_texts_do_not_run_together():
    owner, found = bulk.found_in(["callback 555-013", "-7788", "Member ID:", "AB-12", "x 10.0.0", ".1"])
    assert len(owner) == len(found) == 0
