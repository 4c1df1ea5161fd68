"""What a text costs under a dictionary does not grow with the dictionary, nor with the texts of a batch."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from lakeaudit.operators import dictionary as d


def known(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "value string")
    return d.windows(d.keyed(rows).cache())


def test_windows_of_few_and_of_many_places(spark):
    """Held against a search for each value."""
    rng = random.Random(5)
    for letters, n in (("ab", 400), ("abcdefghijkl🙂é", 3000)):
        word = lambda n: "".join(rng.choice(letters) for _ in range(n))  # noqa: E731,B023
        values = sorted({word(rng.randrange(1, 40)) for _ in range(80)})
        text = "".join(rng.choice([*values, word(9)]) for _ in range(n // 4))
        places, keys = known(spark, values).found(d._codes(text))
        got = set(zip(places.tolist(), keys.tolist(), strict=True))
        want = {(i, key) for v, key in zip(values, d.keys_of(values)[1].tolist(), strict=True) for i in range(len(text)) if text.startswith(v, i)}
        assert want <= got and len(got) < 2 * len(want)


def test_full_filters_emit_few_keys(spark, monkeypatch):
    """A dictionary of more values than the filters tell apart: texts in which no value begins meet nothing."""
    monkeypatch.setattr(d, "FILTER", 1 << 10)
    full = known(spark, [f"CLM-SYN-{i:08}" for i in range(5000)])
    assert full.prefixes.all() and full.keys.all()
    places, _ = full.found(d._codes("Claim review claim_id=[REDACTED_CLAIM_ID] Member ID: [REDACTED_MEMBER_ID]. " * 50))
    assert not len(places)


def test_surroundings_of_many_texts_are_searched_at_once(spark, monkeypatch):
    values = known(spark, ["abc", "[x"])
    calls, real = [], d.Windows.found
    monkeypatch.setattr(d.Windows, "found", lambda self, codes: calls.append(len(codes)) or real(self, codes))
    entry = lambda v: {"value": v, "redaction": "[", "key": int(d.keys_of([v])[1][0])}
    batch = pa.RecordBatch.from_pylist([{"event_no": i, "text": "1 abcx" if i % 2 else "2 abc", "entries": [entry("abc")]} for i in range(300)])
    out = []
    work = SimpleNamespace(select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: out.extend(run([batch]))))
    d._applied(work, SimpleNamespace(value=values))
    rows = out[0].to_pylist()
    assert len(calls) == 1 and [r["text"] for r in rows[:2]] == ["2 [", "1 [x"]
    fresh = entry("[x")["key"]
    assert all((fresh in r["fresh"]) for r in rows if r["event_no"] % 2) and not any(fresh in r["fresh"] for r in rows if r["event_no"] % 2 == 0)
    assert np.all([r["event_no"] == i for i, r in enumerate(rows)])
