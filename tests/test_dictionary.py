import json
import random

import pytest

from lakeaudit.operators import dictionary
from lakeaudit.operators.guard import guard, redact_trace
from lakeaudit.sources.trace import load_trace

from .test_audit import P


def plain(texts, entries):
    """Every entry in order over every text."""
    for _, value, redaction in sorted(entries):
        texts = [t.replace(value, redaction) for t in texts]
    return texts


def replaced(spark, texts, entries):
    df = spark.createDataFrame(list(enumerate(texts)), "event_no long, text string")
    rows = spark.createDataFrame([(v, r, {"no": n}) for n, v, r in entries], "value string, redaction string, rank struct<no:int>")
    again = {r["event_no"]: r["text"] for r in dictionary.replace_values(df, rows).collect()}
    return [again.get(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("bits", [1 << 27, 1 << 10])
def test_against_every_entry_in_order(spark, monkeypatch, bits):
    """Nested values, placeholders that hold values or make them with what stands beside them, and empty placeholders."""
    monkeypatch.setattr(dictionary, "FILTER", bits)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab[]é🙂") for _ in range(n))
    values = list({word(rng.randrange(1, 9)) for _ in range(60)} | {"x" * 40, "x" * 33, "[ab]", "b][a", "]x"})
    entries = [(i, v, rng.choice(["[ab]", "", "xx", "]", v + v, "a[b"])) for i, v in enumerate(values)]
    texts = [word(rng.randrange(30)) for _ in range(60)] + ["", "x" * 100, "[ab]" * 5, "plain"]
    assert replaced(spark, texts, entries) == plain(texts, entries)


def test_chain_of_values_that_come_up_one_after_another(spark):
    entries = [(i, f"<{i}>", f"<{i + 1}>") for i in range(12)]
    texts = ["<0>", "a<5>b<0><1", "<1<0>", "none"]
    assert replaced(spark, texts, entries) == plain(texts, entries)


def test_many_values_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "CHUNK", 64)
    entries = [(i, f"ID-{i:05}" + "z" * (i % 7), f"[{i % 3}]") for i in range(3000)]
    texts = ["-".join(f"ID-{k:05}zzzzzzz" for k in range(i, i + 40)) for i in range(0, 3000, 200)] + ["ID-0000", "zzz"]
    assert replaced(spark, texts, entries) == plain(texts, entries)


def test_trace(spark, tmp_path):
    contents = [f"Member ID: MBR-SYN-000{i} callback 555-013-000{i}." for i in range(4)]
    contents += ["saw MBR-SYN-0003x MBR-SYN-0000y 555-013-0001z", "Member ID: MBR-SYN-00010", "nothing", "see https://x.test/MBR-SYN-0003x", "https://x.test/MBR-SYN-0003xMBR-SYN-0003x", "Name: Redacted Member", "a Redacted Member"]
    path = tmp_path / "t.jsonl"
    path.write_text("".join(json.dumps({"event_id": f"e{i}", "timestamp": "t", "layer": "memory", "content": c}) + "\n" for i, c in enumerate(contents)))
    events = load_trace(spark, str(path))
    rows = guard(events, P, text="content").orderBy("event_no").collect()
    first = {}
    for r in rows:
        for i, f in enumerate(r["findings"]):
            first.setdefault(f["value"], (-len(f["value"]), r["event_no"], i, f["redaction"]))
    want = plain([r["redacted_text"] for r in rows], [(k[:3], v, k[3]) for v, k in first.items()])
    got = {r["event_id"]: r["redacted_content"] for r in redact_trace(events, P).collect()}
    assert [got[f"e{i}"] for i in range(len(contents))] == want and not [t for t in want if "SYN" in t or "555" in t]
