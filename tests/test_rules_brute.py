import random
import re
from pathlib import Path

import pytest

from lakeaudit.functions.detect import detect, settled, spans
from lakeaudit.functions.rules import RULES
from lakeaudit.functions.stage import shared_folder
from lakeaudit.plans.registry import QUERIES

#: Something that each rule finds, by its number.
FOUND = [
    "Patient: Ana B. Cole", "Member: Cole, Ana", "DOB: 1980-02-03", "admitted 1/2/26", "+1 (555) 013-7788 ext. 12", "fax: 555-013-7788", "a.b@c.org", "SSN: XXX-XX-1234", "address: 12 Old Mill Rd, Apt 4",
    "99 Oak Street", "P.O. Box 123", "ZIP 12345-6789", "Member ID: AB12-CD34", "MBR-SYN-0001", "authorization number AB-12", "CLM-SYN-0001", "MRN: A-12345", "Policy No. AB-12", "group number 77AB", "Acct # 99-123",
    "Certificate No. AB-123", "VIN 1HGCM82633A", "Device Serial: DEV-9", "https://x.test/a?b", "192.0.2.7",
]
ODD = ["ſerial DEV-99", "Kſt", "VİN 1HGCM8263", "licenſe no. ab-123", "Policy", "10.0.0.256", "no", "\n", "²³", "٣٤٥ ٠١٣", ":", "é", "🙂", "st. 5", "1996-01-02", "date"]


def plain(text):
    """All rules over all of a text, without guards."""
    found = {}
    for r in RULES:
        for m in r.pattern.finditer(text):
            found.setdefault((r.category, *m.span(1)), {"category": r.category, "value": m[1], "start": m.start(1), "end": m.end(1), "confidence": r.confidence, "reason": r.reason, "detector": "regex"})
    return list(found.values())


@pytest.mark.parametrize("number", range(25))
def test_every_rule_finds_its_example(number):
    rule = RULES[number]
    m = rule.pattern.search(f"x {FOUND[number]} y")
    assert m and {"category": rule.category, "value": m[1], "start": m.start(1), "end": m.end(1), "confidence": rule.confidence, "reason": rule.reason, "detector": "regex"} in spans(f"x {FOUND[number]} y")


def test_guards_lose_nothing():
    rng = random.Random(11)
    for _ in range(3000):
        parts = [rng.choice(FOUND + ODD + ["".join(rng.choices("aZ09 .,:-/@#ſK", k=rng.randrange(9)))]) for _ in range(rng.randrange(8))]
        text = rng.choice(["", " ", "\t", ", "]).join(p if rng.random() < 0.7 else p.swapcase() for p in parts)
        assert spans(text) == plain(text), text


def overlaps_settled(found):
    """Greedy choice from the definition: the best of all that are left, as long as it is clear of what was chosen."""
    left, kept = sorted(found, key=lambda c: (c["start"], -c["confidence"], c["start"] - c["end"], c["category"])), []
    while left:
        kept.append(left[0])
        left = [c for c in left[1:] if c["start"] >= kept[-1]["end"]]
    return kept


def test_documents_against_unguarded_rules(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(FOUND + ODD + ["word", "Words"] * 8) for _ in range(rng.choice([0, 3, 40, 400])))) for i in range(120)] + [(900, None), (901, ""), (902, "x " * 100_000 + "a.b@c.org")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["doc_id"], r["category"], r["value"], r["start"], r["end"], r["confidence"], r["reason"]) for r in QUERIES["detect_all_documents"](spark, str(tmp_path)).collect())
    assert got == sorted((i, c["category"], c["value"], c["start"], c["end"], c["confidence"], c["reason"]) for i, t in rows if t for c in overlaps_settled(plain(t)))
    assert {r[1] for r in got} >= {r.category for r in RULES if r.category != "fax"}  # a phone number at the same place has a higher confidence


@pytest.mark.parametrize("text", ["10.0.0.256.1234", "MBR-SYN-12", "order 123-45-6789", "an address in Main Street", "boxed 12", "claimant 12"])
def test_near_misses_exactly(text):
    assert settled(spans(text)) == []


class Cluster:
    """A session's parts that say where it runs."""

    def __init__(self, master, folder):
        self.sparkContext, self.conf = self, self
        self.master, self.folder = master, folder

    def get(self, name, default=None):
        return self.folder


def test_a_cluster_needs_a_shared_folder():
    assert shared_folder(Cluster("spark://host:7077", "hdfs:///x/")) == "hdfs:///x" and shared_folder(Cluster("local[4]", None))
    with pytest.raises(ValueError, match=re.escape("spark.checkpoint.dir")):
        shared_folder(Cluster("spark://host:7077", None))


def test_staged_files_go_with_the_application(tmp_path):
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
from lakeaudit.functions.stage import staged
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
assert staged(s.range(3), "t").count() == 3
s.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1], capture_output=True, timeout=120)
    assert not list(tmp_path.glob("t-*"))


def test_null_texts(spark):
    assert [r["candidates"] for r in detect(spark.createDataFrame([(None,), ("",)], "content string")).collect()] == [[], []]
