import random
import time

import pytest

from lakeaudit.functions import detect as d

from .test_rules_brute import FOUND, ODD, plain


def body(text):
    return memoryview(text.encode())


@pytest.mark.parametrize("window", [0, 1, 5, 40])
def test_pieces_give_what_the_whole_text_gives(window):
    rng = random.Random(window)
    for _ in range(800):
        parts = [rng.choice(FOUND + ODD + ["".join(rng.choices('aZ09 .,:;!?"<>[]{}|*&-/@#\n\t', k=rng.randrange(9)))]) for _ in range(rng.randrange(12))]
        text = rng.choice(["", " ", "; ", ' "', "!\n"]).join(parts)
        assert "".join(d.pieces(body(text), window)) == text
        assert d.spans_in_pieces(body(text), window) == d.settled(plain(text)), text


def test_places_are_code_points():
    text = "é🙂; " * 50 + "mail a.b@c.org! Member ID: MBR-SYN-0001; é"
    got = d.spans_in_pieces(body(text), 16)
    assert [text[c["start"] : c["end"]] for c in got] == ["a.b@c.org", "MBR-SYN-0001"]


def test_a_text_of_megabytes(spark, monkeypatch):
    """Longer than the window: found as before, in time that grows with the text."""
    block = "The claim was seen; callback 555-013-7788, see https://x.test/a?b;c! Member ID: MBR-SYN-0001 é.\n" * 8000
    got = {}
    for times in (1, 4):
        df = spark.createDataFrame([(block * times,)], "content string").repartition(1)
        begun = time.time()
        found = d.detect(df).first()["candidates"]
        got[times] = time.time() - begun
        assert len(found) == 3 * 8000 * times and found[-1]["end"] == len(block) * times - 4
    assert len(block.encode()) < d.WINDOW < len(block.encode()) * 4 and got[4] < 8 * got[1] + 5
