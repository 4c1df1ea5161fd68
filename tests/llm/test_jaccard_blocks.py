import numpy as np
import pytest

from lakeaudit.llm import jaccard


@pytest.mark.parametrize("base", [0, -5, 2**62])
def test_blocks_hold_each_row_once(base):
    """A bucket of half of all rows leaves only the rows that show it to be large in its own task."""
    r = np.random.default_rng(3)
    key = r.integers(0, 2**64, 4000, dtype=np.uint64)
    key[::2] = key[0]
    owner = r.integers(0, 2**40, 4000) + base
    rows, own = [], {}
    for part, low, hot, h, i in jaccard._pack_rows(key, owner, 7, 16):
        h = np.frombuffer(h, np.uint64)
        i = np.frombuffer(i, np.uint32 if len(i) < 8 * len(h) else np.int64) + np.int64(low)
        rows += zip(h.tolist(), i.tolist(), strict=True)
        assert 0 <= part < 7
        if hot:
            assert set(h.tolist()) == {int(key[0])}
        else:
            own.setdefault(part, []).extend(h.tolist())
    assert sorted(rows) == sorted(zip(key.tolist(), owner.tolist(), strict=True))
    assert sum(x.count(int(key[0])) for x in own.values()) == 17
    assert not any(set(own[a]) & set(own[b]) for a in own for b in own if a < b)


def test_decoded_rows_come_in_order():
    from lakeaudit.llm import segmentation as sg

    voc = sg.Vocabulary({"▁a": (0, -1.0), "b": (1, -2.0)}, list(range(2, 258)), ["▁a", "b", *[None] * 256]).prepare()
    rows = [np.array(x, np.int64) for x in ([0, 1], [], [0, 0], [2 + 0xC3, 2 + 0xA9], [1] * 9000)]
    assert list(sg.decode_rows(rows, voc)) == ["ab", "", "a a", "é", "b" * 9000]
    assert list(sg.decode_rows([], voc)) == []
