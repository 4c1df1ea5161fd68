import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from lakeaudit.llm import trie
from lakeaudit.llm.queries import QUERIES


def plain(rows):
    """Nodes from the definition, walking every sequence."""
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            talks[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32], role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in talks.items()}
    members, kids = defaultdict(list), defaultdict(set)
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 4, (abs(c) - abs(c) % 20) * (-1 if c < 0 else 1)
        talk = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(talk) + 1):
            members[tuple(talk[:d])].append((c, d == len(talk)))
            if d:
                kids[tuple(talk[: d - 1])].add(tuple(talk[:d]))
    out, sums = [], {}
    for k in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        below = [sums[x] for x in kids[k]]
        sums[k] = (sum(x[0] for x in below) or 1, (len(members[k]) - 1) * words + sum(x[1] for x in below))
        ends = ",".join(map(str, sorted(c for c, end in members[k] if end)))
        out.append((min(members[k])[0], len(k), min(members[k[:-1]])[0] if k else None, len(members[k]), len(kids[k]), *sums[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def talks():
    rows = [(c, t, "user" if t % 2 == 0 else "bot", f"w{t} " * (t % 3) + ("same" if c % 3 else f"own {c % 5}")) for c in range(-23, 60) for t in range(c % 7)]
    rows += [(c, t, "user", f"deep {t}" if t < 70 + c % 2 else f"end {c}") for c in (200, 201, 203, 205, 401) for t in range(90 + c % 4)]
    rows += [(7, None, None, None), (7, 3, "user", None), (7, 3, "user", None), (7, 3, "bot", "x y"), (None, 1, "user", "lost"), (300, 1, "user", "")]
    rows += [(c, 0, "user", "hot first turn") for c in range(1000, 1700)] + [(1000 + 20 * c, 1, "bot", f"answer {c % 3}") for c in range(35)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("bits", "many", "share"), [(5, 256, 512), (1, 4, 3)])
def test_brute_force(spark, tmp_path, monkeypatch, bits, many, share):
    """Short chunks, lists and few hot keys: several rounds of chunks, streamed lists, and joins of both kinds."""
    for name, value in (("BITS", bits), ("LIST", many), ("SHARE", share)):
        monkeypatch.setattr(trie, name, value)
    monkeypatch.setattr(trie.join_one, "__defaults__", (share,))
    rows = talks()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    out = QUERIES["op13_prefix_trie"](spark, str(tmp_path))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(5, 0, "user", "x")], [(3, 0, None, None), (3, 0, None, None)]])
def test_small_tables(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], SCHEMA + ", depth int, digest string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted((tuple(r) for r in QUERIES["op13_prefix_trie"](spark, str(tmp_path)).collect()), key=repr) == plain(rows)
