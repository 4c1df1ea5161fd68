import hashlib
from collections import defaultdict

import pytest

from lakeaudit.llm import merkle
from lakeaudit.llm.queries import QUERIES


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """Root and the siblings of each node, from the definition."""
    at, seen = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            if (i ^ 1) < len(nodes):
                seen[k].append((nodes[i ^ 1], i % 2))
        nodes, at = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], [i // 2 for i in at]
    return nodes[0], seen


def plain(rows):
    leaves = [(d, g, h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, s, g, n, t)])) for d, s, g, n, t in rows]
    groups = defaultdict(list)
    for d, g, x in sorted(leaves, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        groups[g].append((d, x))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x for _, x in groups[g]]) for g in order}
    root, tops = tree([trees[g][0] for g in order])
    return sorted((repr(d), repr(g), i, x, [s for s, _ in trees[g][1][i]] + [s for s, _ in tops[k]], trees[g][0], root) for k, g in enumerate(order) for i, (d, x) in enumerate(groups[g]))


ROWS = [(i * 3 % 101, f"s{i % 3}", ["de", "en", None, "é", "z"][min(i % 7, 4)] if i % 7 else "en", i if i % 5 else None, None if i % 11 == 0 else "t é" * (i % 4)) for i in range(97)]
ROWS += [(5, "s", "one", 1, "x"), (None, None, "en", None, None), (7, "s", "en", 1, "same"), (7, "s", "en", 1, "same"), (7, "s", "en", 2, "other"), (8, "s", "", 1, "long " * 100_000)]
MANY = [(i, "s", f"l{i % 23:02}", i, "x") for i in range(40)]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize(("rows", "bits", "top"), [(ROWS, 12, 4096), (ROWS, 2, 8), (ROWS, 1, 3), (MANY, 1, 4), (MANY, 2, 30), (ROWS[:1], 2, 4), (ROWS[:2], 12, 4096)])
def test_brute_force(spark, rows, bits, top):
    """Few bits and a small top: several rounds, paths by cogroup, and subroots that are reduced by tasks."""
    out = merkle.manifest(spark.createDataFrame(rows, SCHEMA), bits=bits, top=top)
    again = merkle.fold(out["leaf"], out["proof"]).alias("again")
    got = out.select("*", again, merkle.proof_digest(out["proof"]).alias("digest")).collect()
    assert sorted((repr(r["doc_id"]), repr(r["lang"]), r["position"], r["leaf"], [s[1:] for s in r["proof"] if s[0] in "<>"], r["subroot"], r["root"]) for r in got) == plain(rows)
    assert all(r["again"] == r["root"] and r["digest"] == h(*[s[1:] for s in r["proof"] if s[0] in "<>"]) for r in got)


def test_empty_and_names(spark):
    df = spark.createDataFrame([(1, "g", 5, "x")], "id long, d string, path long, i string")
    assert merkle.manifest(df.limit(0), ["id"], group="d", order="id").count() == 0
    row = merkle.manifest(df, ["id", "i"], group="d", order="id", keep=["path", "i"]).first()
    assert (row["leaf"], row["proof"], row["path"], row["i"]) == (h("1:11:x"), ["|"], 5, "x") and row["root"] == row["subroot"] == row["leaf"]


def test_tampered_rows(spark, tmp_path):
    import zlib

    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    for r in QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect():
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and any(x[0] == r["doc_id"] and x[3] is not None for x in ROWS)
        assert r["verified"] or hit
