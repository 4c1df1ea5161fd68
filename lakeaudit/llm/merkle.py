"""Merkle manifest of a table: leaf, proof, subtree root and root of every row.

Leaves hash the chosen columns of a row, each with its length. The rows of a group
(null is one) ascend by the order column; pairs of neighbours are hashed together, level by
level, a last single one alone, until one digest is left: the group's subroot. The subroots,
by group, make the root in the same way.

How: blocks of 2**BITS neighbouring leaves are reduced by tasks, and the blocks' digests in
blocks again, until at most TOP nodes are left. That top tree is built on the driver
from so many digests at most, and the paths from its nodes to the root are broadcast; tasks then
go over the blocks once more and finish the proofs. Blocks of lower rounds meet their
paths in a cogroup, one for each block. So neither driver, broadcast nor task grows with
the table, and a group of any size is spread.

A proof is an array of steps to the root: ">" + digest (sibling on the right), "<" + digest
(on the left), "." (no sibling: hashed alone), "|" (here the digest is the subroot).

Defined results: equal values of the order column stand by their leaves, nulls first;
equal rows stand next to each other, each with its own proof. A table of one row has its
leaf as subroot and root and the proof ["|"]. An empty table gives no rows. Columns of the table that are
not chosen, grouped, ordered or kept don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CRC32_SQL, discard, materialise, ranked

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that a task reduces at a time, and nodes that the driver may hold.
BITS, TOP = 12, 4096
NODE = "g long, i long, n long, d string"


def leaf(columns: Sequence[Column | str]) -> Column:
    """Digest of some values: each "-" if null, else its length in UTF-8 bytes, ":" and itself."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    other = lambda s: F.substring(s, 2, 64)
    step = lambda d, s: F.when(s.startswith(">"), F.sha2(F.concat(d, other(s)), 256)).when(s.startswith("<"), F.sha2(F.concat(other(s), d), 256)).when(s == ".", F.sha2(d, 256)).otherwise(d)
    return F.aggregate(proof, start, step)


def proof_digest(proof: Column) -> Column:
    """Digest of the siblings of a proof, in its order."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.substring(s, 2, 64)), ""), 256)


def digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def reduced(nodes: list[bytes], rounds: int) -> list[list[bytes]]:
    """The nodes and so many levels above them."""
    levels = [nodes]
    for _ in range(rounds):
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        levels.append(nodes)
    return levels


def steps(levels: list[list[bytes]]) -> Iterator[list[str]]:
    """For each node of the lowest level, the steps to the highest."""
    marks = []
    for nodes in levels[:-1]:
        names = [n.decode() for n in nodes]
        marks.append([("<" + names[i - 1]) if i % 2 else (">" + names[i + 1]) if i + 1 < len(names) else "." for i in range(len(names))])
    for i in range(len(levels[0])):
        yield [row[i >> k] for k, row in enumerate(marks)]


def climb(node: bytes, path: Sequence[str]) -> tuple[bytes | None, bytes]:
    """(subroot, root) from a node by a path."""
    sub = None
    for s in path:
        if s == "|":
            sub = node
        else:
            other = s[1:].encode()
            node = digest(node, other) if s[0] == ">" else digest(other, node) if s[0] == "<" else digest(node)
    return sub, node


def height(n: int, bits: int) -> int:
    """Levels that a block of a group of n nodes is reduced by."""
    return min(bits, (n - 1).bit_length())


def _block(t: pa.Table, bits: int) -> tuple[pa.Table, list[list[bytes]]]:
    t = t.sort_by("i")
    return t, reduced([d.encode() for d in t.column("d").to_pylist()], height(t.column("n")[0].as_py(), bits))


def _up(nodes: DataFrame, bits: int) -> DataFrame:
    """The nodes that are the tops of blocks of nodes."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        g, b, n = key[0].as_py(), key[1].as_py(), t.column("n")[0].as_py()
        _, levels = _block(t, bits)
        return pa.table({"g": [g], "i": [b], "n": [((n - 1) >> bits) + 1], "d": [levels[-1][0].decode()]}, schema=pa.schema([("g", pa.int64()), ("i", pa.int64()), ("n", pa.int64()), ("d", pa.string())]))

    return nodes.groupBy("g", F.shiftright("i", bits).alias("b")).applyInArrow(run, NODE)


def _down(nodes: DataFrame, above: DataFrame | dict, bits: int) -> DataFrame:
    """nodes (and all their columns) with path, subroot and root. above: paths of the blocks, as a table (g, i, path) or a dictionary to be broadcast."""
    schema = T.StructType([*nodes.schema.fields, *T._parse_datatype_string("path array<string>, subroot string, root string").fields])
    names = nodes.columns

    def finish(t: pa.Table, path: list[str]) -> pa.Table:
        t, levels = _block(t.select(names), bits)
        sub, root = climb(levels[-1][0], path)
        t = t.append_column("path", pa.array([[*p, *path] for p in steps(levels)], pa.list_(pa.string())))
        for name, value in (("subroot", sub), ("root", root)):
            t = t.append_column(name, pa.array([value and value.decode()] * len(t), pa.string()))
        return t

    keyed = nodes.groupBy("g", F.shiftright("i", bits).alias("b"))
    if isinstance(above, dict):
        shared = nodes.sparkSession.sparkContext.broadcast(above)
        return keyed.applyInArrow(lambda key, t: finish(t, shared.value[key[0].as_py(), key[1].as_py()]), schema)
    paths = above.select("g", F.col("i").alias("b"), "path").groupBy("g", "b")
    return keyed.cogroup(paths).applyInArrow(lambda key, t, p: finish(t, p.column("path")[0].as_py()), schema)


def _top(rows: list, one: bool) -> dict:
    """Paths from the nodes that are left. one: they are subroots already."""
    groups: dict[int, list] = {}
    for r in sorted(rows):
        groups.setdefault(r[0], []).append(r[3].encode())
    tops = {g: reduced(ds, (len(ds) - 1).bit_length()) for g, ds in groups.items()}
    if one:
        ((g, levels),) = tops.items()
        return {(g, i): p for i, p in enumerate(steps(levels))}
    subroots = [levels[-1][0] for levels in tops.values()]
    rest = list(steps(reduced(subroots, (len(subroots) - 1).bit_length())))
    return {(g, i): [*p, "|", *rest[k]] for k, (g, levels) in enumerate(tops.items()) for i, p in enumerate(steps(levels))}


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, *, group: str = "lang", order: str = "doc_id", keep: Sequence[str] = (), bits: int = BITS, top: int = TOP) -> DataFrame:
    """(order, group, keep..., position, leaf, proof, subroot, root) of every row."""
    held = [order, group, *keep]
    rows = docs.select(*[F.col(c).alias(f"__h{i}") for i, c in enumerate(held)], leaf(columns).alias("d"))
    rows = ranked(rows, ["__h1"], ["__h0", "d"], "leaves", groups=True)
    lowest = rows.select(*[f"__h{i}" for i in range(len(held))], F.col("__rank").alias("g"), F.col("__at").alias("i"), F.col("__of").alias("n"), "d")
    rounds, one = [(lowest, None)], False
    nodes = materialise(_up(lowest.select("g", "i", "n", "d"), bits), "nodes")
    staged = [nodes]
    while nodes.count() > top:
        if not one and nodes.where("n > 1").isEmpty():  # only subroots are left, and they are many
            one, n = True, nodes.count()
            rounds.append((nodes, "subroots"))
            nodes = nodes.select(F.lit(-1).cast("long").alias("g"), F.col("g").alias("i"), F.lit(n).cast("long").alias("n"), "d")
        rounds.append((nodes, None))
        nodes = materialise(_up(nodes, bits), "nodes")
        staged.append(nodes)
    above: DataFrame | dict = _top([tuple(r) for r in nodes.collect()], one)
    for level, kind in reversed(rounds[1:]):
        if kind:  # a subroot's path goes on as a leaf of the last tree
            above = above.select(F.col("i").alias("g"), F.lit(0).cast("long").alias("i"), F.concat(F.array(F.lit("|")), "path").alias("path"))
        else:
            above = materialise(_down(level, above, bits).select("g", "i", "path"), "paths")
    discard(*staged)
    out = _down(lowest, above, bits)
    return out.select(*[F.col(f"__h{i}").alias(c) for i, c in enumerate(held)], F.col("i").alias("position"), F.col("d").alias("leaf"), F.col("path").alias("proof"), "subroot", "root")


_LEAF = "sha256(" + " || ".join("coalesce(strlen({0}::varchar) || ':' || {0}, '-')".replace("{0}", c) for c in COLUMNS) + ")"
_TOUCHED = _LEAF.replace("n_chars", "(n_chars + 1)")
_STEP = "case when {0} >> {1} & 1 = 1 then '<' || ds[({0} >> {1})] when len(ds) > ({0} >> {1}) + 1 then '>' || ds[({0} >> {1}) + 2] else '.' end"
ORACLE = f"""
with recursive leaves as (select doc_id, lang, {_LEAF} as leaf, case when {CRC32_SQL.format('cast(doc_id as varchar)')} % 7 = 0 then {_TOUCHED} end as touched from documents),
placed as (select *, row_number() over (order by doc_id nulls first, leaf) as id, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, dense_rank() over (order by lang nulls first) - 1 as g from leaves),
t(g, l, ds) as (select g, 0, list(leaf order by i) from placed group by g union all select g, l + 1, list_transform(range(0, len(ds), 2), lambda k: sha256(ds[k + 1] || coalesce(ds[k + 2], ''))) from t where len(ds) > 1),
subs as (select g, ds[1] as subroot from t where len(ds) = 1),
u(l, ds) as (select 0, list(subroot order by g) from subs union all select l + 1, list_transform(range(0, len(ds), 2), lambda k: sha256(ds[k + 1] || coalesce(ds[k + 2], ''))) from u where len(ds) > 1),
top as (select ds[1] as root from u where len(ds) = 1),
s as (select id, l, {_STEP.format('i', 'l')} as step from placed join t using (g) where len(ds) > 1 union all select id, 100 + l, {_STEP.format('g', 'l')} from placed, u where len(ds) > 1),
p as (select id, list(step order by l) as steps from s group by id),
f as (select id, doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda x: x[2:]), ''), '')) as proof_sha256,
  list_reduce(coalesce(steps, []), lambda a, x: case x[1] when '<' then sha256(x[2:] || a) when '>' then sha256(a || x[2:]) else sha256(a) end, coalesce(touched, leaf)) as folded_root from placed join subs using (g) cross join top left join p using (id))
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from f
"""
