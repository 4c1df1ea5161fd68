"""N-gram Jaccard join by parity sketches.

The distinct shingles of a document are dealt by hash to a number of words, and
each word is the XOR of the 64-bit hashes of its shingles. A shingle that only
one of two sets holds changes one word, so sets that differ in at most D shingles
have sketches of W words of which at least W - D are equal. Sets that reach
similarity t differ in at most D = (1-t)/(1+t) * (|A|+|B|) shingles, so a join on
(size band, word number, word) misses no pair (pigeonhole). Sizes are cut into
geometric bands; a pair joins in the band of its smaller set, and a set also
enters the lower bands that hold a size which can be similar to its own.

W exceeds D + 1 by a spare. A word without shingles says nothing and makes no
bucket row. A set whose filled words exceed those that a partner can change by a
margin therefore shares more than that margin of buckets with every partner. A
set without margin also makes one bucket row for each shingle, so two such sets
meet there.

Buckets of at most HOT rows give all their pairs, counted over all buckets; a
pair goes on only if it meets as often as the margins of both sets demand, less
their rows in larger buckets. Of larger buckets only sets whose margin these use
up take part: they are linked to the smallest id, then, where a bucket still lies
in several components, by a spanning forest of what the sketches allow, then by
all pairs between components that remain. So no link is lost, and no table of
all pairs of a large bucket exists. Each pair is tested by a second parity sketch
of one bit a shingle, whose Hamming distance is a lower bound of the symmetric
difference, and confirmed on the texts.

Bucket rows are dealt by ranges of the key's hash, in packed blocks, to a number of
tasks that follows the bytes of the texts. Of a bucket that a third of all documents
share, each block takes only as many rows as show that it is a larger one; the
other rows go to tasks by document. Equal sets are collapsed in each task of the
profile, and meet by a 128-bit identity.

Defined results: a document without words (null, empty, blank) has 0 shingles,
no link and its own id as component; rows with the same doc_id count as one
document of the graph, with the links of all its texts; a row without doc_id
stands under a number of 2**62 or more made from its text (surrogate); repeated rows stay, with equal results; an empty table
gives an empty table. Extra columns of the input pass through, but for those
named like a result column. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import discard, materialise, shielded, shuffle_width
from .components import connected_components

#: Ratio of the sizes at the ends of a size band.
BAND = 1.5
#: Rows of a verification group, and of a block of the exact rest.
GROUP, BLOCK = 256, 512
#: Rows of a bucket that gives all its pairs; larger ones matter only to sets that have no margin beside them.
HOT = 16
#: Pairs a row of a bucket block up to which all go on at once.
DENSE = 4
#: Bytes of text whose bucket rows a task should hold (at 80 percent about one row for 14 bytes), and bucket rows that are packed at once.
TASK_BYTES, PACKED = 24 << 20, 2_000_000
#: Words of a distance sketch at most: a narrow sketch is a lower bound too.
WIDEST = 64
_SEED = np.uint64(0x5DEECE66D1234567)


def bound(percent: int, a: int, b: int) -> int:
    """Largest symmetric difference of sets of sizes a and b whose similarity is percent or more."""
    return (100 - percent) * (a + b) // (100 + percent)


@functools.lru_cache(100_000)
def levels(n: int, percent: int) -> tuple[tuple[int, int, int], ...]:
    """(band, words needed, words) of each size band that a set of size n joins in: its own, and those of smaller partners."""
    band = int(math.floor(math.log(n) / math.log(BAND) + 1e-9))
    out = []
    while band >= 0:
        high = math.ceil(BAND ** (band + 1) - 1e-9) - 1
        if 100 * high < percent * n:
            break
        apart = bound(percent, high, 100 * high // percent)
        out.append((band, apart + 1, apart + 1 + (apart and 2 + -(-apart // 5))))
        band -= 1
    return tuple(out)


def parities(position: np.ndarray, n_words: int) -> np.ndarray:
    """Words of the bits that an odd number of positions toggle."""
    odd = (np.bincount(position, minlength=64 * n_words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def sets_of(column, k: int) -> Iterator[np.ndarray]:
    data, off = tk.utf8(column)
    for lo, hi in tk.slices(off):
        yield from tk.shingle_sets(*tk.words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), k)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b) or not len(a):
        return False
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


FACTS = "n long, words long, ident binary, margin long, sketch binary"
BLOCKS = "part int, base long, hot boolean, hashes binary, owners binary"
MET = "a long, b long, key long"


KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _fields(schema: str) -> list[pa.Field]:
    return [pa.field(x.split()[0], KINDS[x.split()[1]]) for x in schema.split(", ")]


def _batch(fields: list[pa.Field], n_rows: int, **columns) -> pa.RecordBatch:
    """n_rows rows of these fields; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n_rows, f.type) for f in fields], names=[f.name for f in fields])


def _profile(k: int, percent: int, tasks: int, hot: int):
    """Per document: set size, words, 128-bit identity of the set; for the first of equal sets in a task also margin and sketch. Besides, blocks of their bucket rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        fields: list[pa.Field] = []

        def packed() -> pa.RecordBatch:
            blocks = list(_pack_rows(*(np.concatenate(c) for c in zip(*held, strict=True)), tasks, hot))
            held.clear()
            return _batch(fields, len(blocks), **dict(zip(_names(BLOCKS), zip(*blocks, strict=True), strict=True)))

        for batch in batches:
            data, off = tk.utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            own = [f for f in batch.schema if f.name != "text"]
            fields = own + _fields(f"{FACTS}, {BLOCKS}")
            for lo, hi in tk.slices(off):
                hashes, at = tk.words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                (n, *facts), key, owner = _facts(tk.shingle_sets(hashes, at, k), percent, seen)
                columns = {f.name: batch.column(f.name).slice(lo, hi - lo) for f in own}
                columns |= dict(zip(_names(FACTS), [n, np.diff(at), *facts], strict=True))
                yield _batch(fields, hi - lo, **columns, part=_dealt(tk.mix(ids[lo:hi].view(np.uint64)), tasks))
                if len(key):
                    held.append((key, ids[lo:hi][owner]))
                if sum(len(x) for x, _ in held) > PACKED:
                    yield packed()
        if held:
            yield packed()

    return run


def _dealt(h: np.ndarray, tasks: int) -> np.ndarray:
    """The task of each hash: equal ranges of its upper half."""
    return (((h >> np.uint64(32)) * np.uint64(tasks)) >> np.uint64(32)).astype(np.int32)


def _pack_rows(key: np.ndarray, owner: np.ndarray, tasks: int, hot: int) -> Iterator[tuple]:
    """BLOCKS of bucket rows; rows of a bucket beyond those that show it to be large are dealt by owner."""
    order = np.argsort(key)
    key, owner = key[order], owner[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    beyond = np.arange(len(key)) - np.repeat(start, np.diff(np.r_[start, len(key)])) > hot
    for late in (False, True):
        h, i = key[beyond == late], owner[beyond == late]
        part = _dealt(tk.mix(i.view(np.uint64)) if late else h, tasks)
        if late:
            order = np.argsort(part, kind="stable")
            h, i, part = h[order], i[order], part[order]
        cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)] if len(part) else np.zeros(1, np.int64)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = i[lo:hi]
            base = int(own.min())
            narrow = int(own.max()) - base < 2**32
            owners = (own - base).astype(np.uint32) if narrow else own
            yield int(part[lo]), base if narrow else 0, late, h[lo:hi].tobytes(), owners.tobytes()


def _facts(sets: list[np.ndarray], percent: int, seen: set[bytes]) -> tuple[list, np.ndarray, np.ndarray]:
    """Set sizes, identities, margins and sketches; bucket keys and the number of each key's set."""
    size = np.array([len(s) for s in sets], np.int64)
    raw = np.concatenate([*sets, np.zeros(0, np.uint64)])
    h = tk.mix(raw ^ _SEED)
    again = tk.mix(h + tk.MIX[4])
    at = np.r_[0, np.cumsum(size)]
    ident: list[bytes | None] = [None] * len(sets)
    own = np.zeros(len(sets), bool)
    for i in np.flatnonzero(size):
        ident[i] = np.array([h[at[i] : at[i + 1]].sum(dtype=np.uint64), again[at[i] : at[i + 1]].sum(dtype=np.uint64)]).tobytes()
        own[i] = ident[i] not in seen
        seen.add(ident[i])
    # one entry for each band that a set joins in
    doc, band, need, n_words = np.array([(i, *x) for i in np.flatnonzero(own).tolist() for x in levels(int(size[i]), percent)], np.int64).reshape(-1, 4).T
    key, owner, margin = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.full(len(sets), 2**31)
    sketch: list[bytes | None] = [None] * len(sets)
    if len(doc):
        item = np.repeat(at[doc] - np.r_[0, np.cumsum(size[doc])[:-1]], size[doc]) + np.arange(size[doc].sum())
        of = np.repeat(np.arange(len(doc)), size[doc])
        slot = np.r_[0, np.cumsum(n_words)]
        # sets are sorted, so their words come in order too
        word = (((raw[item] >> np.uint64(32)) * n_words[of].astype(np.uint64)) >> np.uint64(32)).astype(np.int64) + slot[of]
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        entry = of[first]
        number = (word[first] - slot[entry] + (band[entry] << 40)).astype(np.uint64)
        key = tk.mix(np.bitwise_xor.reduceat(h[item], first) * tk.MIX[5] + tk.mix(number * tk.MIX[6]))
        owner = doc[entry]
        np.minimum.at(margin, doc, np.bincount(entry, minlength=len(doc)) - need)
        short = np.repeat(margin < 0, size)
        if short.any():
            key, owner = np.r_[key, tk.mix(h[short] ^ tk.MIX[7])], np.r_[owner, np.repeat(np.arange(len(sets)), size)[short]]
        width = np.where(own, sketch_words(np.maximum(size, 1)), 0)
        place = np.r_[0, np.cumsum(width)]
        mine = np.repeat(own, size)
        bit = (h & (np.repeat(width, size) * 64 - 1).astype(np.uint64)).astype(np.int64) + np.repeat(place[:-1], size) * 64
        far = parities(bit[mine], int(place[-1]))
        for i in np.flatnonzero(own):
            sketch[i] = far[place[i] : place[i + 1]].tobytes()
    return [size, ident, margin, sketch], key, owner


def sketch_words(n: np.ndarray) -> np.ndarray:
    """Words of a distance sketch: a power of two with about two bits for each member, WIDEST at most. A sketch folds to a narrower one."""
    return np.minimum(2 ** np.ceil(np.log2(np.maximum(n / 32, 1))).astype(np.int64), WIDEST)


def folded_together(sketches: list[bytes]) -> np.ndarray:
    """One row for each sketch, all of the narrowest one's width."""
    size = np.array([len(s) // 8 for s in sketches])
    out = np.zeros((len(sketches), size.min()), np.uint64)
    for width in np.unique(size):
        own = np.flatnonzero(size == width)
        words = np.frombuffer(b"".join(sketches[i] for i in own), np.uint64).reshape(len(own), -1, out.shape[1])
        out[own] = np.bitwise_xor.reduce(words, axis=1)
    return out


def _meet(hot: int):
    """The rows of documents; (a, b) for each pair of a small bucket, (key, id) for the rows of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, fields = [], [], []
        for batch in batches:
            fields = [f for f in batch.schema if f.name not in _names(BLOCKS)] + _fields(MET)
            docs = batch.filter(pc.is_valid(batch.column("n")))
            yield _batch(fields, docs.num_rows, **{f.name: docs.column(f.name) for f in fields if f.name in docs.schema.names})
            blocks = batch.filter(pc.is_null(batch.column("n"))).select(_names(BLOCKS)[1:])
            for base, large, h, i in zip(*(c.to_pylist() for c in blocks.columns), strict=True):
                h = np.frombuffer(h, np.uint64)
                i = np.frombuffer(i, np.uint32 if len(i) < 8 * len(h) else np.int64) + np.int64(base)
                if large:
                    yield _batch(fields, len(h), key=h.view(np.int64), id=i)
                else:
                    keys.append(h)
                    owners.append(i)
        if not keys:
            return
        key, i = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")  # blocks come sorted
        key, i = key[order], i[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        rows = np.repeat(size > hot, size)
        yield _batch(fields, int(rows.sum()), key=key[rows].view(np.int64), id=i[rows])
        rows = np.repeat((size > 1) & (size <= hot), size)
        key, i = key[rows], i[rows]
        for gap in range(1, hot):
            same = np.flatnonzero(key[gap:] == key[:-gap])
            if not len(same):
                break
            a, b = i[same], i[same + gap]
            a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
            yield _batch(fields, len(a), a=a, b=b)

    return run


def survivors(rows: list[tuple], percent: int, forest: bool) -> tuple[set[tuple[int, int]], bool]:
    """Pairs of different components in a bucket block that size and sketch distance allow, and whether these are all.

    rows: id, n, comp, side, sketch; side: 0, 1 or 2 (within one block). forest: of more than
    DENSE pairs a row only as many as connect the components that they connect.
    """
    comp = np.array([r[2] for r in rows])
    values, counts = np.unique(comp, return_counts=True)
    if len(values) == 1:
        return set(), True
    ids, n, side = (np.array([r[c] for r in rows]) for c in (0, 1, 3))
    table = folded_together([r[4] for r in rows])
    # pairs with at least one row outside the most frequent component
    few = comp != values[counts.argmax()]
    at = []
    for x in np.flatnonzero(few):
        ok = (comp != comp[x]) & ((side != side[x]) | (side[x] == 2)) & (percent * n <= 100 * n[x]) & (100 * n >= percent * n[x])
        ok[:x] &= ~few[:x]
        j = np.flatnonzero(ok)
        if len(j):
            apart = np.bitwise_count(table[j] ^ table[x]).sum(axis=1, dtype=np.int64)
            at += [(x, y) for y in j[apart <= (100 - percent) * (n[j] + n[x]) // (100 + percent)]]
    whole = not forest or len(at) <= DENSE * len(rows)
    if not whole:
        parent: dict[int, int] = {}

        def find(c: int) -> int:
            while parent.setdefault(c, c) != c:
                parent[c] = c = parent[parent[c]]
            return c

        def joins(x: int, y: int) -> bool:
            p, q = find(int(comp[x])), find(int(comp[y]))
            parent[max(p, q)] = min(p, q)
            return p != q

        at = [(x, y) for x, y in at if joins(x, y)]
    return {(min(a, b), max(a, b)) for a, b in ((int(ids[x]), int(ids[y])) for x, y in at)}, whole


def _allowed(percent: int):
    """The pairs whose sizes and sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(c).to_numpy() for c in range(4))
            ok = (percent * n <= 100 * m) & (percent * m <= 100 * n)
            limit = (100 - percent) * (n + m) // (100 + percent)
            s, t = (batch.column(c).to_pylist() for c in (4, 5))
            for x in np.flatnonzero(ok):
                both = folded_together([s[x], t[x]])
                ok[x] = np.bitwise_count(both[0] ^ both[1]).sum(dtype=np.int64) <= limit[x]
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    return run


def _scan_buckets(percent: int, forest: bool):
    """Over rows sorted by bucket block: (a, b) of pairs, (key) of blocks with more; one block in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        mark, found, left = None, set(), set()

        def close() -> None:
            if len(held) > 1:
                pairs, whole = survivors(held, percent, forest)
                found.update(pairs)
                if not whole:
                    left.add(mark[0])

        def send() -> pa.RecordBatch:
            rows = [(a, b, None) for a, b in sorted(found)] + [(None, None, key) for key in sorted(left)]
            found.clear()
            left.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["a", "b", "key"])

        for batch in batches:
            for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if mark != (key, i, j):
                    close()
                    held, mark = [], (key, i, j)
                held.append(tuple(row))
            if len(found) > 10_000:
                yield send()
        close()
        yield send()

    return run


def _verify(k: int, percent: int):
    """Exact similarity of a hub's text with those of its partners, over rows in order: the hub's own come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, hubs = None, []
        for batch in batches:
            near = []
            for hub, part, i, own in zip(*(batch.column(c).to_pylist() for c in range(3)), sets_of(batch.column(3), k), strict=True):
                if mark != (hub, part):
                    mark, hubs = (hub, part), []
                if i == hub:
                    hubs.append(own)
                elif any(similar(h, own, percent) for h in hubs):
                    near.append((hub, i))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in near], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return run


def surrogate(text: str) -> Column:
    """A number for rows without an id, above the ids in use."""
    return F.xxhash64(F.col(text)).bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_shingles and component_id: components of links at Jaccard similarity percent / 100 or more of k-word shingles."""
    docs = docs.drop("n_shingles", "component_id")
    rows, restore = shielded(docs)
    key, text = (f"__x{docs.columns.index(c)}" for c in (key, text))
    found = components_of(rows, k=k, percent=percent, key=key, text=text)
    found = found.select(F.col("id").alias("__id"), F.coalesce("n", F.lit(0).cast("long")).alias("n_shingles"), F.col("component").alias("component_id"))
    out = rows.withColumn("__id", F.coalesce(F.col(key).cast("long"), surrogate(text))).join(found, "__id", "left")
    return out.select(*restore, "n_shingles", "component_id")


def components_of(docs: DataFrame, *, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """(id, n, rows, component) of each document of the graph: its set size, its rows and the smallest id that links reach.

    With carry: (id, words, component and these columns) of each row of docs.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    plain = docs.select(F.coalesce(F.col(key).cast("long"), surrogate(text)).alias("id"), F.col(text).alias("text"), *[F.col(c).alias(f"__{c}") for c in carry or ()])
    kept = [f"__{c}" for c in carry or ()]
    own = ", ".join(["id long", *[f"{f.name} {f.dataType.simpleString()}" for f in plain.select(kept).schema], FACTS])
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(shuffle_width(docs.sparkSession), size // TASK_BYTES)
    # bucket rows only pass through the exchange
    dealt = plain.mapInArrow(_profile(k, percent, tasks, HOT), f"{own}, {BLOCKS}").repartitionById(tasks, "part")
    profile = met = materialise(dealt.mapInArrow(_meet(HOT), f"{own}, {MET}"), "profile")
    plain = plain.select("id", "text")
    profile = profile.where("n is not null")
    lengths = materialise(profile.select("id", "words", *kept), "lengths") if carry is not None else None
    facts = profile.groupBy("id").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("margin").alias("margin"), (F.min("ident") != F.max("ident")).alias("several"))
    facts = materialise(facts, "facts")
    some = profile.where("n > 0")
    # equal sets hang from the smallest id that has the set; the graph needs only those that make bucket rows or have several sets
    reps = materialise(some.groupBy("ident").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last").select("ident", "rep"), "reps")
    copies = some.select("id", "ident", F.col("sketch").isNotNull().alias("first")).join(reps, "ident").where("id <> rep").groupBy("id", "rep").agg(F.max("first").alias("first"))
    copies = copies.join(facts.where("several").select("id", F.lit(True).alias("several")), "id", "left")
    copies = materialise(copies.withColumn("node", F.col("first") | F.coalesce("several", F.lit(False))), "copies")
    sketches = materialise(some.where("sketch is not null").select("id", "n", "sketch"), "sketches")
    # how often a set must meet a partner in small buckets
    large = met.where("key is not null").groupBy("id").agg(F.count(F.lit(1)).alias("large"))
    demand = facts.where("n > 0").join(large, "id", "left").select("id", (F.col("margin") + 1 - F.coalesce("large", F.lit(0))).alias("least"))
    demand = materialise(demand, "demand")
    pairs = met.where("a is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))
    for c in ("a", "b"):
        pairs = pairs.join(demand.select(F.col("id").alias(c), "least"), c).where("times >= least").drop("least")
    # large buckets, for the sets that need them
    members = materialise(met.where("key is not null").select("key", "id").join(demand.where("least <= 0").select("id"), "id", "left_semi"), "members")
    lows = materialise(members.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("key", "a"), "lows")
    stars = members.join(lows, "key").select("a", F.col("id").alias("b")).where("a <> b")
    tried = materialise(_allow(pairs.select("a", "b").union(stars).distinct(), sketches, percent), "tried")
    edges = copies.where("node").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    # the exact rest compares members alone, so texts are read once
    wanted = tried.select(F.explode(F.array("a", "b")).alias("id")).union(members.select("id")).distinct()
    texts = materialise(plain.join(wanted.hint("merge"), "id", "left_semi").distinct(), "texts")
    links = _links(tried, texts, k, percent)
    comps = connected_components(edges.union(links))
    discard(met, demand, lows)
    staged = [members, sketches, texts, tried, links, reps]
    # where a bucket has many pairs, a forest first, so that few of them remain
    for forest in (True, False):
        rest = _rest(members, comps)
        if rest is None:
            break
        scanned = materialise(_pairs(rest, sketches, percent, forest), "scanned")
        more = materialise(scanned.where("a is not null").select("a", "b").join(tried, ["a", "b"], "left_anti"), "more")
        found = _links(more, texts, k, percent)
        members = members.join(scanned.where("key is not null").select("key"), "key", "left_semi")
        staged += [rest, scanned, more, found]
        if not found.isEmpty():
            old, comps = comps, connected_components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))
            discard(old)
        tried = tried.union(more)
    follow = copies.where("not node").select("id", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    placed = comps.withColumnRenamed("node", "id").union(follow)
    rows = facts.select("id", "n", "rows") if carry is None else lengths
    out = rows.join(placed, "id", "left").withColumn("component", F.coalesce("component", "id"))
    out = materialise(out.withColumnsRenamed({f"__{c}": c for c in carry or ()}), "near")
    discard(facts, copies, comps, *staged, *([lengths] if carry is not None else []))
    return out


def _allow(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    of = lambda c: sketches.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    return both.mapInArrow(_allowed(percent), "a long, b long").distinct()


def _rest(members: DataFrame, comps: DataFrame) -> DataFrame | None:
    """Bucket rows (key, id, comp, rows) of buckets that lie in several components; None if there are none."""
    rows = members.join(comps.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    rows = materialise(rows, "placed")
    sizes = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("rows")).where("low <> high").select("key", "rows")
    sizes = materialise(sizes, "sizes")
    rest = materialise(rows.join(sizes, "key"), "open")
    discard(rows, sizes)
    return None if rest.isEmpty() else rest


def _pairs(rows: DataFrame, sketches: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Candidate pairs (a < b) of bucket rows of different components, and keys of buckets that have more; large buckets are cut into blocks.

    The sketches join last, so only one exchange carries them.
    """
    rows = rows.withColumn("blocks", F.ceil(F.col("rows") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    spread = rows.select("key", "id", "comp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    spread = spread.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "comp", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
    spread = spread.join(sketches, "id").select("key", "i", "j", "id", "n", "comp", "side", "sketch")
    width = shuffle_width(rows.sparkSession)
    return spread.repartition(width, "key", "i", "j").sortWithinPartitions("key", "i", "j", "id").mapInArrow(_scan_buckets(percent, forest), "a long, b long, key long").distinct()


def _links(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that the texts confirm."""
    if pairs.isEmpty():
        return pairs
    chunks = materialise(pairs.groupBy(F.col("a").alias("hub")).agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts")), "chunks")
    members = pairs.select(F.col("a").alias("hub"), F.col("b").alias("id")).join(chunks, "hub").select("hub", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), "id")
    hubs = chunks.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("hub").alias("id"))
    rows = members.union(hubs).join(texts, "id").select("hub", "part", "id", "text").repartition(shuffle_width(texts.sparkSession), "hub", "part")
    rows = rows.sortWithinPartitions("hub", "part", F.col("id") != F.col("hub"))
    links = materialise(rows.mapInArrow(_verify(k, percent), "a long, b long").distinct(), "links")
    discard(chunks)
    return links
