"""Replacing the values of a dictionary of any size in texts of any number.

No task holds the dictionary. A value of n characters is keyed by hashes of its first and last
2**k characters (the largest power of two that fits), which cover it. Texts hash
their windows of those widths, each from two of half the width, where a table of the values' first four
characters (or fewer) says that one can begin; where a window's hash is in a filter of
the values' first windows, the lengths in use are tried, and keys in a second filter
are emitted. The table and both filters have a fixed largest size (HEADS places a width, FILTER bits): more values than they tell
apart mean more keys to join, not other results. The keys then meet the values in a join.

Values are replaced in a stated order, and a replacement can make a later value appear where it
touches the text around it. So each task also emits the keys around what it put in; texts in which these
meet further values are done again with them, until no text meets new ones. A value that is not in
the text at its turn changes nothing, so chance hits of a hash are harmless.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import staged

#: Largest number of bits of a filter, bits for each value, and characters hashed at a time.
FILTER, BITS_EACH, CHUNK = 1 << 27, 16, 1 << 20
#: Values are told by their first 2**HEAD characters at first (or the power of two that fits), by a hash of so many places.
HEAD, HEADS = 2, 1 << 20


def _mix(a: np.ndarray, b: np.ndarray | np.uint64, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(salt * 0x632BE59BD9B4E019 % 2**64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _widths(codes: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, hashes of the windows of 2**k characters at every place of the last axis) for k up to top."""
    h = _mix(codes.astype(np.uint64), np.uint64(1), 0)
    for k in range(top + 1):
        if k:
            half = 1 << (k - 1)
            if h.shape[-1] <= half:
                return
            h = _mix(h[..., :-half], h[..., half:], k)
        yield k, h


def _head(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)) & np.uint64(HEADS - 1)


def _key(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    return _mix(first, last, 1000 + n)


def keys_of(values: list[str]) -> np.ndarray:
    """Per value, the hash of its first window, its key and its head (width and place), as signed numbers; values of one length are hashed together."""
    out, sizes = np.zeros((3, len(values)), np.uint64), np.array([len(v) for v in values], np.int64)
    for n in np.unique(sizes).tolist():
        at, k = np.flatnonzero(sizes == n), n.bit_length() - 1
        for step in range(0, len(at), max(1, CHUNK // n)):
            part = at[step : step + max(1, CHUNK // n)]
            for j, h in _widths(_codes("".join(values[i] for i in part)).reshape(len(part), n), k):
                if j == min(k, HEAD):
                    out[2, part] = np.uint64(j * HEADS) + _head(h[:, 0])
            out[0, part], out[1, part] = _mix(h[:, 0], np.uint64(2), 900 + k), _key(h[:, 0], h[:, -1], n)
    return out.view(np.int64)


def keyed(entries: DataFrame) -> DataFrame:
    """entries (value, ...) with n (characters), prefix, key and head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column("value").to_pylist()
            prefixes, keys, heads = keys_of(values)
            new = [pa.array([len(v) for v in values], pa.int32()), pa.array(prefixes), pa.array(keys), pa.array(heads)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "n", "prefix", "key", "head"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    return entries.mapInArrow(run, f"{kinds}, n int, prefix long, key long, head long")


def _filters(entries: DataFrame, words: int) -> np.ndarray:
    """Words of two filters, of prefixes and of keys, with two bits for each hash. words is a power of two and bounds what the driver gets."""
    both = entries.select(F.inline(F.array(*[F.struct(F.lit(i * words).alias("base"), F.col(c).alias("h")) for i, c in enumerate(("prefix", "key"))])))
    mask = F.expr("shiftleft(1L, cast(h & 63 as int)) | shiftleft(1L, cast(shiftrightunsigned(h, 6) & 63 as int))")
    at = F.expr(f"base + (shiftrightunsigned(h, 32) & {words - 1}L)")
    rows = both.groupBy(at.alias("at")).agg(F.bit_or(mask).alias("mask")).toArrow()
    out = np.zeros(2 * words, np.uint64)
    out[rows["at"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return out.reshape(2, words)


def _holds(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask = (np.uint64(1) << (h & np.uint64(63))) | (np.uint64(1) << ((h >> np.uint64(6)) & np.uint64(63)))
    return words[(h >> np.uint64(32)) & np.uint64(len(words) - 1)] & mask == mask


class _Hashes:
    """Hashes of the windows of a run of characters: of all places at the small widths, of others where they are asked for, unless these are many."""

    def __init__(self, codes: np.ndarray):
        self.of = [h for _, h in _widths(codes, HEAD)]

    def at(self, k: int, places: np.ndarray) -> np.ndarray:
        """Hashes of the windows of 2**k characters at places, which lie within."""
        while k >= len(self.of) and 4 * len(places) >= len(self.of[0]):
            half = 1 << (len(self.of) - 1)
            self.of.append(_mix(self.of[-1][:-half], self.of[-1][half:], len(self.of)))
        if k < len(self.of):
            return self.of[k][places]
        return _mix(self.at(k - 1, places), self.at(k - 1, places + (1 << (k - 1))), k)


@dataclass(frozen=True)
class Windows:
    """What tasks know of a dictionary: the lengths in use, by their power of two, the heads at each width, and two filters."""

    lengths: dict[int, list[int]]
    heads: np.ndarray
    prefixes: np.ndarray
    keys: np.ndarray

    @property
    def longest(self) -> int:
        return max(max(v) for v in self.lengths.values())

    def found(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of the windows that may be values."""
        places, keys, reach = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], self.longest - 1
        for begin in range(0, len(codes), CHUNK):
            run = codes[begin : begin + CHUNK + reach]
            hashes, begins = _Hashes(run), {}
            for k, sizes in self.lengths.items():
                j = min(k, HEAD)
                if j >= len(hashes.of):
                    continue
                if j not in begins:
                    begins[j] = np.flatnonzero(self.heads[j][_head(hashes.of[j][:CHUNK])])
                at = begins[j][begins[j] + (1 << k) <= len(run)]
                if not len(at):
                    continue
                first = hashes.at(k, at)
                may = _holds(self.prefixes, _mix(first, np.uint64(2), 900 + k))
                at, first = at[may], first[may]
                for n in sizes:
                    fits = at + n <= len(run)
                    key = _key(first[fits], hashes.at(k, at[fits] + n - (1 << k)), n)
                    hit = _holds(self.keys, key)
                    places.append(at[fits][hit] + begin)
                    keys.append(key[hit])
        return np.concatenate(places), np.concatenate(keys).view(np.int64)


def windows(entries: DataFrame) -> Windows | None:
    """What tasks need to know of keyed entries; none: there are none."""
    sizes = [(r["n"], r["count"]) for r in entries.groupBy("n").count().collect()]
    if not sizes:
        return None
    lengths: dict[int, list[int]] = {}
    for n, _ in sorted(sizes):
        lengths.setdefault(n.bit_length() - 1, []).append(n)
    heads = np.zeros((HEAD + 1) * HEADS, bool)
    heads[entries.select("head").distinct().toArrow()["head"].to_numpy()] = True
    words = max(16, min(FILTER, 1 << (BITS_EACH * sum(c for _, c in sizes)).bit_length()) // 64)
    return Windows(lengths, heads.reshape(HEAD + 1, HEADS), *_filters(entries, words))


def _met(texts: DataFrame, shared) -> DataFrame:
    """(event_no, key): keys of the windows of texts (event_no, text) that may be values, each once for a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            ids, rows = b.column("event_no").to_numpy(zero_copy_only=False), [t or "" for t in b.column("text").to_pylist()]
            owner, keys = _owned(known, rows)
            pairs = np.unique(np.stack([ids[owner], keys]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], names=["event_no", "key"])

    return texts.mapInArrow(run, "event_no long, key long")


def _owned(known: Windows, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of the text in which a window that may be a value begins, and its key. A window that reaches into the next text is a chance hit."""
    ends = np.cumsum([len(t) for t in texts])
    places, keys = known.found(_codes("".join(texts)))
    return np.searchsorted(ends, places, side="right"), keys


def replace_in_order(text: str, entries: list[dict], reach: int) -> tuple[str, list[str]]:
    """The text after the entries, and the surroundings of what was put in, in which others may have come up; reach: one less than the longest value."""
    around = []
    for e in entries:
        parts = text.split(e["value"])
        if len(parts) == 1:
            continue
        text, put, at = e["redaction"].join(parts), e["redaction"], 0
        spots, upto = [], -1
        for p in parts[:-1]:  # the surroundings of each replacement, joined where they meet
            at += len(p)
            low, high = max(0, at - reach), at + len(put) + reach
            if low <= upto:
                spots[-1] = (spots[-1][0], high)
            else:
                spots.append((low, high))
            upto, at = high, at + len(put)
        around += [text[low:high] for low, high in spots]
    return text, around


def _applied(work: DataFrame, shared) -> DataFrame:
    """(event_no, text, fresh) from texts with their entries. The surroundings of many texts are searched at once."""
    schema = pa.schema([("event_no", pa.int64()), ("text", pa.string()), ("fresh", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, fresh, around, owner, size = [], [set() for _ in range(b.num_rows)], [], [], 0
            own = []

            def search() -> None:
                spot, keys = _owned(shared.value, around)
                for i, key in zip(np.array(owner, np.int64)[spot].tolist(), keys.tolist(), strict=True):
                    fresh[i].add(key)

            for i, (no, text, entries) in enumerate(zip(*(b.column(c).to_pylist() for c in ("event_no", "text", "entries")), strict=True)):
                done, spots = replace_in_order(text, entries, shared.value.longest - 1)
                out.append((no, done))
                own.append({e["key"] for e in entries})
                around += spots
                owner += [i] * len(spots)
                size += sum(map(len, spots))
                if size > CHUNK:
                    search()
                    around, owner, size = [], [], 0
            if around:
                search()
            rows = [(no, text, sorted(new - known)) for (no, text), new, known in zip(out, fresh, own, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 3, schema, strict=True)], schema=schema)

    return work.select("event_no", "text", "entries").mapInArrow(run, "event_no long, text string, fresh array<long>")


def replace_values(texts: DataFrame, entries: DataFrame) -> DataFrame | None:
    """(event_no, text) of the texts (event_no, text) that may hold entries, after all entries in order; None: there are no entries.

    event_no is unique. entries: value (unique), redaction, rank (a struct that orders them). A text takes the
    entries that it meets only. What may be few is written before it is joined, so that Spark knows its size and moves
    neither the dictionary nor the texts for it.
    """
    entries = staged(keyed(entries), "dictionary")
    known = windows(entries)
    if known is None:
        return None
    shared = texts.sparkSession.sparkContext.broadcast(known)
    entry = F.struct("rank", "value", "redaction", "key").alias("entry")
    held = staged(staged(_met(texts, shared), "keys").join(entries, "key").select("event_no", entry), "met")
    while True:
        sets = held.groupBy("event_no").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
        done = staged(_applied(texts.join(sets, "event_no"), shared), "replaced")
        fresh = done.where(F.size("fresh") > 0).select("event_no", F.explode("fresh").alias("key"))
        if fresh.isEmpty():
            return done.select("event_no", "text")
        more = staged(staged(fresh, "keys").join(entries, "key").select("event_no", entry), "met")
        if more.isEmpty():
            return done.select("event_no", "text")
        held = staged(held.unionByName(more), "met")
