"""Content segments: the scalar leaves of JSON content with their paths, or the whole text."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bulk
from ..functions.detect import WINDOW
from ..functions.stage import spread


def leaves(content: str) -> list[tuple[str | None, str]]:
    """(path, text) in document order."""
    body = content.strip()
    whole = [(None, content)]
    if body[:1] not in ("{", "["):
        return whole
    try:
        root = json.loads(body)
    except (ValueError, RecursionError):
        return whole
    out, stack = [], [("$", root)]
    while stack:
        path, x = stack.pop()
        if isinstance(x, dict):
            stack += [(f"{path}.{k}", v) for k, v in reversed(x.items())]
        elif isinstance(x, list):
            stack += [(f"{path}[{i}]", x[i]) for i in range(len(x) - 1, -1, -1)]
        elif x is not None and str(x):
            out.append((path, str(x)))
    return out or whole


def segments(events: DataFrame, content: str = "content") -> DataFrame:
    """One row for each segment: the event's columns, seg_no, content_path and text. Null content: none."""
    schema = T.StructType([*events.schema.fields, T.StructField("__s", T._parse_datatype_string("array<struct<path:string,text:string>>"))])
    kind = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [[] if c is None else [{"path": p, "text": t} for p, t in leaves(c)] for c in b.column(content).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, kind)], names=[*b.schema.names, "__s"])

    out = spread(events).mapInArrow(run, schema)
    return out.select(*events.columns, F.posexplode("__s").alias("seg_no", "s")).select(*events.columns, "seg_no", F.col("s.path").alias("content_path"), F.col("s.text").alias("text"))


FOUND = "array<struct<seg_no:int,content_path:string,category:string,value:string,start:int,end:int,confidence:double,reason:string,detector:string>>"


def segment_candidates(events: DataFrame, content: str = "content", analyzer: Callable[[], object] | None = None, *, cuts: np.ndarray | None = None, raw: bool = False, fields: Sequence[str] | None = None) -> DataFrame:
    """events without their content, with found: the candidates of all segments, in order. One pass, and segments without candidates never leave it.

    cuts: a column part, the number of cuts below event_no. raw: a column raw, the categories of the candidates in the content as a whole.
    fields: those of the candidates' fields that are wanted, in the order of FOUND; no others leave the pass.
    """
    kept = [c for c in events.columns if c != content]
    of = T._parse_datatype_string(FOUND).elementType
    names = [n for n in of.names if fields is None or n in fields]
    more = [T.StructField("found", T.ArrayType(T.StructType([of[n] for n in names])))]
    more += [T.StructField("part", T.IntegerType())] * (cuts is not None) + [T.StructField("raw", T.ArrayType(T.StringType()))] * raw
    schema = T.StructType([*[events.schema[c] for c in kept], *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = analyzer() if analyzer else None
        for b in batches:
            for part, texts in bulk.read(b, content):
                yield one(part, texts, engine)

    def one(b: pa.RecordBatch, texts: list, engine: object) -> pa.RecordBatch:
        event, number, paths, own = [], [], [], []
        for i, t in enumerate(texts):
            if isinstance(t, pa.Buffer):  # longer than a window: read in pieces, unless it is JSON
                t = str(t, "utf-8") if memoryview(t)[:WINDOW].tobytes().lstrip()[:1] in (b"{", b"[") else t
            cut = [(None, t)] if t is None or isinstance(t, pa.Buffer) else leaves(t)
            event += [i] * len(cut)
            number += range(len(cut))
            paths += [p for p, _ in cut]
            own += [x for _, x in cut]
        owner, found = bulk.found_in(own, engine)
        event, at = np.array(event, np.int64), pa.array(owner)
        own_place = {"seg_no": lambda: pa.array(number, pa.int32()).take(at), "content_path": lambda: pa.array(paths, pa.string()).take(at)}
        rows = pa.StructArray.from_arrays([own_place[n]() if n in own_place else found.field(n) for n in names], names=names)
        new = {"found": bulk.lists_of(event[owner], rows, b.num_rows)}
        if cuts is not None:
            new["part"] = pa.array(np.searchsorted(cuts, pc.fill_null(b.column("event_no"), 0).to_numpy(zero_copy_only=False)), pa.int32())
        if raw:
            # content that is one segment as it stands has its candidates already
            split = np.zeros(b.num_rows, bool)
            split[event[np.array([p is not None for p in paths], bool)]] = True
            other, found_raw = bulk.found_in([t if s else None for t, s in zip(texts, split.tolist(), strict=True)], engine)
            whole = np.flatnonzero(~split[event[owner]])
            owners = np.concatenate([event[owner][whole], other])
            order = np.argsort(owners, kind="stable")
            kinds = pa.concat_arrays([found.field("category").take(pa.array(whole)), found_raw.field("category")])
            new["raw"] = bulk.lists_of(owners[order], kinds.take(pa.array(order)), b.num_rows)
        return pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *new.values()], names=[*kept, *new])

    return spread(events).mapInArrow(run, schema)


def external_path(bases: str = "external_content_paths", path: str = "content_path") -> Column:
    base, p = F.element_at(F.col(bases), 1), F.col(path)
    joined = F.when(p.isNull() | (p == "$"), base).when(p.startswith("$."), F.concat(base, F.lit("."), F.substring(p, 3, 2**30))).when(p.startswith("$["), F.concat(base, F.substring(p, 2, 2**30)))
    return F.when(F.size(bases) == 1, joined)
