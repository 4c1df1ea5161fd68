"""Candidates of many texts at once: each rule runs over joined texts, and what it finds stays columns.

A rule spends its time on places where it can't begin. So in ASCII texts it is only tried where one of
its beginnings stands (``rules.STARTS``), which the pattern engine looks for fast; rules for either case run over the
lower case, which in ASCII has the same places. Texts are joined by NUL, which no match but a URL's can hold and
which bounds words as the end of a text does; rules without such beginnings (URLs, email) run over one text at
a time. Other texts take the plain way of ``detect.candidates``. Results are the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .detect import WINDOW, candidates, candidates_of
from .rules import RULES, STARTS

#: Characters of joined texts, and bytes of texts read from Arrow at once.
RUN, SLICE = 1 << 16, 1 << 22
_CATEGORY, _REASON = pa.array([r.category for r in RULES]), pa.array([r.reason for r in RULES])
_CONFIDENCE = pa.array([r.confidence for r in RULES], pa.float64())
FIELDS = [("category", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64()), ("reason", pa.string()), ("detector", pa.string())]


def _quick(number: int) -> tuple[re.Pattern, bool] | None:
    """A rule's pattern, tried only where it can begin, and whether it reads the lower case: group 1 is the value. Matches of the quick pattern are as wide as a beginning, so they may overlap."""
    if STARTS[number] is None:
        return None
    starts, width = STARTS[number]
    pattern, lower = RULES[number].pattern.pattern, bool(RULES[number].pattern.flags & re.I)
    return re.compile(rf"(?:{starts})(?<=(?={pattern.lower() if lower else pattern})[\s\S]{{{width}}})"), lower


_QUICK = [_quick(r.number) for r in RULES]
#: Whether a rule's category has several rules: of equal spans the first one's stays.
_SEVERAL = [sum(x.category == r.category for x in RULES) > 1 for r in RULES]


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Text, rule, start, end and value of the settled candidates of ASCII texts, in order."""
    text = "\0".join(texts)
    low = text.lower()
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    digit = any(d in text for d in "0123456789")
    hits: list[tuple] = []
    seen: set[tuple] = set()
    for rule, quick in zip(RULES, _QUICK, strict=True):
        if not (any(w in low for w in rule.words) if rule.words else digit):
            continue
        if quick is None:
            places = [(m.start(1) + at, m.end(1) + at) for i, at in enumerate(begins[:-1].tolist()) if any(w in low[at : at + len(texts[i])] for w in rule.words) for m in rule.pattern.finditer(texts[i])]
        else:
            places, upto = [], 0
            for m in quick[0].finditer(low if quick[1] else text):
                if m.start() >= upto:
                    places.append(m.span(1))
                    upto = m.end(1)
        if _SEVERAL[rule.number]:
            places = [p for p in places if (rule.category, *p) not in seen]
            seen.update((rule.category, *p) for p in places)
        hits += [(start, -rule.confidence, -end, rule.category, rule.number) for start, end in places]
    hits.sort()
    kept, upto = [], -1
    for h in hits:
        if h[0] >= upto:
            kept.append(h)
            upto = -h[2]
    start, end = np.array([h[0] for h in kept], np.int64), np.array([-h[2] for h in kept], np.int64)
    owner = np.searchsorted(begins, start, "right") - 1
    return owner, np.array([h[4] for h in kept], np.int64), start - begins[owner], end - begins[owner], [text[h[0] : -h[2]] for h in kept]


def found_in(texts: list[str | pa.Buffer | None], engine: object = None) -> tuple[np.ndarray, pa.StructArray]:
    """The number of the text of each candidate, rising, and the candidates. Long texts may come as buffers of UTF-8."""
    runs: list[tuple] = []
    group: list[int] = []
    others: list[tuple[int, dict]] = []
    size = 0

    def flush() -> None:
        if group:
            owner, *rest = _joined([texts[i] for i in group])
            runs.append((np.array(group, np.int64)[owner], *rest))
            group.clear()

    for i, t in enumerate(texts):
        if not t:
            continue
        if engine is None and isinstance(t, str) and t.isascii():
            if size + len(t) > RUN:
                flush()
                size = 0
            group.append(i)
            size += len(t)
        else:
            others += [(i, c) for c in (candidates_of(t, engine) if isinstance(t, str) else candidates(t, engine))]
    flush()
    columns = [np.concatenate([r[k] for r in runs]) if runs else np.zeros(0, np.int64) for k in range(4)]
    owner, rule = columns[0], pa.array(columns[1])
    values = [v for r in runs for v in r[4]]
    arrays = [_CATEGORY.take(rule), pa.array(values, pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), _CONFIDENCE.take(rule), _REASON.take(rule), pa.array(["regex"]).take(pa.array(np.zeros(len(owner), np.int64)))]
    if others:
        owner = np.concatenate([owner, np.array([i for i, _ in others], np.int64)])
        order = np.argsort(owner, kind="stable")
        arrays = [pa.concat_arrays([a, pa.array([c[name] for _, c in others], kind)]).take(pa.array(order)) for a, (name, kind) in zip(arrays, FIELDS, strict=True)]
        owner = owner[order]
    return owner, pa.StructArray.from_arrays(arrays, names=[n for n, _ in FIELDS])


def lists_of(owner: np.ndarray, rows: pa.Array, n: int) -> pa.ListArray:
    """n lists of the rows by their rising owners."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), rows)


def read(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str | pa.Buffer | None]]]:
    """Slices of a batch with their texts; texts longer than a window stay buffers."""
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        part = texts.slice(at, upto - at)
        if int(sizes[at:upto].max()) > WINDOW:
            own = [v.as_buffer() if s > WINDOW else v.as_py() for v, s in zip(part, sizes[at:upto].tolist(), strict=True)]
        else:
            own = part.to_pylist()
        yield batch.slice(at, upto - at), own
        at = upto
