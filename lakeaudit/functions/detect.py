"""Candidate detection: spans found and overlaps settled in one pass over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .rules import NER_CATEGORIES, RULES

RAW = "array<struct<category:string,value:string,start:int,end:int,confidence:double,reason:string,detector:string>>"
#: Characters that match ASCII letters in either case but whose lower case is another: no keyword guard then.
_ODD = frozenset("ſıİK")


def spans(text: str) -> list[dict]:
    """All rule matches of a text; of equal spans of one category the first rule's stays."""
    low, digit, odd = text.lower(), any(c.isdigit() for c in text), not _ODD.isdisjoint(text)
    found: dict[tuple, dict] = {}
    for rule in RULES:
        if not (odd or (any(w in low for w in rule.words) if rule.words else digit)):
            continue
        for m in rule.pattern.finditer(text):
            start, end = m.span(1)
            found.setdefault((rule.category, start, end), {"category": rule.category, "value": m[1], "start": start, "end": end, "confidence": rule.confidence, "reason": rule.reason, "detector": "regex"})
    return list(found.values())


#: Bytes from which a text is read in pieces.
WINDOW = 1 << 20
#: Where no match can go on: a blank is in no URL, and these signs are in no other match; neither side holds a letter or digit that a rule looks at.
_SEAM = re.compile(rb"""[;!?|*"<>{}\[\]&$^~`\\][ \t\r\n]|[ \t\r\n][;!?|*"<>{}\[\]&$^~`\\]""")


def pieces(body: memoryview, window: int) -> Iterator[str]:
    """The UTF-8 text cut at seams, each piece ending at the first seam after window bytes."""
    at = 0
    while at < len(body):
        seam = _SEAM.search(body, at + window)
        end = seam.start() + 1 if seam else len(body)
        yield str(body[at:end], "utf-8")
        at = end


def spans_in_pieces(body: memoryview, window: int) -> list[dict]:
    """The settled rule matches of a text of any length, a piece at a time.

    A match lies within one piece, so overlaps are settled there and only places are moved; nothing
    but the matches is held for more than a piece. Between seams a piece is as long as it has to be.
    """
    out, at = [], 0
    for piece in pieces(body, window):
        out += [c | {"start": c["start"] + at, "end": c["end"] + at} for c in settled(spans(piece))]
        at += len(piece)
    return out


def ner_spans(text: str, results: list) -> list[dict]:
    """Spans of an entity recogniser: known entities with sound bounds, trimmed."""
    out = []
    for r in results:
        category, start, end = NER_CATEGORIES.get(r.entity_type), int(r.start), int(r.end)
        if category is None or start < 0 or end > len(text) or start >= end:
            continue
        value = text[start:end]
        start += len(value) - len(value.lstrip())
        end -= len(value) - len(value.rstrip())
        if start < end:
            out.append({"category": category, "value": text[start:end], "start": start, "end": end, "confidence": float(getattr(r, "score", 0.5)), "reason": f"Detected by Presidio {r.entity_type} recognizer.", "detector": "presidio"})
    return out


def candidates_of(text: str, engine: object = None) -> list[dict]:
    """The settled candidates of a text, of rules and of a recogniser."""
    return settled(spans(text) + (ner_spans(text, engine.analyze(text=text, language="en", entities=list(NER_CATEGORIES))) if engine else []))


def candidates(body: pa.Buffer | None, engine: object = None) -> list[dict]:
    """The settled candidates of a text in UTF-8; null: none. A recogniser has to see long texts whole, rules read them in pieces."""
    if body is None:
        return []
    return spans_in_pieces(memoryview(body), WINDOW) if engine is None and body.size > WINDOW else candidates_of(str(body, "utf-8"), engine)


def detect(df: DataFrame, text: str = "content", out: str = "candidates", analyzer: Callable[[], object] | None = None) -> DataFrame:
    """df with the candidates of a text column, in order of their place; analyzer: makes an entity recogniser once in each worker. Null text: none.

    Long texts are read in pieces, unless a recogniser has to see them whole.
    """
    from . import bulk  # which builds on this module

    schema = T.StructType([*df.schema.fields, T.StructField(out, T._parse_datatype_string(RAW))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = analyzer() if analyzer else None
        for b in batches:
            for part, texts in bulk.read(b, text):
                found = bulk.lists_of(*bulk.found_in(texts, engine), part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


def settled(found: list[dict]) -> list[dict]:
    """Greedy selection without overlaps: earliest start first, then rules before recognisers, confidence, length, category."""
    found = sorted(found, key=lambda c: (c["start"], c["detector"] != "regex", -c["confidence"], c["start"] - c["end"], c["category"]))
    kept, upto = [], -1
    for c in found:
        if c["start"] >= upto:
            kept.append(c)
            upto = c["end"]
    return kept
