"""Secret scan with multipart credential linking, in DataFrame operations only.

Base spans (assignments, access identifiers, hex strings) stand alone. Weak
parts (account identifiers, unlabelled key-like strings, endpoints) are
harmless by themselves and are reported only where complementary parts occur
together: an interval join on (row, cell of ``SCOPE`` characters) pairs
identifiers with secrets that begin at most ``SCOPE`` characters apart; an
endpoint needs such a pair within its own scope. Spans do not overlap within a
kind, so a cell holds a bounded number of parts and so does the join.

Spans come from one split and one extraction for each kind; positions are code
points, ends exclusive. Defined results: null text counts as empty and has no
span; repeated rows stay, each with its own result; an empty table gives an
empty table. Extra columns pass through, but for those named like a result
column (scan; redact has none); other names never clash.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import replaced, running
from .common import materialise, shielded

#: Characters between the parts of one credential.
SCOPE = 400
MARK = "[SECRET]"
#: kind: pattern, group whose length counts, least length, a cheap test
BASE = {
    "assign": ("""((?i:password|passwd|secret|token|api_?key))["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "(?i)passw|secret|token|api_?key"),
    "access": ("AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    "hex": ("[0-9a-f]{24,}+", 0, 24, "[0-9a-f]{24}"),
}
WEAK = {
    "identifier": ("""(?:(?i:client_?id|access_?key_?id|account_?id|user_?name|login)["']?\\x20*[:=]\\x20*["']?[A-Za-z0-9@._-]{3,}|A(?:SIA|IDA|ROA|GPA)[A-Z0-9]{16})""", 0, 1, "(?i)client_?id|access_?key_?id|account_?id|user_?name|login|ASIA|AIDA|AROA|AGPA"),
    "key": ("(?<![A-Za-z0-9/+=_-])(?=[A-Za-z0-9/+]{0,39}[0-9])(?=[A-Za-z0-9/+]{0,39}[A-Z])(?=[A-Za-z0-9/+]{0,39}[a-z])[A-Za-z0-9/+]{40}={0,2}(?![A-Za-z0-9/+=_-])", 0, 1, "[A-Za-z0-9/+]{40}"),
    "endpoint": ("(?i:https?|s3|ftp|jdbc:[a-z]+|amqps?|rediss?|mongodb(?:\\\\+srv)?|postgres(?:ql)?|mysql)://[^\\x20\\t\\r\\n\"'<>)\\\\]]+".replace("\\\\", "\\"), 0, 1, "://"),
}
ORDER = {"assign": 0, "access": 1, "hex": 2, "identifier": 3, "key": 4, "endpoint": 5}
_SPAN = "struct<start:int,ord:int,kind:string,end:int,value:string>"
RESULTS = ("n_assign", "n_access", "n_hex", "base", "found")


def _spans(docs: DataFrame, kind: str, spec: tuple, text: str) -> DataFrame:
    """docs with the spans of a kind as __<kind>: matches from one extraction, places from one split."""
    pattern, group, least, test = spec
    body = F.when(F.col(text).rlike(test), F.col(text))
    docs = docs.withColumn("__b", body)
    docs = docs.withColumn("__m", F.regexp_extract_all("__b", F.lit(pattern), F.lit(0))).withColumn("__g", F.split("__b", pattern, -1))
    docs = docs.withColumn("__v", F.regexp_extract_all("__b", F.lit(pattern), F.lit(group)) if group else F.col("__m"))
    empty = F.expr(f"cast(array() as array<{_SPAN}>)")
    # each match ends where the gaps and matches so far do: a running sum, so that thousands of spans don't copy one another
    sizes = F.zip_with("__m", F.slice("__g", F.lit(1), F.size("__m")), lambda m, g: F.length(m) + F.length(g))
    docs = docs.withColumn("__e", F.when(F.size("__m") > 0, running(sizes, lambda x, y: x + y)))
    each = F.transform("__m", lambda m, i: F.struct((F.get("__e", i) - F.length(m)).alias("start"), F.lit(ORDER[kind]).alias("ord"), F.lit(kind).alias("kind"), F.get("__e", i).alias("end"), F.when(F.length(F.get("__v", i)) >= least, m).alias("value")))
    found = F.filter(each, lambda x: x["value"].isNotNull()).cast(f"array<{_SPAN}>")
    return docs.withColumn(f"__{kind}", F.when(F.size("__m") > 0, found).otherwise(empty)).drop("__b", "__m", "__g", "__v", "__e")


def _with_parts(docs: DataFrame, text: str) -> DataFrame:
    docs = functools.reduce(lambda d, k: _spans(d, k, (BASE | WEAK)[k], text), ORDER, docs)
    docs = docs.withColumn("__base", F.array_sort(F.concat("__assign", "__access", "__hex")))
    # a weak part is clear of the base if the base spans before it end in time and the next one begins in time
    some = F.size("__identifier") + F.size("__key") + F.size("__endpoint") > 0
    docs = docs.withColumn("__all", F.when(some, F.array_sort(F.concat("__base", "__identifier", "__key", "__endpoint"))))
    before = running(F.transform("__all", lambda x: F.when(x["ord"] <= 2, x["end"]).otherwise(-1)), F.greatest)
    after = F.reverse(running(F.reverse(F.transform("__all", lambda x: F.when(x["ord"] <= 2, x["start"]).otherwise(2**31 - 1))), F.least))
    docs = docs.withColumn("__before", before).withColumn("__after", after)
    clear = F.filter("__all", lambda x, i: (x["ord"] > 2) & (F.get("__before", i) <= x["start"]) & (F.get("__after", i) >= x["end"]))
    docs = docs.withColumn("__weak", F.when(some, clear).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)")))
    return docs.drop("__identifier", "__key", "__endpoint", "__all", "__before", "__after")


def _linked(parts: DataFrame) -> DataFrame:
    """(row, added): the weak parts whose complements are near. parts: row, base, weak."""
    each = parts.select("row", F.explode(F.concat("base", "weak")).alias("s")).select("row", "s", F.expr(f"s.start div {SCOPE}").alias("cell"))
    ids = each.where("s.kind in ('access', 'identifier')").select("row", "cell", F.col("s").alias("i"))
    keys = each.where("s.kind in ('assign', 'hex', 'key')").select("row", "s", F.explode(F.expr("array(cell - 1, cell, cell + 1)")).alias("cell"))
    pairs = ids.join(keys, ["row", "cell"]).where(f"abs(i.start - s.start) <= {SCOPE} and (i.end <= s.start or s.end <= i.start)")
    ends = each.where("s.kind = 'endpoint'").select("row", F.col("s").alias("e"), F.explode(F.expr("array(cell - 1, cell, cell + 1)")).alias("cell"))
    near = ends.join(pairs.select("row", "cell", "i").distinct(), ["row", "cell"]).where(f"abs(e.start - i.start) <= {SCOPE}")
    hit = pairs.select("row", F.col("i").alias("s")).union(pairs.select("row", "s")).union(near.select("row", F.col("e").alias("s")))
    return hit.where("s.ord > 2").groupBy("row").agg(F.array_sort(F.collect_set("s")).alias("added"))


def _named(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def _scanned(docs: DataFrame, text: str, *, keep: bool) -> DataFrame:
    """docs (keep: with the text) with __assign, __access, __hex, __base, __found; each pattern runs over a text once."""
    parts = _with_parts(docs, text)
    parts = parts if keep else parts.drop(text)
    parts = materialise(parts.withColumn("__row", F.monotonically_increasing_id()), "parts")
    # only rows with weak parts join
    able = parts.where("size(__weak) > 0")
    added = _linked(able.select(F.col("__row").alias("row"), F.col("__base").alias("base"), F.col("__weak").alias("weak")))
    found = able.join(added.withColumnsRenamed({"row": "__row", "added": "__added"}), "__row", "left")
    found = found.withColumn("__found", F.when(F.col("__added").isNull(), F.col("__base")).otherwise(F.array_sort(F.concat("__base", "__added")))).drop("__added")
    return parts.where("size(__weak) = 0").withColumn("__found", F.col("__base")).unionByName(found)


def scan(docs: DataFrame, *, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """columns of docs (all by default) with base and found: arrays of spans (start, kind, end, value), and counts."""
    docs = docs.drop(*RESULTS)
    shown = docs.select(*(docs.columns if columns is None else columns))
    # the scanned text beside the columns to keep
    rows, _ = shielded(docs.select(*[F.col(c).alias(f"{i}") for i, c in enumerate(shown.columns)], F.col(text).alias("body")))
    body = rows.columns[-1]
    out = _scanned(rows, body, keep=False)
    counts = [F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return out.select(*[F.col(f"__x{i}").alias(c) for i, c in enumerate(shown.columns)], *counts, F.col("__base").alias("base"), F.col("__found").alias("found"))


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    return scanned.select(key, "n_assign", "n_access", "n_hex", F.sha2(_named("base"), 256).alias("base_sha256"), _named("found").alias("spans"))


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with every found span replaced by MARK; overlapping spans are replaced as one."""
    rows, restore = shielded(docs)
    at = docs.columns.index(text)
    return replaced(_scanned(rows, f"__x{at}", keep=True), f"__x{at}", "__found", lambda x: F.lit(MARK), f"__x{at}").select(*restore)
