"""Quality rules: a table of thresholds compiled into one Spark projection.

A rule compares one measure of a text with a share of another (or with a number):
``100 * measure`` against ``percent * base``, in whole numbers, so Spark and SQL agree
to the last row. ``measured`` makes the measures, each once; ``failures`` compiles the
table into one column. All of it is built-in expressions; nothing is shuffled.

Words are runs of characters other than blank, tab, line feed, vertical tab, form
feed and carriage return; lines are split at line feeds, and only those with a word count.
Defined results: a null text counts as an empty one, which has no words and fails
``too_few_words``; a ratio over no lines never fails. Very long texts are read whole
(sorting their word triples takes n log n steps). Repeated rows and ids are
scored one by one. Every column of the input passes through, whatever its name: the
measures are made beside a reserved copy of the text, and a measure whose name
the input already has is returned in place of that column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shielded


class Rule(NamedTuple):
    """Fails where measure is over (or under) percent hundredths of base; without a base, over (or under) the number itself."""

    name: str
    measure: str
    sign: str
    percent: int
    base: str | None = None


#: The rules that make up base_failed. Further ones are wide where a share is coarse: of three lines one that repeats is a third.
BASE = (Rule("too_few_words", "n_words", "<", 50), Rule("repeated_words", "n_repeat_words", ">", 50, "n_words"))
TABLE = (
    *BASE,
    Rule("short_words", "word_chars", "<", 300, "n_words"),
    Rule("long_words", "word_chars", ">", 1000, "n_words"),
    Rule("symbols", "n_symbols", ">", 10, "n_words"),
    Rule("few_stop_words", "n_stop_words", "<", 5, "n_words"),
    Rule("repeated_lines", "n_dup_lines", ">", 50, "n_lines"),
    Rule("bullets", "n_bullet_lines", ">", 90, "n_lines"),
    Rule("ellipses", "n_ellipsis_lines", ">", 30, "n_lines"),
)
#: Function words of the four languages of the corpus; another corpus passes its own.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "ce", "dans", "de", "du", "en", "est", "et", "il", "la", "le", "les", "ne", "pas", "pour", "que", "qui", "un", "une",
    "con", "del", "el", "es", "las", "lo", "los", "no", "por", "se", "su", "una", "y",
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\f\r"
BULLETS, ELLIPSES, EDGES = ("-", "*", "•"), ("...", "…"), " \t\r"
#: Bits of a sort key that hold the place of a word triple; the others hold its hash. Longer texts compare strings from the start.
PLACE = 24


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _triples(words: Column, n: Column) -> Column:
    """Sorted keys of the word triples: hash above, place below."""
    key = lambda i: F.shiftleft(F.shiftright(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), PLACE), PLACE).bitwiseOR(i.cast("long"))
    return F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), key))).otherwise(F.array().cast("array<bigint>"))


def _spread(starts: Column) -> Column:
    """Number of words that triples at these places cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))


def _top(key: Column) -> Column:
    return F.shiftright(key, PLACE)


def _place(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")


def _pairs(keys: Column) -> Column:
    """Places in the sorted keys where two neighbours have one hash."""
    return F.filter(F.transform(keys, lambda k, i: F.when(_top(F.get(keys, i + 1)) == _top(k), i)), lambda i: i.isNotNull())


def _hits(words: Column, keys: Column, pairs: Column) -> Column:
    """(one, two, same): the places of both triples of a pair, and whether their words are equal."""
    triple = lambda k: F.slice(words, _place(k) + 1, 3)
    return F.transform(pairs, lambda i: F.struct(_place(F.get(keys, i)).alias("one"), _place(F.get(keys, i + 1)).alias("two"), (triple(F.get(keys, i)) == triple(F.get(keys, i + 1))).alias("same")))


def _by_text(words: Column, n: Column) -> Column:
    """Places of the triples that occur again, by their text."""
    rows = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, 3)).alias("g"), i.alias("i"))))
    found = F.filter(F.transform(F.array(rows), lambda t: F.filter(t, lambda x, i: F.coalesce(F.get(t, i - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(t, i + 1)["g"] == x["g"], F.lit(False)))), lambda t: F.lit(True))
    return F.transform(F.get(found, 0), lambda x: x["i"])


def _repeated(words: Column, n: Column, hits: Column) -> Column:
    """Words in triples that occur again. Where two texts met in one hash, or places don't fit, the texts themselves are sorted."""
    sound = (n < (1 << PLACE)) & F.forall(hits, lambda x: x["same"])
    return F.when(F.size(hits) == 0, F.lit(0)).when(sound, _spread(F.flatten(F.transform(hits, lambda x: F.array(x["one"], x["two"]))))).otherwise(_spread(_by_text(words, n)))


def _measures(text: Column, words: Column, lines: Column, hits: Column, stop_words: Sequence[str]) -> list[Column]:
    """The columns of MEASURES over a text, its words, its lines and its shared triples."""
    one_of = lambda tests: reduce(lambda a, b: a | b, tests)
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(_without(text, BLANKS)),
        "n_symbols": F.length(text) - F.length(_without(text, SYMBOLS)),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeated(words, F.size(words), hits),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*stop_words))),
        "n_lines": F.size(lines),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: one_of([F.ltrim(x, F.lit(EDGES)).startswith(b) for b in BULLETS]))),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: one_of([F.rtrim(x, F.lit(EDGES)).endswith(e) for e in ELLIPSES]))),
    }
    return [counts[m].cast("long").alias(m) for m in MEASURES]


def measured(docs: DataFrame, text: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """docs with the measures of a text column."""
    rows, own = shielded(docs)
    kept = [c for c, n in zip(own, docs.columns, strict=True) if n not in MEASURES]
    body = F.coalesce(F.col(f"__x{docs.columns.index(text)}"), F.lit(""))
    parts = rows.select("*", body.alias("__t"), F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("__w"), F.filter(F.split(body, "\n"), lambda x: _without(x, BLANKS) != "").alias("__l"))
    parts = parts.withColumn("__k", _triples(F.col("__w"), F.size("__w"))).withColumn("__p", _pairs(F.col("__k"))).withColumn("__h", _hits(F.col("__w"), F.col("__k"), F.col("__p")))
    return parts.select(*kept, *_measures(F.col("__t"), F.col("__w"), F.col("__l"), F.col("__h"), stop_words))


def failed(rule: Rule) -> Column:
    left, right = (F.col(rule.measure), F.lit(rule.percent)) if rule.base is None else (F.col(rule.measure) * 100, F.col(rule.base) * rule.percent)
    return {"<": left < right, ">": left > right}[rule.sign]


def failures(table: Sequence[Rule] = TABLE) -> Column:
    """Names of the rules that a measured row fails, in the table's order."""
    return F.array_compact(F.array(*[F.when(failed(r), F.lit(r.name)) for r in table]))


def judge(docs: DataFrame, table: Sequence[Rule] = TABLE, *, text: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """docs with the measures, base_failed, failed_rules and kept (no rule of the table or of BASE fails)."""
    bad = [failed(r) for r in dict.fromkeys([*BASE, *table])]
    base, any_ = bad[0] | bad[1], bad[0]
    for b in bad[1:]:
        any_ = any_ | b
    rows = measured(docs, text, stop_words)
    new = {"base_failed": base, "failed_rules": failures(table), "kept": ~any_}
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in new], *[c.alias(n) for n, c in new.items()])


def _sql(rule: Rule) -> str:
    return f"{rule.measure} {rule.sign} {rule.percent}" if rule.base is None else f"100 * {rule.measure} {rule.sign} {rule.percent} * {rule.base}"


_IN = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE = rf"""
with t as (select row_number() over () as id, doc_id, coalesce(text, '') as text from documents),
b as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
g as (select id, unnest(range(len(w) - 2)) as i, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) as g from b where len(w) >= 3),
again as (select id, i from (select id, i, count(*) over (partition by id, g) as n from g) where n > 1),
r as (select id, count(distinct i + k) as n from again, range(3) as o(k) group by id),
m as (select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words, len(list_filter(w, lambda x: lower(x) in ({_IN})))::bigint as n_stop_words,
  len(l)::bigint as n_lines, len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\t\r]*[-*•]')))::bigint as n_bullet_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\t\r]*$')))::bigint as n_ellipsis_lines from b left join r on r.id = b.id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({' or '.join(_sql(r) for r in BASE)}) as base_failed, not ({' or '.join(_sql(r) for r in TABLE)}) as kept from m
"""
