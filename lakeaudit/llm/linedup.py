"""Line dedup by content-defined line chunks, in DataFrame operations only.

A text's lines are hashed; a rolling hash over the last ``WINDOW`` line hashes
ends a chunk where it is divisible by ``MODULUS``, so boundaries depend on nearby
lines alone and move with them. Chunks of several lines that occur more than once
in the table are removed but for the first occurrence (by doc_id, then position),
after the bytes of all occurrences were compared. Boundaries cut through a passage's
first and last lines, so a removed chunk is a seed: the removal extends over the
neighbouring lines that equal those around the first occurrence, line by line back
through the chunk before and on through the chunk after it (a neighbour that is
equal as a whole and has several lines is a seed itself). An extension stays clear
of its own first occurrence. Each removed line equals an earlier one, so the first
occurrence of everything stays.

A passage of few lines may have no whole chunk. With ``spans``, those of over
``LONG`` words are also found without boundaries and counted apart: a span is a
shortest run of whole lines of over ``LONG`` words, from
each line on and back from each line. Every run of over ``LONG`` words is covered
by its spans, and two equal runs have equal spans, so removing all spans that
occur before removes all such runs. Spans meet by SHA-256 of their bytes. One that
overlaps its own first occurrence stays.

One pass over the texts finds all chunks and spans and writes their places and
hashes; only texts that hold a repeated chunk are read again, for its bytes and for
digests of the lines around it, which meet those of the first occurrence. All
joins are merge joins at every size: their small sides grow with the table. Hashes
are counted with partial aggregation, so a chunk that a third of all documents
hold stays one row per task.

Defined results: n_removed counts the chunks that lost a line, n_seed_lines the lines
removed from seeds on, n_span_lines those that spans alone remove; null text stays null; a text whose chunks all go becomes empty;
rows with equal doc_id and text count as one document; chunks of equal hash but
different bytes stay; an empty table gives an empty table. Extra columns pass
through, but for those named like a result column; other names never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, shielded

MODULUS, WINDOW = 4, 3
LONG = 50
RESULTS = ("n_chunks", "n_removed", "n_seed_lines", "n_span_lines")
WORD = "[^\\x20\\x09-\\x0D]+"
FIRST, LAST = "shiftright({0}, 32)", "({0} & 4294967295)"
_HASH = "transform(ls, l -> cast(conv(substr(md5(l), 1, 8), 16, 10) as bigint))"
_ROLLED = " + ".join(f"{31**g} * if(i < {g}, 0, h[greatest(i - {g}, 0)])" for g in range(WINDOW))
#: Numbers of the last line of each chunk; ls and h are lambda variables.
_ENDS = f"filter(sequence(0, size(ls) - 1), i -> i = size(ls) - 1 or ({_ROLLED}) % {MODULUS} = 0)"


def _packed(first: str, last: str) -> str:
    return f"shiftleft(cast({first} as bigint), 32) + {last}"


def _let(name: str, value: str, body: str) -> str:
    """body with name bound to value, which is computed once wherever the optimiser puts the expression."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _body(w: str) -> str:
    return f"array_join(slice(ls, cast({FIRST.format(w)} as int) + 1, cast({LAST.format(w)} - {FIRST.format(w)} as int) + 1), '\\n')"


def _places(text: str) -> Column:
    """Place, neighbourhood (first line of the chunk before, last of that after) and hash of each chunk of several lines, place and hash of each span. of holds the line of each word."""
    around = _packed("if(j < 2, 0, ends[j - 2] + 1)", "if(j + 1 < size(ends), ends[j + 1], e)")
    chunks = f"filter(transform(ends, (e, j) -> named_struct('at', {_packed('if(j = 0, 0, ends[j - 1] + 1)', 'e')}, 'around', {around})), c -> {FIRST.format('c.at')} < {LAST.format('c.at')})"
    many = f"if(size(of) > {LONG}, sequence({LONG}, size(of) - 1), cast(array() as array<int>))"
    edge = f"k = {LONG} or of[k - {LONG}] <> of[k - {LONG + 1}] or k = size(of) - 1 or of[k] <> of[k + 1]"
    spans = f"array_distinct(transform(filter({many}, k -> {edge}), k -> {_packed(f'of[k - {LONG}]', 'of[k]')}))"
    pattern = WORD.replace("\\", "\\\\")
    found = f"""named_struct(
      'chunks', transform({chunks}, c -> named_struct('at', c.at, 'around', c.around, 'h', unhex(md5({_body('c.at')})))),
      'spans', {_let('of', f"flatten(transform(ls, (l, i) -> array_repeat(i, regexp_count(l, '{pattern}'))))", f"transform({spans}, w -> named_struct('at', w, 'h', unhex(sha2({_body('w')}, 256))))")})"""
    return F.expr(_let("ls", f"split({text}, '\\n', -1)", _let("h", _HASH, _let("ends", _ENDS, found))))


def _row(key: str, text: str) -> Column:
    return F.concat(F.hex(F.xxhash64(F.col(key), F.col(text))), F.hex(F.hash(F.col(text), F.col(key))))


def _again(found: DataFrame) -> DataFrame:
    """(h, first) of the hashes that occur in more than one place."""
    first = F.min(F.struct("__id", "__row", "at")).alias("first")
    return found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1").select("h", "first")


def _common(own: str, first: str) -> str:
    """How many leading members two arrays share."""
    differ = f"array_position(zip_with({own}, {first}, (x, y) -> x <=> y), false)"
    return f"if({differ} = 0, size({own}), cast({differ} as int) - 1)"


def _seeds(rows: DataFrame, met: DataFrame, text: str) -> DataFrame:
    """(__row, at): chunks that occur before with the same bytes, extended by the lines that also equal those around the first occurrence."""
    chunk = F.struct("at", "around", "h", F.col("first.__row").alias("frow"), F.col("first.at").alias("fat"))
    holders = met.groupBy("__row").agg(F.collect_set(chunk).alias("cs"))
    first, last = FIRST.format("c.at"), LAST.format("c.at")
    low, high = FIRST.format("c.around"), LAST.format("c.around")
    before = f"reverse(slice(digests, cast({low} as int) + 1, cast({first} - {low} as int)))"
    after = f"slice(digests, cast({last} as int) + 2, cast({high} - {last} as int))"
    found = f"transform(cs, c -> named_struct('h', c.h, 'at', c.at, 'frow', c.frow, 'fat', c.fat, 'body', {_body('c.at')}, 'before', {before}, 'after', {after}))"
    found = _let("ls", f"split({text}, '\\n', -1)", _let("digests", "transform(ls, l -> unhex(md5(l)))", found))
    around = rows.select("__row", text).join(holders.hint("merge"), "__row").select("__row", F.explode(F.expr(found)).alias("c"))
    around = materialise(around.select("__row", "c.*"), "around")
    differ = around.groupBy("h").agg(F.min("body").alias("low"), F.max("body").alias("high")).where("low <> high").select("h")
    differ = materialise(differ, "differ")
    own = "(frow = __row and fat = at)"
    # equal rows of the table show their chunks once each
    firsts = around.where(own).groupBy("h").agg(F.first("before").alias("fbefore"), F.first("after").alias("fafter"))
    # written, so that the planner can split the places of a hash that many texts hold where they join
    firsts = materialise(firsts.join(differ.hint("merge"), "h", "left_anti"), "firsts")
    later = around.where(f"not {own}").select("h", "__row", "at", "frow", "fat", "before", "after").join(firsts.hint("merge"), "h")
    back, on = (F.expr(_common(c, f"f{c}")) for c in ("before", "after"))
    free = F.expr(f"cast({FIRST.format('at')} - {LAST.format('fat')} as int) - 1")
    later = later.withColumn("back", F.when(F.expr("frow = __row"), F.least(back, free)).otherwise(back)).withColumn("on", on)
    seeds = later.selectExpr("__row", f"{_packed(FIRST.format('at') + ' - back', LAST.format('at') + ' + on')} as at")
    seeds = materialise(seeds, "seeds")
    discard(around, differ, firsts)
    return seeds


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", spans: bool = True) -> DataFrame:
    """docs with the remaining text, n_chunks, n_removed, n_seed_lines and n_span_lines."""
    docs = docs.drop(*RESULTS)
    rows, restore = shielded(docs)
    key, text = (f"__x{docs.columns.index(c)}" for c in (key, text))
    rows = rows.withColumn("__row", _row(key, text))
    facts = rows.where(F.col(text).isNotNull()).select("__row", F.col(key).cast("long").alias("__id"), _places(text).alias("f"))
    kinds = ("chunks", "spans") if spans else ("chunks",)
    facts = materialise(facts.select("__row", "__id", *[f"f.{c}" for c in kinds]), "places")
    each = {c: facts.select("__row", "__id", F.explode(c).alias("c")).select("__row", "__id", "c.*") for c in kinds}
    # written before they join, so that the planner can split the places of a hash that many texts hold
    again = {c: materialise(_again(each[c]), "again") for c in kinds}
    met = {c: materialise(each[c].join(again[c].hint("merge"), "h"), c) for c in kinds}
    seeds = _seeds(rows, met["chunks"], text)
    gone = seeds.select("__row", F.col("at").alias("seed"), F.lit(None).cast("long").alias("span"))
    if spans:
        later = met["spans"].where(f"not (first.__row = __row and {FIRST.format('at')} <= {LAST.format('first.at')})")
        gone = gone.union(later.select("__row", F.lit(None).cast("long"), "at"))
    gone = materialise(gone.groupBy("__row").agg(F.collect_set("seed").alias("__seeds"), F.collect_set("span").alias("__spans")), "gone")
    discard(facts, seeds, *again.values(), *met.values())
    rows = rows.join(gone.hint("merge"), "__row", "left")
    lines = "array_distinct(flatten(transform({0}, w -> sequence(cast(" + FIRST.format("w") + " as int), cast(" + LAST.format("w") + " as int)))))"
    kept = "array_join(transform(array_except(sequence(0, size(ls) - 1), lines), i -> ls[i]), '\\n')"
    chunk = "flatten(transform(ends, (e, j) -> array_repeat(j, e - if(j = 0, -1, ends[j - 1]))))"
    lost = _let("of", chunk, "size(array_distinct(transform(lines, i -> of[i])))")
    done = f"named_struct('n', size(ends), 'lost', {lost}, 'seeds', size(own), 'spans', size(lines) - size(own), 'text', {kept})"
    done = _let("own", lines.format("__seeds"), _let("lines", f"array_union(own, {lines.format('__spans')})", done))
    done = f"if(__seeds is null, named_struct('n', size(ends), 'lost', 0, 'seeds', 0, 'spans', 0, 'text', {text}), {done})"
    done = _let("ls", f"split({text}, '\\n', -1)", _let("h", _HASH, _let("ends", _ENDS, done)))
    rows = rows.withColumn("__done", F.when(F.col(text).isNotNull(), F.expr(done))).withColumn(text, F.col("__done.text"))
    counts = [F.coalesce(F.col(f"__done.{c}"), F.lit(0)).cast("long").alias(r) for c, r in zip(("n", "lost", "seeds", "spans"), RESULTS, strict=True)]
    return rows.select(*restore, *counts)


def _sql_common(own: str, first: str) -> str:
    return f"coalesce(nullif(list_position(list_transform(range(1, greatest(len({own}), len({first})) + 1), lambda i: {own}[i] is not distinct from {first}[i]), false), 0) - 1, len({own}))"


_SQL_ROLLED = " + ".join(f"{31**g} * (case when i < {g} then 0 else h[i + 1 - {g}] end)" for g in range(WINDOW))
ORACLE = f"""
with lines as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
hashed as (select *, list_transform(ls, lambda l: cast('0x' || substr(md5(l), 1, 8) as bigint)) as h, list_transform(ls, lambda l: len(regexp_extract_all(l, '{WORD}'))) as ws from lines),
ended as (select *, list_filter(range(len(ls)), lambda i: i = len(ls) - 1 or ({_SQL_ROLLED}) % {MODULUS} = 0) as ends from hashed),
cut as (select doc_id, ls, unnest(range(len(ends))) as j, ends from ended),
chunks as (select doc_id, j, case when j = 0 then 0 else ends[j] + 1 end as a, ends[j + 1] as z, case when j < 2 then 0 else ends[j - 1] + 1 end as low, coalesce(ends[j + 2], ends[j + 1]) as high, ls from cut),
counted as (select doc_id, ls, unnest(ws) as w, unnest(range(len(ls))) as i from hashed),
summed as (select doc_id, ls, w, i, sum(w) over (partition by doc_id order by i) as upto from counted),
worded as (select * from summed where w > 0),
spans as (select distinct x.doc_id, x.i as a, y.i as z, x.ls from worded x join worded y on x.doc_id = y.doc_id and x.i <= y.i
  and y.upto - x.upto + x.w > {LONG} and (y.upto - y.w - x.upto + x.w <= {LONG} or y.upto - x.upto <= {LONG})),
pieces as (select doc_id, a, z, 'chunk' as kind, array_to_string(ls[a + 1:z + 1], chr(10)) as body, list_reverse(ls[low + 1:a]) as before, ls[z + 2:high + 1] as after from chunks where z > a
  union all select doc_id, a, z, 'span', array_to_string(ls[a + 1:z + 1], chr(10)), null, null from spans),
ranked as (select *, first_value(doc_id) over same as d, first_value(a) over same as fa, first_value(z) over same as fz, first_value(before) over same as fbefore, first_value(after) over same as fafter
  from pieces window same as (partition by kind, body order by doc_id, a, z)),
later as (select *, {_sql_common('before', 'fbefore')} as back, {_sql_common('after', 'fafter')} as more from ranked where not (doc_id = d and case kind when 'chunk' then a = fa and z = fz else a <= fz end)),
reach as (select doc_id, kind, case kind when 'span' then a else a - case when doc_id = d then least(back, a - fz - 1) else back end end as a, case kind when 'span' then z else z + more end as z from later),
hit as (select doc_id, kind, unnest(range(a, z + 1)) as i from reach),
gone as (select doc_id, i, bool_or(kind = 'chunk') as seed from hit group by doc_id, i),
tally as (select doc_id, count(*) filter (where seed) as seeds, count(*) filter (where not seed) as spans from gone group by doc_id),
lost as (select c.doc_id, count(distinct c.j) as n from chunks c join gone g on g.doc_id = c.doc_id and g.i between c.a and c.z group by c.doc_id),
kept as (select n.doc_id, string_agg(n.ls[n.i + 1], chr(10) order by n.i) as text from counted n left join gone g on g.doc_id = n.doc_id and g.i = n.i where g.i is null group by n.doc_id)
select e.doc_id, coalesce(cast(len(e.ends) as bigint), 0) as n_chunks, coalesce(lost.n, 0) as n_removed, coalesce(tally.seeds, 0) as n_seed_lines, coalesce(tally.spans, 0) as n_span_lines, case when e.text is not null then coalesce(kept.text, '') end as text
from ended e left join lost on lost.doc_id = e.doc_id left join kept on kept.doc_id = e.doc_id left join tally on tally.doc_id = e.doc_id
"""
