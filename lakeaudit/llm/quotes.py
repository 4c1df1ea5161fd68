"""Chat formatting by quotation linking, in DataFrame operations only.

Lines that begin with ``>`` (nested: ``>>`` or ``> >``) are quotes; a passage is
a run of lines of one level. Passages, and the whole text, paragraphs and lines
that each message says itself, are normalised (lower case, white space
collapsed) and hashed. A passage links to the first message of its conversation
that says it, by an equality join on (conversation, hash); originals are
pre-aggregated to one row for each hash, so a line that everybody repeats joins
once. A message replies to the latest message that its level-1 passages link
to, or else, that deeper ones link to. Reply chains are resolved by pointer
doubling into ``reply_path``, whose order within a conversation is that of the
threads: each reply below what it quotes.

Defined results: null text counts as empty and stays null; messages that quote
nothing known start a thread; quotes of later messages or of oneself do not link;
equal (conversation, turn) rows get equal results; an empty table gives an empty
table. Extra columns pass through, but for those named like a result column;
other names never clash. Work is linear in a message's lines; a path is as long
as its thread is deep.

``quoted_replies`` makes a table with known quotes out of one without any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, shielded

RESULTS = ("own_text", "n_passages", "n_linked", "max_level", "reply_to", "depth", "reply_path")
_NORM = "trim(regexp_replace(lower({0}), '[ \\\\t\\\\r\\\\n]+', ' '))"
_LEVEL = "length(regexp_replace(regexp_extract(l, '^[> ]*', 0), ' ', ''))"
#: What a text with a quoted line holds.
QUOTED = "(?:^|\n) *>"
#: Every expression is bound to a lambda variable, so it is computed once for a message wherever the optimiser puts it.
_PARSE = f"""
transform(array(split(coalesce(__text, ''), '\\n', -1)), ls -> transform(array(transform(ls, l -> {_LEVEL})), lv ->
  transform(array(sequence(0, size(ls) - 1)), at -> named_struct(
    'own', transform(filter(at, i -> lv[i] = 0), i -> ls[i]),
    'passages', transform(array(filter(at, i -> lv[i] > 0 and (i = size(ls) - 1 or lv[i + 1] <> lv[i]))), stops ->
      transform(filter(at, i -> lv[i] > 0 and (i = 0 or lv[i - 1] <> lv[i])), (b, p) -> named_struct(
        'level', lv[b], 'lines', transform(slice(ls, b + 1, stops[p] - b + 1), l -> regexp_replace(l, '^[> ]+', '')))))[0]
  ))[0])[0])[0]
"""


def link_quotes(messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """messages with own_text (no quotes), counts, reply_to (a turn or null), depth and reply_path (turns from the thread's start)."""
    messages = messages.drop(*RESULTS)
    rows, restore = shielded(messages)
    place = {c: F.col(f"__x{messages.columns.index(c)}") for c in (conv, turn, text)}
    rows = rows.withColumns({"__conv": place[conv], "__turn": place[turn].cast("long"), "__text": place[text]})
    parsed = rows.withColumn("__parsed", F.expr(_PARSE))
    quoting = rows.select("__conv", "__turn", "__text").where(F.col("__text").rlike(QUOTED)).withColumn("__parsed", F.expr(_PARSE))
    # only conversations that quote matter; written, so that a hot conversation's rows can be split where they join
    convs = materialise(quoting.select("__conv").distinct(), "convs")
    said = rows.select("__conv", "__turn", "__text").join(convs, "__conv", "left_semi").select("__conv", "__turn", F.array_join(F.expr(_PARSE)["own"], "\n").alias("own"))
    pieces = F.expr("concat(array(own), split(own, '\\n[ \\t]*\\n', -1), split(own, '\\n', -1))")
    said = said.select("__conv", "__turn", F.explode(F.array_distinct(pieces)).alias("piece")).withColumn("piece", F.expr(_NORM.format("piece"))).where("piece <> ''")
    originals = said.groupBy("__conv", F.md5("piece").alias("h")).agg(F.min("__turn").alias("first"))
    asked = quoting.select("__conv", "__turn", F.posexplode("__parsed.passages").alias("p", "q"))
    asked = asked.select("__conv", "__turn", "p", "q.level", F.explode(F.expr("concat(array(array_join(q.lines, ' ')), q.lines)")).alias("piece"))
    asked = asked.withColumn("piece", F.expr(_NORM.format("piece"))).where("piece <> ''").select("__conv", "__turn", "p", "level", F.md5("piece").alias("h")).distinct()
    hits = asked.join(originals, ["__conv", "h"]).where(F.col("first") < F.col("__turn"))
    per = hits.groupBy("__conv", "__turn", "p", "level").agg(F.max("first").alias("first"))
    replies = per.groupBy("__conv", "__turn").agg(F.max(F.struct(-F.col("level"), F.col("first"))).alias("best"), F.count(F.lit(1)).alias("linked"))
    replies = materialise(replies.select(F.col("__conv").alias("c"), F.col("__turn").alias("t"), F.col("best.first").alias("to"), "linked"), "replies")
    paths = _paths(replies)
    shown = parsed.join(paths, (F.col("__conv") == F.col("c")) & (F.col("__turn") == F.col("t")), "left")
    padded = F.expr("transform(coalesce(path, array(__turn)), x -> lpad(cast(x as string), 19, '0'))")
    return shown.select(
        *restore,
        F.when(F.col("__text").isNotNull(), F.regexp_replace(F.array_join("__parsed.own", "\n"), "^\\n+|\\n+$", "")).alias("own_text"),
        F.size("__parsed.passages").cast("long").alias("n_passages"),
        F.coalesce("linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce(F.expr("array_max(transform(__parsed.passages, p -> p.level))"), F.lit(0)).cast("long").alias("max_level"),
        F.col("to").alias("reply_to"),
        (F.coalesce(F.size("path"), F.lit(1)) - 1).cast("long").alias("depth"),
        F.array_join(padded, "/").alias("reply_path"),
    )


def _paths(replies: DataFrame) -> DataFrame:
    """The turns from the thread's start to each reply, by pointer doubling: as many rounds as the log of the depth."""
    now = replies.withColumn("path", F.array("to", "t")).withColumn("next", F.col("to"))
    while True:
        up = now.select(F.col("c").alias("uc"), F.col("t").alias("ut"), F.col("path").alias("upath"), F.col("next").alias("unext"))
        joined = now.join(up, (F.col("c") == F.col("uc")) & (F.col("next") == F.col("ut")), "left")
        step = joined.select("c", "t", "to", "linked", F.expr("if(upath is null, path, concat(upath, slice(path, 2, size(path))))").alias("path"), F.col("unext").alias("next"))
        old, now = now, materialise(step, "paths")
        discard(old)
        if now.where("next is not null").isEmpty():
            return now.drop("next")


#: Turns of derived replies begin here; every so many turns a thread of theirs ends.
LATER, THREAD = 1_000_000_000, 8


def quoted_replies(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): all messages, and for each turn with a text a reply that quotes.

    The reply to turn t is turn LATER + t and says "Re t: " and the text. It quotes what the reply before it says,
    in capitals and with doubled blanks, below a second quote level with what the reply before that says, as far as
    these belong to its thread: turns t with equal t div THREAD. Of rows with equal turn the least text counts.
    """
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    one = rows.where("text is not null").groupBy("conv_id", "turn").agg(F.min(F.struct("text", "role")).alias("m"))
    one = one.select("conv_id", "turn", "m.role", F.concat(F.lit("Re "), F.col("turn"), F.lit(": "), F.col("m.text")).alias("says"))
    for gap, level in ((1, "> "), (2, ">> ")):
        lines = F.split(F.regexp_replace(F.translate("says", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), " ", "  "), "\n", -1)
        quote = one.select("conv_id", (F.col("turn") + gap).alias("turn"), F.concat(F.lit(level), F.array_join(lines, f"\n{level}")).alias(f"quote{gap}"))
        one = one.join(quote, ["conv_id", "turn"], "left").withColumn(f"quote{gap}", F.when(F.col("turn") % THREAD >= gap, F.col(f"quote{gap}")))
    replies = one.select("conv_id", (F.col("turn") + LATER).alias("turn"), "role", F.concat_ws("\n", "quote2", "quote1", "says").alias("text"))
    return rows.union(replies)
