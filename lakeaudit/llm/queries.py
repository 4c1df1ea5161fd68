"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, imatch, jaccard, langid, linedup, merkle, packing, quality, quotes, rules, secretscan, segmentation, trie
from .common import fold, materialise, table

#: The vocabulary that op7 uses; any SentencePiece model file does.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op2_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the table holds no quotes: replies with known quotes are derived from all of it and stand beside its rows
    linked = quotes.link_quotes(materialise(quotes.quoted_replies(table(spark, sf_dir, "conversations")), "messages"))
    return linked.select("conv_id", "turn", "role", "own_text", "n_passages", "n_linked", "max_level", "reply_to", "depth", "reply_path")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold("doc_id", 4) != 2)
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_parity_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.near_duplicates(docs, k=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *linedup.RESULTS, "text")


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return imatch.compare_with_next(docs, imatch.lexicon(docs))


def op7_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES, n_best=3, digest=True)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), near=(5, 80))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(secretscan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), columns=["doc_id"]))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.COLUMNS)
    touched = merkle.leaf([F.try_add(F.col(c), F.lit(1)) if c == "n_chars" else c for c in merkle.COLUMNS])
    docs = docs.withColumn("touched", F.when(fold("doc_id", 7) == 0, touched))
    rows = merkle.manifest(docs, keep=["touched"]).withColumn("folded_root", merkle.fold(F.coalesce("touched", "leaf"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(*trie.rebuilt(trie.turns(table(spark, sf_dir, "conversations")))).drop("digest", "parent")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_multi_index, op2_quotation_links, op3_language_id, op4_parity_jaccard, op5_line_chunks, op6_imatch, op7_nbest, op8_quality, op9_packing, op10_secrets, op11_merkle_manifest, op12_quality_rules, op13_prefix_trie, pipeline)
}

OP4_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]))
   when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.c >= 90 * (x.n + y.n - p.c)),
r(a, b) as (select doc_id, doc_id from w union select r.a, e.b from r join e on e.a = r.b)
select w.doc_id, coalesce(max(n.n), 0) as n_shingles, min(r.b) as component_id from w join r on r.a = w.doc_id left join n on n.doc_id = w.doc_id group by w.doc_id
"""

#: The links that quotes.quoted_replies plants. Blanks are those of the query's pattern.
OP2_SQL = f"""
with rows as (select conv_id, cast(turn as bigint) as turn, role, text from conversations),
one as (select conv_id, turn, min({{'text': text, 'role': role}}) as m from rows where text is not null group by conv_id, turn),
says as (select conv_id, turn, m.role as role, 'Re ' || turn || ': ' || m.text as says from one),
linked as (select a.conv_id, a.turn, a.role, a.says, b.turn is not null and a.turn % {quotes.THREAD} >= 1 as near, c.turn is not null and a.turn % {quotes.THREAD} >= 2 as far
  from says a left join says b on b.conv_id = a.conv_id and b.turn = a.turn - 1 left join says c on c.conv_id = a.conv_id and c.turn = a.turn - 2),
threads as (select *, case when near then {quotes.LATER} + turn - 1 when far then {quotes.LATER} + turn - 2 end as up from linked),
plain as (select conv_id, turn, role, regexp_replace(text, '^\n+|\n+$', '', 'g') as own_text, 0::bigint as n_passages, 0::bigint as n_linked, 0::bigint as max_level, cast(null as bigint) as reply_to, 0::bigint as depth, lpad(cast(turn as varchar), 19, '0') as reply_path from rows),
paths as (with recursive p(conv_id, turn, depth, path) as (
  select conv_id, turn, 0::bigint, lpad(cast({quotes.LATER} + turn as varchar), 19, '0') from threads where up is null
  union all select t.conv_id, t.turn, p.depth + 1, p.path || '/' || lpad(cast({quotes.LATER} + t.turn as varchar), 19, '0') from threads t join p on p.conv_id = t.conv_id and t.up = {quotes.LATER} + p.turn) select * from p)
select * from plain union all
select conv_id, {quotes.LATER} + turn, role, regexp_replace(says, '^\n+|\n+$', '', 'g'), near::bigint + far::bigint, near::bigint + far::bigint,
  case when far then 2 when near then 1 else 0 end, up, depth, path from threads join paths using (conv_id, turn)
"""

ORACLES = {"op2_quotation_links": OP2_SQL, "op4_parity_jaccard": OP4_SQL, "op5_line_chunks": linedup.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op12_quality_rules": rules.ORACLE, "op13_prefix_trie": trie.ORACLE}
