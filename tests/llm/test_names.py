"""Extra columns whose names operators use: nothing crashes, values stay; empty tables and repeated rows too."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeaudit.llm import ann, imatch, jaccard, langid, linedup, packing, quality, quotes, secretscan, segmentation
from lakeaudit.llm.queries import PIECES

from .test_operators import words

NAMES = """c t to linked path p q level own h piece first last weak row base found added n_assign n_access n_hex assign access hex score lang_pred rejected n_chunks n_removed component_id
 n_shingles component id n rows key low high a b hub part rep ident keys sketch margin shard bin cluster piece start length offset words node body fingerprint rank ids vec query_id label y u vector block
 best depth reply_to own_text __x __key at chunk span""".split()
NAMES = list(dict.fromkeys(NAMES))


def table(spark, rows, schema):
    """rows with an extra column of each name that holds the name and the row's number."""
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", __no int")
    own = {f.split()[0] for f in schema.split(", ")}
    return df.select(*[c for c in df.columns if c != "__no"], *[F.concat(F.lit(f"{n}:"), "__no").alias(n) for n in NAMES if n not in own])


TEXTS = [words(1, 100), words(1, 100) + " more", "first\n" + words(2, 60) + "\nend", "other\n" + words(2, 60) + "\nend " + words(3, 20), "my password = hunter22 " + words(4, 20), None, "", words(5, 30), words(5, 30)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    return table(spark, [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)] + [(8, TEXTS[8], "en", "s0", len(TEXTS[8]))], DOCS)


OPERATORS = {
    "langid": lambda d: langid.predict(d, langid.fit(d, F.lit(True))),
    "jaccard": jaccard.near_duplicates,
    "linedup": linedup.dedup_lines,
    "imatch": lambda d: imatch.fingerprint(d, imatch.lexicon(d)),
    "secrets": secretscan.scan,
    "redact": secretscan.redact,
}
RESULTS = {"langid": {"score", "lang_pred", "rejected"}, "jaccard": {"component_id", "n_shingles"}, "linedup": set(linedup.RESULTS), "imatch": {"fingerprint"}, "secrets": {"n_assign", "n_access", "n_hex", "base", "found"}, "redact": set()}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_keep_extra_columns(spark, name):
    docs = documents(spark)
    out = OPERATORS[name](docs)
    extra = [n for n in docs.columns if n in NAMES and n not in RESULTS[name]]
    want = sorted(map(tuple, docs.select("doc_id", *extra).collect()))
    assert sorted(map(tuple, out.select("doc_id", *extra).collect())) == want
    assert OPERATORS[name](docs.where("false")).count() == 0


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_extra_columns(spark, stage):
    docs = documents(spark)
    run = corpus_pipeline.STAGES[stage][1]
    out = run(spark, docs, "")
    assert out.columns == docs.columns
    extra = [n for n in docs.columns if n in NAMES]
    have = {tuple(r) for r in docs.select("doc_id", *extra).collect()}
    got = [tuple(r) for r in out.select("doc_id", *extra).collect()]
    assert got and set(got) <= have
    empty = run(spark, docs.where("false"), "")
    assert empty.columns == docs.columns and empty.count() == 0


def test_tables_without_rows(spark):
    docs = documents(spark).where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert packing.pack(docs).count() == packing.pack(docs, near=(5, 80)).count() == quality.classify(docs, labels, F.lit(True)).count() == 0
    assert imatch.compare_with_next(docs, imatch.lexicon(docs)).count() == segmentation.encode(docs.select("doc_id", "text"), PIECES).count() == 0
    assert ann.search(docs.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding")), docs.select(F.col("doc_id").alias("vec_id"))).count() == 0


def test_repeated_rows_and_names_of_the_other_operators(spark):
    docs = documents(spark)
    packed = packing.pack(docs, near=(5, 80)).collect()
    assert sum(r["length"] for r in packed) == sum(len((t or "").split()) for t in [*TEXTS, TEXTS[8]])
    assert len(packed) == len(TEXTS) + 1 and [r["cluster"] for r in packed if r["doc_id"] in (7, 8)] == ["7"] * 3
    pairs = [r for r in segmentation.encode(docs.select("doc_id", "text"), PIECES, n_best=1).collect() if r["doc_id"] == 8]
    assert len(pairs) == 2 and pairs[0]["ids"] == pairs[1]["ids"]
    near = [r for r in imatch.compare_with_next(docs, imatch.lexicon(docs)).collect() if r["doc_id"] == 8]
    assert len(near) == 2 and near[0]["fingerprint"] == near[1]["fingerprint"]
    scores = [r["score"] for r in quality.classify(docs, spark.createDataFrame([(0, 1), (4, 0)], "doc_id long, quality int"), F.lit(True)).collect()]
    assert len(scores) == len(TEXTS) + 1


def test_quotes_with_names_long_messages_and_repeats(spark):
    lines = [f"line {i}" for i in range(100_000)]
    quoted = "\n".join(("> " if i % 3 else ">> ") + line for i, line in enumerate(lines))
    rows = [(1, 0, "\n".join(lines)), (1, 1, quoted), (2, 0, "Hello"), (2, 1, "> hello\nyes"), (2, 1, "> hello\nyes"), (2, 2, None), (None, 3, "> x")]
    df = table(spark, rows, "conv_id long, turn long, text string")
    extra = [n for n in df.columns if n in NAMES and n not in quotes.RESULTS]
    out = quotes.link_quotes(df)
    got = out.select("conv_id", "turn", "reply_to", "n_passages", "n_linked", *extra).collect()
    assert sorted((r["conv_id"] or 0, r["turn"], r["reply_to"], r["n_passages"], r["n_linked"]) for r in got if r["conv_id"] != 1) == [(0, 3, None, 1, 0), (2, 0, None, 0, 0), (2, 1, 0, 1, 1), (2, 1, 0, 1, 1), (2, 2, None, 0, 0)]
    assert [(r["reply_to"], r["n_passages"], r["n_linked"]) for r in got if r["conv_id"] == 1 and r["turn"] == 1] == [(0, 66_667, 66_667)]
    assert {r[extra[0]] for r in got} == {f"{extra[0]}:{i}" for i in range(7)}
    assert quotes.link_quotes(df.where("false")).count() == 0
