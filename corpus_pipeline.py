"""A corpus pipeline of five stages over the documents table.

Each stage gets all documents that the one before kept. The first four return
the columns of ``documents``; the last returns packed pieces. Empty and null
texts: language ID rejects them. Rows whose text line dedup empties go. Repeated
rows count as copies. Extra columns of the table pass through all stages but the last,
whatever their names: operators see them under reserved ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.llm import jaccard, langid, linedup, packing, secretscan
from lakeaudit.llm.common import materialise, table


CORE = ("doc_id", "text", "lang", "source", "n_chars")


def reserved(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs with extra columns under reserved names, and the columns that give docs' own back."""
    names = [c if c in CORE else f"__extra{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated classifier rejects go."""
    docs, own = reserved(docs)
    model = langid.fit(docs, F.lit(True))
    return langid.predict(docs, model).where(~F.col("rejected")).select(*own)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, and documents of which nothing is left."""
    docs, own = reserved(docs)
    # written first: a filter pushed below the rebuilt text would have it computed twice
    clean = materialise(linedup.dedup_lines(docs), "clean")
    left = clean.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*own)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id."""
    docs, own = reserved(docs)
    found = jaccard.components_of(docs, k=5, percent=80)
    rows = docs.withColumn("__own", F.coalesce(F.col("doc_id").cast("long"), jaccard.surrogate("text")))
    gone = found.where("component <> id").select(F.col("id").alias("__own"))
    twice = found.where("component = id and rows > 1").select(F.col("id").alias("__own"))
    kept = rows.join(gone, "__own", "left_anti")
    # only rows whose id occurs again are compared by text
    if not twice.isEmpty():
        again = kept.join(twice, "__own", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(twice, "__own", "left_anti").unionByName(again)
    return kept.select(*own)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced by a mark; all documents stay."""
    clean = secretscan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every word of every document in a bin without conflicts of source or copies."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
