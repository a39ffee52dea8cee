"""Corpus pipeline: five operators in sequence, each stage on all that its predecessor kept.

Stages take (spark, docs, sf_dir); all but the last return the columns of ``documents``. Quality: rejected documents go.
Near duplicates (word 5-grams, Jaccard 0.8 or more): of each class the row with the smallest id stays (of equal ids one).
Decontamination: documents that hold a window of 8 words of any benchmark item go (a leak is often a single item, whole);
shorter items, such as an answer of one word, are no evidence and are not looked for. PII: found spans are replaced and
n_chars follows. Packing: the rest is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taglog.llm import pii, quality
from taglog.llm.common import cut, table
from taglog.llm.decontaminate import decontaminate
from taglog.llm.jaccard import jaccard_classes
from taglog.llm.packing import pack_documents


#: Words that a benchmark window must have to drop a document.
LEAST_WORDS = 8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    evidence = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, evidence).where("keep").select(*docs.columns)


def _placed(docs: DataFrame) -> DataFrame:
    """``docs`` with _at, what a row is decided by: its id (null last) and its text, as an id may name several texts."""
    return docs.withColumn("_at", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.unhex(F.sha2("text", 256)).alias("text")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = _placed(docs)
    classes = cut(jaccard_classes(placed, n=5, num=80, den=100, id_col="_at"))
    first = classes.where(F.col("_at").eqNullSafe(F.col("component_id"))).groupBy(F.col("_at").alias("_kept")).count()
    kept = placed.join(first, placed["_at"] == first["_kept"], "left_semi")
    repeated = first.where("count > 1").select(F.col("_kept").alias("_again"))
    if repeated.isEmpty():  # no row comes twice: the texts are joined once
        return kept.select(*docs.columns)
    alone = kept.join(repeated, kept["_at"] == repeated["_again"], "left_anti")
    again = kept.join(repeated, kept["_at"] == repeated["_again"], "left_semi")
    return alone.unionByName(again.dropDuplicates(["_at"])).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = _placed(docs)
    found = decontaminate(placed, table(spark, sf_dir, "benchmark"), id_col="_at", least=LEAST_WORDS)
    bad = found.where(F.size("items") > 0).select(F.col("_at").alias("_bad")).distinct()
    return placed.join(bad, placed["_at"] == bad["_bad"], "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]

#: Trained models and packing by supersteps are not expressible in SQL; tests hold every stage against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
