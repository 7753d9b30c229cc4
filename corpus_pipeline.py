"""A training-corpus pipeline over `documents`: quality, repeated lines, near duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from segline.llm.line_dedup import drop_repeated_runs
from segline.llm.near_dedup import near_duplicates
from segline.llm.packing import pack_documents
from segline.llm.quality_rules import score_documents
from segline.llm.storage import Workspace, table, unless_few


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality is 1. A document that labels know is scored like any other.

    Several rows of one doc_id are one document: it goes if any of them is rejected. Rows without doc_id stay.
    """
    verdict = score_documents(docs, table(spark, sf_dir, "labels")).groupBy("doc_id").agg(F.min("predicted").alias("good"))
    return docs.join(verdict.where("good = 0").select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of runs of lines; n_chars follows. A document left blank by that goes."""
    kept = drop_repeated_runs(docs).where("n_removed = 0 or trim(text) <> ''")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, by five-word shingles and a similarity of 0.8.

    Several rows of one doc_id are one document, of which the least row stays. Rows without doc_id stay.
    """
    ws = Workspace(spark, "near-stage")
    gone, n = ws.measured(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
    kept = docs.join(unless_few(gone, n["n"]), "doc_id", "left_anti").select(docs.columns)
    repeated, n = ws.measured(kept.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    repeated = unless_few(repeated, n["n"])
    least = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(least)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 ids."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near), ("best-fit packing", packing)]

#: Trees, lasso weights and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = ws.save(docs, name.replace(" ", "_"))
    return docs
