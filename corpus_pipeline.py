"""A corpus from raw documents to packed training sequences, as stages that each read what the one before has written.

All stages but the last return the rows that stay, with all columns of their input, whatever these are called. In each, null
text counts as empty, very long texts are whole, and a table without rows gives one without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plotweave.llm.line_dedup import dedup_lines
from plotweave.llm.mixing import training_stream
from plotweave.llm.near_dedup import keep_one
from plotweave.llm.packing import pack_documents
from plotweave.llm.quality import THRESHOLD, score_quality, train
from plotweave.llm.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from labels that are not held out.

    Empty texts are scored like others. Rows are judged by their texts alone, so repeated rows and rows without doc_id go or
    stay together. Without labels, or with labels of one kind only, all scores are that kind's share, smoothed.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model, keep_rows=True).where(F.col("score") >= THRESHOLD).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that enough documents share go from all but the one of largest doc_id; no document goes. n_chars follows the text
    where lines went. Each row counts as a document, also of a repeated doc_id; null is smaller than any."""
    out = dedup_lines(docs, keep_rows=True)
    had_text = F.col("n_dropped") > 0
    rows = out.select("row.*", "text", had_text.alias("_cut"))
    return rows.withColumn("n_chars", F.when(F.col("_cut"), F.char_length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of smallest doc_id; all rows of that doc_id that are in the
    group, if it repeats. Texts without words stay, and rows without doc_id unless a row of their group has one."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them: each row by itself, a null source as a source of its own,
    empty texts once. Ties of position are in order of doc_id."""
    return training_stream(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, numbered in training order: each row's ids and the end id, in one piece each."""
    out = pack_documents(docs, in_order=True)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written as Parquet and read again. What operators have left in
    the shared folder goes when their stage is written, and a stage's rows when the next one is."""
    scratch, docs, before = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with Scratch.passing():
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
