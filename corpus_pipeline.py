"""From raw documents to token ids: quality rules, near copies, repeated passages, mixing, byte-level BPE.

Each stage is a function of ``(spark, docs, sf_dir)``. All but the last return the columns of ``docs``, in
their order, whatever further columns there are. Rows that share a ``doc_id`` are one document and stay or go
together; rows without one are judged on their text alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from maskloom.llm import byte_bpe, mixing, near_copies, quality_rules, repeats
from maskloom.llm.queries import MIX, domain_labels
from maskloom.llm.records import REGION_ID, TEXT, stored, text_regions

ROW = "row"


def _boxed(docs: DataFrame, *without: str) -> DataFrame:
    """Id and text as a text region beside the whole row as one struct, so that no given name can clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in without])
    return docs.select(F.col("doc_id").cast("bigint").alias(REGION_ID), F.col("text").alias(TEXT), row.alias(ROW))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and no learned rule rejects; the list is learned from all labelled ones."""
    counts = stored(quality_rules.text_statistics(text_regions(docs)), "statistics")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias(REGION_ID), "quality")
    rules = quality_rules.learn_rules(counts.join(labels, REGION_ID))
    judged = quality_rules.text_statistics(_boxed(docs), keep=[ROW])
    return judged.filter(~quality_rules.base_failed() & quality_rules.verdict(rules)).select(f"{ROW}.*")


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = 85) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    found = near_copies.near_copies(text_regions(docs), percent)
    gone = stored(found.filter(~F.col("kept")).select(F.col(REGION_ID).alias("gone")).distinct(), "gone")
    return docs.join(gone, F.col("doc_id").cast("bigint") == F.col("gone"), "left_anti")


def near_copy_stage_at_80(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The near copies of the pipeline: 0.85 is op2's own threshold, and here 0.8 of all shingles make a copy."""
    return near_copy_stage(spark, docs, sf_dir, percent=80)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document or place has; ``n_chars`` follows the text."""
    cut = repeats.cut_repeats(_boxed(docs, "text"))
    kinds = dict(docs.dtypes)
    new = {"text": F.col(TEXT), "n_chars": F.length(TEXT).cast(kinds.get("n_chars", "bigint"))}
    return cut.select(*[new.get(c, F.col(ROW)[c]).alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, so that the languages have the shares of tokens asked for."""
    _, model, rates = mixing.mixed_rates(text_regions(docs), domain_labels(docs), MIX)
    members = mixing.memberships(_boxed(docs), model, keep=[REGION_ID, ROW])
    often = members.select(ROW, mixing.copies(rates.column(), F.col(REGION_ID)).alias("copies"))
    # The outer form, as the plain one would test the array's size below all that made it, and so make it twice.
    repeated = often.select(ROW, F.explode_outer(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"))
    return repeated.filter("copy IS NOT NULL").select(f"{ROW}.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``token_ids`` and the ``text`` that the ids decode to."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.encode_texts(text_regions(docs), ranks, public_tokenizers.PATTERN, decoded=True).select(
        F.col(REGION_ID).alias("doc_id"), F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids",
        F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality rules", quality_stage),
    ("near copies", near_copy_stage_at_80),
    ("repeated passages", repeats_stage),
    ("mixing", mixing_stage),
    ("byte-level BPE", token_stage),
]

#: Learned rules, signatures and content-defined chunks are beyond SQL; tests compare stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
