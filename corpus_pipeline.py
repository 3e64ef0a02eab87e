"""Corpus pipeline: quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  ``run`` writes the result of each
stage to the shared folder and reads it again, so a lost executor costs at most
a stage.

All stages: a null text counts as an empty one and passes where it breaks no
rule; null doc_ids stay null; texts of any length are read whole; columns
beside doc_id and text stay with their rows whatever their names; an empty
table gives an empty table.  Repeated rows are judged alike, and near-dedup
leaves one of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from touchgrid.llm import bpe, decontaminate, lines, near_copies, resample, simhash
from touchgrid.llm.shared import small_batches, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling draws, after its screen for toxic text.  Ties in the key go by doc_id, then text."""
    return resample.keep_good(small_batches(docs), _table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier one; n_chars follows, and what loses all its lines goes.  Lines at one place tie and stay."""
    return lines.without_later_lines(small_batches(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five-word shingles: the smallest doc_id, of equal ones the least text hash.

    SimHash groups come first.  Two bits of a fingerprint find near-identical
    texts only, so an exact join at Jaccard 0.8 takes the other near copies.
    """
    one = written(simhash.keep_one(small_batches(docs), near_copies.SHINGLE), "one-per-fingerprint")
    return near_copies.keep_one(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item, word for word."""
    return decontaminate.keep_clean(small_batches(docs), _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count and digests of each document; repeated rows each give one."""
    return bpe.encode_decode(small_batches(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encode", encode)]

#: No SQL: the classifier draws by fitted models; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
