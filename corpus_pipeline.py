"""A corpus pipeline of five stages, from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of `documents`. A stage's scratch tables are deleted when the next stage starts, unless
its docs still read them: by then its output is written.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import bpe, exact, minhash, mixing, quality
from larder.llm.common import drop_scratch, reads_scope, scratch_scope, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled thresholds of their language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_rules(docs.select(COLUMNS), labels).filter("kept").select(COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal up to white space, the one with the smallest doc_id."""
    return exact.keep_first(docs.select(COLUMNS))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-duplicates, the one with the smallest doc_id."""
    return minhash.keep_one(docs.select(COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of its slot; blocks after the end of the mix come later."""
    return mixing.mix(docs.select(COLUMNS), ordered=True).select(COLUMNS)


def place(docs: DataFrame) -> Column:
    """A number that rises in the order in which `docs` lie: partition, then row. For a table in files, these are the partitions that
    wrote them, since tasks take files by their size and not in their order."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return F.monotonically_increasing_id()
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    return F.shiftleft(part, 33) + F.col("_metadata.row_index")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, place, ids (exact token ids of the whole text). By place, rows are in the order of the mix."""
    return bpe.bpe_encode(docs.withColumn("place", place(docs)), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id", "lang", "source", "place"])


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
ORDER: list[tuple[str, Stage]] = [("quality_rules", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("bpe", encode_stage)]


def _scoped(k: int, stage: Stage) -> Stage:
    """The stage with its scratch tables in a folder of their own, which goes when the next one starts."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = f"pipeline-{k - 1}"
        if k and not reads_scope(docs, before):
            drop_scratch(spark, before)
        with scratch_scope(f"pipeline-{k}"):
            return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [(name, _scoped(k, stage)) for k, (name, stage) in enumerate(ORDER)]

#: Signatures, schedules and token ids can't be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"stage-{name}")
    return docs
