"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of
``documents``; the last returns packed pieces. ``run`` writes every stage as Parquet to the shared folder
and reads it again. Nulls, empty and repeated rows are treated as each operator states; an empty table
passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.decontamination import decontaminated
from ledgerloom.llm.line_dedup import deduplicated
from ledgerloom.llm.near_dedup import near_dedup
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.queries import tokenizer_path
from ledgerloom.llm.shared import table, written
from ledgerloom.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go."""
    return deduplicated(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays."""
    return near_dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences."""
    return pack_documents(docs, tokenizer_path())


STAGES = [(f.__name__, f) for f in (toxicity, line_dedup, minhash_near_dedup, benchmark_decontamination, best_fit_packing)]

#: The network, the sketches and the tokenizer can't be put into SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
