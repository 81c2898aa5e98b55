"""From raw documents to packed training sequences: five operators, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as Parquet in
the shared folder and read again as the next stage's documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kalkula.llm import mixing, packing, pii, quality, resemblance
from kalkula.llm.common import cut_lineage, delete_tables, made_from, noted_tables, read_table, recorded, small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(work: Stage) -> Stage:
    """The stage with its tables put away: a result names the tables that the stage wrote for itself, in metadata that Parquet keeps.

    The stage that gets the result written and read again deletes these, and no others; tables that its documents still read stay.
    """

    @functools.wraps(work)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        still_read = delete_tables(spark, noted_tables(docs), but=docs)
        with recorded() as paths:
            out = work(spark, made_from(docs, []), sf_dir)
        return made_from(out, still_read + paths)

    return begin


@stage
def reject_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the policy go."""
    return quality.apply_policy(docs)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 or more of the five-word shingles alike) stays: links by SimHash, checked, then the others by an exact search."""
    return resemblance.drop_near_duplicates(docs)


@stage
def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are generalised, terms that disclose them removed."""
    return pii.sanitise(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as the mix takes it."""
    return mixing.apply_mix(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and their place in it."""
    return packing.pack(packing.token_pieces(docs)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", reject_by_quality),
    ("near-dedup", drop_near_duplicates),
    ("pii", sanitise),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL has neither the tokenizer nor the shingles' hash; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), []
    for i, (_, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            with recorded() as paths:
                docs = cut_lineage(docs)
            delete_tables(spark, before)
            before = paths
    return docs
