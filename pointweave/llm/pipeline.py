"""From documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointweave.llm import decontamination, near_duplicates, packing, quality
from pointweave.llm.tables import table
from pointweave.plans.scratch import staged


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; all of them where nothing is rated. Null and empty texts are judged by their shape."""
    return quality.selected(docs, quality.fitted(spark, docs, sf_dir))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and one row of each id; rows without an id, words or text stay."""
    return near_duplicates.deduplicated(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item; null and empty texts, and all where no item is given, stay."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens; a null or empty text is a piece of the end id."""
    return packing.packed_sequences(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicate removal", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("best-fit packing", pack_sequences),
]

#: Models, hashes and alignments have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again.

    Further columns, whatever their names, are carried through the first three stages. Long texts are handled whole,
    repeated rows and ties as each stage's operator says, and an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
