"""From raw documents to encoded clean ones, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns they were given, so a
stage can be written as Parquet and read as the next one's documents. Rows with null ids or texts, repeated rows and
extra columns go along as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionmill.llm import bpe, decontaminate, jaccard, language, repeats
from sessionmill.llm.frames import Steps, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and not ambiguous."""
    return language.kept(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.kept(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that stand earlier; documents of which no word is left go."""
    return repeats.cleaned(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.kept(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of the text they decode to."""
    return bpe.encoded_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", decontaminated),
    ("encoding", encode),
]

ORACLE_SQL = None  # languages, repeats and merges are beyond SQL; tests/llm holds them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded documents; each stage but the last is a written table, which cuts the lineage."""
    docs, steps = read(spark, sf_dir, "documents"), Steps(spark)
    for name, stage in STAGES[:-1]:
        docs = steps.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
