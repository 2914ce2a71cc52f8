"""Training-data pipeline over ``documents``: language ID, near-duplicate removal, removal of repeated passages,
benchmark decontamination, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of ``documents``; extra columns pass through.  A stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigia.llm import decontaminate, language, ngram_join, packing, suffix_dedup
from vigia.llm.common import table
from vigia.llm.scratch import save


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that resemble one of the labelled languages; texts without letters go.  The model is learned from the
    labelled rows of ``docs``; without any labelled row every text is of no known language."""
    return language.accepted(docs, language.learn(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group linked by a Jaccard similarity of 0.8 or more of 5-word shingles."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 200-byte strings that occur elsewhere; documents with nothing left go."""
    return suffix_dedup.without_repeats(docs, window=200)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their token ids, in sequences of at most 1024 tokens."""
    return packing.pack(docs, size=1024, end_id=0)


STAGES = [
    ("language", keep_languages),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("decontamination", decontaminated),
    ("packing", pack_sequences),
]

#: Suffix automata, similarity classes and token ids are beyond SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
