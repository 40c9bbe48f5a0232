"""A corpus from raw documents to packed sequences: five stages, each one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, as they were, whatever else they are called.

An empty table goes through all stages as an empty table. A null text counts as empty, a null id as smaller than any id, and a null
source as a source of its own; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import exact_dedup, mixing, ngram_join, packing, quality
from graphloom.llm.common import documents, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules.

    Null, empty and blank texts fail them; rows that repeat are judged alike.
    """
    return quality.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id.

    Null and empty texts are equal; of rows that repeat the id too, one stays.
    """
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, five-word shingles at a similarity of 0.8, the document with the smallest id.

    Texts without words are in no group and stay; rows that share an id but no group all stay.
    """
    return ngram_join.keep_first(docs, k=ngram_join.NEAR_K, threshold=ngram_join.NEAR_THRESHOLD)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them: never, once or twice.

    Texts without words stay once; which of equally long documents of a source is taken depends on id and text alone.
    """
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, with their sequences and offsets.

    An empty text is a piece of one token; a document that was taken twice is packed twice.
    """
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("source_mix", source_mix), ("best_fit_packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", codec="snappy")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Library token ids and the mixing method are beyond SQL; tests hold run() against a brute-force version, stage by stage.
ORACLE_SQL = None
