"""The corpus pipeline: quality, toxicity, near copies, mixing, packing.

``run`` applies the stages to ``documents``; each one works on all that the one
before has kept, written as Parquet and read again.  A stage takes (spark, docs,
sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusdesk.llm import mixing, packing, quality, toxicity
from corpusdesk.llm.common import discard, documents, file_order, settle
from corpusdesk.llm.near_copies import drop_near_copies


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs, quality.language_references(docs))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; the labelled documents of the tables teach."""
    return toxicity.keep_clean(docs, toxicity.train(toxicity.labelled(spark, sf_dir)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return drop_near_copies(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources in the order of virtual time, repeats as rows of their own."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in fixed windows, in the order in which the mix was written."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), order=file_order(docs))


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity_filter), ("near_dedup", near_dedup),
          ("source_mixing", source_mixing), ("packing", pack_sequences)]

#: SQL cannot express the tokenizer, the classifier or the shingle links.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
        discard(*done)
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
