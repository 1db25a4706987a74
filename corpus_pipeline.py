"""A corpus, from raw documents to token ids, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; ``run`` writes what a stage
returns as Parquet and gives it to the next one.  All stages but the last return rows of
documents, with all their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silo_analytics.llm import queries, simhash, toxicity, winnow
from silo_analytics.llm.common import select_rows, table
from silo_analytics.scratch import materialize

# The share of all words that the mix keeps.  Copies are gone by then, so no document is repeated.
MIX_SHARE = 0.8
MIX_EPOCHS = 1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go: rows of that id and text; a null text is an empty one."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash neighbours stays; null ids come last, texts without words are alike."""
    return simhash.keep_one_per_group(docs, shingle=4, max_bits=4)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go: rows of that id and text; null texts stay."""
    items = table(spark, sf_dir, "benchmark")
    found = winnow.contamination(docs, items, window=10)
    return select_rows(docs, found.where(F.size("spans") > 0), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen so that the words of domains, languages and sources follow the weights.

    Rows under a null or repeated id are chosen each by itself; of rows that agree in id and text, all stay if one is chosen.
    """
    taken = queries.mixed(docs, MIX_SHARE, MIX_EPOCHS).where("epochs > 0")
    return select_rows(docs, taken, "left_semi")


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary files; one row per document read back from them, null ids first, null texts as empty ones."""
    return queries.token_table(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("source_mixing", mix_sources),
    ("token_output", write_token_ids),
]

# A tree ensemble and a tokenizer are not expressible in SQL; tests check the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, from the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
