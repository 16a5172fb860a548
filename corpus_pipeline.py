"""The corpus pipeline: quality rules, toxicity, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's
docs. All but the last return the columns of docs. A stage judges what it is given as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm import fertility, lsh_forest, mixing, packing, toxicity
from strataflow.llm.common import already_written, forget, remainder, shared_path
from strataflow.llm.queries import VOCABULARIES


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility rules keep: those with words, within their language's bands. Null and empty texts go;
    repeated rows share their fate; an empty table gives no rows."""
    return fertility.keep(docs, VOCABULARIES)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.7, by a model of the labelled ones here (but every third, held out). Without
    both labels nothing is dropped; null and empty texts are scored as texts without words."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder(F.col("doc_id"), 3) != 1)
    return toxicity.keep(docs, toxicity.fit(docs, labels), 0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest doc_id, of each class of near duplicates. Rows without a doc_id or a word stay."""
    return lsh_forest.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources come alike, in random order; null is a source of its own."""
    return mixing.poisson_mix(docs, weights=None, measure="rows", seed="mix").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; a null or empty text is its end id alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenisers, the string kernel and the forest can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each result is written to the shared folder and read again, and what led to it is
    removed. Null and empty texts, repeated rows and other columns go through as each stage's operator says; an empty table
    gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begun = already_written()
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        forget(spark, [*begun, path])
    return docs
