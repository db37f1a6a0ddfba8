"""A corpus pipeline of five stages, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept. All but the last return
the columns that they were given, whatever further ones there are and what they are called. Rows without a doc_id leave at
the first stage; a repeated doc_id stays or goes as one. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlens.llm.common import stored, table, unused
from govlens.llm.decontamination import contamination
from govlens.llm.jaccard import jaccard_components
from govlens.llm.line_dedup import dedup_lines
from govlens.llm.packing import pack_documents
from govlens.llm.quality import select_quality



def _chosen(docs: DataFrame, keys: DataFrame) -> DataFrame:
    return docs.join(keys.select("doc_id"), "doc_id", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what importance resampling selects. A null or empty text has weight 1; ties at the cut stay."""
    return _chosen(docs, select_quality(docs, table(spark, sf_dir, "labels")).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete repeated line runs; a document of which nothing is left goes. A null or empty text loses nothing and stays."""
    n_lines, n_deleted = unused("n_lines", docs.columns), unused("n_deleted", docs.columns)
    found = dedup_lines(docs, added=(n_lines, n_deleted))
    kept = found.where((F.col(n_deleted) == 0) | (F.length(F.trim("text")) > 0))
    n_chars = F.when(F.col(n_deleted) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select(*(n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near duplicates, at a similarity of 0.8 of five-word shingles.

    Null, empty and blank texts are near nothing and stay.
    """
    found = jaccard_components(docs, percent=80, shingle=5)
    return _chosen(docs, found.where(F.col("doc_id") == F.col("component_id")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item. A null or empty text holds none; an empty benchmark drops nothing."""
    return _chosen(docs, contamination(docs, table(spark, sf_dir, "benchmark")).where("not contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into context windows. A null or empty text is its closing id alone."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The quality stage samples and the last stage tokenizes, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
