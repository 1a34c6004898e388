"""From `documents` to packed training windows, stage by stage.

Each stage takes what its predecessor kept and returns the columns of
`documents`; the last one returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialsift.llm.common import stored, table
from trialsift.llm.cube_mix import mixed_documents
from trialsift.llm.drr_packing import pack
from trialsift.llm.seed_extend import cut_repeats
from trialsift.llm.trie_join import keep_one_each
from trialsift.llm.zstd_lang import keep_identified
from trialsift.session import ship_package


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells clearly; the others go."""
    ship_package(spark)
    return keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each component of near copies."""
    ship_package(spark)
    return keep_one_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier text already has."""
    ship_package(spark)
    return cut_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    ship_package(spark)
    return mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of the mixture's proportions."""
    ship_package(spark)
    found = pack(docs, checksums=True)
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("source_mix", mix_sources),
    ("packing", pack_windows),
]

#: Compression, balanced sampling and token ids have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
