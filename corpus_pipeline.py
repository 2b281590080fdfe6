"""From raw documents to packed training sequences: each stage takes (spark, docs, sf_dir) and works on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hirelens.llm._common import gone_at_end, shared_folder
from hirelens.llm.language import accepted_only
from hirelens.llm.mixing import mixed
from hirelens.llm.near_duplicates import without_near_duplicates
from hirelens.llm.packing import pack
from hirelens.llm.substrings import without_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go: texts that the languages named in docs.lang all need too many phrases for, and null, empty and letterless ones. Rows are judged each by its text; columns stay as they are."""
    return accepted_only(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, joined by all pairs within the threshold, the document of least doc_id stays; rows without doc_id and texts that match nothing stay."""
    return without_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay where they stand first; documents of which nothing is left go. Rows alike in doc_id and text are cut alike; null and empty texts stay."""
    return without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are weighted by their tokens to the power of 0.7, the shares of languages kept; rows stand as often as their copies. A null source or language is one of its own; rows alike have as many copies each."""
    return mixed(docs, margins=("lang",))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of up to 2,048 tokens, balanced by cost; texts without a word take no place, rows alike are each packed."""
    return pack(docs)


STAGES = [("language ID", language_id), ("near-duplicate removal", near_dedup), ("substring dedup", substring_dedup), ("source mixing", mix_sources), ("packing", pack_sequences)]

#: No stage but the last has a form in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each kept is a table in the shared folder, so that no later failure undoes it; they are deleted when the driver ends. An empty table gives an empty one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    gone_at_end(spark, folder)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
