"""Each operator of this subpackage over its whole table, with production parameters, as the driver calls it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As each doc_id has one text, it tells the documents apart."""
    from hirelens.llm.substrings import repeats

    return repeats(table(spark, sf_dir, "documents")).drop("text_hash")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are the rows whose vec_id is divisible by 100, against all rows."""
    from hirelens.llm.neighbours import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"), every=100)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelens.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelens.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelens.llm.toxicity import toxic_passages

    return toxic_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelens.llm.winnowing import winnow

    return winnow(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents have no paths; each stands for the file <source>/<lang>/<doc_id>.txt."""
    from hirelens.llm.licenses import scan

    docs = table(spark, sf_dir, "documents")
    return scan(docs.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelens.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelens.llm.chat import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by tokens to the power of 0.7, the shares of languages as they are."""
    from hirelens.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), margins=("lang",)).withColumn("rate", F.round("rate", 5))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if re.match(r"op\d+_", k)}


def oracle_sql() -> dict[str, str]:
    from hirelens.llm import licenses, mixing, packing, substrings

    return {"op1_substring_dedup": substrings.SQL, "op4_packing": packing.SQL, "op7_licenses": licenses.SQL, "op10_mixing": mixing.SQL}
