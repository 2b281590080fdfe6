"""The driver's tables in the roles of the engine's: see the README."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents; the labelled ones are scored, those of quality shortlisted."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    label = table(spark, sf_dir, "labels").select(F.col("doc_id"), "quality")
    return d.join(label, "doc_id", "left").select(F.col("doc_id").alias("pos"), F.col("source").alias("name"), "lang", F.when(F.col("quality").isNotNull(), (F.col("n_chars") % 101).cast("double")).alias("score"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("shortlisted"))


CANDIDATES = "candidates AS (SELECT d.doc_id AS pos, d.source AS name, d.lang, CASE WHEN l.quality IS NOT NULL THEN CAST(d.n_chars % 101 AS DOUBLE) END AS score, coalesce(l.quality = 1, false) AS shortlisted FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.split("p_name", " ").alias("skills"), F.col("p_type").alias("jobTitle"), F.col("p_size").cast("double").alias("score"), (F.col("p_size") % 3 == 0).alias("shortlisted"))


POOL = "pool AS (SELECT p_partkey AS id, p_brand AS name, string_split(p_name, ' ') AS skills, p_type AS \"jobTitle\", CAST(p_size AS DOUBLE) AS score, p_size % 3 = 0 AS shortlisted FROM part)"


def pool_log(events: DataFrame) -> DataFrame:
    """Sign-ups and views add (a view without a score), purchases add shortlisted, clicks toggle, errors remove."""
    kind = F.col("event_type")
    op = F.when(kind.isin("signup", "view", "purchase"), "add").when(kind == "click", "toggle").when(kind == "error", "remove").otherwise("none")
    return events.select(F.col("user_id").cast("string").alias("id"), "ts", F.col("event_id").alias("seq"), op.alias("op"), (kind == "purchase").alias("shortlisted"), F.when(kind != "view", F.col("value")).alias("score"))
