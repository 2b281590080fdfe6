"""Tables kept as JSON documents, document writes, and live reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_json(texts: DataFrame, column: str, schema: str) -> DataFrame:
    """The rows of JSON arrays; text that can't be parsed gives none."""
    return texts.select(F.inline(F.coalesce(F.from_json(column, f"array<struct<{schema}>>"), F.array().cast(f"array<struct<{schema}>>"))))


def dump_json(table: DataFrame, *by: str) -> DataFrame:
    """one JSON array for each key (or for all), fields that are null left out. For tables of a user's size."""
    rows = F.collect_list(F.struct(*[c for c in table.columns if c not in by])) if by else F.collect_list(F.struct(*table.columns))
    return table.groupBy(*by).agg(F.to_json(rows).alias("json"))


def save_whole(table: DataFrame, path: str, name: str) -> str:
    """The whole table to a new folder below path, so that no reader meets half of it; the newest version is the largest name."""
    spark = table.sparkSession
    version = f"{path}/{name}/v{int(spark.sql('select unix_micros(current_timestamp())').first()[0]):020d}-{uuid.uuid4().hex[:8]}"
    table.write.parquet(version)
    return version


def placeholder_images(spark: SparkSession, path: str) -> DataFrame:
    """A static lookup file."""
    return spark.read.schema("id string, description string, imageUrl string, imageHint string").option("multiLine", True).json(path)


def collection(table: DataFrame, key: str = "key") -> DataFrame:
    """S13 and ST1: a collection's rows, each with its document id."""
    return table.withColumn("id", F.col(key).cast("string"))


def document(table: DataFrame, id_: str) -> DataFrame:
    """One document, no row if there is none."""
    return table.filter(F.col("id") == id_)


def apply_writes(table: DataFrame, log: DataFrame) -> DataFrame:
    """Table (id, fields map<string,string>) after the log (seq, id, op, fields): set, merge, add, update, delete, in order of seq.

    One shuffle by id. After an id's last set, add or delete, merges and updates lay their fields over one another; an update without a document does nothing."""
    from pyspark.sql import Window

    base = table.select("id", F.lit(-1).cast("bigint").alias("seq"), F.lit("set").alias("op"), "fields")
    every = base.unionByName(log.select("id", F.col("seq").cast("bigint").alias("seq"), "op", "fields"))
    of = Window.partitionBy("id")
    reset = F.max(F.when(F.col("op").isin("set", "add", "delete"), F.col("seq"))).over(of)
    ground = F.max(F.when(F.col("op").isin("set", "add"), F.col("seq"))).over(of)
    live = every.withColumn("reset", reset).withColumn("ground", ground).filter("(reset is null or seq >= reset) and op <> 'delete'")
    # without a document, the first merge makes one
    start = F.coalesce(F.when(F.col("ground") == F.col("reset"), F.col("ground")), F.min(F.when(F.col("op") == "merge", F.col("seq"))).over(of))
    use = live.withColumn("start", start).filter("start is not null and seq >= start").select("id", "seq", F.explode_outer(F.map_entries("fields")).alias("e"))
    last = use.groupBy("id", "e.key").agg(F.max_by("e.value", "seq").alias("value"))
    return last.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value"))))).alias("fields"))


def transfer(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Rows of a tracking system by externalId, theirs beside ours."""
    return local.join(remote.select(F.col("externalId"), *[F.col(c).alias(f"remote_{c}") for c in remote.columns if c != "externalId"]), "externalId")
