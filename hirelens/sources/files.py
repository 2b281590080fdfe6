"""Uploaded files and the blob store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirelens.functions.text import blob_id, col, file_stem, stable_id
from hirelens.schemas import BLOBS

MIME = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """The PDF and DOCX files of a folder, as (name, content, length)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,docx}").load(folder)
    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "content", "length")


def data_uri(name: str | Column, content: str | Column) -> Column:
    """Data:<mime>;base64,<content>, by the file's extension."""
    known = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.concat(F.lit("data:"), F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(col(name), "[^.]*$", 0))), F.lit("application/octet-stream")), F.lit(";base64,"), F.replace(F.base64(col(content)), F.lit("\r\n"), F.lit("")))


def from_data_uri(uri: str | Column) -> Column:
    """The content; null if it isn't base64."""
    return F.try_to_binary(F.regexp_replace(col(uri), "^data:[^,]*,", ""), F.lit("base64"))


def put(blobs: DataFrame, new: DataFrame) -> DataFrame:
    """S3: upsert by id; of several new rows for an id the last by seq, if they have one."""
    order = F.col("seq").desc() if "seq" in new.columns else F.lit(0)
    last = new.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(order))).filter("rn = 1")
    return blobs.join(last.select("id"), "id", "left_anti").select("id", "file").unionByName(last.select("id", "file"))


def get(blobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids with their file, null if there is none."""
    return ids.join(blobs, "id", "left")


def delete(blobs: DataFrame, ids: DataFrame) -> DataFrame:  # S5
    return blobs.join(ids, "id", "left_anti")


def open_store(spark: SparkSession, path: str, schema: str = BLOBS) -> DataFrame:
    """The table at path, made empty if it isn't there."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
        return spark.read.schema(schema).parquet(path)


def candidates_from_files(files: DataFrame, entered_name: str | None = None) -> DataFrame:
    """A new candidate for each file; files (pos, name)."""
    name = F.lit(entered_name) if entered_name else file_stem("name")
    return files.select("pos", stable_id("pos", "name").alias("id"), name.alias("name"), F.col("name").alias("fileName"), F.lit("idle").alias("status"))


def pool_files(pool: DataFrame, blobs: DataFrame) -> DataFrame:
    """Each pool row with its file."""
    return pool.withColumn("blobId", blob_id("id")).join(blobs.select(F.col("id").alias("blobId"), "file"), "blobId", "left")
