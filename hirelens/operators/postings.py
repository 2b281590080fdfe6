"""Job postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.functions.skills import keywords
from hirelens.functions.text import col, prefixed_id, trim


def valid(form: DataFrame) -> DataFrame:
    """V6: title and description aren't blank."""
    return form.filter((F.coalesce(trim("title"), F.lit("")) != "") & (F.coalesce(trim("description"), F.lit("")) != ""))


def postings(form: DataFrame) -> DataFrame:
    """Form (title, description, department, location, type, createdAt) to postings: all trimmed, what is blank absent, keywords from the description."""
    absent = lambda c: F.nullif(trim(c), F.lit(""))
    return valid(form).select(prefixed_id("job", "createdAt").alias("id"), trim("title").alias("title"), trim("description").alias("description"), keywords(trim("description")).alias("keySkills"), *[absent(c).alias(c) for c in ("department", "location", "type")], col("createdAt"), F.lit(0).cast("bigint").alias("candidateCount"))


def with_counts(jobs: DataFrame, matches: DataFrame) -> DataFrame:
    """Q13: candidateCount from the matches (jobId), where the field itself is never set."""
    n = matches.groupBy(F.col("jobId").alias("id")).agg(F.count("*").alias("n"))
    return jobs.join(n, "id", "left").withColumn("candidateCount", F.coalesce("n", F.lit(0)).cast("bigint")).drop("n")


def loaded(job: DataFrame, posting: DataFrame) -> DataFrame:
    """P20: the posting's title and description in the job form, to be analysed anew, with the posting's own skills (not the stale ones)."""
    return job.limit(1).select(*[c for c in job.columns if c not in ("title", "description", "keySkills", "status")]).crossJoin(F.broadcast(posting.limit(1).select("title", "description", "keySkills"))).withColumn("status", F.lit("idle"))
