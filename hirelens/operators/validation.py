"""Checks of requests, access rules and integrity."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.functions.text import array_or_empty, byte_length, col, starts_with, trim

MOST_BYTES = 10 * 1024 * 1024
LEAST_JOB, MOST_JOB, LEAST_MATCH = 50, 10_000, 10


def _absent(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit("")) == ""


def job_error(text: str | Column) -> Column:
    """V1: what is wrong with a job description, null if nothing is; lengths count after trimming."""
    n = F.length(trim(text))
    return F.when(_absent(text), "Job description is required and must be a string").when(n < LEAST_JOB, f"Job description must be at least {LEAST_JOB} characters long").when(n > MOST_JOB, f"Job description must not exceed {MOST_JOB:,} characters")


def uri_error(uri: str | Column) -> Column:
    """V2: the limit is on the URI's bytes, not the file's."""
    return F.when(_absent(uri), "Resume data URI is required and must be a string").when(~starts_with(uri, "data:"), "Invalid resume data format").when(byte_length(uri) > MOST_BYTES, f"Resume file is too large. Maximum size is {MOST_BYTES >> 20}MB")


def match_error(resume: str | Column, job: str | Column) -> Column:
    """V3: of a request with several faults the first."""
    short = lambda c: F.length(trim(c)) < LEAST_MATCH
    return F.when(_absent(resume), "Resume text is required and must be a string").when(_absent(job), "Job description text is required and must be a string").when(short(resume), "Resume content is too short").when(short(job), "Job description content is too short")


def match_input(resume: str | Column, job: str | Column, criteria: str | Column) -> Column:
    """V3: what goes on to the model: both texts trimmed, criteria that are absent as none."""
    return F.struct(trim(resume).alias("resumeText"), trim(job).alias("jobDescriptionText"), array_or_empty(criteria).alias("hiringCriteria"))


def matchable(status: str | Column, description: str | Column) -> Column:
    """V4: the length is as typed."""
    return (col(status) == "completed") | (F.coalesce(F.length(col(description)), F.lit(0)) > 50)


def login_error(mode: str | Column, email: str | Column, password: str | Column, first: str | Column, last: str | Column) -> Column:  # V7
    blank = lambda c: F.coalesce(col(c), F.lit("")) == ""
    return F.when(blank(email) | blank(password), "Email and password are required").when((col(mode) == "signup") & (blank(first) | blank(last)), "First and last name are required")


#: What a failed operation's message begins with.
FAILED = {"analyze": "Failed to analyze job description: ", "extract": "Failed to extract resume information: ", "match": "Failed to calculate match score: "}


def failed(operation: str, message: str | Column) -> Column:
    """V8: the error of an operation that broke, null if message is null."""
    return F.concat(F.lit(FAILED[operation]), col(message))


def envelope(error: str | Column, data: str | Column) -> Column:
    """{success, data} or {error}, and the status that goes with it: 400 for a bad request, 500 for an operation that broke."""
    e = col(error)
    broke = functools.reduce(lambda a, b: a | b, [F.startswith(e, F.lit(x)) for x in FAILED.values()])
    return F.struct(F.when(e.isNull(), True).alias("success"), F.when(e.isNull(), col(data)).alias("data"), e.alias("error"), F.when(e.isNull(), 200).when(broke, 500).otherwise(400).alias("status"))


def next_status(status: str | Column, event: str | Column) -> Column:
    """V9: start, succeed, fail and edit; anything else changes nothing."""
    s, e = col(status), col(event)
    return F.when(e == "edit", "idle").when(e.isin("start", "analyze"), F.when(e == "start", "processing").otherwise("analyzing")).when(s.isin("processing", "analyzing") & (e == "succeed"), "completed").when(s.isin("processing", "analyzing") & (e == "fail"), "error").otherwise(s)


def allowed(requests: DataFrame) -> DataFrame:
    """Requests (user, op, path_id, new, old: structs with id and the parents' ids, null where there is none), with allowed.

    All need a user; create needs the path's id, update an existing row and unchanged ids, delete an existing row."""
    keys = [f for f in requests.schema["new"].dataType.fieldNames() if f == "id" or f.endswith("Id")]
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"new.{k}").eqNullSafe(F.col(f"old.{k}"))
    op = F.col("op")
    rule = F.when(op.isin("get", "list"), True).when(op == "create", F.col("new.id") == F.col("path_id")).when(op == "update", F.col("old").isNotNull() & same).when(op == "delete", F.col("old").isNotNull()).otherwise(False)
    return requests.withColumn("allowed", F.coalesce(F.col("user").isNotNull() & rule, F.lit(False)))


def denied(requests: DataFrame) -> DataFrame:
    """What was refused, as the request object of a dead-letter table."""
    auth = F.when(F.col("user").isNotNull(), F.struct(F.col("user").alias("uid")))
    return allowed(requests).filter(~F.col("allowed")).select(F.struct(auth.alias("auth"), F.col("op").alias("method"), F.concat(F.lit("/databases/(default)/documents/"), F.col("path_id")).alias("path"), F.when(F.col("new").isNotNull(), F.struct(F.col("new").alias("data"))).alias("resource")).alias("request"))


def identities(rows: DataFrame) -> DataFrame:
    """(user, provider, uid) to a map from provider to its uids."""
    return rows.groupBy("user", "provider").agg(F.array_sort(F.collect_list("uid")).alias("uids")).groupBy("user").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", "uids")))).alias("identities"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Children whose parent isn't there."""
    return child.join(parent.select(F.col(parent_key).alias("_parent")), F.col(key) == F.col("_parent"), "left_anti")
