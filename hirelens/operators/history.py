"""Each user's analysis history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelens.functions.text import prefixed_id, rounded, user_key

KEEP = 20


def keep_newest(sessions: DataFrame, n: int = KEEP, by: str = "user_email", tie: str = "id") -> DataFrame:
    """The n newest of each user. Spark cuts groups to n before the shuffle as well (WindowGroupLimit)."""
    return sessions.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(F.col("timestamp").desc(), F.col(tie).desc()))).filter(F.col("rn") <= n).drop("rn")


def save(history: DataFrame, new: DataFrame, n: int = KEEP) -> DataFrame:
    """New sessions (user_email, timestamp, ...) on top, each user's newest kept. Where an id exists twice, the later row wins no place: ids are epoch milliseconds."""
    keyed = new.withColumn("user_email", user_key("user_email")).withColumn("id", prefixed_id("analysis", "timestamp"))
    return keep_newest(history.unionByName(keyed, allowMissingColumns=True), n)


def printed(history: DataFrame, sessions: DataFrame, when: str, n: int = KEEP) -> tuple[DataFrame, DataFrame]:
    """Sessions (user_email, timestamp, candidates, ...) with candidates are saved, without a title, and printed: the history then, and one page (user_email, timestamp, pos, report) for each candidate. The pages are the text reports; a browser's PDF is out of scope."""
    from hirelens.sources.exports import report

    some = sessions.filter(F.size("candidates") > 0)
    pages = some.select("user_email", "timestamp", F.posexplode("candidates").alias("pos", "c")).select("user_email", "timestamp", F.col("pos").cast("bigint").alias("pos"), "c.*")
    return save(history, some.withColumn("jobTitle", F.lit("")), n), pages.select("user_email", "timestamp", "pos", report(when).alias("report"))


def clear(history: DataFrame, user: str) -> DataFrame:  # U3
    return history.filter(F.col("user_email") != user)


def labels(sessions: DataFrame, title: str = "jobTitle", tie: str = "id") -> DataFrame:
    """The title, or "Session N", 1 the oldest."""
    newest = Window.partitionBy("user_email").orderBy(F.col("timestamp").desc(), F.col(tie).desc())
    n = F.count("*").over(Window.partitionBy("user_email")) - F.row_number().over(newest) + 1
    return sessions.withColumn("label", F.coalesce(F.nullif(F.col(title), F.lit("")), F.concat(F.lit("Session "), n.cast("string"))))


def completed(candidates: str = "candidates") -> Column:
    """P14, A7."""
    return F.size(F.filter(F.coalesce(F.col(candidates), F.array()), lambda c: c.status == "completed")).cast("bigint")


def mean_of(candidates: str = "candidates") -> Column:
    """A4: the rounded mean of a session's scores, null if it has none."""
    s = F.filter(F.transform(F.col(candidates), lambda c: c.matchResults.matchScore), lambda x: x.isNotNull())
    return F.when(F.size(s) > 0, rounded(F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s)))


def summary(sessions: DataFrame) -> DataFrame:
    """A4, A7, A8 of nested sessions."""
    return sessions.select("user_email", "id", completed().alias("completed"), F.size("candidates").cast("bigint").alias("total"), mean_of().alias("avg_score"), F.coalesce(F.size("jobAnalysis.keySkills"), F.lit(0)).cast("bigint").alias("key_skills"))


def restore(history: DataFrame, id_: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The job, the candidates in order, and the id of the first."""
    one = history.filter(F.col("id") == id_)
    rows = one.select(F.posexplode("candidates").alias("pos", "c")).select(F.col("pos").cast("bigint").alias("pos"), "c.*")
    return one.select("jobAnalysis.*"), rows, rows.agg(F.min_by("id", "pos").alias("id"))
