"""Filters, order, top-k and totals over candidates (pos, score, ...)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelens.functions.text import rounded

PENDING = ("idle", "error", "processing")


def pending(candidates: DataFrame) -> DataFrame:  # P4
    return candidates.filter(F.col("status").isin(*PENDING))


def scored(candidates: DataFrame) -> DataFrame:
    """P5: a score of 0 counts."""
    return candidates.filter(F.col("score").isNotNull())


def high(candidates: DataFrame, above: float = 75) -> DataFrame:  # P6
    return candidates.filter(F.col("score") > above)


def without(table: DataFrame, ids: DataFrame) -> DataFrame:  # P7
    return table.join(ids, "id", "left_anti")


def first_match(table: DataFrame, id_: object, key: str = "id") -> DataFrame:
    """The first row with the id, by pos."""
    return table.filter(F.col(key) == F.lit(id_)).orderBy("pos").limit(1)


def updated(table: DataFrame, where: Column, changes: dict[str, Column]) -> DataFrame:
    """New values where the condition holds."""
    return table.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in changes.items()})


def in_order(candidates: DataFrame) -> DataFrame:
    """O1: by score, none as -1, then as they came."""
    return candidates.orderBy(F.coalesce("score", F.lit(-1.0)).desc(), F.col("pos").asc())


def ranked(candidates: DataFrame, by: str | None = None) -> DataFrame:
    """O1 and O6 as a column: the rank in each group, or in all.

    Ranks are counted inside each whole score of a group, and start after all that are higher, which a small table has; so no group, however large, comes to one task unless all its scores are alike."""
    group, score = [by] if by else [], F.coalesce("score", F.lit(-1.0))
    rows = candidates.withColumn("_whole", F.floor(score))
    higher = F.sum("_n").over(Window.partitionBy(*group).orderBy(F.desc("_whole")).rowsBetween(Window.unboundedPreceding, -1))
    start = rows.groupBy(*group, "_whole").agg(F.count("*").alias("_n")).select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_whole").alias("_of"), F.coalesce(higher, F.lit(0)).alias("_higher"))
    own = F.row_number().over(Window.partitionBy(*group, "_whole").orderBy(score.desc(), F.col("pos").asc()))
    same = functools.reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_{c}")), group, F.col("_whole") == F.col("_of"))
    return rows.withColumn("_own", own).join(start, same).select(*candidates.columns, (F.col("_own") + F.col("_higher")).cast("bigint").alias("rank"))


def top_candidates(candidates: DataFrame, n: int = 5, above: float = 75) -> DataFrame:  # O2
    return high(candidates, above).orderBy(F.col("score").desc(), F.col("pos").asc()).limit(n)


def first_id(table: DataFrame) -> DataFrame:  # O5
    return table.agg(F.min_by("id", "pos").alias("id"))


def export_summary(candidates: DataFrame) -> DataFrame:
    """The count, and the mean with missing scores as 0, not rounded."""
    return candidates.agg(F.count("*").alias("totalCandidates"), F.coalesce(F.avg(F.coalesce("score", F.lit(0.0))), F.lit(0.0)).alias("averageMatchScore"))


def mean_score(score: str = "score") -> Column:
    """A3, A4: the rounded mean of the scores there are; null if there are none."""
    return rounded(F.avg(score))


def score_label(score: str | Column) -> Column:  # P24
    return F.coalesce((F.col(score) if isinstance(score, str) else score).cast("string"), F.lit("--"))


def gap_state(match: str, missing: str) -> Column:  # P22
    return F.when(F.col(match).isNull(), "provide job context").when(F.coalesce(F.size(missing), F.lit(0)) <= 0, "perfect match").otherwise("gaps")


def unnested(table: DataFrame, array: str, name: str, *keep: str) -> DataFrame:
    """One row an entry, in order; one with nulls if there is none."""
    return table.select(*keep, F.posexplode_outer(array).alias("at", name))


def pairs_by_name(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Pending candidates with the first file of their fileName; those without one are left out."""
    first = files.groupBy("name").agg(F.min_by(F.struct(*[c for c in files.columns if c != "name"]), "pos").alias("file"))
    return pending(candidates).join(first, F.col("fileName") == F.col("name"))


def against_job(candidates: DataFrame, job: DataFrame) -> DataFrame:
    """Every candidate with the one job, if that is analysed or long enough. The broadcast side is one row."""
    one = job.limit(1).filter((F.col("jobStatus") == "completed") | (F.length("description") > 50))
    return candidates.crossJoin(F.broadcast(one))


def with_results(candidates: DataFrame, results: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Results laid over the candidates by id."""
    new = results.select("id", *[F.col(c).alias(f"new_{c}") for c in columns])
    return candidates.join(new, "id", "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in columns}).drop(*[f"new_{c}" for c in columns])


def appended(candidates: DataFrame, new: DataFrame) -> DataFrame:
    """Union all; new rows stand after those there are, as pos says."""
    return candidates.unionByName(new)


def visible_tabs(role: str | Column) -> Column:
    """The parts that a role sees, the first by default; a candidate can't change postings."""
    r = F.col(role) if isinstance(role, str) else role
    tabs = lambda *names: F.array(*map(F.lit, names))
    return F.when(r == "recruiter", tabs("talent-pool", "job-postings")).when(r == "candidate", tabs("active-match", "job-postings", "history")).otherwise(tabs("job-postings"))
