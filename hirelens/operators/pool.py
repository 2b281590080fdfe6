"""The talent pool: search, statistics, and the fold of its operation log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelens.functions.text import safe_job_title, trim
from hirelens.operators.ranking import mean_score


def shortlisted(pool: DataFrame) -> DataFrame:  # P1
    return pool.filter("shortlisted")


def search(pool: DataFrame, query: str) -> DataFrame:
    """The query in small letters, as typed with its blanks, stands in the name, a skill or the job title. A blank query finds all."""
    if not query.strip():
        return pool
    q = F.lit(query.lower())
    has = lambda c: F.coalesce(F.contains(F.lower(c), q), F.lit(False))
    return pool.filter(has(F.col("name")) | F.coalesce(F.exists("skills", lambda s: F.contains(F.lower(s), q)), F.lit(False)) | has(F.col("jobTitle")))


def view(pool: DataFrame, query: str = "", only_shortlisted: bool = False) -> DataFrame:
    """The cheap flag first, then the text."""
    return search(shortlisted(pool) if only_shortlisted else pool, query)


def statistics(pool: DataFrame) -> DataFrame:
    """A1, A2, A3, A9 over the whole pool; the mean is "--" if nobody has a score."""
    return pool.agg(F.count("*").alias("total"), F.count_if("shortlisted").alias("shortlisted"), F.coalesce(mean_score().cast("string"), F.lit("--")).alias("avg_score"), F.coalesce(F.bool_or(F.col("score").isNotNull()), F.lit(False)).alias("any_scored"))


def shown(pool: DataFrame, most: int = 5) -> DataFrame:
    """The first skills, how many more there are, and the label."""
    n = F.coalesce(F.size("skills"), F.lit(0))
    return pool.withColumns({"shownSkills": F.slice("skills", 1, most), "moreSkills": F.greatest(n - most, F.lit(0)).cast("bigint"), "label": F.when(F.col("shortlisted"), "Shortlisted").otherwise("In Pool")})


def pool_row(candidate: DataFrame) -> DataFrame:
    """What an analysed candidate adds to the pool; candidate has title and description of the job too."""
    return candidate.select("id", "name", "fileName", F.coalesce("extractedInfo.skills", F.array().cast("array<string>")).alias("skills"), F.col("matchResults.matchScore").alias("matchScore"), safe_job_title("title", "description").alias("jobTitle"), "extractedInfo", "matchResults", F.lit(False).alias("shortlisted"))


def fold(log: DataFrame, payload: tuple[str, ...]) -> DataFrame:
    """The pool after a log (id, ts, seq, op, shortlisted, *payload) of add, toggle and remove, in order of (ts, seq).

    An add lays its whole payload over the old one, nulls too, keeps addedAt and the flag if it was set; a toggle turns the flag; a remove forgets all. Toggles of unknown ids do nothing. Newest first by addedAt.

    One shuffle, by id; windows that spill, rather than a list of each id's operations in memory."""
    of = Window.partitionBy("id")
    at = F.struct("ts", "seq")
    is_ = lambda *ops: F.col("op").isin(*ops)
    live = log.withColumn("at", at).withColumn("removed", F.max(F.when(is_("remove"), F.col("at"))).over(of)).filter("removed is null or at > removed")
    known = live.withColumns({"born": F.min(F.when(is_("add"), F.col("at"))).over(of), "flagged": F.max(F.when(is_("add") & F.col("shortlisted"), F.col("at"))).over(of)}).filter("born is not null")
    turns = F.count_if(is_("toggle") & (F.col("at") > F.coalesce("flagged", "born")))
    flag = (turns + F.max(F.col("flagged").isNotNull().cast("int"))) % 2 == 1
    return known.groupBy("id").agg(flag.alias("shortlisted"), F.min("born.ts").alias("addedAt"), F.max_by(F.struct(*payload), F.when(is_("add"), F.col("at"))).alias("p")).select("id", "shortlisted", "addedAt", *[F.col(f"p.{c}").alias(c) for c in payload])


def newest_first(table: DataFrame, added: str = "addedAt") -> DataFrame:  # O4, U2
    return table.orderBy(F.col(added).desc(), "id")


def blank(c: str):  # noqa: ANN201  # V5
    return F.coalesce(trim(c), F.lit("")) == ""
