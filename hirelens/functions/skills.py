"""Keywords, skill overlap and similarity, as native columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelens.functions.text import array_or_empty, col

#: X4's dictionary; its order is that of the result.
DICTIONARY = "react|python|javascript|typescript|java|c++|node.js|aws|azure|gcp|docker|kubernetes|sql|mongodb|machine learning|deep learning|tensorflow|pytorch|nlp|rest api|graphql|git|ci/cd|agile|scrum|html|css|vue|angular|flask|django|spring".split("|")


def keywords(text: str | Column, dictionary: Sequence[str] = DICTIONARY, most: int = 8) -> Column:
    """Terms that stand anywhere in the text, inside other words too, in dictionary order, the first `most`."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return F.slice(F.filter(F.array(*[F.lit(x) for x in dictionary]), lambda k: F.contains(low, k)), 1, most)


def normal_skills(c: str | Column) -> Column:
    return F.array_distinct(F.transform(array_or_empty(c), lambda s: F.lower(F.trim(s))))


def matched(resume: str | Column, job: str | Column) -> Column:  # U6
    return F.array_intersect(normal_skills(job), normal_skills(resume))


def missing(resume: str | Column, job: str | Column) -> Column:  # U6
    return F.array_except(normal_skills(job), normal_skills(resume))


def skill_weight(resume: str | Column, job: str | Column) -> Column:
    """D3: the share of the job's skills that the résumé has; null if the job names none."""
    n = F.size(normal_skills(job))
    return F.when(n > 0, F.size(matched(resume, job)) / n)


def cosine(a: str | Column, b: str | Column) -> Column:
    """D2, in double; null if a length is zero."""
    x, y = col(a).cast("array<double>"), col(b).cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm)


def final_score(tfidf: str | Column, bert: str | Column, skill: str | Column, weights: tuple[float, float, float] = (0.4, 0.4, 0.2)) -> Column:
    """The weighted mean, of 100, of those that are there; null if none is."""
    parts = [(col(c), w) for c, w in zip((tfidf, bert, skill), weights)]
    have = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.when(have > 0, 100 * sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts), F.lit(0.0)) / have)


#: D1's tokens, in small letters.
TERM = "[a-z0-9+#.]+"


def terms(c: str | Column) -> Column:
    """D1's tokens, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(TERM), F.lit(0))
