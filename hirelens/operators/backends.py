"""The three model operators behind a protocol, with retry and fallback. The default backend is lexical and needs no network."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol, TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.functions.skills import DICTIONARY, keywords, matched, missing, skill_weight
from hirelens.functions.text import backoff_ms, col, falsy_to
from hirelens.operators.validation import FAILED
from hirelens.schemas import JOB_REQUIREMENTS, LLM_MATCH, RESUME_INFO

T = TypeVar("T")


class Backend(Protocol):
    """A model; each method may raise, and is then tried again."""

    def requirements(self, description: str) -> dict: ...
    def resume(self, text: str) -> dict: ...
    def match(self, prompt: str) -> dict: ...


def with_retry(models: Sequence[str], call: Callable[[str], T], attempts: int = 3, sleep: Callable[[float], None] = time.sleep, chance: Callable[[], float] = random.random) -> T:
    """Each model in turn, each so often, with a growing wait after all its attempts but the last; the last error if none succeeds."""
    error: Exception = ValueError("no model")
    for model in models:
        for attempt in range(attempts):
            try:
                return call(model)
            except Exception as e:  # noqa: BLE001 - any failure of a model is tried again
                error = e
                if attempt < attempts - 1:
                    sleep(backoff_ms(attempt, chance()) / 1000)
    raise error


#: The heading of the criteria in a prompt.
CRITERIA = "Additional Specific Hiring Criteria to prioritize (if applicable)"


def criteria_block(criteria: str | Column) -> Column:
    """A heading and one line for each criterion, each ended; '' if there are none."""
    c = F.coalesce(col(criteria), F.array().cast("array<string>"))
    return F.when(F.size(c) > 0, F.concat(F.lit(f"{CRITERIA}:\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""))).otherwise("")


def match_prompt(resume: str | Column, job: str | Column, criteria: str | Column) -> Column:
    return F.concat(F.lit("Rate the candidate for the job from 0 to 100.\nCandidate:\n"), col(resume), F.lit("\nJob:\n"), col(job), F.lit("\n"), criteria_block(criteria))


def checked(result: str | Column) -> Column:
    """The result if its score is from 0 to 100, else null, which counts as a failed call."""
    r = col(result)
    return F.when(r["matchScore"].between(0, 100), r)


def lexical_requirements(description: str | Column) -> Column:
    """X1's shape from the dictionary; sentences that name years or a degree are its experience and qualifications."""
    sentences = F.filter(F.split(col(description), r"[.;\n]+"), lambda s: F.trim(s) != "")
    pick = lambda p: F.transform(F.filter(sentences, lambda s: F.rlike(s, F.lit(p))), lambda s: F.trim(s))
    return F.struct(keywords(description, most=len(DICTIONARY)).alias("keySkills"), pick(r"(?i)\byears?\b|experience").alias("requiredExperience"), pick(r"(?i)degree|bachelor|master|certif|phd").alias("essentialQualifications")).cast(JOB_REQUIREMENTS)


#: A line with a span of years ("2019 - 2022", "2021 to present"), and words that make it a school's or a certificate's.
SPAN = r"(?i)\b(?:19|20)\d\d\s*(?:-|–|to)\s*(?:(?:19|20)\d\d|present|now|current)\b"
SCHOOL, CERTIFICATE, DEGREE = r"(?i)\b(?:university|college|school|institute|academy)\b", r"(?i)\bcertifi", r"(?i)\b(?:bachelor|master|doctor|phd|diploma|associate|b\.?sc|m\.?sc|b\.?a|m\.?a|mba)\b"


def lexical_resume(text: str | Column) -> Column:
    """X2's shape by rules, line by line: skills by the dictionary; a line with a span of years is a post ("title, company, span"; the line after it, if it has none, describes it); a line that names a degree or a school is education, its last year the graduation; a line that speaks of a certificate is one."""
    lines = F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    of = lambda line, p: F.regexp_extract(line, p, 0)
    part = lambda line, k: F.trim(F.coalesce(F.get(F.split(F.trim(F.regexp_replace(line, r"[(|,\s-]*" + SPAN + r".*$", "")), r"\s*(?:,|\||\bat\b)\s*"), F.lit(k)), F.lit("")))
    school = lambda s: F.rlike(s, F.lit(SCHOOL)) | F.rlike(s, F.lit(DEGREE))
    certificate = lambda s: F.rlike(s, F.lit(CERTIFICATE)) & ~school(s)
    post = lambda s: F.rlike(s, F.lit(SPAN)) & ~school(s) & ~certificate(s)
    paired = F.transform(lines, lambda s, k: F.struct(s.alias("line"), F.coalesce(F.get(lines, k + 1), F.lit("")).alias("next")))
    plain = lambda s: F.when(post(s) | school(s) | certificate(s), "").otherwise(s)
    experience = F.transform(F.filter(paired, lambda p: post(p.line)), lambda p: F.struct(part(p.line, 0).alias("title"), part(p.line, 1).alias("company"), of(p.line, SPAN).alias("duration"), plain(p.next).alias("description")))
    pieces = lambda s: F.split(s, r"\s*(?:,|\|)\s*")
    first = lambda s, p: F.coalesce(F.get(F.filter(pieces(s), lambda x: F.rlike(x, F.lit(p))), F.lit(0)), F.lit(""))
    education = F.transform(F.filter(lines, school), lambda s: F.struct(first(s, DEGREE).alias("degree"), first(s, SCHOOL).alias("institution"), F.regexp_extract(s, r"((?:19|20)\d\d)(?!.*(?:19|20)\d\d)", 1).alias("graduationDate")))
    return F.struct(keywords(text, most=len(DICTIONARY)).alias("skills"), experience.alias("experience"), education.alias("education"), F.filter(lines, certificate).alias("certifications")).cast(RESUME_INFO)


def lexical_match(skills: str | Column, wanted: str | Column) -> Column:
    """X3's shape: 100 times the share of wanted skills; 0 if none is wanted."""
    score = F.coalesce(100.0 * skill_weight(skills, wanted), F.lit(0.0))
    had, gaps = matched(skills, wanted), missing(skills, wanted)
    return F.struct(score.alias("matchScore"), F.concat(F.size(had).cast("string"), F.lit(" of "), (F.size(had) + F.size(gaps)).cast("string"), F.lit(" required skills found")).alias("reasons"), had.alias("matchedSkills"), gaps.alias("missingSkills")).cast(LLM_MATCH)


def call_model(table: DataFrame, column: str, out: str, schema: str, backend: Callable[[str], Callable[[str], dict]], models: Sequence[str], sleep: Callable[[float], None] = time.sleep, operation: str = "match") -> DataFrame:
    """X1-X3 by a model: backend(model) gives the call; out is null and error says why where all attempts of the operation (analyze, extract or match) failed (S16, V8). Rows are sent by the partition, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got, errors = [], []
            for text in batch[column]:
                try:
                    got.append(with_retry(models, lambda m, t=text: backend(m)(t), sleep=sleep))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    got.append(None)
                    errors.append(f"{FAILED[operation]}{e}")
            yield batch.assign(**{out: got, "error": errors})

    return table.mapInPandas(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema] + [f"`{out}` {schema}", "error string"]))


def client_result(response: str | Column, operation: str) -> Column:
    """What a caller gets of an envelope: its data, or what is thrown, the error or a default if that is empty."""
    r = col(response)
    ok = F.coalesce(r["success"], F.lit(False))
    return F.struct(F.when(ok, r["data"]).alias("data"), F.when(~ok, falsy_to(r["error"], FAILED[operation].rstrip(": "))).alias("thrown"))


def analysed(candidates: DataFrame) -> DataFrame:
    """Where matching failed (matchError) the extraction stands, completed, without a match."""
    return candidates.withColumns({"matchResults": F.when(F.col("matchError").isNull(), F.col("matchResults")), "status": F.when(F.col("extractedInfo").isNotNull(), "completed").otherwise("error")})
