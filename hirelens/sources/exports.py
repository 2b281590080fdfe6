"""CSV, JSON and text exports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.functions.text import array_or_empty, csv_field, falsy_to, first_piece, to_fixed1
from hirelens.operators.ranking import export_summary

HEADERS = tuple("Candidate Name|Status|Match Score|Current Position|Skills|Missing Skills|Strategic Assessment|Resume File".split("|"))
NONE = "N/A"


def position(info: str = "extractedInfo") -> Column:
    """The title of the first experience, null if anything on the way is."""
    return F.get(F.col(f"{info}.experience"), F.lit(0))["title"]


def csv_columns() -> list[Column]:
    """P10: the eight cells of a candidate."""
    score = F.col("matchResults.matchScore")
    joined = lambda c: F.coalesce(F.array_join(F.col(c), "; "), F.lit(NONE))
    cells = (falsy_to("name", NONE), falsy_to("status", NONE), F.when(score.isNull(), NONE).otherwise(to_fixed1(score)), falsy_to(position(), NONE), joined("extractedInfo.skills"), joined("matchResults.missingSkills"), falsy_to("matchResults.reasons", NONE), falsy_to("fileName", NONE))
    return [c.alias(h) for c, h in zip(cells, HEADERS)]


def csv_rows(candidates: DataFrame) -> DataFrame:
    """(pos, line) of each candidate."""
    return candidates.select("pos", *csv_columns()).select("pos", F.concat_ws(",", *[csv_field(h) for h in HEADERS]).alias("line"))


def csv_preamble(job: DataFrame, when: str) -> DataFrame:
    """(pos, line) of the lines above the rows, unescaped; pos from -10 up."""
    listed = lambda c: falsy_to(F.coalesce(F.array_join(F.col(c), ", "), F.lit("")), NONE)
    lines = [F.concat(F.lit("Job Title: "), F.when(F.coalesce(F.col("description"), F.lit("")) == "", NONE).otherwise(first_piece("description", "\n"))), F.lit(f"Analysis Date: {when}"), F.lit(""), F.lit("JOB ANALYSIS")]
    lines += [F.concat(F.lit(f"{label}: "), listed(c)) for label, c in (("Key Skills", "keySkills"), ("Required Experience", "requiredExperience"), ("Essential Qualifications", "essentialQualifications"))]
    lines += [F.lit(""), F.lit("CANDIDATES"), F.lit(",".join(HEADERS))]
    return job.limit(1).select(F.posexplode(F.array(*lines)).alias("at", "line")).select((F.col("at") - len(lines)).cast("bigint").alias("pos"), "line")


def export_csv(job: DataFrame, candidates: DataFrame, when: str) -> DataFrame:
    """All lines in order; write the line column as text."""
    return csv_preamble(job, when).unionByName(csv_rows(candidates).withColumn("pos", F.col("pos").cast("bigint"))).orderBy("pos")


def json_candidates(candidates: DataFrame) -> DataFrame:
    """What the JSON export has of each candidate."""
    return candidates.select("pos", F.struct("id", "name", "fileName", "status", F.col("matchResults.matchScore").alias("matchScore"), F.col("matchResults.reasons").alias("strategicAssessment"), "extractedInfo").alias("candidate"))


def export_json(job: DataFrame, candidates: DataFrame, when: str) -> DataFrame:
    """(pos, line), the lines of one JSON document in order: date and job, one line for each candidate, summary. Write the line column as text; no task holds the whole."""
    last, one = candidates.agg(F.max("pos").alias("last")), json_candidates(candidates)
    top = candidates.filter(F.col("matchResults.matchScore") > 75).orderBy(F.col("matchResults.matchScore").desc(), "pos").limit(5)
    top = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("matchResults.matchScore")).alias("k"), "pos", F.struct(*[c for c in candidates.columns if c != "pos"]).alias("c")))), lambda x: x.c).alias("topCandidates"))
    summary = export_summary(candidates.select("pos", F.col("matchResults.matchScore").alias("score"))).crossJoin(top)
    head = job.limit(1).select(F.lit(-1).cast("bigint").alias("pos"), F.concat(F.lit(f'{{"exportDate":{json.dumps(when)},"jobAnalysis":'), F.to_json(F.struct("*")), F.lit(',"candidates":[')).alias("line"))
    body = one.crossJoin(F.broadcast(last)).select(F.col("pos").cast("bigint").alias("pos"), F.concat(F.to_json("candidate"), F.when(F.col("pos") < F.col("last"), ",").otherwise("")).alias("line"))
    tail = summary.select(F.lit((1 << 63) - 1).cast("bigint").alias("pos"), F.concat(F.lit('],"summary":'), F.to_json(F.struct("totalCandidates", "averageMatchScore", "topCandidates")), F.lit("}")).alias("line"))
    return head.unionByName(body).unionByName(tail).orderBy("pos")


def report(when: str) -> Column:
    """A candidate's report as text; a score of 0 counts as none."""
    score, rule = F.col("matchResults.matchScore"), "=" * 40
    bullets = lambda c, none: F.when(F.size(array_or_empty(c)) > 0, F.array_join(F.transform(array_or_empty(c), lambda s: F.concat(F.lit("  • "), s)), "\n")).otherwise(none)
    label = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    blocks = [
        F.lit("\nCANDIDATE ANALYSIS REPORT\n" + rule),
        F.concat_ws("\n", label("Name", falsy_to("name", NONE)), label("Current Position", falsy_to(position(), NONE)), label("Resume File", falsy_to("fileName", NONE))),
        label("MATCH SCORE", F.when(F.coalesce(score, F.lit(0.0)) == 0, NONE).otherwise(F.concat(to_fixed1(score), F.lit("%")))),
        F.concat(F.lit("SKILLS:\n"), bullets("extractedInfo.skills", "  No skills found")),
        F.concat(F.lit("MISSING SKILLS:\n"), bullets("matchResults.missingSkills", "  No missing skills")),
        F.concat(F.lit("STRATEGIC ASSESSMENT:\n"), falsy_to("matchResults.reasons", "No assessment available")),
        F.lit(f"{rule}\nGenerated: {when}\n"),
    ]
    return F.concat_ws("\n\n", *blocks)
