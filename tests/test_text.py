"""Golden rows of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from hirelens.functions import skills as S
from hirelens.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("value", "want"), [(1.45, "1.4"), (0.25, "0.3"), (8.35, "8.3"), (80.0, "80.0"), (None, None), (0.0, "0.0")])
def test_to_fixed1(spark, value, want):
    assert one(spark, T.to_fixed1(F.lit(value).cast("double"))) == want


@pytest.mark.parametrize(("value", "want"), [("a,b", '"a,b"'), ('x"y', '"x""y"'), ("l\nm", '"l\nm"'), ("p\rq", "p\rq"), ("", ""), (None, "")])
def test_csv_field(spark, value, want):
    assert one(spark, T.csv_field(F.lit(value).cast("string"))) == want


@pytest.mark.parametrize(("value", "want"), [("tp-x9-1", "x9"), ("tp-x9", "tp-x9"), ("x9", "x9")])
def test_blob_id(spark, value, want):
    assert one(spark, T.blob_id(F.lit(value))) == want


@pytest.mark.parametrize(("value", "want"), [("john.doe.pdf", "john"), (".pdf", ""), ("none", "none")])
def test_file_stem(spark, value, want):
    assert one(spark, T.file_stem(F.lit(value))) == want


@pytest.mark.parametrize(("title", "description", "want"), [("", "", "Unknown Role"), (None, "first\nsecond", "first"), ("T", "x", "T"), ("", "a" * 70, "a" * 60)])
def test_safe_job_title(spark, title, description, want):
    assert one(spark, T.safe_job_title(F.lit(title).cast("string"), F.lit(description))) == want


@pytest.mark.parametrize(("seconds", "want"), [(59, "Just now"), (60, "1m ago"), (3600, "1h ago"), (86400, "1d ago"), (7 * 86400, "1/3/2024"), (-5, "Just now"), (3599, "59m ago")])
def test_time_ago(spark, seconds, want):
    as_of = F.lit("2024-01-10 00:00:00").cast("timestamp")
    assert one(spark, T.time_ago(F.timestamp_seconds(F.unix_seconds(as_of) - seconds), as_of)) == want


def test_rest(spark):
    assert one(spark, T.rounded(F.lit(-2.5))) == -2 and one(spark, T.rounded(F.lit(62.5))) == 63
    assert one(spark, T.utf16_length(F.lit("a😀"))) == 3
    assert one(spark, T.trim(F.lit(" ﻿\n x  "))) == "x"
    assert one(spark, T.trim(F.lit("\u0085x"))) == "\u0085x"
    assert one(spark, T.truncated(F.lit("a" * 201))) == "a" * 200 + "..." and one(spark, T.truncated(F.lit("a" * 200))) == "a" * 200
    assert one(spark, T.storage_key(F.lit(""))) == "resume-screener-history-guest"
    assert one(spark, T.full_name(F.lit("signup"), F.lit("A"), F.lit("B"))) == "A B" and one(spark, T.full_name(F.lit("login"), F.lit("A"), F.lit("B"))) == "System User"
    assert [one(spark, T.counted(F.lit(n), "candidate")) for n in (0, 1, 2)] == ["0 candidates", "1 candidate", "2 candidates"]
    assert len(one(spark, T.stable_id(F.lit(1)))) == 9
    assert one(spark, T.prefixed_id("job", F.lit(5))) == "job-5"
    assert one(spark, T.iso_time(F.lit("2024-01-02 03:04:05.006").cast("timestamp"))) == "2024-01-02T03:04:05.006Z"
    assert one(spark, T.locale_time(F.lit("2024-01-02 15:04:05").cast("timestamp"))) == "1/2/2024, 3:04:05 PM"
    assert one(spark, T.quotient(F.lit(119_999), 60_000)) == 1 and one(spark, T.starts_with(F.lit("data:x"), "data:"))
    assert one(spark, T.clean_text(F.lit("  C++ & Node.js!  "))) == "c++ node.js"
    assert one(spark, T.falsy_to(F.lit(""), "N/A")) == "N/A"
    assert T.backoff_ms(1, 0.5) == 4500


def test_skills(spark):
    assert one(spark, S.keywords(F.lit("JavaScript and digital SQL"))) == ["javascript", "java", "sql", "git"]
    assert one(spark, S.keywords(F.lit(" ".join(S.DICTIONARY[:10])))) == S.DICTIONARY[:8]
    r, j = F.array(*map(F.lit, ("Go", "SQL "))), F.array(*map(F.lit, ("sql", "rust", "SQL")))
    assert one(spark, S.matched(r, j)) == ["sql"] and one(spark, S.missing(r, j)) == ["rust"] and one(spark, S.skill_weight(r, j)) == 0.5
    assert one(spark, S.skill_weight(r, F.array().cast("array<string>"))) is None
    assert one(spark, S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.70710678)
    assert one(spark, S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert one(spark, S.final_score(F.lit(0.5), F.lit(None).cast("double"), F.lit(1.0))) == pytest.approx(100 * 0.4 / 0.6)
