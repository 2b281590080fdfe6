"""Golden rows of the operators, with the reference's quirks."""

import csv
import io
import json
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from hirelens import schemas
from hirelens.operators import backends, history, integrity_tables, pool, postings, ranking, requirements, scoring, validation
from hirelens.plans import records, screening
from hirelens.sources import documents, exports, files
from hirelens.streaming import logs
from tests.check_parity import compare

CANDIDATE = f"pos bigint, {schemas.CANDIDATE}"


def scores(spark, values):
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in enumerate(values)], "pos bigint, score double")


def test_means_and_order(spark):
    two = scores(spark, [80.0, None]).withColumn("shortlisted", F.lit(True))
    assert pool.statistics(two).first().asDict() == {"total": 2, "shortlisted": 2, "avg_score": "80", "any_scored": True}
    assert ranking.export_summary(two).first().averageMatchScore == 40
    assert pool.statistics(scores(spark, [62.0, 63.0]).withColumn("shortlisted", F.lit(False))).first().avg_score == "63"
    none = two.limit(0)
    assert pool.statistics(none).first().avg_score == "--" and ranking.export_summary(none).first().averageMatchScore == 0
    order = scores(spark, [None, 0.0, 90.0, 90.0])
    assert [r.pos for r in ranking.in_order(order).collect()] == [2, 3, 1, 0]
    assert {r.pos: r["rank"] for r in ranking.ranked(order).collect()} == {2: 1, 3: 2, 1: 3, 0: 4}
    assert [r.score for r in ranking.top_candidates(scores(spark, [75, 75.1, 100, 76, 77, 78, 79])).collect()] == [100, 79, 78, 77, 76]
    assert ranking.scored(order).count() == 3 and ranking.high(order).count() == 2


def log(spark, rows):
    return spark.createDataFrame([("a", s, s, op, flag, score) for s, (op, flag, score) in enumerate(rows)], "id string, t long, seq long, op string, shortlisted boolean, score double").withColumn("ts", F.timestamp_seconds("t"))


def test_fold(spark):
    def state(*rows):
        got = pool.fold(log(spark, rows), ("score",)).collect()
        return (got[0].shortlisted, int(got[0].addedAt.timestamp()), got[0].score) if got else None

    add, toggle, remove = lambda s, f=False: ("add", f, s), ("toggle", False, None), ("remove", False, None)
    assert state(add(80.0), toggle, add(None)) == (True, 0, None)
    assert state(add(1.0), toggle, remove, add(2.0)) == (False, 3, 2.0)
    assert state(toggle, toggle, add(1.0), toggle) == (True, 2, 1.0)
    assert state(add(1.0, True), toggle, add(3.0)) == (False, 0, 3.0)
    assert state(add(1.0), remove) is None and state(toggle) is None


def test_stream_agrees_with_batch(spark, tmp_path):
    import random

    rng = random.Random(0)
    rows = [(str(rng.randrange(6)), k, k, rng.choice(("add", "toggle", "remove", "add")), rng.random() < 0.3, rng.choice((None, 5.0))) for k in range(300)]
    data = spark.createDataFrame(rows, "id string, t long, seq long, op string, shortlisted boolean, score double").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    want = {(r.id, r.shortlisted, r.addedAt, r.score) for r in pool.fold(data, ("score",)).collect()}
    # three runs of the stream, each with new operations
    for k in range(3):
        data.filter(f"seq >= {100 * k} and seq < {100 * k + 100}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        stream = spark.readStream.schema(data.schema).parquet(f"{tmp_path}/log")
        logs.run_once(logs.fold_pool(stream), f"{tmp_path}/c", lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"), "update")
    got = {(r.id, r.shortlisted, r.addedAt, r.score) for r in logs.latest(spark.read.parquet(f"{tmp_path}/out").drop("batch")).collect()}
    assert got == want


def test_notifications_and_emitter(spark, tmp_path):
    rows = [("u", 1, "add", "1", "one"), ("u", 2, "add", "2", "two"), ("u", 3, "update", "2", "new"), ("u", 4, "update", "1", "old"), ("v", 1, "add", "9", "x"), ("v", 2, "dismiss", None, None), ("w", 1, "add", "5", "y"), ("w", 2, "remove", "5", None)]
    spark.createDataFrame(rows, "channel string, seq long, action string, id string, title string").coalesce(1).write.parquet(f"{tmp_path}/a")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/a").schema).parquet(f"{tmp_path}/a")
    seen, heard, emitter = [], [], logs.Emitter()
    logs.run_once(logs.notifications(stream), f"{tmp_path}/c1", lambda b, n: seen.extend(b.collect()), "update", timeouts=True)
    assert {(r.channel, r.id, r.title, r.open) for r in seen} == {("u", "2", "new", True), ("v", "9", "x", False), ("w", None, None, False)}
    listen = lambda b, n: heard.append(b.count())
    emitter.on("add", listen)
    emitter.on("remove", listen)
    emitter.off("remove", listen)
    logs.run_once(stream, f"{tmp_path}/c2", lambda b, n: emitter.emit(b, n, "action"))
    assert heard == [4]
    signed = spark.createDataFrame([("u", 1, "login"), ("u", 2, "logout"), ("v", 1, "login")], "user string, ts long, kind string")
    assert {r.user: r.signed_in for r in logs.sign_ins(signed).collect()} == {"u": False, "v": True}


def test_search_is_untrimmed(spark):
    p = spark.createDataFrame([("1", "Ann", ["React"], None, True), ("2", "Bob", None, "Reactor", False)], "id string, name string, skills array<string>, jobTitle string, shortlisted boolean")
    ids = lambda q, s=False: [r.id for r in pool.view(p, q, s).orderBy("id").collect()]
    assert ids("react") == ["1", "2"] and ids("react ") == [] and ids("  ") == ["1", "2"] and ids("react", True) == ["1"] and ids("BOB") == ["2"]
    assert [r.label for r in pool.shown(p).orderBy("id").collect()] == ["Shortlisted", "In Pool"]


def candidates(spark):
    info = (["a,b", "c"], [("Lead", "X", None, None)], [], [])
    rows = [(0, "i0", "Ann", "ann.pdf", info, (0.0, "why", ["c"], []), "completed", None), (1, "i1", "", "bob.pdf", None, None, "idle", None), (2, "i2", 'C "x"', "c.pdf", ([], [], [], []), (91.26, None, [], ["z"]), "completed", None)]
    return spark.createDataFrame(rows, CANDIDATE)


def test_exports(spark):
    job = spark.createDataFrame([("T", "First, line\nsecond", ["k"], [], None, "completed")], schemas.JOB_ANALYSIS)
    lines = [r.line for r in exports.export_csv(job, candidates(spark), "now").collect()]
    assert lines[:9] == ["Job Title: First, line", "Analysis Date: now", "", "JOB ANALYSIS", "Key Skills: k", "Required Experience: N/A", "Essential Qualifications: N/A", "", "CANDIDATES"]
    cells = list(csv.reader(io.StringIO("\n".join(lines[9:]))))
    assert cells[0] == list(exports.HEADERS)
    assert cells[1] == ["Ann", "completed", "0.0", "Lead", "a,b; c", "", "why", "ann.pdf"]
    assert cells[2] == ["N/A", "idle", "N/A", "N/A", "N/A", "N/A", "N/A", "bob.pdf"]
    assert cells[3] == ['C "x"', "completed", "91.3", "N/A", "", "z", "N/A", "c.pdf"]
    doc = json.loads("\n".join(r.line for r in exports.export_json(job, candidates(spark), "now").collect()))
    assert doc["exportDate"] == "now" and doc["jobAnalysis"]["title"] == "T"
    assert json.loads("".join(r.line for r in exports.export_json(job, candidates(spark).limit(0), "now").collect()))["candidates"] == []
    assert [c["id"] for c in doc["candidates"]] == ["i0", "i1", "i2"] and "matchScore" not in doc["candidates"][1]
    assert doc["summary"]["totalCandidates"] == 3 and doc["summary"]["averageMatchScore"] == pytest.approx(30.42) and [c["id"] for c in doc["summary"]["topCandidates"]] == ["i2"]
    texts = [r.x for r in candidates(spark).select("pos", exports.report("now").alias("x")).orderBy("pos").collect()]
    assert "MATCH SCORE: N/A" in texts[0] and "  • a,b\n  • c" in texts[0] and "MATCH SCORE: 91.3%" in texts[2] and "  No skills found" in texts[1]


def test_validation(spark):
    def error(column):
        return spark.range(1).select(column.alias("x")).first().x

    by = {n: error(validation.job_error(F.lit(" " + "x" * n + "\n"))) for n in (49, 50, 10_000, 10_001)}
    assert by[49] and by[10_001] and by[50] is by[10_000] is None
    assert error(validation.uri_error(F.lit("http:x"))) and error(validation.uri_error(F.lit(None).cast("string")))
    size = F.concat(F.lit("data:"), F.repeat(F.lit("x"), validation.MOST_BYTES - 5))
    assert error(validation.uri_error(size)) is None and error(validation.uri_error(F.concat(size, F.lit("x"))))
    assert error(validation.match_error(F.lit("x" * 10), F.lit("y" * 9))) and error(validation.match_error(F.lit("x" * 10), F.lit("y" * 10))) is None
    assert [error(validation.matchable(F.lit("idle"), F.lit("x" * n))) for n in (50, 51)] == [False, True]
    assert error(validation.login_error(F.lit("signup"), F.lit("e"), F.lit("p"), F.lit(""), F.lit("l"))) and error(validation.login_error(F.lit("login"), F.lit("e"), F.lit("p"), F.lit(""), F.lit(""))) is None
    assert error(validation.envelope(F.lit(None).cast("string"), F.lit("d"))).asDict() == {"success": True, "data": "d", "error": None, "status": 200}
    assert error(validation.envelope(validation.failed("extract", F.lit("down")), F.lit("d"))).asDict() == {"success": None, "data": None, "error": "Failed to extract resume information: down", "status": 500}
    assert error(validation.envelope(F.lit("Resume content is too short"), F.lit("d"))).status == 400
    steps = [("idle", "start", "processing"), ("processing", "succeed", "completed"), ("processing", "fail", "error"), ("completed", "edit", "idle"), ("idle", "succeed", "idle"), ("idle", "analyze", "analyzing")]
    assert [error(validation.next_status(F.lit(s), F.lit(e))) for s, e, _ in steps] == [x for *_, x in steps]


def test_access(spark):
    rows = [("u", "update", "p", ("1", "r1"), ("1", "r2")), ("u", "update", "p", ("1", "r1"), ("1", "r1")), (None, "get", "p", None, None), ("u", "create", "1", ("1", "r"), None), ("u", "create", "2", ("1", "r"), None), ("u", "delete", "1", None, None)]
    req = spark.createDataFrame(rows, "user string, op string, path_id string, new struct<id: string, resumeId: string>, old struct<id: string, resumeId: string>")
    assert [r.allowed for r in validation.allowed(req).collect()] == [False, True, False, True, False, False]
    assert validation.denied(req).count() == 4


def test_retry():
    waits, calls = [], []

    def fail(model):
        calls.append(model)
        raise RuntimeError(model)

    with pytest.raises(RuntimeError, match="m3"):
        backends.with_retry(["m1", "m2", "m3"], fail, sleep=waits.append, chance=lambda: 0.5)
    assert calls == ["m1"] * 3 + ["m2"] * 3 + ["m3"] * 3 and waits == [2.5, 4.5] * 3
    assert backends.with_retry(["a"], lambda m: m.upper(), sleep=waits.append) == "A"


def test_backends(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, text string")

    def backend(model):
        def call(text):
            if text == "bad":
                raise ValueError("no")
            return {"keySkills": [text], "requiredExperience": [], "essentialQualifications": []}

        return call

    rows = backends.call_model(df, "text", "req", schemas.JOB_REQUIREMENTS, backend, ["m"], sleep=lambda s: None).collect()
    assert rows[0].req.keySkills == ["ok"] and rows[0].error is None and rows[1].req is None and rows[1].error == "Failed to calculate match score: no"
    m = spark.range(1).select(backends.lexical_match(F.array(F.lit("SQL")), F.array(F.lit("sql"), F.lit("git"))).alias("m")).first().m
    assert m.matchScore == 50 and m.matchedSkills == ["sql"] and m.missingSkills == ["git"]
    assert spark.range(1).select(backends.checked(F.struct(F.lit(101.0).alias("matchScore"))).alias("x")).first().x is None
    req = spark.range(1).select(backends.lexical_requirements(F.lit("Python. 5 years of SQL; a degree")).alias("r")).first().r
    assert req.keySkills == ["python", "sql"] and req.requiredExperience == ["5 years of SQL"] and req.essentialQualifications == ["a degree"]


def test_history(spark):
    rows = [("u", f"analysis-{k}", k, "") for k in range(1, 22)]
    h = spark.createDataFrame(rows, "user_email string, id string, timestamp long, jobTitle string")
    assert sorted(r.timestamp for r in history.keep_newest(h).collect()) == list(range(2, 22))
    assert [r.label for r in history.labels(h.filter("timestamp <= 3")).orderBy(F.desc("timestamp")).collect()] == ["Session 3", "Session 2", "Session 1"]
    saved = history.save(h, spark.createDataFrame([(None, 99, "x")], "user_email string, timestamp long, jobTitle string"))
    assert saved.filter("user_email = 'guest'").first().id == "analysis-99"
    assert history.clear(h, "u").count() == 0
    nested = candidates(spark).agg(F.collect_list(F.struct(*[c for c in candidates(spark).columns if c != "pos"])).alias("candidates")).select(F.lit("u").alias("user_email"), F.lit("s").alias("id"), "candidates", F.struct(F.array(F.lit("k")).alias("keySkills")).alias("jobAnalysis"))
    assert history.summary(nested).first().asDict() == {"user_email": "u", "id": "s", "completed": 2, "total": 3, "avg_score": 46, "key_skills": 1}
    job, back, first = history.restore(nested, "s")
    assert job.first().keySkills == ["k"] and back.count() == 3 and first.first().id == "i0"


def test_candidates_and_files(spark, tmp_path):
    (tmp_path / "john.doe.pdf").write_bytes(b"%PDF")
    (tmp_path / "x.txt").write_bytes(b"no")
    found = files.scan(spark, str(tmp_path))
    assert [(r.name, r.uri) for r in found.select("name", files.data_uri("name", "content").alias("uri")).collect()] == [("john.doe.pdf", "data:application/pdf;base64,JVBERg==")]
    assert spark.range(1).select(files.from_data_uri(F.lit("data:x;base64,JVBERg==")).alias("x")).first().x == b"%PDF"
    made = files.candidates_from_files(found.withColumn("pos", F.lit(0).cast("long"))).first()
    assert (made.name, made.fileName, made.status) == ("john", "john.doe.pdf", "idle")
    store = files.open_store(spark, f"{tmp_path}/blobs")
    new = spark.createDataFrame([("a", b"1", 1), ("a", b"2", 2)], "id string, file binary, seq int")
    blobs = files.put(store, new)
    assert [(r.id, bytes(r.file)) for r in blobs.collect()] == [("a", b"2")]
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    assert {r.id: r.file is None for r in files.get(blobs, ids).collect()} == {"a": False, "b": True} and files.delete(blobs, ids).count() == 0
    c = spark.createDataFrame([(0, "f1", "idle"), (1, "f2", "error"), (2, "f1", "completed")], "pos long, fileName string, status string")
    f = spark.createDataFrame([(5, "f1", "late"), (3, "f1", "first")], "pos long, name string, what string")
    assert [(r.pos, r.file.what) for r in ranking.pairs_by_name(c, f).collect()] == [(0, "first")]
    res = spark.createDataFrame([("i1", "completed")], "id string, status string")
    assert {r.id: r.status for r in ranking.with_results(candidates(spark), res, ("status",)).collect()}["i1"] == "completed"
    gap = spark.createDataFrame([(None, None), (1, []), (1, ["x"])], "m int, g array<string>").select(ranking.gap_state("m", "g").alias("s"))
    assert [r.s for r in gap.collect()] == ["provide job context", "perfect match", "gaps"]


def test_documents(spark, tmp_path):
    t = spark.createDataFrame([('[{"id": "1", "title": "T"}]',), ("broken",)], "json string")
    assert [r.id for r in documents.load_json(t, "json", schemas.JOB_POSTINGS).collect()] == ["1"]
    v = documents.save_whole(spark.range(3), str(tmp_path), "t")
    assert spark.read.parquet(v).count() == 3
    base = spark.createDataFrame([("a", {"x": "1"}), ("b", {"x": "1"})], "id string, fields map<string, string>")
    ops = [(1, "a", "update", {"y": "2"}), (2, "b", "delete", None), (3, "c", "update", {"q": "1"}), (4, "d", "merge", {"q": "1"}), (5, "b", "merge", {"z": "9"}), (6, "a", "merge", {"x": "3"}), (7, "d", "set", {"w": "5"})]
    log_ = spark.createDataFrame(ops, "seq long, id string, op string, fields map<string, string>")
    assert {r.id: r.fields for r in documents.apply_writes(base, log_).collect()} == {"a": {"x": "3", "y": "2"}, "b": {"z": "9"}, "d": {"w": "5"}}
    assert documents.transfer(spark.createDataFrame([("e", 1)], "externalId string, a int"), spark.createDataFrame([("e", 2)], "externalId string, a int")).first().remote_a == 2


def test_requirements(spark):
    as_of = F.lit("2024-01-01").cast("date")
    exp = spark.createDataFrame([("r", "Python dev", "2020-01-01", None, ""), ("r", "Chef", "2010-01-01", "2020-01-01", "")], "resumeId string, title string, s string, e string, description string").select("resumeId", "title", F.col("s").cast("date").alias("startDate"), F.col("e").cast("date").alias("endDate"), "description")
    assert requirements.total_years(exp, as_of).first().years == pytest.approx(14)
    need = spark.createDataFrame([("r", "q1", 4.0, ["python"], False), ("r", "q2", 5.0, ["python"], True), ("z", "q3", 1.0, ["x"], False)], "resumeId string, requirementId string, minimumYears double, relevantKeywords array<string>, isPreferred boolean")
    assert {r.requirementId: (r.met, r.blocks) for r in requirements.experience_met(need, exp, as_of).collect()} == {"q1": (True, False), "q2": (False, False), "q3": (False, True)}
    edu = spark.createDataFrame([("r", "BSc", "Computer Science")], "resumeId string, degree string, fieldOfStudy string")
    want = spark.createDataFrame([("r", "a", ["bsc"], ["computer"], False), ("r", "b", ["bsc"], ["law"], False)], "resumeId string, requirementId string, degreeKeywords array<string>, fieldOfStudyKeywords array<string>, isPreferred boolean")
    assert {r.requirementId: r.met for r in requirements.education_met(want, edu).collect()} == {"a": True, "b": False}
    sk = spark.createDataFrame([("1", " SQL", "db"), ("2", "sql", "db"), ("3", "Go", None)], "id string, name string, category string")
    assert {r.category: r.skills for r in requirements.by_category(sk).collect()} == {"db": 1, "uncategorised": 1}
    assert requirements.skills_of(spark.createDataFrame([("o", ["1", "3"])], "id string, skillIds array<string>"), sk).count() == 2
    ranked = spark.createDataFrame([("r", ["SQL", "Go"], 3.0), ("s", ["SQL"], 9.0)], "id string, skills array<string>, years double")
    assert [r.id for r in requirements.with_skills(ranked, ["go", "sql"], 2).collect()] == ["r"]
    ents = {"Resume": spark.createDataFrame([("r",)], "id string"), "Education": spark.createDataFrame([("e", "gone"), ("f", "r")], "id string, resumeId string")}
    assert [(r.child, r.id, r.missing) for r in integrity_tables.violations(ents).collect()] == [("Education", "e", "gone")]
    for ddl in schemas.ENTITIES.values():
        assert spark.createDataFrame([], ddl).count() == 0


def test_experience_without_posts(spark, tmp_path):
    """Without a post no requirement is met, with one that of 0 years is; as the query's SQL has it, with missing values too."""
    exp = spark.createDataFrame([("r", "Chef", None, None, "")], "resumeId string, title string, startDate date, endDate date, description string")
    need = spark.createDataFrame([("r", "a", 0.0, ["python"], False), ("z", "b", 0.0, ["python"], False), ("r", "c", None, ["python"], False)], "resumeId string, requirementId string, minimumYears double, relevantKeywords array<string>, isPreferred boolean")
    assert {r.requirementId: (r.met, r.blocks) for r in requirements.experience_met(need, exp, F.lit("2024-01-01").cast("date")).collect()} == {"a": (True, False), "b": (False, True), "c": (False, True)}
    spark.createDataFrame([(k, n) for k in range(6) for n in (4, 1, None)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(1, "5-LOW", "2000-02-29 00:00:00"), (2, "1-URGENT", None), (3, None, "2001-01-01 00:00:00"), (4, None, None), (4, "1-URGENT", "1999-12-31 23:00:00"), (None, "1-URGENT", None)]
    spark.createDataFrame(orders, "o_custkey long, o_orderpriority string, d string").withColumn("o_orderdate", F.col("d").cast("timestamp")).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert compare(spark, con, "experience_required", records.experience_required, screening.SQL["experience_required"], str(tmp_path)) is None


def test_postings_and_scores(spark):
    form = spark.createDataFrame([(" T ", "We use SQL ", " ", "Here", None, 7), ("", "x", None, None, None, 8)], "title string, description string, department string, location string, type string, createdAt long")
    row = postings.postings(form).collect()
    assert len(row) == 1 and (row[0].id, row[0].title, row[0].keySkills, row[0].department) == ("job-7", "T", ["sql"], None)
    job = spark.createDataFrame([("old", "d", ["stale"], "completed")], "title string, description string, keySkills array<string>, status string")
    now = postings.loaded(job, postings.postings(form)).first()
    assert (now.title, now.keySkills, now.status) == ("T", ["sql"], "idle")
    docs = spark.createDataFrame([(1, "python sql sql"), (2, "cooking"), (3, None)], "doc_id long, text string")
    jobs = spark.createDataFrame([(9, "python sql")], "item_id long, text string")
    got = scoring.tfidf_scores(docs, jobs).collect()
    assert [(r.id, r.job) for r in got] == [(1, 9)] and 0.9 < got[0].score < 1


def test_dismissed_notifications_go(spark, tmp_path):
    """ST7: a dismissed notification is taken away once its time has passed, in the next batch; an open one stays."""
    schema = "channel string, seq bigint, action string, id string, title string"
    shown = {}

    def run(*rows):
        spark.createDataFrame(rows, schema).write.mode("append").json(f"{tmp_path}/in")
        logs.run_once(logs.notifications(spark.readStream.schema(schema).json(f"{tmp_path}/in"), 1), f"{tmp_path}/c", lambda b, n: shown.update({r.channel: (r.id, r.open) for r in b.collect()}), "update", timeouts=True)

    run(("a", 1, "add", "n1", "x"), ("a", 2, "dismiss", None, None), ("b", 1, "add", "n2", "y"))
    assert shown == {"a": ("n1", False), "b": ("n2", True)}
    time.sleep(0.1)
    run(("c", 1, "add", "n3", "z"))
    assert shown == {"a": (None, False), "b": ("n2", True), "c": ("n3", True)}


def test_placeholder_images(spark, tmp_path):
    """S19."""
    (tmp_path / "images.json").write_text('[{"id": "a", "description": "d", "imageUrl": "u", "imageHint": "h"}]')
    assert [tuple(r) for r in documents.placeholder_images(spark, f"{tmp_path}/images.json").collect()] == [("a", "d", "u", "h")]
    (tmp_path / "none.json").write_text("[]")
    assert documents.placeholder_images(spark, f"{tmp_path}/none.json").count() == 0


def test_resume_lines(spark):
    text = "Jane\nSenior Engineer at Acme (2019 - 2022)\nLed a team\nTeacher | School of Art | 2001 to 2004\nMSc, Some College, 2000\nCertified in X"
    got = spark.range(1).select(backends.lexical_resume(F.lit(text)).alias("r")).first().r
    assert [tuple(x) for x in got.experience] == [("Senior Engineer", "Acme", "2019 - 2022", "Led a team")]
    assert [x.degree for x in got.education] == ["", "MSc"] and got.education[1].institution == "Some College" and got.education[1].graduationDate == "2000"
    assert got.certifications == ["Certified in X"]
    empty = spark.range(1).select(backends.lexical_resume(F.lit(None).cast("string")).alias("r")).first().r
    assert empty.skills == empty.experience == empty.education == empty.certifications == []
