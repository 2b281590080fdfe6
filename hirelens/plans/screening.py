"""Queries over the driver's tables, by name, and the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.functions import skills as S
from hirelens.functions import text as T
from hirelens.operators import backends, history, integrity_tables, pool, postings, ranking, requirements, scoring, validation
from hirelens.plans.adapters import AS_OF, CANDIDATES, POOL, candidates, pool_log, table
from hirelens.plans.adapters import pool as pool_table
from hirelens.sources import exports, files
from hirelens.streaming import logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WORDS = ("that", "with", "this", "from", "tion", "data")


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9+#.]+'), lambda x: x <> '')"
TF = f"tf AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents), w AS (SELECT id, tf.term, tf, df, tf * (ln((n + 1.0) / (df + 1.0)) + 1.0) AS weight FROM tf JOIN df USING (term), n)"
JOBS = f"jtf AS (SELECT item_id AS job, term, count(*) AS tf FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL), jw AS (SELECT job, jtf.term, jtf.tf * (ln((n + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0) AS jw FROM jtf LEFT JOIN df ON df.term = jtf.term, n), jn AS (SELECT job, sqrt(sum(jw * jw)) AS jn FROM jw GROUP BY ALL), wn AS (SELECT id, sqrt(sum(weight * weight)) AS wn FROM w GROUP BY ALL), scores AS (SELECT w.id, jw.job, round(sum(weight * jw) / (any_value(wn) * any_value(jn)), 6) AS score FROM w JOIN jw USING (term) JOIN jn USING (job) JOIN wn ON wn.id = w.id GROUP BY w.id, jw.job)"


@query(f"WITH {TF}, {JOBS} SELECT id AS doc_id, score FROM scores WHERE job = 0 ORDER BY score DESC, doc_id LIMIT 20")
def rank_candidates_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents nearest to the first job."""
    scores = scoring.tfidf_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").filter("item_id = 0"))
    return scores.select(F.col("id").alias("doc_id"), "score").orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"WITH {TF}, {JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY score DESC, id) AS rank FROM scores) SELECT job, id AS doc_id, score, rank FROM r WHERE rank <= 5")
def rank_per_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of each job, all jobs at once."""
    best = scoring.best_per_job(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 5)
    return best.select("job", F.col("id").alias("doc_id"), "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {TF} SELECT id AS doc_id, term, tf, df, round(weight, 6) AS weight FROM w")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.tfidf_weights(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "term", "tf", "df", F.round("weight", 6).alias("weight"))


@query("SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(j.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) j")
def embedding_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against that of the job, vec_id 0; one row is broadcast."""
    e = table(spark, sf_dir, "embeddings")
    job = e.filter("vec_id = 0").select(F.col("embedding").alias("job")).limit(1)
    return e.crossJoin(F.broadcast(job)).select("vec_id", F.round(S.cosine("embedding", "job"), 6).alias("score"))


@query(f"WITH {TF}, {JOBS}, b AS (SELECT e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(j.embedding AS DOUBLE[])) AS bert FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) j), s AS (SELECT doc_id, coalesce(score, 0) AS t, bert AS b, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.5 END AS k FROM documents LEFT JOIN scores ON id = doc_id AND job = 0 LEFT JOIN b ON vec_id = doc_id) SELECT doc_id, round(100 * (t * 0.4 + coalesce(b, 0) * 0.4 + k * 0.2) / CASE WHEN b IS NULL THEN 0.4 + 0.0 + 0.2 ELSE 0.4 + 0.4 + 0.2 END, 4) AS \"finalScore\" FROM s")
def final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English is the one skill asked for, its lack half met; documents without a vector go by the rest."""
    docs = table(spark, sf_dir, "documents")
    t = scoring.tfidf_scores(docs, table(spark, sf_dir, "benchmark").filter("item_id = 0")).select(F.col("id").alias("doc_id"), F.col("score").alias("t"))
    e = table(spark, sf_dir, "embeddings")
    b = e.crossJoin(F.broadcast(e.filter("vec_id = 0").select(F.col("embedding").alias("job")).limit(1))).select(F.col("vec_id").alias("doc_id"), S.cosine("embedding", "job").alias("bertScore"))
    all_ = docs.select("doc_id", "lang").join(t, "doc_id", "left").join(b, "doc_id", "left").select("doc_id", F.coalesce("t", F.lit(0.0)).alias("tfidfScore"), "bertScore", F.when(F.col("lang") == "en", 1.0).otherwise(0.5).alias("skillMatchWeight"))
    return scoring.match_results(all_).select("doc_id", F.round("finalScore", 4).alias("finalScore"))


@query("SELECT doc_id, array_to_string(list_filter(['" + "','".join(WORDS) + "'], lambda k: contains(lower(text), k))[1:8], ', ') AS keywords, array_to_string(list_filter(['" + "','".join(S.DICTIONARY) + "'], lambda k: contains(lower(text), k))[1:8], ', ') AS skills FROM documents")
def keyword_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4 with a dictionary of this corpus and with the default one."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(S.keywords("text", WORDS), ", ").alias("keywords"), F.array_join(S.keywords("text"), ", ").alias("skills"))


@query("WITH s AS (SELECT p_partkey, string_split(p_name, ' ') AS r, ['red', 'widget', 'large'] AS j FROM part) SELECT p_partkey, array_to_string(list_filter(j, lambda x: list_contains(r, x)), ', ') AS matched, array_to_string(list_filter(j, lambda x: NOT list_contains(r, x)), ', ') AS missing, round(len(list_filter(j, lambda x: list_contains(r, x))) / 3, 6) AS weight, CAST(floor(100 * len(list_filter(j, lambda x: list_contains(r, x))) / 3 + 0.5) AS BIGINT) AS score FROM s")
def skill_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U6, D3, X3 with the lexical backend, X7."""
    j = F.array(*[F.lit(x) for x in ("red", "widget", "large")])
    r = F.split("p_name", " ")
    m = table(spark, sf_dir, "part").select("p_partkey", backends.checked(backends.lexical_match(r, j)).alias("m"), F.round(S.skill_weight(r, j), 6).alias("weight"))
    return m.select("p_partkey", F.array_join("m.matchedSkills", ", ").alias("matched"), F.array_join("m.missingSkills", ", ").alias("missing"), "weight", T.rounded("m.matchScore").alias("score"))


@query(f"WITH {POOL} SELECT id, name, array_to_string(skills, ' ') AS skills, \"jobTitle\" FROM pool WHERE contains(lower(name), 'red') OR len(list_filter(skills, lambda s: contains(lower(s), 'red'))) > 0 OR contains(lower(\"jobTitle\"), 'red')")
def pool_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.view(pool_table(spark, sf_dir), "RED").select("id", "name", F.array_join("skills", " ").alias("skills"), "jobTitle")


@query(f"WITH {POOL} SELECT id, name FROM pool WHERE shortlisted AND (contains(lower(name), '#2') OR len(list_filter(skills, lambda s: contains(lower(s), '#2'))) > 0 OR contains(lower(\"jobTitle\"), '#2'))")
def pool_shortlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.view(pool_table(spark, sf_dir), "#2", only_shortlisted=True).select("id", "name")


@query(f"WITH {POOL} SELECT id, array_to_string(skills[1:1], ', ') AS shown, greatest(len(skills) - 1, 0) AS more, CASE WHEN shortlisted THEN 'Shortlisted' ELSE 'In Pool' END AS label FROM pool")
def pool_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3, A10, P23, with one skill shown."""
    return pool.shown(pool_table(spark, sf_dir), 1).select("id", F.array_join("shownSkills", ", ").alias("shown"), F.col("moreSkills").alias("more"), "label")


@query(f"WITH {CANDIDATES} SELECT count(*) AS total, count_if(shortlisted)::BIGINT AS shortlisted, coalesce(CAST(CAST(floor(avg(score) + 0.5) AS BIGINT) AS VARCHAR), '--') AS avg_score, coalesce(bool_or(score IS NOT NULL), false) AS any_scored FROM candidates")
def pool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.statistics(candidates(spark, sf_dir))


@query(f"WITH {CANDIDATES} SELECT count(*) AS \"totalCandidates\", round(avg(coalesce(score, 0)), 6) AS \"averageMatchScore\" FROM candidates")
def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.export_summary(candidates(spark, sf_dir)).withColumn("averageMatchScore", F.round("averageMatchScore", 6))


@query(f"WITH {CANDIDATES} SELECT pos, score FROM candidates WHERE score > 75 ORDER BY score DESC, pos LIMIT 5")
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_candidates(candidates(spark, sf_dir)).select("pos", "score")


@query(f"WITH {CANDIDATES} SELECT pos, name, score, row_number() OVER (PARTITION BY name ORDER BY coalesce(score, -1) DESC, pos) AS rank FROM candidates")
def candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1 in each source."""
    return ranking.ranked(candidates(spark, sf_dir), "name").select("pos", "name", "score", "rank")


@query(f"WITH {CANDIDATES} SELECT pos, coalesce(score, -1) AS score, row_number() OVER (ORDER BY coalesce(score, -1) DESC, pos) AS rank FROM candidates")
def candidates_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1 over all: the range-partitioned sort, and each one's place."""
    return ranking.in_order(ranking.ranked(candidates(spark, sf_dir))).select("pos", F.coalesce("score", F.lit(-1.0)).alias("score"), "rank")


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    info = F.struct(F.array(F.col("lang"), F.lit('a "b", c')).alias("skills"), F.array(F.struct(F.concat(F.lit("Title, "), "lang").alias("title"))).alias("experience"))
    match = F.when(F.col("score").isNotNull(), F.struct(F.col("score").alias("matchScore"), F.lit("line\nbreak").alias("reasons"), F.array().cast("array<string>").alias("missingSkills")))
    return c.select("pos", F.col("pos").cast("string").alias("id"), "name", F.concat("name", F.lit(".pdf")).alias("fileName"), info.alias("extractedInfo"), match.alias("matchResults"), F.when(F.col("score").isNull(), "idle").otherwise("completed").alias("status"))


@query(f"WITH {CANDIDATES} SELECT pos, concat(name, ',', CASE WHEN score IS NULL THEN 'idle' ELSE 'completed' END, ',', CASE WHEN score IS NULL THEN 'N/A' ELSE printf('%.1f', score) END, ',\"Title, ', lang, '\",', '\"', lang, '; a \"\"b\"\", c\",', CASE WHEN score IS NULL THEN 'N/A,N/A' ELSE ',\"line' || chr(10) || 'break\"' END, ',', name, '.pdf') AS line FROM candidates")
def export_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10, F20, A11, F14."""
    return exports.csv_rows(exported(spark, sf_dir))


@query(f"""WITH {CANDIDATES} SELECT pos, concat_ws(chr(10), '', 'CANDIDATE ANALYSIS REPORT', repeat('=', 40), '', 'Name: ' || name, 'Current Position: Title, ' || lang, 'Resume File: ' || name || '.pdf', '', 'MATCH SCORE: ' || CASE WHEN coalesce(score, 0) = 0 THEN 'N/A' ELSE printf('%.1f', score) || '%' END, '', 'SKILLS:', '  • ' || lang, '  • a "b", c', '', 'MISSING SKILLS:', '  No missing skills', '', 'STRATEGIC ASSESSMENT:', CASE WHEN score IS NULL THEN 'No assessment available' ELSE 'line' || chr(10) || 'break' END, '', repeat('=', 40), 'Generated: 1/31/2024, 12:00:00 AM', '') AS report FROM candidates""")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exported(spark, sf_dir).select("pos", exports.report("1/31/2024, 12:00:00 AM").alias("report"))


FOLD = "WITH ops AS (SELECT user_id AS id, ts, event_id AS seq, CASE WHEN event_type IN ('signup', 'view', 'purchase') THEN 'add' WHEN event_type = 'click' THEN 'toggle' WHEN event_type = 'error' THEN 'remove' ELSE 'none' END AS op, event_type = 'purchase' AS sl, CASE WHEN event_type <> 'view' THEN value END AS score FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, seq) AS k FROM ops), r AS (SELECT *, coalesce(max(CASE WHEN op = 'remove' THEN k END) OVER (PARTITION BY id), 0) AS gone FROM o), l AS (SELECT *, min(CASE WHEN op = 'add' THEN k END) OVER (PARTITION BY id) AS born, max(CASE WHEN op = 'add' AND sl THEN k END) OVER (PARTITION BY id) AS flagged FROM r WHERE k > gone) SELECT CAST(id AS VARCHAR) AS id, ((max(CASE WHEN flagged IS NULL THEN 0 ELSE 1 END) + count_if(op = 'toggle' AND k > coalesce(flagged, born))) % 2) = 1 AS shortlisted, CAST(epoch_us(min(CASE WHEN k = born THEN ts END)) AS BIGINT) AS added_us, arg_max_null(score, CASE WHEN op = 'add' THEN k END) AS score FROM l WHERE born IS NOT NULL GROUP BY id"


@query(FOLD)
def pool_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4, U5, P7."""
    log = pool_log(table(spark, sf_dir, "events"))
    return pool.fold(log, ("score",)).select("id", "shortlisted", F.unix_micros(F.col("addedAt").cast("timestamp")).alias("added_us"), "score")


def shared(spark: SparkSession) -> str:
    """A new folder for a stream's checkpoint: in spark.checkpoint.dir, or a temporary one in a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="hirelens-stream-")
    return f"{folder}/stream-{uuid.uuid4()}"


@query(FOLD)
def pool_fold_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6: the same log as a stream, run until it is read, its versions written by batch."""
    folder = shared(spark)
    versions = logs.fold_pool(pool_log(logs.events(spark, f"{sf_dir}/events.parquet")).filter("op <> 'none'"))
    logs.run_once(versions, f"{folder}/checkpoint", lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/versions/batch={n}"), "update")
    return logs.latest(spark.read.parquet(f"{folder}/versions").drop("batch")).select("id", "shortlisted", F.unix_micros("addedAt").alias("added_us"), "score")


@query("SELECT event_type, count(*) AS n, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM events GROUP BY 1")
def snapshot_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, S13: complete mode; the last snapshot is the result."""
    folder = shared(spark)
    logs.run_once(logs.snapshots(logs.events(spark, f"{sf_dir}/events.parquet"), "event_type"), f"{folder}/checkpoint", lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/snapshot"), "complete")
    return spark.read.parquet(f"{folder}/snapshot").select("event_type", "n", F.unix_micros("last_ts").alias("last_us"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def dead_letter_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4: an emitter's listener writes the error events of each batch."""
    folder, emitter = shared(spark), logs.Emitter()
    emitter.on("error", lambda batch, n: batch.select("event_id", "user_id").write.mode("overwrite").parquet(f"{folder}/errors/batch={n}"))
    logs.run_once(logs.events(spark, f"{sf_dir}/events.parquet"), f"{folder}/checkpoint", lambda batch, n: emitter.emit(batch, n, "event_type"))
    return spark.read.parquet(f"{folder}/errors").select("event_id", "user_id")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(T.user_key(F.col("user_id").cast("string")).alias("user_email"), F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("jobTitle"), "value")


@query("SELECT CAST(user_id AS VARCHAR) AS user_email, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def history_keep20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.keep_newest(sessions(spark, sf_dir)).select("user_email", "id")


@query("SELECT CAST(user_id AS VARCHAR) AS user_email, event_id AS id, CASE WHEN event_type = 'view' THEN 'Session ' || (count(*) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) + 1) ELSE event_type END AS label FROM events")
def history_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.labels(sessions(spark, sf_dir)).select("user_email", "id", "label")


@query("SELECT CAST(user_id AS VARCHAR) AS user_email, count_if(event_type = 'purchase')::BIGINT AS completed, count(*) AS total, CAST(floor(round(avg(CASE WHEN event_type = 'purchase' THEN value END), 6) + 0.5) AS BIGINT) AS avg_score, count(*) || ' candidate' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END AS label FROM events GROUP BY user_id")
def history_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """totals of each user's events."""
    done = F.col("event_type") == "purchase"
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("user_email")).agg(F.count_if(done).alias("completed"), F.count("*").alias("total"), T.rounded(F.round(F.avg(F.when(done, F.col("value"))), 6)).alias("avg_score"), T.counted(F.count("*"), "candidate").alias("label"))


@query(f"WITH e AS (SELECT event_id, ts, epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms(ts) AS ms FROM events) SELECT event_id, CASE WHEN ms < 60000 THEN 'Just now' WHEN ms < 3600000 THEN (ms // 60000) || 'm ago' WHEN ms < 86400000 THEN (ms // 3600000) || 'h ago' WHEN ms < 604800000 THEN (ms // 86400000) || 'd ago' ELSE strftime(ts, '%-m/%-d/%Y') END AS age FROM e")
def history_time_ago(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", T.time_ago("ts", as_of).alias("age"))


@query("SELECT doc_id, concat(substring(text, 1, 200), CASE WHEN length(text) > 200 THEN '...' ELSE '' END) AS preview, coalesce(nullif(substring(split_part(text, chr(10), 1), 1, 60), ''), 'Unknown Role') AS title, split_part(source || '.v1.pdf', '.', 1) AS stem FROM documents")
def jd_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5-F8."""
    return table(spark, sf_dir, "documents").select("doc_id", T.truncated("text").alias("preview"), T.safe_job_title(F.lit(""), "text").alias("title"), T.file_stem(F.concat("source", F.lit(".v1.pdf"))).alias("stem"))


RE2 = "[\\t-\\r \\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
TRIM = f"regexp_replace(text, '^{RE2}+|{RE2}+$', '', 'g')"


@query(f"WITH t AS (SELECT doc_id, text, source, {TRIM} AS trimmed FROM documents) SELECT doc_id, CASE WHEN text = '' THEN 'Job description is required and must be a string' WHEN length(trimmed) < 50 THEN 'Job description must be at least 50 characters long' WHEN length(trimmed) > 10000 THEN 'Job description must not exceed 10,000 characters' END AS error, CASE WHEN text = '' THEN 'Resume text is required and must be a string' WHEN length(trimmed) < 10 THEN 'Resume content is too short' WHEN length(trim(source)) < 10 THEN 'Job description content is too short' END AS match_error, length(text) > 50 AS matchable, trimmed AS \"jobDescription\" FROM t")
def validate_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V3, V4, and the trimmed input that goes on."""
    return table(spark, sf_dir, "documents").select("doc_id", validation.job_error("text").alias("error"), validation.match_error("text", "source").alias("match_error"), validation.matchable(F.lit("idle"), "text").alias("matchable"), T.trim("text").alias("jobDescription"))


@query("SELECT page_id, CASE WHEN page_id = 0 THEN 'Resume data URI is required and must be a string' WHEN page_id = 2 THEN 'Resume file is too large. Maximum size is 10MB' WHEN page_id % 5 = 0 THEN 'Invalid resume data format' END AS error, CASE WHEN page_id >= 3 THEN strlen(html) END AS bytes FROM pages")
def validate_data_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth page without its scheme, one without a URI, one of exactly 10 MB and one of a byte more. The page comes back out of the URI."""
    k = F.col("page_id")
    big = F.concat(F.lit("data:"), F.repeat(F.lit("x"), validation.MOST_BYTES - 5))
    uri = F.when(k == 0, "").when(k == 1, big).when(k == 2, F.concat(big, F.lit("x"))).when(k % 5 == 0, F.col("html")).otherwise(files.data_uri(F.lit("page.pdf"), F.encode("html", "UTF-8")))
    return table(spark, sf_dir, "pages").withColumn("uri", uri).select("page_id", validation.uri_error("uri").alias("error"), F.when(k >= 3, F.when(k % 5 == 0, F.octet_length("html")).otherwise(F.octet_length(files.from_data_uri("uri")))).cast("bigint").alias("bytes"))


@query("WITH f AS (SELECT source AS name, min(doc_id) AS pos FROM documents WHERE lang = 'en' GROUP BY 1) SELECT d.doc_id, f.pos AS file_pos FROM documents d JOIN f ON f.name = d.source WHERE d.n_chars % 3 = 0")
def reprocess_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the documents pending; files are the English ones, by source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    c = d.select("doc_id", F.col("source").alias("fileName"), F.when(F.col("n_chars") % 3 == 0, "error").otherwise("completed").alias("status"))
    return ranking.pairs_by_name(c, d.filter("lang = 'en'").select(F.col("source").alias("name"), F.col("doc_id").alias("pos"), "n_chars")).select("doc_id", F.col("file.pos").alias("file_pos"))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'tp-' || doc_id || '-1' ELSE CAST(doc_id AS VARCHAR) END AS id, CAST(CASE WHEN doc_id % 3 <> 0 THEN n_chars END AS BIGINT) AS size FROM documents")
def blob_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third blob deleted."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    blobs = files.delete(d.select(F.col("doc_id").cast("string").alias("id"), F.col("n_chars").alias("file")), d.filter("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("id")))
    p = d.select(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("tp-"), F.col("doc_id").cast("string"), F.lit("-1"))).otherwise(F.col("doc_id").cast("string")).alias("id"))
    return files.pool_files(p, blobs).select("id", F.col("file").alias("size"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS \"resumeId\", round(sum(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01')) , 4) AS days FROM orders GROUP BY 1")
def experience_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact base of A14: days in post, all going on."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("resumeId")).agg(F.sum(F.datediff(F.lit("2000-01-01").cast("date"), F.col("o_orderdate").cast("date"))).cast("double").alias("days"))


@query("WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS \"resumeId\", CAST(o_orderdate AS DATE) AS d FROM orders) SELECT \"resumeId\", round(sum(round((2000 - year(d)) * 12 + 1 - month(d) + (1 - day(d)) / 31.0, 8) / 12), 6) AS years FROM o GROUP BY 1")
def experience_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14, by months: whole ones between equal days, else 31sts for the days over."""
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("resumeId"), F.col("o_orderdate").cast("date").alias("startDate"), F.lit(None).cast("date").alias("endDate"))
    return requirements.total_years(e, F.lit("2000-01-01").cast("date")).withColumn("years", F.round("years", 6))


@query("SELECT c_custkey AS \"resumeId\", n_nationkey AS \"requirementId\", coalesce(bool_or(contains(lower(o_orderpriority), 'high') AND o_orderdate >= TIMESTAMP '1999-01-01'), false) AS met, any_value(n_nationkey % 2 = 0) AS \"isPreferred\", NOT coalesce(bool_or(contains(lower(o_orderpriority), 'high') AND o_orderdate >= TIMESTAMP '1999-01-01'), false) AND NOT any_value(n_nationkey % 2 = 0) AS blocks FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, n_nationkey")
def requirement_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers' orders as certificates; each nation asks for one HIGH that hasn't expired."""
    required = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resumeId"), F.col("c_nationkey").alias("requirementId")).withColumns({"nameKeywords": F.array(F.lit("HIGH")), "isPreferred": F.col("requirementId") % 2 == 0})
    held = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("resumeId"), F.col("o_orderpriority").alias("name"), F.col("o_orderdate").cast("date").alias("expirationDate"))
    return requirements.certification_met(required, held, F.lit("1999-01-01").cast("date"))


@query("WITH s AS (SELECT p_brand AS category, lower(unnest(string_split(p_name, ' '))) AS name FROM part) SELECT category, count(DISTINCT name) AS skills FROM s GROUP BY 1")
def skill_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    return requirements.by_category(table(spark, sf_dir, "part").select(F.col("p_brand").alias("category"), F.explode(F.split("p_name", " ")).alias("name")))


@query("SELECT 'unlabelled' AS kind, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'label', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'line', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)")
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8."""
    t = lambda name: table(spark, sf_dir, name)
    pairs = {"unlabelled": ("documents", "doc_id", "labels", "doc_id"), "label": ("labels", "doc_id", "documents", "doc_id"), "line": ("lineitem", "l_orderkey", "orders", "o_orderkey"), "nation": ("nation", "n_regionkey", "region", "r_regionkey")}
    return integrity_tables.union([validation.orphans(t(c), k, t(p), q).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, (c, k, p, q) in pairs.items()])


@query("SELECT c_custkey AS path_id, CASE WHEN c_custkey % 7 = 0 THEN false WHEN c_custkey % 3 = 0 THEN c_custkey % 2 = 0 WHEN c_custkey % 3 = 1 THEN c_nationkey % 4 <> 0 ELSE c_nationkey % 5 <> 0 END AS allowed FROM customer")
def access_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed out by 7; creates with a wrong id by 2, updates that move by 4, deletes of nothing by 5."""
    c, k, n = table(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("c_nationkey")
    op = F.when(k % 3 == 0, "create").when(k % 3 == 1, "update").otherwise("delete")
    new = F.struct((k + F.when((op == "create") & (k % 2 != 0), 1).otherwise(0)).alias("id"), (n + F.when((op == "update") & (n % 4 == 0), 1).otherwise(0)).alias("resumeId"))
    old = F.when((op == "update") | ((op == "delete") & (n % 5 != 0)), F.struct(k.alias("id"), n.alias("resumeId")))
    return validation.allowed(c.select(F.when(k % 7 != 0, "u").alias("user"), op.alias("op"), k.alias("path_id"), new.alias("new"), old.alias("old"))).select("path_id", "allowed")


@query("SELECT doc_id AS pos, 'idle' AS status FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'idle' FROM documents WHERE lang <> 'en'")
def append_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1, P15."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("source").alias("name"), "lang")
    made = [files.candidates_from_files(d.filter(c).drop("lang")) for c in ("lang = 'en'", "lang <> 'en'")]
    return ranking.appended(*made).select("pos", "status")


@query(f"WITH {CANDIDATES} SELECT pos, CASE WHEN score IS NULL THEN 'provide job context' WHEN score > 50 THEN 'perfect match' ELSE 'gaps' END AS state, coalesce(CAST(CAST(score AS BIGINT) AS VARCHAR), '--') AS shown, CASE WHEN score IS NULL THEN 'idle' ELSE 'completed' END AS status FROM candidates")
def gap_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P22, P24, P9."""
    c = candidates(spark, sf_dir).withColumns({"match": F.col("score"), "missing": F.when(F.col("score") <= 50, F.array(F.lit("x"))), "status": F.lit("idle")})
    return ranking.updated(c, F.col("score").isNotNull(), {"status": F.lit("completed")}).select("pos", ranking.gap_state("match", "missing").alias("state"), ranking.score_label(F.col("score").cast("bigint")).alias("shown"), "status")


@query("SELECT 'job-' || doc_id AS id, trim(source) AS title, CAST(0 AS BIGINT) + coalesce(n, 0) AS \"candidateCount\" FROM documents d LEFT JOIN (SELECT doc_id AS j, count(*) AS n FROM labels WHERE quality = 1 GROUP BY 1) m ON m.j = d.doc_id WHERE " + TRIM + " <> ''")
def job_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17, V6, Q13."""
    form = table(spark, sf_dir, "documents").select(F.concat(F.lit(" "), "source", F.lit("\n")).alias("title"), F.col("text").alias("description"), F.lit(" ").alias("department"), F.col("lang").alias("location"), F.lit("Contract").alias("type"), F.col("doc_id").alias("createdAt"))
    matches = table(spark, sf_dir, "labels").filter("quality = 1").select(T.prefixed_id("job", "doc_id").alias("jobId"))
    return postings.with_counts(postings.postings(form), matches).select("id", "title", "candidateCount")


@query("WITH a AS (SELECT item_id, text FROM benchmark) SELECT item_id, concat(CASE WHEN item_id % 2 = 0 THEN '' ELSE 'Additional Specific Hiring Criteria to prioritize (if applicable):' || chr(10) || '- one' || chr(10) || '- ' || item_id || chr(10) END) AS block FROM a")
def criteria_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 2 != 0, F.array(F.lit("one"), F.col("item_id").cast("string"))).alias("criteria"))
    return b.select("item_id", backends.criteria_block("criteria").alias("block"))


@query("SELECT page_id, array_to_string(list_filter(['" + "','".join(S.DICTIONARY) + "'], lambda k: contains(lower(html), k)), ', ') AS \"keySkills\", array_to_string(list_filter(['" + "','".join(S.DICTIONARY) + "'], lambda k: contains(lower(html), k)), ', ') AS skills FROM pages")
def extract_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1, X2 with the lexical backend; flat columns."""
    t = table(spark, sf_dir, "pages")
    return t.select("page_id", F.array_join(backends.lexical_requirements("html")["keySkills"], ", ").alias("keySkills"), F.array_join(backends.lexical_resume("html")["skills"], ", ").alias("skills"))


@query("SELECT page_id, trim(regexp_replace(lower(html), '[^\\p{L}\\p{N}+#.]+', ' ', 'g')) AS cleaned FROM pages")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8."""
    return table(spark, sf_dir, "pages").select("page_id", T.clean_text("html").alias("cleaned"))


@query("SELECT conv_id, turn, role, length(text) AS n FROM conversations UNION ALL SELECT -1, NULL, NULL, NULL WHERE false")
def unnested_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation to one JSON document and back, its messages in order."""
    from hirelens.sources.documents import dump_json

    c = table(spark, sf_dir, "conversations")
    back = dump_json(c, "conv_id").withColumn("m", F.from_json("json", "array<struct<turn: bigint, role: string, text: string>>"))
    return ranking.unnested(back, "m", "x", "conv_id").select("conv_id", "x.turn", "x.role", F.length("x.text").cast("bigint").alias("n"))


@query("SELECT CAST(user_id AS VARCHAR) AS user, string_agg(k, ';' ORDER BY k) AS identities FROM (SELECT user_id, event_type || '=' || count(*) AS k FROM events GROUP BY user_id, event_type) GROUP BY 1")
def identity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many uids each provider has for a user."""
    m = validation.identities(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("provider"), F.col("event_id").cast("string").alias("uid")))
    return m.select("user", F.array_join(F.array_sort(F.transform(F.map_entries("identities"), lambda e: F.concat(e.key, F.lit("="), F.size(e.value).cast("string")))), ";").alias("identities"))
