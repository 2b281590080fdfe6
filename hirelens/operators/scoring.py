"""TF-IDF ranking and the combined score."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelens.functions.skills import TERM, final_score, terms

#: Rows of a table of terms up to which it is sent to every executor; beyond it, it is joined by a shuffle.
BROADCAST_TERMS = 1_000_000
#: Rows of an Arrow batch that are Python objects at a time.
SLICE = 200


def term_counts(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, term, tf), counted inside each row, so nothing is shuffled; rows that share an id count each.

    In Arrow batches: native columns can only count the runs of a sorted array by functions that are interpreted, which took 1.6 times as long, or by grouping the exploded tokens, which shuffles them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TERM).findall
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for k in range(0, len(texts), SLICE):
                found = [Counter(find(t.lower())) if t else {} for t in texts.slice(k, SLICE).to_pylist()]
                at = np.repeat(np.arange(k, k + len(found)), [len(c) for c in found])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array([t for c in found for t in c], pa.string()), pa.array([n for c in found for n in c.values()], pa.int64())], ["id", "term", "tf"])

    rows = docs.select(F.col(id_).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(count, f"id {rows.schema['id'].dataType.simpleString()}, term string, tf bigint")


def document_frequencies(docs: DataFrame, text: str, n: int) -> DataFrame:
    """(term, df, idf): counts are summed up in each partition before they are shuffled."""
    return docs.select(F.explode(F.array_distinct(terms(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", idf(F.lit(n), F.col("df")))


def idf(n: Column, df: Column) -> Column:
    """Smooth inverse document frequency; df null for a term that no document has."""
    return F.log((n + 1.0) / (F.coalesce(df, F.lit(0)) + 1.0)) + 1.0


def least_frequency(df: DataFrame) -> int | None:
    """The least df of which all terms, and of higher ones, can be sent everywhere; None if not even the commonest can."""
    most, found, least = 10_000, 0, None
    for r in sorted(df.groupBy(F.least("df", F.lit(most)).alias("df")).count().collect(), reverse=True):
        found += r["count"]
        if found > BROADCAST_TERMS:
            break
        least = r["df"]
    return least


def with_frequencies(tf: DataFrame, of: DataFrame, df: DataFrame) -> DataFrame:
    """tf with the columns that of, a row a term of df, has for each term.

    Common terms are sent everywhere and meet the documents where these are read. Only the others, beyond BROADCAST_TERMS, are shuffled; few documents have them, so these are few rows, but the documents are read twice."""
    least = least_frequency(df)
    if least is None:
        return tf.join(of, "term")
    common = of.filter(F.col("df") >= least)
    met = tf.join(F.broadcast(common), "term")
    if df.filter(F.col("df") < least).isEmpty():
        return met
    others = tf.join(F.broadcast(common.select("term")), "term", "left_anti")
    return met.unionByName(others.join(of.filter(F.col("df") < least), "term"))


def tfidf_weights(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, term, tf, df, weight). Of documents nothing is shuffled but each partition's count of each term, and the terms too rare to be sent everywhere."""
    df = document_frequencies(docs, text, docs.count()).persist()
    return with_frequencies(term_counts(docs, id_, text), df, df).select("id", "term", "tf", "df", (F.col("tf") * F.col("idf")).alias("weight"))


def job_weights(jobs: DataFrame, df: DataFrame, n: int, job_id: str) -> DataFrame:
    """(job, term, idf, jw), one row a job and term, kept; jobs without an id are none."""
    tf = term_counts(jobs.filter(F.col(job_id).isNotNull()), job_id, "text").groupBy(F.col("id").alias("job"), "term").agg(F.sum("tf").alias("tf"))
    return tf.join(df.select("term", "df"), "term", "left").withColumn("idf", idf(F.lit(n), F.col("df"))).select("job", "term", "idf", (F.col("tf") * F.col("idf")).alias("jw")).persist()


def tfidf_scores(docs: DataFrame, jobs: DataFrame, doc_id: str = "doc_id", job_id: str = "item_id") -> DataFrame:
    """(id, job, score), the cosine of each document with each job that it shares a term with. Weights count documents only.

    The frequencies meet the documents where these are read. A document's squares and its products with each job are sums that partitions make before they are shuffled, so one row a document and job moves, however long the text. For the best of each job see best_per_job, which doesn't make all pairs."""
    n = docs.count()
    tf = term_counts(docs, doc_id, "text")
    df = document_frequencies(docs, "text", n).persist()
    jw = job_weights(jobs, df, n, job_id)
    jn = jw.groupBy("job").agg(F.sqrt(F.sum(F.col("jw") * F.col("jw"))).alias("job_norm"))
    if jw.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        # a null job takes the document's own square, so that one pass makes both
        own = F.struct(F.lit(None).cast(jobs.schema[job_id].dataType).alias("job"), F.lit(0.0).alias("jw"))
        at = df.join(F.broadcast(jw.groupBy("term").agg(F.collect_list(F.struct("job", "jw")).alias("of"))), "term", "left").select("term", "df", "idf", F.concat(F.array(own), F.coalesce("of", F.array().cast("array<struct<job: " + jobs.schema[job_id].dataType.simpleString() + ", jw: double>>"))).alias("of"))
        part = with_frequencies(tf, at, df).select("id", (F.col("tf") * F.col("idf")).alias("w"), F.explode("of").alias("o")).select("id", "o.job", F.when(F.col("o.job").isNull(), F.col("w") * F.col("w")).otherwise(F.col("w") * F.col("o.jw")).alias("p"))
    else:
        w = with_frequencies(tf, df, df).select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
        part = w.select("id", F.lit(None).cast(jobs.schema[job_id].dataType).alias("job"), (F.col("w") * F.col("w")).alias("p")).unionByName(w.join(jw.drop("idf"), "term").select("id", "job", (F.col("w") * F.col("jw")).alias("p")))
    sums = part.groupBy("id", "job").agg(F.sum("p").alias("p"))
    dots = sums.withColumn("norm", F.sqrt(F.max(F.when(F.col("job").isNull(), F.col("p"))).over(Window.partitionBy("id")))).filter("job is not null")
    return dots.join(F.broadcast(jn) if jn.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else jn, "job").select("id", "job", F.round(F.col("p") / (F.col("norm") * F.col("job_norm")), 6).alias("score"))


def best_per_job(docs: DataFrame, jobs: DataFrame, most: int, doc_id: str = "doc_id", job_id: str = "item_id") -> DataFrame:
    """(job, id, score, rank) of tfidf_scores, the `most` best of each job by score, then id.

    Pairs of documents and jobs are only ever made in slices. A document moves once, as its norm and its counts of the jobs' terms, and each task hands on its `most` best of each job. Jobs of more than BROADCAST_TERMS terms in all go by tfidf_scores."""
    rank = F.row_number().over(Window.partitionBy("job").orderBy(F.desc("score"), "id"))
    n = docs.count()
    df = document_frequencies(docs, "text", n).persist()
    jw = job_weights(jobs, df, n, job_id)
    if jw.limit(BROADCAST_TERMS + 1).count() > BROADCAST_TERMS:
        return tfidf_scores(docs, jobs, doc_id, job_id).withColumn("rank", rank).filter(F.col("rank") <= most)
    w = with_frequencies(term_counts(docs, doc_id, "text"), df, df).select("id", (F.col("tf") * F.col("idf")).alias("w"))
    norms = w.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("square"))
    rows = jw.toArrow()
    job_ids, of = rows["job"].unique(), rows["term"].unique().to_pylist()
    term_at = {t: k for k, t in enumerate(of)}
    terms_ = np.array([term_at[t] for t in rows["term"].to_pylist()], np.int64)
    by_term = np.argsort(terms_, kind="stable")
    job_at = {j: k for k, j in enumerate(job_ids.to_pylist())}
    job, jws, idfs = (x[by_term] for x in (np.array([job_at[j] for j in rows["job"].to_pylist()], np.int64), rows["jw"].to_numpy(), rows["idf"].to_numpy()))
    norm = np.sqrt(np.bincount(job, jws * jws, len(job_ids)))
    start = np.searchsorted(terms_[by_term], np.arange(len(of) + 1))
    schema = f"id {docs.schema[doc_id].dataType.simpleString()}, square double, terms array<int>, counts array<int>"

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TERM).findall
        for b in batches:
            for k in range(0, b.num_rows, SLICE):
                found = [Counter(x for x in map(term_at.get, find(t.lower())) if x is not None) if t else {} for t in b.column(1).slice(k, SLICE).to_pylist()]
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array([x for c in found for x in part(c)], pa.int32())) for part in (dict.keys, dict.values)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, SLICE), pa.nulls(len(found), pa.float64()), *lists], ["id", "square", "terms", "counts"])

    shared = docs.select(F.col(doc_id).alias("id"), "text").mapInArrow(counts, schema).filter(F.size("terms") > 0)
    none = F.array().cast("array<int>")
    whole = norms.select("id", "square", none.alias("terms"), none.alias("counts")).unionByName(shared).repartition("id").sortWithinPartitions("id")
    best = whole.mapInArrow(functools.partial(_best, most=most, job_ids=job_ids, norm=norm, start=start, job=job, weight=idfs * jws), f"job {jobs.schema[job_id].dataType.simpleString()}, id {docs.schema[doc_id].dataType.simpleString()}, score double")
    return best.withColumn("rank", rank).filter(F.col("rank") <= most)


def _rounded6(x: float) -> float:
    """As Spark rounds: the shortest decimal, halves away from zero."""
    return float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def _best(batches: Iterator[pa.RecordBatch], most: int, job_ids: pa.Array, norm: np.ndarray, start: np.ndarray, job: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of rows (id, square, terms, counts) in order of id, the best of each job as (job, id, score). Term t adds count * weight[k] to job[k], k from start[t] up to start[t + 1]."""
    n = len(job_ids)
    top: list[list] = [[] for _ in range(n)]
    floor = np.full(n, -np.inf)
    id_type = None

    def settle(ids: list, square: np.ndarray, p: np.ndarray) -> None:
        score = np.where(p > 0, p / (np.sqrt(square)[:, None] * norm), -np.inf)
        least = np.maximum(floor, np.partition(score, len(ids) - most, axis=0)[len(ids) - most]) if len(ids) >= most else floor
        # 2e-6: what rounding can move two scores past each other
        rows, cols = np.nonzero((score > -np.inf) & (score >= least - 2e-6))
        for j in np.unique(cols):
            new = [(-_rounded6(float(score[g, j])), (ids[g] is not None, ids[g])) for g in rows[cols == j]]
            top[j] = sorted(top[j] + new)[:most]
            if len(top[j]) == most:
                floor[j] = -top[j][-1][0]

    # the last id goes on into the next slice
    last: tuple | None = None
    step = max(1, min(500, 100_000 // max(n, 1)))
    for b in batches:
        id_type = b.column(0).type
        for k in range(0, b.num_rows, step):
            s = b.slice(k, step)
            ids = s.column(0).to_pylist()
            first = [0] + [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]]
            group = np.zeros(len(ids), np.int64)
            group[first[1:]] = 1
            group = np.cumsum(group)
            square = np.bincount(group, np.nan_to_num(s.column(1).to_numpy(zero_copy_only=False)))
            terms_, counts = (s.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
            of = np.repeat(group, s.column(2).value_lengths().to_numpy(zero_copy_only=False))
            each = start[terms_ + 1] - start[terms_]
            at = np.repeat(start[terms_] - np.cumsum(each) + each, each) + np.arange(each.sum())
            p = np.bincount(np.repeat(of, each) * n + job[at], np.repeat(counts, each) * weight[at], len(first) * n).reshape(len(first), n)
            names = [ids[i] for i in first]
            if last is not None:
                if last[0] == names[0]:
                    square[0] += last[1]
                    p[0] += last[2]
                else:
                    settle([last[0]], np.array([last[1]]), last[2][None])
            if len(names) > 1:
                settle(names[:-1], square[:-1], p[:-1])
            last = (names[-1], square[-1], p[-1].copy())
    if last is not None:
        settle([last[0]], np.array([last[1]]), last[2][None])
        found = [(j, id_, -score) for j, rows in enumerate(top) for score, (_, id_) in rows]
        yield pa.RecordBatch.from_arrays([job_ids.take(pa.array([x[0] for x in found], pa.int64())), pa.array([x[1] for x in found], id_type), pa.array([x[2] for x in found], pa.float64())], ["job", "id", "score"])


def match_results(scores: DataFrame, weights: tuple[float, float, float] = (0.4, 0.4, 0.2)) -> DataFrame:
    """D4 over (tfidfScore, bertScore, skillMatchWeight)."""
    return scores.withColumn("finalScore", final_score("tfidfScore", "bertScore", "skillMatchWeight", weights))
