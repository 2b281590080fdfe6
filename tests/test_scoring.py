"""TF-IDF on tables whose terms don't all fit a broadcast, and the best of each job without all pairs."""

import random
import tracemalloc
from collections import Counter
from math import log, sqrt

import pyarrow as pa
import pytest

from hirelens.operators import scoring

COMMON = [f"w{k}" for k in range(80)]
DOCS, JOBS = 1500, 120


def shuffled(spark, f):
    """f's result, and the bytes written to shuffles meanwhile."""
    sc = spark.sparkContext._jsc.sc()

    def so_far():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().executorList(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    before = so_far()
    return f(), so_far() - before


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    docs = [(k, " ".join(r.choices(COMMON, k=r.randint(5, 60)) + [f"own{k}a", f"own{k}b", f"rare{k // 2}"])) for k in range(DOCS)]
    docs[7] = (7, docs[5][1])
    docs[9], docs[11] = (9, None), (11, "own11a")
    jobs = [(k, " ".join(r.choices(COMMON, k=12)) + f" own{k}a nowhere{k}") for k in range(JOBS)]
    jobs[3], jobs[4] = (3, "nowhere"), (None, "w1 w2")
    return docs, jobs


@pytest.fixture(scope="module")
def want(texts):
    docs, jobs = ([(k, Counter((t or "").split())) for k, t in rows] for rows in texts)
    df = Counter(t for _, c in docs for t in c)
    weights = lambda c: {t: n * (log((len(docs) + 1) / (df[t] + 1)) + 1) for t, n in c.items()}
    docs, jobs = ([(k, w, sqrt(sum(x * x for x in w.values()))) for k, w in ((k, weights(c)) for k, c in rows)] for rows in (docs, jobs))
    return {(d, j): sum(w[t] * x for t, x in v.items() if t in w) / (a * b) for d, w, a in docs for j, v, b in jobs if j is not None and w.keys() & v.keys()}


@pytest.fixture
def tables(spark, texts):
    return spark.createDataFrame(texts[0], "doc_id long, text string").repartition(3), spark.createDataFrame(texts[1], "item_id long, text string")


@pytest.mark.parametrize("most_sent", [1_000_000, 3000])
def test_best_per_job(spark, tables, want, monkeypatch, most_sent):
    """As all pairs have it, but these aren't shuffled, also with more terms than can be sent everywhere."""
    monkeypatch.setattr(scoring, "BROADCAST_TERMS", most_sent)
    rows, moved = shuffled(spark, scoring.best_per_job(*tables, 5).collect)
    got = {(r.job, r["rank"]): (r.id, r.score) for r in rows}
    assert len(got) == len(rows)
    for j in range(JOBS):
        best = sorted((-round(s, 6), d) for (d, job), s in want.items() if job == j)[:5]
        assert [got[j, k + 1] for k in range(len(best))] == [(d, pytest.approx(-s, abs=1e-9)) for s, d in best] and (j, len(best) + 1) not in got
    assert (3, 1) not in got and None not in {j for j, _ in got}
    assert moved < 8 * DOCS * JOBS / 2


def test_best_of_no_jobs(spark, tables):
    docs, jobs = tables
    assert scoring.best_per_job(docs, jobs.limit(0), 5).collect() == [] and scoring.best_per_job(docs.limit(0), jobs, 5).collect() == []


def test_best_with_slices_and_equal_ids(spark, monkeypatch):
    """Rows of one id count together wherever slices end, and more of the same score go by id."""
    docs = spark.createDataFrame([(k // 3, "a b" if k % 3 else "a c") for k in range(3000)], "doc_id long, text string")
    jobs = spark.createDataFrame([(1, "a"), (2, "c")], "item_id long, text string")
    assert sorted((r.job, r["rank"], r.id) for r in scoring.best_per_job(docs, jobs, 3).collect()) == [(j, k + 1, k) for j in (1, 2) for k in range(3)]


def test_scores_of_rare_terms(spark, tables, want, monkeypatch, request):
    """Terms beyond those that are sent everywhere are shuffled, and no others; scores stay as they are."""
    monkeypatch.setattr(scoring, "BROADCAST_TERMS", 3000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    docs, jobs = tables
    rows, moved = shuffled(spark, scoring.tfidf_scores(docs, jobs.filter("item_id = 0")).collect)
    assert {r.id: r.score for r in rows} == {d: pytest.approx(s, abs=1e-6) for (d, j), s in want.items() if j == 0}
    monkeypatch.setattr(scoring, "BROADCAST_TERMS", 1_000_000)
    _, least = shuffled(spark, scoring.tfidf_scores(docs, jobs.filter("item_id = 0")).collect)
    assert moved < 2 * least, (moved, least)
    monkeypatch.setattr(scoring, "BROADCAST_TERMS", 0)
    assert len(scoring.tfidf_scores(docs, jobs.filter("item_id = 0")).collect()) == len(rows)


def test_texts_become_objects_in_slices(spark, monkeypatch):
    """What a Python worker holds beside an Arrow batch doesn't grow with the batch."""
    docs = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: f)
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(["word" + " " * 4000] * 10_000)], ["id", "text"])
    tracemalloc.start()
    assert sum(b.num_rows for b in scoring.term_counts(docs, "doc_id", "text")(iter([batch]))) == 10_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6
