import numpy as np
import pytest

from hirelens.llm.neighbours import neighbours


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(range(len(x)) if ids is None else ids, x)], "vec_id bigint, embedding array<float>")


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


@pytest.mark.parametrize("kind", ["random", "clusters"])
def test_recall_of_all_queries(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    if kind == "clusters":
        x = x[:30].repeat(50, axis=0) + 0.2 * x
    want, s = brute(x, 10)
    rows = neighbours(frame(spark, x), first=24).collect()
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, set()).add(r.neighbour_id)
        assert r.cosine == pytest.approx(s[r.vec_id, r.neighbour_id], abs=1e-4)
    assert all(len(got[k]) == 10 for k in range(len(x)))
    assert np.mean([len(got[k] & set(want[k].tolist())) / 10 for k in range(len(x))]) >= 0.9


def test_small_is_exact(spark):
    x = np.random.default_rng(2).standard_normal((60, 8)).astype(np.float32)
    want, _ = brute(x, 10)
    got = {(r.vec_id, r["rank"]): r.neighbour_id for r in neighbours(frame(spark, x)).collect()}
    assert got == {(i, j + 1): int(want[i, j]) for i in range(60) for j in range(10)}


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, -1.0]), (4, [0.0, -1.0])]
    bad = [(5, None), (6, []), (7, [0.0, 0.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [1.0, None]), (11, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 0) for r in good + bad], "vec_id bigint, embedding array<float>, rank int")
    rows = sorted((r.vec_id, r["rank"], r.neighbour_id, r.cosine) for r in neighbours(df, k=2).collect())
    assert rows == [(1, 1, 2, 1.0), (1, 2, 3, 1.0), (2, 1, 1, 1.0), (2, 2, 3, 1.0), (3, 1, 1, 1.0), (3, 2, 2, 1.0), (4, 1, 1, 0.0), (4, 2, 2, 0.0)]
    assert neighbours(df.limit(0)).count() == neighbours(df.filter("vec_id = 1")).count() == 0
