import math
import random
from collections import Counter

import numpy as np
import pytest

from hirelens.llm import toxicity as T


def brute(score):
    """Ruzzo and Tompa's definition: the best segment (shortest, then first, of equals), then the same on either side."""
    best = None
    for a in range(len(score)):
        for b in range(a + 1, len(score) + 1):
            s = sum(score[a:b])
            if s > 0 and (best is None or s > best[0] + 1e-9 or (abs(s - best[0]) <= 1e-9 and b - a < best[2] - best[1])):
                best = (s, a, b)
    if best is None:
        return []
    s, a, b = best
    return brute(score[:a]) + [(a, b, s)] + [(x + b, y + b, z) for x, y, z in brute(score[b:])]


def test_segments_against_brute_force():
    rng = random.Random(0)
    for _ in range(200):
        # distinct scores, so that no two segments tie
        score = [rng.uniform(1, 5) if rng.random() < 0.3 else rng.uniform(-4, 0) if rng.random() < 0.4 else None for _ in range(rng.randint(0, 25))]
        at = [k for k, s in enumerate(score) if s is not None]
        got = T.segments(at, [score[k] for k in at], 0.5)
        want = brute([-0.5 if s is None else s for s in score])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def corpus(seed, n=400):
    rng = random.Random(seed)
    clean, bad = [f"word{k}é" for k in range(300)], [f"slur{k}" for k in range(8)]
    docs, labels = [], []
    for k in range(n):
        w = [rng.choice(clean) for _ in range(rng.randint(20, 300))]
        if toxic := k % 6 == 0:
            p = rng.randrange(len(w))
            w[p:p] = [x for _ in range(rng.randint(3, 8)) for x in (rng.choice(bad), rng.choice(clean))]
        docs.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_accuracy(spark):
    d, y = corpus(1)
    held, truth = corpus(2)
    docs = d + [(k + 10_000, t) for k, t in held]
    rows = T.toxic_passages(*frames(spark, docs, y)).collect()
    found = {r.doc_id - 10_000 for r in rows if r.doc_id >= 10_000}
    bad = {k for k, t in truth if t}
    assert len(found & bad) >= 0.97 * len(bad) and len(found - bad) <= 0.01 * len(truth)
    for r in rows:
        words = dict(docs)[r.doc_id].split()[r.start_token : r.end_token]
        assert words[0].startswith("slur") and words[-1].startswith("slur")
        assert r.doc_p_value <= r.p_value <= T.ALPHA and r.best_score >= r.score


def test_edges(spark):
    d, y = corpus(3)
    slurs = "Slur1 SLUR2, slur3! " * 3
    more = [(1000, None), (1001, ""), (1002, " ?! "), (None, slurs), (1003, slurs), (1003, slurs), (1004, "word1é " * 60_000 + slurs)]
    docs, labels = frames(spark, d + more, [*y, (0, 0), (None, 1), (5, None), (1000, 1)])
    rows = T.toxic_passages(docs.selectExpr("*", "1 score", "2 toxic"), labels.selectExpr("*", "'x' text")).collect()
    assert {r.doc_id for r in rows if r.doc_id is None or r.doc_id >= 1000} == {None, 1003, 1004}
    assert sum(r.doc_id == 1003 for r in rows) == 2
    assert [r.start_token for r in rows if r.doc_id == 1004] == [60_000]
    for a, b in ((docs.limit(0), labels), (docs, labels.limit(0)), (docs, labels.filter("toxic = 0")), (docs, labels.filter("toxic = 1"))):
        assert T.toxic_passages(a, b).count() == 0


def test_scattered_and_noisy(spark):
    """Insults far apart in a long text count together, and a wrong label among the clean ones changes little."""
    d, y = corpus(4)
    rng = random.Random(5)
    far = [rng.choice([f"word{k}é" for k in range(300)]) for _ in range(9_000)]
    insulted = [f"slur{k % 8}" if k % 600 == 300 else w for k, w in enumerate(far)]
    docs, labels = frames(spark, [*d, (1000, " ".join(insulted)), (1001, " ".join(far)), (1002, " ".join(f"slur{k}" for k in range(8)))], [*y, (1002, 0)])
    rows = [r for r in T.toxic_passages(docs, labels).collect() if r.doc_id in (1000, 1001)]
    assert sorted((r.doc_id, r.start_token) for r in rows) == [(1000, k) for k in range(300, 9_000, 600)]
    assert {(r.n_passages, r.doc_p_value <= T.ALPHA, r.p_value > T.ALPHA) for r in rows} == {(15, True, True)}


def test_sum_p_value():
    rng = np.random.default_rng(0)
    s = np.array([rng.exponential(size=n).sum() for n in rng.poisson(3, 200_000)])
    for x in (3.5, 6.0, 10.0, 14.0):
        assert T.sum_p_value(x, 3.0) == pytest.approx((s >= x).mean(), rel=0.1)
    assert T.sum_p_value(20.0, 1e-6) == pytest.approx(1e-6 * math.exp(-20), rel=1e-3)
    assert T.sum_p_value(1.0, 2.0) == 1 and 0 <= T.sum_p_value(5000.0, 40.0) < 1e-300


def test_every_token_of_the_rule_counts(spark):
    """Also one common in both classes, whose shares differ by less than a fifth."""
    docs = [(k, "both " * (k % 2 == 0 or k % 20 < 17) + f"a{k % 7} " + ("rare " * (k in (0, 2)))) for k in range(12_000)]
    labels = [(k, int(k % 2 == 0)) for k in range(12_000)]
    # texts differ, as copies count once
    model = T.train(*frames(spark, [(k, f"{t} only{k}") for k, t in docs], labels))
    h = lambda w: T.tokens(w)[0] in model["h"]
    assert h("both") and not h("rare") and not h("a1")


def plain(docs, labels):
    """The query in plain Python, by the definitions; only the segments come from the operator, which has its own test."""
    label = dict(labels)
    texts: dict = {}
    for doc, text in docs:
        if doc in label:
            texts[text] = max(label[doc], texts.get(text, 0))
    toxic, clean = Counter(), Counter()
    for text, y in texts.items():
        (toxic if y else clean).update(set(text.lower().split()))
    n_t, n_c = sum(toxic.values()), sum(clean.values())

    def odds(t, c):
        total = max(1.0, T.PRIOR * math.sqrt(n_t + n_c))
        prior = total * (t + c) / (n_t + n_c)
        a, b = t + prior, c + prior
        d = math.log(a / (n_t + total - a)) - math.log(b / (n_c + total - b))
        return d, d / math.sqrt(1 / a + 1 / b)

    least = next((k for k in range(1, 200) if odds(k, 0)[1] >= T.LEAST_Z), 1)
    often = [w for w in {*toxic, *clean} if toxic[w] + clean[w] >= least]
    now = {w: odds(toxic[w], clean[w]) for w in often}
    less = {w: odds(toxic[w], clean[w] - 1) for w in often if clean[w] and toxic[w] + clean[w] > 1}
    rows = [w for w in often if abs(now[w][1]) >= T.LEAST_Z or w in less and abs(less[w][1]) >= T.LEAST_Z]
    score = {w: d - T.DRIFT for w, (d, z) in now.items() if abs(z) >= T.LEAST_Z}
    share = {w: (clean[w] + 1) / (n_c + len(rows)) for w in score}
    excess = lambda x: sum(share[w] * math.exp(x * s) for w, s in score.items()) + (1 - sum(share.values())) * math.exp(-x * T.DRIFT) - 1
    lo, hi = 1e-6, 64.0
    for _ in range(200):
        lo, hi = ((lo + hi) / 2, hi) if excess((lo + hi) / 2) < 0 else (lo, (lo + hi) / 2)
    rate = lo

    def passages(text, score):
        w = text.lower().split()
        at = [k for k, x in enumerate(w) if x in score and (not k or w[k - 1] != x)]
        return T.segments(at, [score[w[k]] for k in at]), len(w)

    others = {w: less[w][0] - T.DRIFT for w in less if abs(less[w][1]) >= T.LEAST_Z}
    met = [passages(t, others) for t, y in texts.items() if not y]
    k = (sum(len(p) for p, _ in met) + 1) / sum(n for _, n in met)
    pois = lambda n, m: math.exp(n * math.log(m) - m - math.lgamma(n + 1))
    out = []
    for doc, text in docs:
        found, n = passages(text, score)
        if found:
            x, mean = rate * sum(s for *_, s in found), k * n
            together = 1.0 if x <= mean else sum(pois(j, mean) * sum(pois(i, x) for i in range(j)) for j in range(1, 150))
            p = [1 - math.exp(-mean * math.exp(-rate * s)) if mean * math.exp(-rate * s) > 1e-9 else mean * math.exp(-rate * s) for *_, s in found]
            if min(*p, together) <= T.ALPHA:
                out += [(doc, a, b, s, q, len(found), min(*p, together)) for (a, b, s), q in zip(found, p)]
    return out


def test_query_against_plain_python(spark):
    d, y = corpus(6, 300)
    want = sorted(plain(d, y))
    got = sorted((r.doc_id, r.start_token, r.end_token, r.score, r.p_value, r.n_passages, r.doc_p_value) for r in T.toxic_passages(*frames(spark, d, y)).collect())
    assert [g[:3] + g[5:6] for g in got] == [w[:3] + w[5:6] for w in want] and len(got) > 40
    for g, w in zip(got, want):
        assert g[3:5] + g[6:] == pytest.approx(w[3:5] + w[6:], rel=1e-4, abs=1e-300)
