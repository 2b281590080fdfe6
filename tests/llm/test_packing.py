import random

import numpy as np

from hirelens.llm import packing as P


def naive(lengths, capacity):
    """Each piece by a plain search through all sequences."""
    n = max(1, -(-sum(lengths) // capacity))
    seqs = [[0.0, capacity] for _ in range(n)]
    out = []
    for x in lengths:
        fits = [k for k, (_, room) in enumerate(seqs) if room >= x]
        if not fits:
            seqs.append([0.0, capacity])
            fits = [len(seqs) - 1]
        k = min(fits, key=lambda k: (seqs[k][0], k))
        seqs[k][0] += P.LINEAR * x + P.QUADRATIC * x * x
        seqs[k][1] -= x
        out.append(k)
    return out


def brute(docs, capacity):
    """{(sequence, doc_id, piece): tokens} of one shard."""
    pieces = []
    for doc, text in docs:
        n = len(text.split()) + 1 if text and text.split() else 0
        pieces += [(-min(capacity, n - a), -1 if doc is None else doc, a // capacity) for a in range(0, n, capacity)]
    pieces.sort()
    return [(s, None if d == -1 else d, p, -n) for s, (n, d, p) in zip(naive([-x[0] for x in pieces], capacity), pieces)]


def test_assign_against_brute_force():
    rng = random.Random(0)
    for _ in range(30):
        lengths = sorted((rng.randint(1, 100) for _ in range(rng.randint(1, 120))), reverse=True)
        assert P.assign(np.array(lengths), 100)[0].tolist() == naive(lengths, 100)


def test_against_brute_force(spark):
    rng = random.Random(1)
    docs = [(k, "w " * rng.randint(0, 260)) for k in range(80)] + [(None, "a b"), (3, "x " * 50), (3, "x " * 50), (200, None), (201, ""), (202, " \n")]
    frame = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id int, text string, n_tokens int")
    rows = P.pack(frame, capacity=64).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted([(r.sequence_id, r.doc_id, r.piece, r.n_tokens) for r in rows], key=key) == sorted(brute(docs, 64), key=key)
    many = P.pack(frame, capacity=64, shard_tokens=1000).collect()
    for got in (rows, many):
        total, cost = {}, {}
        for r in got:
            total[r.sequence_id] = total.get(r.sequence_id, 0) + r.n_tokens
            cost[r.sequence_id] = cost.get(r.sequence_id, 0) + r.n_tokens + P.QUADRATIC * r.n_tokens**2
            assert r.start_token == 64 * r.piece
        assert max(total.values()) <= 64
        assert all(total[r.sequence_id] == r.sequence_tokens and abs(cost[r.sequence_id] - r.sequence_cost) < 1e-6 for r in got)
        assert sum(total.values()) == sum(x[3] for x in brute(docs, 64))
    assert len({r.sequence_id >> 32 for r in many}) > 3


def test_edges(spark):
    assert P.pack(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert P.pack(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")).count() == 0
    rows = P.pack(spark.createDataFrame([(1, "w " * 100_000)], "doc_id bigint, text string")).collect()
    assert sum(r.n_tokens for r in rows) == 100_001 and sorted(r.piece for r in rows) == list(range(49))
