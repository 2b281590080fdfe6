import random

import numpy as np

from hirelens.llm import near_duplicates as N


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(40, 200))]
        rows.append(" ".join(words))
        for _ in range(rng.choice((0, 0, 1, 4))):
            other = list(words)
            for _ in range(rng.randint(0, 6)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            rows.append(" ".join(other).upper() if rng.random() < 0.3 else ", ".join(other))
    rng.shuffle(rows)
    return list(enumerate(rows))


def matches(docs, blocks_too=True):
    """All pairs by the definition."""
    ids, v = zip(*[(d, N.blocks([f])[0]) for d, t in docs if d is not None and t and (f := N.fingerprint(t))])
    out = set()
    for i in range(len(ids)):
        for j in range(i):
            each = np.bitwise_count(v[i] ^ v[j])
            if each.sum() <= N.MOST and (not blocks_too or each.min() <= 2) and ids[i] != ids[j]:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def groups(pairs):
    of = {}
    for a, b in sorted(pairs):
        x, y = of.setdefault(a, {a}), of.setdefault(b, {b})
        if x is not y:
            x |= y
            for k in y:
                of[k] = x
    return {k: min(s) for k, s in of.items()}


def found(spark, docs):
    return {r.doc_id: r.group_id for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}


def test_against_brute_force(spark):
    docs = corpus()
    pairs = matches(docs)
    assert len(pairs) > 50
    assert found(spark, docs) == groups(pairs)
    assert len(pairs) >= 0.9 * len(matches(docs, blocks_too=False))


def test_stage(spark):
    docs = spark.createDataFrame([(d, t, "g", "h") for d, t in corpus(3)], "doc_id int, text string, group_id string, Gone_id string")
    of = groups(matches(corpus(3)))
    kept = N.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in corpus(3) if of.get(d, d) == d}


def test_edges(spark):
    long = " ".join(f"x{k % 9000}" for k in range(60_000))
    docs = [(1, None), (2, ""), (3, "?! ..."), (4, "one two three"), (4, "one two three"), (5, "One, two; THREE"), (None, "one two three"), (6, long), (7, long + " end"), (8, "alone here")]
    assert found(spark, docs) == {4: 4, 5: 4, 6: 6, 7: 6}
    assert found(spark, []) == {}
    copies = [(k, f"the same text again and again {k % 2}") for k in range(400)]
    assert set(found(spark, [(k, "the same text again and again") for k in range(400)]).values()) == {0}
    assert found(spark, copies) == groups(matches(copies))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(100)]
    got = {r.id: r.component for r in N.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == groups([(min(e), max(e)) for e in edges if e[0] != e[1]])


def test_links():
    """Members that matched different earlier ones are compared too: here only 1-3, 2-4 and 3-4 match."""
    at = lambda *bits: np.array([sum(1 << b - 30 * k for b in bits if 30 * k <= b < 30 * k + 30) for k in range(N.BLOCKS)], np.uint64)
    values = np.stack([at(*range(60, 100)), at(*range(140, 180)), at(*range(80, 100)), at(*range(140, 160))])
    assert set(N.links(values, np.array([1, 2, 3, 4]), N.MOST)) == {(1, 3), (2, 4), (3, 4)}
    rng = random.Random(1)
    for _ in range(20):
        v = np.stack([at(*(b for b in range(240) if rng.random() < 0.1)) for _ in range(40)])
        pairs = {(i, j) for i in range(40) for j in range(i + 1, 40) if np.bitwise_count(v[i] ^ v[j]).sum() <= N.MOST}
        assert groups(set(N.links(v, np.arange(40), N.MOST))) == groups(pairs)


def test_pairs_near_the_threshold():
    """Of random pairs 31 to 35 bits apart, 8 blocks of 30 find 0.87, 7 of 34 found 0.62."""
    rng = np.random.default_rng(0)
    flips = [rng.choice(N.BLOCKS * N.BITS, rng.integers(31, 36), replace=False) // N.BITS for _ in range(3000)]
    assert np.mean([np.bincount(f, minlength=N.BLOCKS).min() <= 2 for f in flips]) >= 0.8


def spread_out(rng, apart):
    """Two random fingerprints that differ in `apart` bits, as evenly over the 8 blocks as can be."""
    a = rng.random((N.BLOCKS, N.BITS)) < 0.5
    b = a.copy()
    for k in range(N.BLOCKS):
        b[k, rng.choice(N.BITS, apart // N.BLOCKS + (k < apart % N.BLOCKS), replace=False)] ^= True
    return [np.packbits(x, axis=1).tobytes() for x in (a, b)]


def brute(fps, most):
    v = N.blocks(fps)
    return {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if np.bitwise_count(v[i] ^ v[j]).sum() <= most}


def test_all_pairs_within_the_threshold(spark):
    """No block of a pair need be near: here 3 to 5 bits differ in each. In one chunk, in two and in many."""
    rng = np.random.default_rng(2)
    fps = [f for k in range(60) for f in spread_out(rng, (24, 33, 39, 40, 41)[k % 5])]
    # a chain through fingerprints that match their neighbours alone
    chain = [np.packbits(np.arange(N.BLOCKS * N.BITS).reshape(N.BITS, N.BLOCKS).T < 40 * k, axis=1).tobytes() for k in range(6)]
    fps = [fps[k] for k in rng.permutation(len(fps))] + chain
    reps = spark.createDataFrame([(k, bytearray(f)) for k, f in enumerate(fps)], "doc_id bigint, fp binary")
    pairs = brute(fps, N.MOST)
    assert len(pairs) == 48 + 5
    for chunk in (N.CHUNK, 70, 13, 3):
        got = {(min(r), max(r)) for r in N.near_edges(reps, chunk=chunk).collect()}
        assert got <= pairs and groups(got) == groups(pairs)


def test_links_against_brute_force():
    """Biased bits, as one language has them, so that many are near the threshold; any threshold; groups in pieces."""
    rng = np.random.default_rng(3)
    share = rng.choice((0.06, 0.2), (1, N.BLOCKS, N.BITS))
    fps = [np.packbits(x, axis=1).tobytes() for x in rng.random((400, N.BLOCKS, N.BITS)) < share]
    v, ids = N.blocks(fps), np.arange(400)
    for most in (0, 3, 15, 16, 30, 40, 47):
        pairs = brute(fps, most)
        assert groups(set(N.links(v, ids, most))) == groups(pairs) and set(N.links(v, ids, most)) <= pairs
        across = {(i, j) for i, j in pairs if i < 150 <= j}
        assert groups(set(N.links(v, ids, most, 150))) == groups(across)
    tile, N.TILE = N.TILE, 50
    try:
        assert groups(set(N.links(v, ids, 40))) == groups(brute(fps, 40))
    finally:
        N.TILE = tile


def from_fingerprints(monkeypatch, fps):
    """Texts t0, t1, ... that have these fingerprints."""
    monkeypatch.setattr(N, "fingerprints", lambda docs: docs.sparkSession.createDataFrame([(k, bytearray(f)) for k, f in enumerate(fps)], "doc_id bigint, fp binary"))


def test_query_finds_pairs_without_a_near_block(spark, monkeypatch):
    fps = spread_out(np.random.default_rng(4), 40) + spread_out(np.random.default_rng(5), 41)
    from_fingerprints(monkeypatch, fps)
    assert found(spark, [(k, f"t{k}") for k in range(4)]) == {0: 0, 1: 0}
