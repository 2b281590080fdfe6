import random

import numpy as np

from hirelens.llm import _common as C
from hirelens.llm import winnowing as W


def brute(text, k, w):
    letters = [(i, c) for i, c in enumerate(text) if c.isalnum()]
    grams = ["".join(c.lower() if len(c.lower()) == 1 else c for _, c in letters[i : i + k]) for i in range(len(letters) - k + 1)]
    at = [letters[i][0] for i in range(len(grams))]
    return grams, at


def gram_hash(gram):
    """The hash of a gram by the definition: its code points as digits to a base modulo 2**64, and its length, spread."""
    h = (sum(ord(c) * pow(C.ODD, j, 1 << 64) for j, c in enumerate(gram)) + len(gram)) % (1 << 64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h ^ h >> shift) * by % (1 << 64)
    return h


def test_rows_against_brute_force(spark):
    """The query's rows with production parameters and small ones: every window's least hash, the rightmost if tied."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abC dé\n.") for _ in range(n)) for n in (0, 5, 60, 200, 900)] + ["aaaa" * 30, None]
    docs = spark.createDataFrame([(k // 2, t, 0) for k, t in enumerate(texts)], "doc_id bigint, text string, hashes int")
    for k, w in ((W.GRAM, W.WINDOW), (5, 4)):
        want = []
        for n, t in enumerate(texts):
            grams, at = brute(t or "", k, w)
            h = [gram_hash(g) for g in grams]
            chosen = sorted({max(j for j in range(i, min(i + w, len(h))) if h[j] == min(h[i : i + w])) for i in range(max(1, len(h) - w + 1) if h else 0)})
            want.append((n // 2, len(chosen), [h[j] - (h[j] >> 63 << 64) for j in chosen], [at[j] for j in chosen]))
        assert sorted((r.doc_id, r.n_fingerprints, r.hashes, r.positions) for r in W.winnow(docs, k, w).collect()) == sorted(want)


def test_against_brute_force(spark):
    rng = random.Random(0)
    texts = ["".join(rng.choice("abC dé\n.😀") for _ in range(n)) for n in (0, 3, 8, 20, 100, 700)] + ["aaaa" * 30, "ab" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    seen = {}
    for r in W.winnow(docs, 5, 4).collect():
        grams, at = brute(texts[r.doc_id], 5, 4)
        hashes = dict(zip(r.positions, r.hashes))
        assert r.n_fingerprints == len(r.hashes) == len(r.positions)
        # equal grams have equal hashes, wherever they are
        for g, p in zip(grams, at):
            if p in hashes:
                assert seen.setdefault(g, hashes[p]) == hashes[p]
    small = W.lower_table()
    for t in texts:
        grams, at = brute(t, 5, 4)
        hs, ps = W.fingerprint(t, small, 5, 1)  # windows of one: every gram
        assert ps.tolist() == at
        h = hs.view(np.uint64).tolist()
        want = set()
        for i in range(max(1, len(h) - 3) if h else 0):
            window = h[i : i + 4]
            want.add(at[max(j for j in range(i, i + len(window)) if h[j] == min(window))])
        assert W.fingerprint(t, small, 5, 4)[1].tolist() == sorted(want)


def test_guarantee():
    rng = random.Random(2)
    small = W.lower_table()
    for _ in range(50):
        shared = "".join(rng.choice("abcdefgh") for _ in range(W.GRAM + W.WINDOW - 1))
        a, b = ("".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 80))) for _ in range(2))
        assert set(W.fingerprint(a + shared + b, small)[0]) & set(W.fingerprint(b + " " + shared.upper() + a, small)[0])


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "?!", 1), (4, "short", 1), (None, "abc" * 40, 1), (6, "z" * 300_000, 1), (6, "z" * 300_000, 1)], "doc_id int, text string, hashes int")
    rows = W.winnow(docs).collect()
    assert {(r.doc_id, r.n_fingerprints > 0) for r in rows} == {(1, False), (2, False), (3, False), (4, False), (None, True), (6, True)}
    assert len(rows) == 7
    assert W.winnow(docs.limit(0)).count() == 0
