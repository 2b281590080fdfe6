import random

import pytest

from hirelens.llm.substrings import common_words, cut_ranges, earlier_places, repeats, without_repeats

L, K = 8, 3


def brute(spark, docs):
    """{(doc_id, text_hash, again): set of words} by comparing all windows of L words."""
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("doc_id", "xxhash64(text) h", "text").collect()
    at = {}
    for doc, h, text in sorted({tuple(r) for r in docs if r.doc_id is not None and r.text is not None}):
        w = text.split()
        for p in range(len(w) - L + 1):
            at.setdefault(tuple(w[p : p + L]), []).append((doc, h, p))
    out = {}
    for where in at.values():
        first = min(where)
        for doc, h, p in where if len(where) > 1 else ():
            again = (doc, h, p) != first
            lo = max(p, first[2] + L) if again and (doc, h) == first[:2] else p
            if lo < p + L:
                out.setdefault((doc, h, again), set()).update(range(lo, p + L))
    return {k: v for k, v in out.items() if v}


def found(spark, docs, **most):
    out = {}
    for r in repeats(spark.createDataFrame(docs, "doc_id bigint, text string"), L, K, **most).collect():
        new = set(range(r.start_word, r.end_word))
        old = out.setdefault((r.doc_id, r.text_hash, r.again), set())
        assert not old & new
        old |= new
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}é" for k in range(12 if seed else 400)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(L - 1, 25))] for _ in range(5)]
    docs = []
    for doc in range(60):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 12))]
        docs.append((doc if seed < 2 else doc // 2, rng.choice(" \n").join(w)))
    want = brute(spark, docs)
    assert found(spark, docs) == want
    # prefixes of over three places are lengthened instead of grouped
    assert found(spark, docs, most=3) == found(spark, docs, most=1) == want


def test_nodes():
    """Leaves ab, abc, abd, x: places 5, 3, 7 under the node of two words, 3 and 7 under none deeper; then a deeper one."""
    a, b, c = (5, 0, 0), (3, 0, 0), (7, 0, 0)
    assert earlier_places([0, 2, 2], [a, b, c]) == [[(2, b)], [], [(2, b)]]
    assert earlier_places([0, 2, 6], [b, a, c]) == [[], [(2, b)], [(6, a), (2, b)]]
    assert earlier_places([0, 6, 2, 4], [a, c, b, (9, 0, 0)]) == [[(2, b)], [(6, a), (2, b)], [], [(4, b)]]
    assert earlier_places([0], [a]) == [[]]
    assert [common_words(*x) for x in ((b"a b", b"a b c"), (b"a b", b"a bc"), (b"a b", b"a b"), (b"x", b"y"))] == [2, 1, 2, 0]


def test_edges(spark):
    text = " ".join(f"a{k}" for k in range(20))
    docs = [(None, text), (1, None), (2, ""), (3, text), (3, text), (4, "a b"), (5, "x " * 30)]
    x = spark.sql("select xxhash64(repeat('x ', 30))").first()[0]
    assert found(spark, docs) == brute(spark, docs) == {(5, x, False): set(range(8)), (5, x, True): set(range(8, 30))}
    assert found(spark, [(3, text), (3, text)]) == {}
    assert found(spark, []) == {}
    long = " ".join(str(k) for k in range(30_000))
    got = found(spark, [(1, long), (2, "start " + long)])
    assert {(d, a): x for (d, _, a), x in got.items()} == {(1, False): set(range(30_000)), (2, True): set(range(1, 30_001))}
    twice = [(1, text), (1, text + " and more"), (1, None), (1, text)]
    assert found(spark, twice) == brute(spark, twice) and len(brute(spark, twice)) == 2


def test_cutting(spark):
    shared = " ".join(f"s{k}" for k in range(10))
    docs = spark.createDataFrame([(1, f"one {shared}\nend", 7, "p"), (2, f"two {shared}  tail here", 7, "q"), (3, shared, 7, None), (None, shared, 7, "r"), (5, None, 7, "s"), (6, "", 7, "t")], "doc_id int, text string, n_chars int, again string")
    rows = {r.doc_id: r for r in without_repeats(docs, L, K).collect()}
    assert {k: (r.text, r.n_chars, r.again) for k, r in rows.items()} == {1: (f"one {shared}\nend", 7, "p"), 2: ("two tail here", 13, "q"), None: (shared, 7, "r"), 5: (None, 7, "s"), 6: ("", 7, "t")}
    assert rows[2].__fields__ == docs.columns
    again = spark.createDataFrame([(1, shared, 0, 0), (1, shared + " tail", 1, 1), (1, shared, 2, 2)], "doc_id int, text string, cut_id int, Gone int")
    out = without_repeats(again, L, K)
    assert out.columns == again.columns
    first = min((spark.createDataFrame([(t,)], "t string").selectExpr("xxhash64(t)").first()[0], t) for t in (shared, shared + " tail"))[1]
    assert sorted((r.text, r.cut_id) for r in out.collect()) == ([(shared, 0), (shared, 2), ("tail", 1)] if first == shared else [(shared + " tail", 1)])
    assert cut_ranges("a b\nc d", [(0, 1), (2, 3)]) == "b\nd"
