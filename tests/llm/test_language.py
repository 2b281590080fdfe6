import math
import random

import numpy as np
import pytest

from hirelens.llm import language as L

SYLLABLES = {"aa": "ka mo ri tel sun pa".split(), "bb": "zug brem ost wal fip ü".split(), "cc": "çe lou via nni dro esc".split()}


def prose(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words)).capitalize() + "."


def coded(text, codes):
    return "".join(map(chr, L.encode(text, codes)))


def corpus(spark, n=90, seed=0):
    rng = random.Random(seed)
    rows = [(k, prose(rng, lang := sorted(SYLLABLES)[k % 3], rng.randint(30, 200)), lang) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def naive(text, trained):
    """Phrases of the greedy parse, by search in the training text, and those that the end of a block didn't cut off; blocks as the operator has them."""
    n = cut = 0
    for a in range(0, len(text), L.BLOCK):
        block, k = text[a : a + L.BLOCK], 0
        while k < len(block):
            size = 1
            while k + size < len(block) and block[k : k + size + 1] in trained:
                size += 1
            cut += k + size == len(block) and block[k:] in trained
            k += size
            n += 1
    return n, n - cut


def test_phrases_against_search():
    rng = random.Random(1)
    trained = [[rng.randint(0, 4) for _ in range(400)], [rng.randint(2, 6) for _ in range(300)]]
    texts = [bytes(rng.randint(0, 7) for _ in range(n)) for n in (0, 1, 5, 300, L.BLOCK, L.BLOCK + 1, 3 * L.BLOCK + 7)]
    for dense in (94, 3):
        L.DENSE, before = dense, L.DENSE
        got = L.phrases([np.frombuffer(t, np.uint8) for t in texts], [L.table(L.edges(L.automaton(c)), 8) for c in trained], 8)
        L.DENSE = before
        for k in range(2):
            assert got[k].tolist() == [[naive(t, bytes(c))[k] for t in texts] for c in trained]


def test_large_alphabets(spark):
    """Thousands of letters keep apart what letters beyond the 94 commonest would confuse; other scripts are in no language."""
    rng = random.Random(4)
    han, hangul, thai = (["".join(chr(rng.randrange(a, b)) for _ in range(2)) for _ in range(n)] for a, b, n in ((0x4E00, 0x59B8, 1500), (0xAC00, 0xB000, 600), (0x0E01, 0x0E2F, 300)))
    text = lambda of, n: " ".join(rng.choice(of) for _ in range(n))
    rows = [(k, text((han, hangul)[k % 2], 150), ("zh", "ko")[k % 2]) for k in range(80)]
    model = L.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model["width"] > 2000 and all(1 not in e[:, 1] for e in model["edges"])
    test = [text((han, hangul, thai)[k % 3], 60) for k in range(30)] + ["\u0e01", "\u0e01\u0e02", han[0][0]]
    got = list(L.score(test, model))
    assert [g[0] for k, g in enumerate(got[:30]) if k % 3 < 2] == ["zh", "ko"] * 10
    assert [g[3] <= L.MOST_BITS for g in got] == [k % 3 < 2 for k in range(30)] + [False, False, True]


def test_held_out_accuracy(spark):
    test = corpus(spark, 300, seed=9)
    rows = L.identify(test.drop("lang"), labelled=corpus(spark)).join(test, "doc_id").collect()
    assert len(rows) == 300
    assert sum(r.detected == r.lang and r.accepted for r in rows) >= 297


def test_query_against_search(spark):
    docs = corpus(spark, 12)
    model = L.train(docs)
    trained = [coded(" ".join(r[0] for r in docs.filter(f"lang = '{lang}'").orderBy("doc_id").select("text").collect()).lower(), model["codes"]) for lang in model["langs"]]
    assert sorted(map(len, trained)) == sorted(model["sizes"])
    for r in L.identify(docs).join(docs, "doc_id").collect():
        x = coded(r.text, model["codes"])
        bits = min(round(naive(x, t)[0] * math.log2(n + 1) / len(x), 6) for t, n in zip((coded(" ".join(y[2] for y in sorted((h.h, h.doc_id, h.text) for h in docs.filter(f"lang = '{lang}'").selectExpr("pmod(xxhash64(doc_id), 4294967296l) h", "doc_id", "text").collect())).lower(), model["codes"]) for lang in model["langs"]), model["sizes"]))
        assert r.bits == pytest.approx(bits)


def test_edges(spark):
    docs = corpus(spark).unionByName(spark.createDataFrame([(900, None, "aa"), (901, "", "bb"), (902, "12 +? 3\n", None), (903, "日本語のテキスト" * 20, None), (None, "kamo ritel sunpa kari mo", None), (904, "kamo " * 60_000, None), (904, "kamo " * 60_000, None)], "doc_id bigint, text string, lang string")).selectExpr("*", "'x' detected", "1 accepted")
    rows = [r for r in L.identify(docs).collect() if r.doc_id is None or r.doc_id >= 900]
    got = {(r.doc_id, r.detected, r.accepted) for r in rows}
    assert got == {(900, None, False), (901, None, False), (902, None, False), (903, "aa", False), (None, "aa", True), (904, "aa", True)}
    assert len(rows) == 7
    kept = L.accepted_only(docs)
    assert kept.columns == docs.columns
    assert kept.count() == 93
    empty = docs.limit(0)
    assert L.identify(empty).count() == L.accepted_only(empty).count() == 0
    assert [r.accepted for r in L.identify(spark.createDataFrame([(1, "abc def", None)], "doc_id int, text string, lang string")).collect()] == [False]


def test_languages_of_short_texts(spark):
    """A language is trained on short texts where it has no others, and on all usable ones however many short ones it has."""
    rng = random.Random(2)
    short = [(k, prose(rng, "bb", 6)[:60], "bb") for k in range(1000, 1200)]
    mixed = [(k, prose(rng, "aa", 60) if k % 50 == 0 else "ka", "aa") for k in range(2000, 4000)]
    model = L.train(spark.createDataFrame(short + mixed, "doc_id bigint, text string, lang string"), train_docs=40)
    assert model["langs"] == ["aa", "bb"] and min(model["sizes"]) > 1000
    long = [len(t) for _, t, _ in mixed if len(t) >= 100]
    assert model["sizes"][0] >= 0.9 * sum(long)
