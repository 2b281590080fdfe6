"""The whole pipeline against plain Python over a small corpus."""

import hashlib
import math
import random

import pytest

import corpus_pipeline
from hirelens.llm import language, mixing, near_duplicates
from hirelens.llm.substrings import GRAM, MIN_WORDS
from tests.llm.test_language import coded
from tests.llm.test_language import naive as naive_phrases
from tests.llm.test_mixing import raking
from tests.llm.test_near_duplicates import groups, matches
from tests.llm.test_packing import brute as naive_packing

SYLLABLES = {"aa": "ka mo ri tel sun pa du".split(), "bb": "zug brem ost wal fip ü ack".split()}


def corpus():
    rng = random.Random(7)
    word = lambda g: "".join(rng.choice(SYLLABLES[g]) for _ in range(rng.randint(2, 5)))
    passages = {g: [word(g) for _ in range(70)] for g in SYLLABLES}
    rows = []
    for k in range(150):
        g = rng.choice("aab") * 2
        w = [word(g) for _ in range(rng.randint(60, 200))]
        if k % 5 == 0:
            p = rng.randrange(len(w))
            w[p:p] = passages[g]
        rows.append((" ".join(w), g))
        if k % 4 == 0:
            other = list(w)
            other[rng.randrange(len(w))] = word(g)
            rows.append((" ".join(other).upper(), g))
    rows += [("日本語" * 30, "aa"), ("", "bb"), (None, "aa"), ("123 456", None)]
    rng.shuffle(rows)
    return [(k, t, g, rng.choices(("s0", "s1", "s2"), (6, 2, 1))[0], -1 if t is None else len(t)) for k, (t, g) in enumerate(rows)]


def cut_windows(rows):
    """rows without their repeated windows of MIN_WORDS words but the first of each."""
    at = {}
    for doc, text, *_ in rows:
        w = text.split()
        for p in range(len(w) - MIN_WORDS + 1):
            at.setdefault(tuple(w[p : p + MIN_WORDS]), []).append((doc, p))
    gone = {}
    for where in at.values():
        first = min(where)
        for doc, p in where:
            if (doc, p) != first:
                gone.setdefault(doc, set()).update(range(max(p, first[1] + MIN_WORDS) if doc == first[0] else p, p + MIN_WORDS))
    out = []
    for doc, text, g, s, n in rows:
        if doc in gone:
            text = " ".join(x for k, x in enumerate(text.split()) if k not in gone[doc])
            n = len(text)
            if not text:
                continue
        out.append((doc, text, g, s, n))
    return out


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(corpus(), "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_against_brute_force(spark, documents):
    docs = spark.read.parquet(f"{documents}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    assert GRAM < MIN_WORDS
    stages = dict(corpus_pipeline.STAGES)

    # language ID: parses by search in the training text
    model = language.train(docs)
    hashed = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id), 4294967296l) h").collect()}
    trained = []
    for lang in model["langs"]:
        own = sorted((hashed[d], d, t) for d, t, g, *_ in rows if g == lang and t and 100 <= len(t) <= language.TRAIN_LONGEST)[: language.TRAIN_DOCS]
        trained.append(coded(" ".join(x[2] for x in own)[: language.TRAIN_CHARS].lower(), model["codes"]))
    kept = []
    for r in rows:
        x = coded(r[1] or "", model["codes"])
        each = [tuple(round(n * math.log2(len(t) + 1) / len(x), 6) for n in naive_phrases(x, t)) for t in trained] if x else []
        if x and min(e[1] for e in each) <= language.MOST_BITS:
            kept.append(r)
    got = stages["language ID"](spark, docs, documents)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted(kept)
    assert len(rows) - len(kept) == 4

    # near duplicates: all pairs
    of = groups(matches([r[:2] for r in kept]))
    kept2 = [r for r in kept if of.get(r[0], r[0]) == r[0]]
    assert sorted(map(tuple, stages["near-duplicate removal"](spark, got, documents).collect())) == sorted(kept2) and len(kept2) < len(kept) - 20

    # substrings: all windows
    kept3 = cut_windows(kept2)
    third = stages["substring dedup"](spark, spark.createDataFrame(kept2, docs.schema), documents)
    assert third.columns == docs.columns and sorted(map(tuple, third.collect())) == sorted(kept3) and kept3 != kept2

    # mixing: rates by raking, rounded by the same hash
    tokens = lambda t: len(t.split()) + 1 if t.split() else 0
    mass = {}
    for _, t, g, s, _ in kept3:
        mass[s, g] = mass.get((s, g), 0) + tokens(t)
    total, by = sum(mass.values()), lambda j: {x: sum(m for c, m in mass.items() if c[j] == x) for x in {c[j] for c in mass}}
    weight = {s: (m / total) ** mixing.TEMPERATURE for s, m in by(0).items()}
    exact = raking(mass, [{s: total * w / sum(weight.values()) for s, w in weight.items()}, by(1)])
    u = {d: int(hashlib.md5(f"7 {d}".encode()).hexdigest()[:8], 16) / 2**32 for d, *_ in rows}
    kept4 = [r for r in kept3 for _ in range(int(exact[r[3], r[2]]) + (u[r[0]] < exact[r[3], r[2]] % 1))]
    assert sorted(map(tuple, stages["source mixing"](spark, spark.createDataFrame(kept3, docs.schema), documents).collect())) == sorted(kept4)

    # packing, and the stages one after another
    want = sorted(naive_packing([r[:2] for r in kept4], 2048))
    assert sorted((r.sequence_id, r.doc_id, r.piece, r.n_tokens) for r in corpus_pipeline.run(spark, documents).collect()) == want


def test_edges(spark, tmp_path):
    rows = [(None, "kamori telsun " * 40, "aa", None, 9), (1, "kamori telsun " * 40, "aa", "s", 9), (1, "kamori telsun " * 40, "aa", "s", 9), (2, None, None, None, None), (3, "", "aa", "s", 0), (4, "kamori " * 50_000, "aa", "s", 9)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for k, data in enumerate((rows, [], rows[3:5])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{k}").collect()
        assert bool(out) == (k == 0)
    assert near_duplicates.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_near_copies_without_a_near_block(spark):
    """Copies within the threshold of which each block of the fingerprint differs in 3 bits or more go too."""
    rng, texts, pairs = random.Random(11), [], 0
    vocabulary = [f"w{k}" for k in range(3000)]
    while pairs < 4:
        one = [rng.choice(vocabulary) for _ in range(60)]
        two = [rng.choice(vocabulary) if rng.random() < 0.08 else w for w in one]
        pair = [(len(texts) + k, " ".join(w)) for k, w in enumerate((one, two))]
        if matches(pair, blocks_too=False) and not matches(pair):
            texts += [t for _, t in pair]
            pairs += 1
    rows = [(k, t, None, None, -1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    of = groups(matches([r[:2] for r in rows], blocks_too=False))
    assert len(of) == 8
    assert sorted(map(tuple, corpus_pipeline.near_dedup(spark, docs, "").collect())) == [r for r in rows if of.get(r[0], r[0]) == r[0]]
