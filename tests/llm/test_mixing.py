import random

import pytest

from hirelens.llm import mixing as M


def corpus(spark, seed=0, n=600):
    rng = random.Random(seed)
    rows = [(k, "w " * rng.randint(1, 60), rng.choices("abcd", (8, 4, 2, 1))[0], rng.choice(("en", "fr"))) for k in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")


def raking(mass, want):
    """Rates by iterative proportional fitting, which has the same limit; mass by cell, want: one {group: tokens} for each margin."""
    x = [dict.fromkeys(w, 1.0) for w in want]
    rate = lambda c: x[0][c[0]] * (x[1][c[1]] if len(x) > 1 else 1)
    for _ in range(500):
        for j, w in enumerate(want):
            now = dict.fromkeys(w, 0.0)
            for c, m in mass.items():
                now[c[j]] += m * rate(c)
            for g in w:
                x[j][g] *= w[g] / now[g]
    return {c: rate(c) for c in mass}


@pytest.mark.parametrize("margins", [(), ("lang",)])
def test_against_raking(spark, margins):
    rows, docs = corpus(spark)
    targets = {"a": 1, "b": 2, "c": 3, "d": 4}
    mass = {}
    for _, text, s, g in rows:
        c = (s, g) if margins else (s,)
        mass[c] = mass.get(c, 0) + len(text.split()) + 1
    total = sum(mass.values())
    want = [{s: total * w / 10 for s, w in targets.items()}] + ([{g: sum(m for c, m in mass.items() if c[1] == g) for g in ("en", "fr")}] if margins else [])
    exact = raking(mass, want)
    got = M.mix(docs, targets, margins).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.rate == pytest.approx(exact[(r.source, r.lang) if margins else (r.source,)], rel=1e-5)
        assert r.copies in (int(r.rate), int(r.rate) + 1)
    for s, tokens in want[0].items():
        assert sum(r.n_tokens * r.copies for r in got if r.source == s) == pytest.approx(tokens, rel=0.25)
    out = M.mixed(docs, targets, margins)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)


def test_rounding_is_unbiased(spark):
    docs = spark.createDataFrame([(k, "w w w", "ab"[k % 2]) for k in range(4000)], "doc_id bigint, text string, source string")
    got = M.mix(docs, {"a": 3, "b": 1}).collect()
    assert sum(r.copies for r in got if r.source == "a") == pytest.approx(3000, rel=0.04)
    assert sum(r.copies for r in got if r.source == "b") == pytest.approx(1000, rel=0.08)


def test_edges(spark):
    rows = [(1, "a b c", "x", "p"), (1, "a b c", "x", "p"), (2, None, "x", "p"), (3, "", "y", "p"), (4, "d " * 100_000, None, "q"), (None, "e f", "z", "p")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, rate string")
    got = M.mix(docs, {"x": 1, None: 1, "gone": 5, "y": 1}, total=80).collect()
    rates = {r.source: round(r.rate, 6) for r in got}
    assert rates == {"x": 5.0, None: round(40 / 100_001, 6), "z": 0.0, "y": 0.0}
    assert len(got) == 6 and len({r.copies for r in got if r.doc_id == 1}) == 1
    assert M.mixed(docs, {"x": 1}, total=8).columns == docs.columns
    assert M.mix(docs).count() == 6
    assert M.mix(docs.limit(0)).count() == M.mixed(docs.limit(0)).count() == 0
    assert {r.rate for r in M.mix(docs.filter("text = '' or text is null")).collect()} == {0.0}
    with pytest.raises(ValueError, match="no source"):
        M.mix(docs, {"other": 1}).count()
    # two sources of one language each: the languages can't keep their shares, and it still settles
    apart = spark.createDataFrame([(1, "a b c", "x", "p"), (2, "a b c", "y", "q")], "doc_id int, text string, source string, lang string")
    assert M.mix(apart, {"x": 3, "y": 1}, ("lang",)).count() == 2


def test_clashing_columns(spark):
    names = ("mix_rate", "mix_source", "Mix_Copies", "mix_copy", "mix_lang", "n_tokens", "copies", "rate")
    docs = spark.createDataFrame([(k, "w w w", "ab"[k % 2], "p", *[k + j for j in range(8)]) for k in range(100)], "doc_id int, text string, source string, lang string, " + ", ".join(f"{c} int" for c in names))
    out = M.mixed(docs, {"a": 3, "b": 1}, ("lang",))
    assert out.columns == docs.columns
    assert all(tuple(r)[4:] == tuple(r.doc_id + j for j in range(8)) for r in out.collect())
    assert M.mix(docs, {"a": 3, "b": 1}, ("lang",)).columns == ["doc_id", "source", "lang", "n_tokens", "rate", "copies"]
