"""Toxic passages: maximal-scoring segments of token log-odds, summed over each document and calibrated on clean ones."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm._common import arrow_map, durable, range_hashes, spans

#: At most so many labelled rows train the model, those of least hash of doc_id; so the broadcast of their ids is bounded too.
TRAIN_DOCS = 20_000
#: The prior weighs as much as so many times the root of the number of tokens in training, so the less the more of them there are; and the z from which a token counts.
PRIOR, LEAST_Z = 20.0, 3.5
#: What each token takes off its log-odds, which is 0 if it doesn't count; a document's p-value from which it is significant.
DRIFT, ALPHA = 1.5, 1e-7
LETTER = np.array([chr(c).isalnum() and c < 128 or c >= 128 for c in range(256)])


def tokens(text: str) -> np.ndarray:
    """Hashes of the text's words in small letters, in order."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    s, e = spans(LETTER[b])
    return range_hashes(b.astype(np.uint64) + np.uint64(1), s, e)


def log_odds(toxic, clean, n_t: int, n_c: int, prior: float = PRIOR, of=np):  # noqa: ANN001, ANN201
    """Of each token's counts among n_t and n_c: the log-odds ratio with an informative Dirichlet prior (Monroe, Colaresi and Quinn 2008) in proportion to the token's share of both classes, and its z. Arrays, or columns with functions as `of`."""
    total = max(1.0, prior * math.sqrt(n_t + n_c))
    a = (toxic + clean) * (total / max(1, n_t + n_c))
    t, c = toxic + a, clean + a
    delta = of.log(t / (n_t + total - t)) - of.log(c / (n_c + total - c))
    return delta, delta / of.sqrt(1 / t + 1 / c)


def segments(at: list[int], score: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (Ruzzo and Tompa 1999), as (start, end, score), of a sequence in which token at[k] scores score[k], and every other -drift; in time linear in len(at)."""
    held: list[list] = []  # left sum, right sum, start, end, of candidates
    total, after = 0.0, 0
    for p, s in zip(at, score):
        total -= drift * (p - after)
        after = p + 1
        if s <= 0:
            total += s
            continue
        new = [total, total + s, p, p + 1]
        total += s
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= new[0]:
                j -= 1
            if j < 0 or held[j][1] >= new[1]:
                break
            new = [held[j][0], new[1], held[j][2], new[3]]
            del held[j:]
        held.append(new)
    return [(s, e, r - left) for left, r, s, e in held]


def rate(score: np.ndarray, share: np.ndarray, drift: float) -> float:
    """Karlin and Altschul's lambda: the positive root of sum p exp(lambda s) = 1 over the clean distribution of scores."""
    rest = max(0.0, 1 - share.sum())
    f = lambda x: float((share * np.exp(np.minimum(700, x * score))).sum()) + rest * math.exp(-x * drift) - 1
    if not (score > 0).any() or f(1e-6) >= 0:
        return 0.0
    lo, hi = 1e-6, 1.0
    while f(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return lo


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, prior: float = PRIOR, least_z: float = LEAST_Z, drift: float = DRIFT) -> dict:
    """Token scores and the parameters of the passages of clean text, from at most train_docs labelled rows. The driver gets significant tokens and the clean documents' number of passages only."""
    chosen = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id")).limit(train_docs)
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    # copies of one text would make each of its words telling
    sample = durable(sample.groupBy("text").agg(F.max("toxic").alias("toxic")))

    def count(x: dict) -> Iterator[dict]:
        toxic = np.array(x["toxic"]) > 0
        sides = [np.unique(np.concatenate([np.zeros(0, np.uint64)] + [np.unique(tokens(t)) for t, y in zip(x["text"], toxic) if y == side]), return_counts=True) for side in (True, False)]
        yield {"h": np.concatenate([h for h, _ in sides]).view(np.int64), "toxic": np.concatenate([sides[0][1], 0 * sides[1][1]]), "clean": np.concatenate([0 * sides[0][1], sides[1][1]])}

    counts = durable(arrow_map(sample, count, "h bigint, toxic bigint, clean bigint").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    n = counts.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.coalesce(F.sum("clean"), F.lit(0)).alias("clean")).first()
    none = {"h": np.zeros(0, np.uint64), "score": np.zeros(0), "rate": 0.0, "k": 1.0}
    if not n["toxic"] or not n["clean"]:
        return none
    # the rule's least count: that from which a token in no clean document has least_z
    few = [(k, float(log_odds(k, 0, n["toxic"], n["clean"], prior)[1])) for k in range(1, 200)]
    least = next((k for k, z in few if z >= least_z), 1)
    z_of = lambda c: F.abs(log_odds(F.col("toxic").cast("double"), c.cast("double"), n["toxic"], n["clean"], prior, F)[1])
    # one that counts only without one of its clean documents is needed below; z is worked out again there
    rows = counts.filter(F.col("toxic") + F.col("clean") >= least).filter((z_of(F.col("clean")) >= least_z - 1e-6) | F.when((F.col("clean") > 0) & (F.col("toxic") + F.col("clean") > 1), z_of(F.col("clean") - 1) >= least_z - 1e-6).otherwise(False)).collect()
    if not rows:
        return none
    h, t, c = (np.array([r[k] for r in rows], np.int64) for k in ("h", "toxic", "clean"))

    def scores(c: np.ndarray, seen: np.ndarray) -> dict:
        delta, z = log_odds(t, c, n["toxic"], n["clean"], prior)
        use = np.flatnonzero((np.abs(z) >= least_z) & seen)
        use = use[np.argsort(h[use].view(np.uint64))]
        return {"h": h[use].view(np.uint64), "score": delta[use] - drift, "use": use}

    model = scores(c, c >= 0) | {"rate": 0.0, "k": 1.0}
    # each token as if one more clean document had it: else those in none would count as impossible there, and the first to have one, perhaps a wrong label, would decide
    share = (c + 1) / (n["clean"] + len(c))
    model["rate"] = rate(model["score"], share[model.pop("use")], drift)
    # a clean document is scored by the others' counts: its own occurrences would hide what it has of the toxic ones' words
    others = scores(np.maximum(0, c - 1), c > 0)

    def passed(x: dict) -> Iterator[dict]:
        texts = [tokens(t) for t in x["text"]]
        yield {"tokens": [sum(map(len, texts))], "passages": [sum(len(passages(h, others, drift)) for h in texts)]}

    # passages of clean documents a token, one more than were met, as none met doesn't mean none
    fit = arrow_map(sample.filter("toxic = 0").select("text"), passed, "tokens bigint, passages bigint").agg(F.sum("tokens").alias("tokens"), F.sum("passages").alias("passages")).first()
    return model | {"k": ((fit["passages"] or 0) + 1) / max(fit["tokens"] or 0, 1)}


def sum_p_value(x: float, mean: float) -> float:
    """P(S >= x) of the sum S of a Poisson number (of that mean) of exponential variables of mean 1: the sum over j of P(Poisson(x) = j) P(Poisson(mean) > j)."""
    if x <= mean:
        return 1.0
    j = np.arange(int(x + 12 * math.sqrt(x)) + 60)
    fact = np.concatenate([[0.0], np.cumsum(np.log(j[1:]))])
    log_n = j * math.log(mean) - mean - fact
    above = np.concatenate([np.logaddexp.accumulate(log_n[::-1])[::-1][1:], [-np.inf]])
    return float(min(1.0, np.exp(j * math.log(x) - x - fact + above).sum()))


def passages(h: np.ndarray, model: dict, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    if not len(model["h"]) or not len(h):
        return []
    k = np.minimum(np.searchsorted(model["h"], h), len(model["h"]) - 1)
    at = np.flatnonzero((model["h"][k] == h) & (h != np.concatenate([~h[:1], h[:-1]])))
    return segments(at.tolist(), model["score"][k[at]].tolist(), drift) if len(at) else []


def toxic_passages(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, drift: float = DRIFT, **bounds: float) -> DataFrame:
    """docs (doc_id, text, ...) and labels (doc_id, toxic, ...) to (doc_id, start_token, end_token, score, p_value, n_passages, best_score, doc_p_value): every passage of each significant document, and what they come to together. Other documents have no row; no shuffle of docs.

    A token scores its log-odds in toxic against clean documents (each document counts once) if its z is 3.5 or more either way and it is in at least as many documents of the sample as give a token of no clean document that z (a rarer one can have it with a few clean ones, but z is unreliable there), else 0, less drift (0 too if it repeats the token before it); a text's passages are all its maximal-scoring segments. In clean text of m tokens their number is about Poisson of mean k m and rate s exponential, with the rate by Karlin and Altschul over clean token shares (each token counted in one document more) and k the passages a token of clean documents, each scored without its own counts. So a passage's p_value is 1 - exp(-k m exp(-rate s)), and all passages of a document together have the p of a compound Poisson sum; doc_p_value is the lesser of that and the least p_value, without correction for the choice. A document with doc_p_value up to alpha is significant, however far apart its passages stand; p_value may then be over alpha.

    Texts that are null, empty or without letters give nothing; nor does any text if labels is empty or all of one kind. A document with both labels counts as toxic. Repeated rows of docs each give their passages; other columns don't matter. Whole texts are scanned."""
    model = train(docs, labels, drift=drift, **bounds)
    if not len(model["h"]) or model["rate"] <= 0:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(x: dict) -> Iterator[dict]:
        out = []
        for doc, t in zip(x["doc_id"], x["text"]):
            h, m = tokens(t), shared.value
            if got := passages(h, m, drift):
                mean, whole = m["k"] * len(h), [m["rate"] * s for _, _, s in got]
                p = [-math.expm1(-mean * math.exp(-s)) for s in whole]
                doc_p = min(*p, sum_p_value(sum(whole), mean))
                if doc_p <= alpha:
                    out += [(doc, *g, q, len(got), max(x[2] for x in got), doc_p) for g, q in zip(got, p)]
        yield dict(zip(("doc_id", "start_token", "end_token", "score", "p_value", "n_passages", "best_score", "doc_p_value"), zip(*out) if out else [[]] * 8))

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text").filter("text is not null"), make, SCHEMA)


SCHEMA = "doc_id bigint, start_token int, end_token int, score double, p_value double, n_passages int, best_score double, doc_p_value double"
