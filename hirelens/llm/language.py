"""Language identification by cross-parsing entropy against a suffix automaton per language."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm._common import arrow_map

#: Letters of a language up to which its automaton is a dense table of states by letters; of more, a sorted list of edges.
DENSE = 94
#: Texts are parsed in blocks of so many codes; no phrase crosses a block.
BLOCK = 1024
#: A text that needs more bits a character than this even in its best language is in none of them.
MOST_BITS = 5.5
TRAIN_DOCS, TRAIN_CHARS, TRAIN_LONGEST = 60, 40_000, 20_000


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of codes; state 0 is the root."""
    go: list[dict[int, int]] = [{}]
    link, long, last = [-1], [0], 0
    for c in codes:
        now = len(go)
        go.append({})
        long.append(long[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = now
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if long[p] + 1 == long[q]:
                link[now] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                long.append(long[p] + 1)
                link.append(link[q])
                link[q] = link[now] = twin
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
        last = now
    return go


def edges(go: list[dict[int, int]]) -> np.ndarray:
    """The automaton as rows (state, code, next state): a few for each character of training text, which is what goes to the workers."""
    return np.array([(s, c, q) for s, out in enumerate(go) for c, q in out.items()], np.uint32).reshape(-1, 3)


def table(rows: np.ndarray, width: int) -> dict:
    """The automaton as a parser. An entry is the next state, with the number of phrases that ended in bits 30 and 31.

    dense: entry [state * own letters + letter], letter the code's number among this language's; else the entries of its edges by their sorted keys, state * width + code, and for all others what a code gives at the root."""
    s, c, q = rows.T.astype(np.int64)
    root = np.full(width, 1 << 30, np.uint32)  # a code that the language lacks is a phrase
    root[c[s == 0]] = q[s == 0]
    letters, c_own = np.unique(c, return_inverse=True)
    if len(letters) > DENSE:
        key = s * width + c
        order = np.argsort(key)
        return {"root": root, "keys": key[order], "next": q[order].astype(np.uint32)}
    own = np.zeros(width, np.uint8)  # 0 is any code that it lacks
    own[letters] = np.arange(1, len(letters) + 1)
    root = np.append(np.uint32(1 << 30), root[letters])
    out = np.empty((int(max(s.max(initial=0), q.max(initial=0))) + 1, len(root)), np.uint32)
    out[:] = root + np.uint32(1 << 30)  # the match ends; the code begins the next phrase
    out[0] = root
    out[s, c_own + 1] = q
    return {"own": own, "width": len(root), "dense": out.ravel()}


def steps(t: dict, state: np.ndarray, code: np.ndarray, width: int) -> np.ndarray:
    """The entries for these states and codes (dense: letters)."""
    if "dense" in t:
        return t["dense"].take(state * np.uint32(t["width"]) + code)
    key = state.astype(np.int64) * width + code
    at = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
    return np.where(t["keys"][at] == key, t["next"][at], t["root"][code] + ((state > 0).astype(np.uint32) << np.uint32(30)))


def fold(alphabet: str) -> np.ndarray:
    """Code point to code, capitals as their small letters: 0 divides words, 1 is a letter outside the alphabet, which so is in no automaton."""
    out = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint16 if len(alphabet) < 65_000 else np.uint32, 0x110000)
    for k, c in enumerate(alphabet, 2):
        out[ord(c)] = k
        if len(c.upper()) == 1:
            out[ord(c.upper())] = k
    return out


def encode(text: str, codes: np.ndarray) -> np.ndarray:
    """Codes of the text's letters; any run of others is one 0, none at either end."""
    x = codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    x = x[(x > 0) | (np.concatenate([[0], x[:-1]]) > 0)]
    return x[:-1] if len(x) and not x[-1] else x


def phrases(texts: list[np.ndarray], tables: list[dict], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(languages, texts): phrases of the greedy parse of each text into longest matches, and those of them that ended for want of a longer match, not by the end of the text or block. All blocks advance together, one code a step."""
    size = np.array([len(x) for x in texts], np.int64)
    of = np.repeat(np.arange(len(texts)), -(-size // BLOCK))
    out, ended = np.zeros((2, len(tables), len(texts)), np.int64)
    if not len(of):
        return out, ended
    first = np.concatenate([[0], np.cumsum(-(-size // BLOCK))[:-1]])
    length = np.minimum(BLOCK, size[of] - (np.arange(len(of)) - first[of]) * BLOCK)
    order = np.argsort(-length, kind="stable")
    starts = (np.concatenate([[0], np.cumsum(size)[:-1]])[of] + (np.arange(len(of)) - first[of]) * BLOCK)[order]
    length, of = length[order], of[order]
    flat = np.concatenate([*texts, np.zeros(BLOCK, texts[0].dtype)])
    active = np.searchsorted(-length, -np.arange(length[0]), side="left")
    for k, t in enumerate(tables):
        own = t["own"][flat] if "dense" in t else flat
        grid = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(own, BLOCK)[starts].T)
        state, count = np.zeros(len(of), np.uint32), np.zeros(len(of), np.uint32)
        for step in range(length[0]):
            n = active[step]
            v = steps(t, state[:n], grid[step, :n], width)
            count[:n] += v >> np.uint32(30)
            state[:n] = v & np.uint32((1 << 30) - 1)
        ended[k] = np.bincount(of, count, len(texts)).astype(np.int64)
        out[k] = ended[k] + np.bincount(of, state > 0, len(texts)).astype(np.int64)
    return out, ended


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> dict:
    """A parser for each language in docs.lang, from at most train_docs rows and train_chars characters of it: those of least hash of doc_id, of 100 to 20,000 characters, and where a language has too few such, others (of longer ones the beginning). The bounds keep what goes to the workers at about 1 MB a language, and the tables they make of it at 20 MB."""
    usable = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).filter("lang is not null and doc_id is not null").withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)))
    # of a language's texts those of 100 to 20,000 characters come first, others where it has too few; the bound on hashes is drawn from what each kind has
    usable = usable.filter(F.length("text") > 0).withColumn("fits", F.length("text").between(100, TRAIN_LONGEST))
    counts = {(r["lang"], r["fits"]): r["n"] for r in usable.groupBy("lang", "fits").agg(F.count("*").alias("n")).collect()}
    counts = {k: n for k, n in counts.items() if k[1] or counts.get((k[0], True), 0) < train_docs}
    if not counts:
        return {"langs": [], "codes": fold(""), "edges": [], "width": 2, "sizes": []}
    below = F.create_map(*[F.lit(x) for (lang, fits), n in counts.items() for x in (f"{str(fits).lower()} {lang}", int((1 << 32) * min(1.0, 4 * train_docs / n)))])
    rows = usable.filter(F.col("h") < below[F.concat_ws(" ", F.col("fits").cast("string"), "lang")]).withColumn("text", F.substring("text", 1, TRAIN_LONGEST)).collect()
    text: dict[str, str] = {}
    for lang in sorted({k[0] for k in counts}):
        own = sorted((not r["fits"], r["h"], r["doc_id"], r["text"]) for r in rows if r["lang"] == lang)[:train_docs]
        if got := " ".join(x[3] for x in own)[:train_chars].lower():
            text[lang] = got
    codes = fold("".join(sorted(c for c in set().union(*text.values()) if c.isalpha())))
    width = int(codes.max()) + 1
    coded = [encode(t, codes) for t in text.values()]
    return {"langs": list(text), "codes": codes, "width": width, "sizes": [len(x) for x in coded], "edges": [edges(automaton(x.tolist())) for x in coded]}


def score(texts: list[str | None], model: dict) -> Iterator[tuple[str | None, float | None, float | None, float | None]]:
    """Of each text: the best language, its bits a character, those of the second, and the least bits in any language without phrases that only the end cut off."""
    tables = model.setdefault("tables", [table(e, model["width"]) for e in model["edges"]] if "tables" not in model else None)
    coded = [encode(t or "", model["codes"]) for t in texts]
    k = 0
    while k < len(coded):
        total, end = 0, k
        while end < len(coded) and (end == k or total + len(coded[end]) <= 12_000_000):
            total += len(coded[end])
            end += 1
        c, ended = phrases(coded[k:end], tables, model["width"])
        for j in range(k, end):
            if not (n := len(coded[j])) or not model["langs"]:
                yield None, None, None, None
            else:
                each = [math.log2(x + 1) / n for x in model["sizes"]]
                bits = sorted((round(int(c[i, j - k]) * x, 6), lang, round(int(ended[i, j - k]) * x, 6)) for i, (lang, x) in enumerate(zip(model["langs"], each)))
                yield bits[0][1], bits[0][0], bits[1][0] if len(bits) > 1 else None, min(x[2] for x in bits)
        k = end


def identify(docs: DataFrame, labelled: DataFrame | None = None, most_bits: float = MOST_BITS, **bounds: int) -> DataFrame:
    """docs (doc_id, text, ...) to (doc_id, detected, bits, next_bits, accepted), one row for each row of docs.

    detected is the language whose automaton needs the fewest normalised phrases, c log2(N) / n: c phrases of a greedy parse of the text's n codes into longest matches with N codes of training text. Ties go to the language first in the alphabet. accepted is false if in every language that, without the phrases that only the end of the text (or of a block) cut off, is over most_bits, so that a text too short to be judged stays; and, with detected and bits null, if the text is null, empty or has no letter, or no row of labelled (by default docs itself) names a language. A letter that no training text has is a phrase of its own in every language. Whole texts are parsed, in blocks of 1,024 codes. Repeated rows are scored each; other columns don't matter."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs if labelled is None else labelled, **bounds))

    def make(x: dict) -> Iterator[dict]:
        got = list(score(x["text"], model.value))
        yield {"doc_id": x["doc_id"], "detected": [g[0] for g in got], "bits": [g[1] for g in got], "next_bits": [g[2] for g in got], "accepted": [g[3] is not None and g[3] <= most_bits for g in got]}

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), make, "doc_id bigint, detected string, bits double, next_bits double, accepted boolean")


def accepted_only(docs: DataFrame, most_bits: float = MOST_BITS, **bounds: int) -> DataFrame:
    """The rows of docs that identify accepts, with their columns as they are, whatever their names; no shuffle. So null, empty and letterless texts go, rows without doc_id or lang and repeated rows are judged each by its text, and an empty table gives an empty one."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, **bounds))
    names = docs.columns

    def keep(batches):  # noqa: ANN001, ANN202
        for b in batches:
            got = [g[3] is not None and g[3] <= most_bits for g in score(b.column(names.index("text")).to_pylist(), model.value)]
            yield b.filter(pa.array(got, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
