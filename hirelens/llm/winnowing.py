"""Document fingerprints by winnowing (Schleimer, Wilkerson and Aiken 2003)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm._common import arrow_map, range_hashes

GRAM, WINDOW = 24, 32


def window_minima(g: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values, where its least stands, the rightmost if tied; one window if there are fewer than w. By doubling: log2(w) passes over g."""
    if not len(g):
        return np.zeros(0, np.int64)
    w, at, wide = min(w, len(g)), np.arange(len(g)), 1
    while wide < w:
        d = min(wide, w - wide)
        right = g[d:] <= g[:-d]
        g, at = np.where(right, g[d:], g[:-d]), np.where(right, at[d:], at[:-d])
        wide += d
    return at


def lower_table() -> np.ndarray:
    """Code point to its small letter; 0 for what is neither letter nor digit."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalnum():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def fingerprint(text: str, small: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions (code points of the text as it is) of the chosen k-grams of its letters and digits."""
    x = small[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    where = np.flatnonzero(x)
    if len(where) < gram:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    first = np.arange(len(where) - gram + 1)
    g = range_hashes(x[where].astype(np.uint64), first, first + gram)
    at = np.unique(window_minima(g, window))
    return g[at].view(np.int64), where[at].astype(np.int32)


def winnow(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text, ...) to (doc_id, n_fingerprints, hashes, positions), one row for each row of docs; no shuffle.

    Letters and digits in small form count, all else is left out. In each window of `window` successive hashes of `gram` letters the least is chosen, the rightmost if tied, and each chosen place once; so two texts that share gram + window - 1 letters in a row share a fingerprint, and none shorter than gram is matched. A text of fewer than `window` grams is one window. A text that is null, empty or of fewer than `gram` letters has empty lists. Repeated rows each give theirs."""
    small = docs.sparkSession.sparkContext.broadcast(lower_table())

    def make(x: dict) -> Iterator[dict]:
        for k in range(0, len(x["text"]), 1000):
            got = [fingerprint(t or "", small.value, gram, window) for t in x["text"][k : k + 1000]]
            yield {"doc_id": x["doc_id"][k : k + 1000], "n_fingerprints": [len(h) for h, _ in got], "hashes": [h for h, _ in got], "positions": [p for _, p in got]}

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), make, "doc_id bigint, n_fingerprints int, hashes array<bigint>, positions array<int>")
