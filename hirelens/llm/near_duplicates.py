"""SimHash near duplicates, all pairs within the threshold, by multi-index hashing of chunks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm._common import arrow_map, components, durable, mix, range_hashes, spans, unused

#: 240 bits in 8 blocks of 30; two fingerprints match if they differ in at most 40 bits.
BLOCKS, BITS, MOST = 8, 30, 40
#: A block is kept in whole bytes, its unused bits, the lowest, 0.
BYTES = -(-BITS // 8)
SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)
LETTER = np.array([chr(c).isalnum() and c < 128 or c >= 128 for c in range(256)])


def fingerprint(text: str) -> bytes:
    """240 bits as 8 words of 30, each in 4 bytes: the signs of the sum of +-1 vectors of its words, each weighted by the root of its count. Case and punctuation don't count. b"" if there is no word."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    s, e = spans(LETTER[b])
    if not len(s):
        return b""
    h, n = np.unique(range_hashes(b.astype(np.uint64) + np.uint64(1), s, e), return_counts=True)
    total, sign = np.zeros(256, np.float32), np.sqrt(n).astype(np.float32)
    for k in range(0, len(h), 4096):
        bits = np.unpackbits(mix(h[k : k + 4096, None] ^ SEEDS).view(np.uint8), axis=1)
        total += sign[k : k + 4096] @ bits
    up = total[: BLOCKS * BITS] * 2 > sign.sum(dtype=np.float32)
    return np.packbits(up.reshape(BLOCKS, BITS), axis=1).tobytes()


def blocks(fps: list[bytes]) -> np.ndarray:
    """(n, 8) uint64 block values."""
    raw = np.frombuffer(b"".join(fps), np.uint8).reshape(-1, BLOCKS, BYTES)
    out = np.zeros((len(fps), BLOCKS), np.uint64)
    for j in range(BYTES):
        out = out << np.uint64(8) | raw[:, :, j]
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every text with a word."""

    def make(x: dict) -> Iterator[dict]:
        fp = [fingerprint(t) for t in x["text"]]
        keep = [k for k, f in enumerate(fp) if f]
        yield {"doc_id": [x["doc_id"][k] for k in keep], "fp": [fp[k] for k in keep]}

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text").filter("doc_id is not null and text is not null"), make, "doc_id bigint, fp binary")


#: Fingerprints in a chunk; every two chunks are compared, whatever their number.
CHUNK = 1 << 19
#: Two blocks are a word, whose quarters (of 16, 14, 16 and 14 bits) are looked up. A fingerprint goes to at most so many tasks while there are few chunks.
WORDS, QUARTER, QUARTERS, TASKS = 4, 16, 16, 32
#: Pairs compared at once.
TILE = 1 << 17


def shares(most: int) -> list[list[int]]:
    """For each word how many bits may differ in it, then in each of its quarters (-1: it needn't be looked at).

    Of fingerprints at most `most` bits apart, at least one word differs in no more than its number, and in that word at least one quarter in no more than its own: were all above, the numbers plus one, which add up to most + 1, would be too many bits."""

    def split(n: int, order: tuple[int, ...]) -> list[int]:
        return [n // 4 + (order[k] < n % 4) for k in range(4)]

    return [[n - 1, *(x - 1 for x in split(n, (0, 2, 1, 3)))] for n in split(most + 1, (0, 1, 2, 3))]


def masks(most: int) -> np.ndarray:
    """All values of a quarter with at most so many bits, 0 first."""
    v = np.arange(1 << QUARTER)
    v = v[np.bitwise_count(v) <= most]
    return v[np.argsort(np.bitwise_count(v), kind="stable")]


def links(values: np.ndarray, ids: np.ndarray, most: int, first: int | None = None, quarters: Iterable[int] = range(QUARTERS)) -> list[tuple[int, int]]:
    """Edges that join all that match, directly or through others, each between two that match. With `first`, those before it with those from it on alone; with fewer than all quarters, those alone that these find.

    For each quarter, whoever has one value of it is compared with all who have it or one near enough, first over the word, then over all. Groups are compared in pieces, however large."""
    words = values[:, ::2] << np.uint64(32) | values[:, 1::2]
    own, end = first is None, len(ids)
    parent, out = list(range(end)), []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for q in quarters:
        word, k = divmod(q, 4)
        far, *near = shares(most)[word]
        flips, w = masks(near[k]), words[:, word]
        key = (w >> np.uint64(QUARTER * (3 - k)) & np.uint64((1 << QUARTER) - 1)).astype(np.int64)
        left = np.argsort(key[:first], kind="stable")
        right = left if own else first + np.argsort(key[first:], kind="stable")
        at, start = (np.append(0, np.cumsum(np.bincount(key[x], minlength=1 << QUARTER))) for x in (left, right))
        wl, wr = w[left], w[right]
        for value in np.flatnonzero(np.diff(at)) if len(flips) else ():
            to = value ^ flips
            if own:  # each two values once
                to = to[to >= value]
            size = start[to + 1] - start[to]
            n = int(size.sum())
            lo, hi = int(at[value]), int(at[value + 1])
            if n <= own and hi - lo == 1:  # alone, or met by nobody
                continue
            met = np.repeat(start[to] - np.cumsum(size) + size, size) + np.arange(n)
            x = wr[met]
            for c in range(0, n, 4096):
                d = min(c + 4096, n)
                step = max(1, TILE // (d - c))
                for a in range(lo, hi, step):
                    b = min(a + step, hi)
                    apart = np.bitwise_count(wl[a:b, None] ^ x[None, c:d])
                    if own:  # the group itself stands first among those it meets
                        same = np.arange(max(a - lo, c), min(b - lo, d))
                        apart[same + lo - a, same - c] = 255
                    if apart.min() > far:
                        continue
                    i, j = np.nonzero(apart <= far)
                    i, j = left[a + i], right[met[c + j]]
                    hit = np.bitwise_count(words[i] ^ words[j]).sum(1) <= most
                    for one, two in zip(i[hit].tolist(), j[hit].tolist()):
                        if (r := root(one)) != (s := root(two)):
                            parent[max(r, s)] = min(r, s)
                            out.append((int(ids[min(one, two)]), int(ids[max(one, two)])))
    return out


def near_edges(reps: DataFrame, most: int = MOST, chunk: int = CHUNK) -> DataFrame:
    """reps (doc_id, fp), each fp once, to edges (a, b) that join all fingerprints that match, directly or through others.

    Every two chunks meet in one task, or in several with a part of the quarters each; a fingerprint goes to as many tasks as there are chunks, times those parts. Nothing is capped; the cost is a part of the square of the number of fingerprints, the larger the more they are alike."""
    n = max(1, -(-reps.count() // chunk))
    parts = next(p for p in (16, 4, 1) if n * p <= TASKS or p == 1)

    def emit(x: dict) -> Iterator[dict]:
        for k in range(0, len(x["fp"]), 4096):
            ids = np.array(x["doc_id"][k : k + 4096], np.int64)
            rows = np.concatenate([ids[:, None].view(np.uint32), blocks(x["fp"][k : k + 4096]).astype(np.uint32)], 1)
            of = (mix(ids.view(np.uint64)) % np.uint64(n)).astype(np.int64)
            for c in np.unique(of):
                packed = rows[of == c].tobytes()
                tasks = [(min(c, o) * n + max(c, o)) * parts + p for o in range(n) for p in range(parts)]
                yield {"task": tasks, "packed": pa.array([packed] * len(tasks), pa.binary())}

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        pair, part = divmod(key[0].as_py(), parts)
        a, b = divmod(pair, n)
        rows = np.frombuffer(b"".join(t["packed"].to_pylist()), np.uint32).reshape(-1, 2 + BLOCKS)
        ids = np.ascontiguousarray(rows[:, :2]).view(np.int64).ravel()
        of = mix(ids.view(np.uint64)) % np.uint64(n)
        order = np.argsort(of != a, kind="stable")
        got = links(rows[order, 2:].astype(np.uint64), ids[order], most, None if a == b else int((of == a).sum()), range(part, QUARTERS, parts))
        return pa.table({"a": pa.array([x for x, _ in got], pa.int64()), "b": pa.array([y for _, y in got], pa.int64())})

    packed = arrow_map(reps.select("doc_id", "fp"), emit, "task bigint, packed binary")
    return packed.groupBy("task").applyInArrow(meet, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, most: int = MOST) -> DataFrame:
    """docs (doc_id, text, ...) to (doc_id, group_id) of every document that has a near copy; group_id is the least doc_id of the group, the document that stays.

    Two texts match if their 240-bit SimHashes differ in at most `most` bits, all such pairs are found; groups are the connected components. Rows without doc_id or text, and texts without a letter or digit, match nothing. Rows that repeat a doc_id are one document, so they make no group; other columns are ignored. Nothing for an empty table."""
    # A fingerprint that many documents share (exact copies) is searched for once.
    fps = durable(fingerprints(docs).distinct())
    reps = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "fp"))
    copies = fps.join(reps.withColumnRenamed("doc_id", "rep"), "fp").filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    found = components(near_edges(reps, most).union(copies))
    return found.select(F.col("id").alias("doc_id"), F.col("component").alias("group_id"))


def without_near_duplicates(docs: DataFrame, most: int = MOST) -> DataFrame:
    """docs without the documents that near_duplicates finds, but the first of each group; columns as they are, whatever their names.

    Rows without doc_id and texts that match nothing (null, empty, without a letter or digit) stay. Rows that repeat a doc_id stay or go together: they go if any of their texts matches that of a lesser doc_id. An empty table gives an empty one."""
    gone = unused(docs, "gone_id")
    found = near_duplicates(docs, most).filter("doc_id <> group_id").select(F.col("doc_id").alias(gone))
    return docs.join(found, F.col("doc_id").cast("bigint") == F.col(gone), "left_anti")
