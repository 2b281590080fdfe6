"""Approximate nearest neighbours with a forest of hash prefixes (LSH Forest: Bawa, Condie and Ganesan 2005)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm._common import arrow_map, durable, partitions, written

K, TREES, BITS = 10, 16, 64
#: A query ends its ascent when its neighbours, at the angles found, would by now have been met with this probability.
TARGET = 0.95
#: The descent's first stop: the longest prefix under which all trees together hold so many others.
FIRST = 256
#: Rows of a sorted array that are stored and compared together, and queries that meet them together.
BLOCK, PACK = 4096, 256
#: Candidates by 8-bit cosine, for each neighbour wanted, whose cosine is then taken exactly.
SLACK = 3
#: Bytes of queries up to which they are sent to every executor, instead of both sides being shuffled by cell.
BROADCAST_BYTES = 64 << 20
SEED = 20_030_707
TOP_BIT = np.uint64(1 << 63)


def unit_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, v: the vector at length 1, as float32 bytes)."""

    def make(x: dict) -> Iterator[dict]:
        m = np.array(x["embedding"], np.float64).reshape(-1, dim)
        m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
        yield {"vec_id": x["vec_id"], "v": [r.tobytes() for r in m]}

    return arrow_map(vectors, make, "vec_id bigint, v binary")


def hashed(units: DataFrame, dim: int, trees: int) -> DataFrame:
    """(vec_id, v, v8: 8-bit components and their scale, hashes: for each tree 64 hyperplane signs, as a bigint whose order is that of the strings)."""

    def make(x: dict) -> Iterator[dict]:
        planes = np.random.default_rng(SEED).standard_normal((dim, trees * BITS), dtype=np.float32)
        m = np.frombuffer(b"".join(x["v"]), np.float32).reshape(-1, dim)
        bits = np.packbits((m @ planes > 0).reshape(len(m), trees, BITS), axis=2).view(">u8")[:, :, 0].astype(np.uint64) ^ TOP_BIT
        scale = np.abs(m).max(1, keepdims=True) / np.float32(127)
        small = np.concatenate([scale.astype(np.float32).view(np.int8), np.rint(m / scale).astype(np.int8)], axis=1)
        yield {"vec_id": x["vec_id"], "v": x["v"], "v8": [r.tobytes() for r in small], "hashes": pa.ListArray.from_arrays(np.arange(0, bits.size + 1, trees, dtype=np.int32), pa.array(bits.view(np.int64).ravel()))}

    return arrow_map(units, make, "vec_id bigint, v binary, v8 binary, hashes array<bigint>")


def top(q: np.ndarray, ids: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query its k best distinct ids, by cosine, then id; sorted so."""
    order = np.lexsort((-cos, ids, q))
    q, ids, cos = q[order], ids[order], cos[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
    q, ids, cos = q[new], ids[new], cos[new]
    order = np.lexsort((ids, -cos, q))
    q, ids, cos = q[order], ids[order], cos[order]
    first = np.flatnonzero(np.diff(q, prepend=q[:1] - 1)) if len(q) else np.zeros(0, np.int64)
    keep = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k
    return q[keep], ids[keep], cos[keep]


def lists(q: np.ndarray, ids: np.ndarray, cos: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """Sorted rows as one (q, ids, cos) for each query, and where each begins and ends."""
    first = np.flatnonzero(np.diff(q, prepend=q[:1] - 1)) if len(q) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(q))
    return pa.RecordBatch.from_pydict({"q": pa.array(q[first], pa.int64()), "ids": pa.array([ids[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()), "cos": pa.array([cos[a:b].astype(np.float32).tobytes() for a, b in zip(first, ends)], pa.binary())}), first, ends


def level_reached(cos: np.ndarray, level: int, trees: int, target: float) -> int:
    """The longest prefix, up to level, at which neighbours with these cosines share it in some tree with probability target on average: 1 - (1 - p^x)^trees, p = 1 - angle / pi."""
    p = 1 - np.arccos(np.clip(cos.astype(np.float64), -1, 1)) / math.pi
    met = (1 - (1 - p[:, None] ** np.arange(level + 1)) ** trees).mean(0)
    return int(np.flatnonzero(met >= target).max())


def ranges(hs: np.ndarray, h: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted strings hs those begin and end that share h's first `level` bits; nowhere if level is over 64."""
    rest = np.minimum(BITS - np.minimum(level, BITS), BITS - 1).astype(np.uint64)
    low = np.where(level == 0, ~np.uint64(0), (np.uint64(1) << rest) - np.uint64(1))
    lo, hi = np.searchsorted(hs, h & ~low), np.searchsorted(hs, h | low, "right")
    return lo, np.where(level > BITS, lo, hi)


def sorted_blocks(forest: DataFrame, bits: int, parts: int) -> DataFrame:
    """forest (vec_id, v8, hashes) to (tree, cell, hs, ids, v8): each tree's sorted array, cut where its first `bits` bits change and after 4,096 rows. Range partitions split what hangs together, also a group of equal strings."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, ids = batch.column("tree").to_numpy(), batch.column("vec_id").to_numpy()
            hs = batch.column("h").to_numpy().view(np.uint64) ^ TOP_BIT
            cell = hs >> np.uint64(BITS - bits) if bits else np.zeros(len(hs), np.uint64)
            flat = np.frombuffer(b"".join(batch.column("v8").to_pylist()), np.int8).reshape(len(hs), -1)
            first = np.flatnonzero((np.diff(tree, prepend=-1) != 0) | (np.diff(cell.view(np.int64), prepend=-1) != 0))
            cuts = [(a, min(a + BLOCK, e)) for s, e in zip(first, [*first[1:], len(hs)]) for a in range(s, e, BLOCK)]
            for k in range(0, len(cuts), 64):
                part = cuts[k : k + 64]
                yield pa.RecordBatch.from_pydict({"tree": tree[[a for a, _ in part]], "cell": cell[[a for a, _ in part]].view(np.int64), "hs": pa.array([hs[a:e].tobytes() for a, e in part], pa.binary()), "ids": pa.array([ids[a:e].tobytes() for a, e in part], pa.binary()), "v8": pa.array([flat[a:e].tobytes() for a, e in part], pa.binary())})

    rows = forest.select("vec_id", "v8", F.posexplode("hashes").alias("tree", "h"))
    return rows.repartitionByRange(parts, "tree", "h", "vec_id").sortWithinPartitions("tree", "h", "vec_id").mapInArrow(pack, "tree int, cell bigint, hs binary, ids binary, v8 binary")


def asked_packs(rows: DataFrame, bits: int, dim: int) -> DataFrame:
    """Queries (q, v, hashes, level, old) to (tree, cell, asked): for each cell that their prefixes of length `level` touch, up to 256 queries a row, as bytes. A prefix of no bits is met in the first tree alone, which holds all."""
    u = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    here = F.shiftrightunsigned(u, BITS - bits) if bits else F.lit(0).cast("bigint")
    wide = F.greatest(F.lit(bits) - F.col("level"), F.lit(0))
    low = F.call_function("shiftleft", F.lit(1).cast("bigint"), wide) - 1
    each = rows.select("q", "v", "level", "old", F.posexplode("hashes").alias("tree", "h")).filter("level > 0 or tree = 0")
    each = each.select("*", F.explode(F.sequence(here.bitwiseAND(F.bitwise_not(low)), here.bitwiseOR(low))).alias("cell"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            tree, cell = b.column("tree").to_numpy(), b.column("cell").to_numpy()
            rows = np.zeros(len(tree), asked_type(dim))
            rows["q"], rows["h"], rows["level"], rows["old"] = (b.column("q").to_numpy(), b.column("h").to_numpy().view(np.uint64) ^ TOP_BIT, b.column("level").to_numpy(), b.column("old").to_numpy())
            rows["v"] = np.frombuffer(b"".join(b.column("v").to_pylist()), np.float32).reshape(-1, dim)
            first = np.flatnonzero((np.diff(tree, prepend=-1) != 0) | (np.diff(cell, prepend=-1) != 0))
            cuts = [(a, min(a + PACK, e)) for s, e in zip(first, [*first[1:], len(tree)]) for a in range(s, e, PACK)]
            yield pa.RecordBatch.from_pydict({"tree": tree[[a for a, _ in cuts]], "cell": cell[[a for a, _ in cuts]], "asked": pa.array([rows[a:e].tobytes() for a, e in cuts], pa.binary())})

    # the query's id is part of the key, so that a hot cell's queries are in several partitions
    return each.repartitionByRange(partitions(rows.sparkSession), "tree", "cell", "q").sortWithinPartitions("tree", "cell", "q").mapInArrow(pack, "tree int, cell bigint, asked binary")


def asked_type(dim: int) -> np.dtype:
    return np.dtype([("q", np.int64), ("h", np.uint64), ("level", np.int32), ("old", np.int32), ("v", np.float32, (dim,))])


def meeting(blocks: DataFrame, packs: DataFrame, size: int) -> DataFrame:
    """Each block beside each pack of queries of its cell; queries of few bytes go to all executors' blocks, else both are shuffled by cell."""
    return blocks.join(F.broadcast(packs) if size <= BROADCAST_BYTES else packs, ["tree", "cell"])


def neighbours(vectors: DataFrame, every: int = 1, k: int = K, trees: int = TREES, target: float = TARGET, first: int = FIRST) -> DataFrame:
    """vectors (vec_id, embedding, ...) to (vec_id, rank, neighbour_id, cosine): for each vector whose vec_id is divisible by `every` its k nearest others among all vectors by cosine, approximately.

    1. Each of the trees is the sorted array of all vectors' strings of 64 random-hyperplane signs, range-partitioned and stored in blocks. 2. Descent: for each query and tree the lengths of the common prefixes with the array's strings are counted by binary search; the query starts at the longest prefix, the same in all trees, under which `first` others stand. 3. Ascent: it is compared with all that stand there. While neighbours at the angles found so far would have shared a prefix of this length in some tree with a probability under `target` on average, its prefix gets shorter in all trees at once, to the length at which that holds, or by one bit if it hasn't met k others; only queries still open go on, and only to what they haven't met. So near copies stop at once and isolated vectors search widely, at worst (no prefix at all) everything; candidates are never capped. 4. Blocks hold 8-bit vectors; the 3 k best by those are ranked by the exact cosine.

    The trees together hold dim + 20 bytes a vector each, written once; queries and results are all that moves after that, unless the queries are too many to send everywhere.

    Ties in cosine (to six places) go by id. Vectors that are null or empty, have a null, NaN or infinite entry, length zero or not the commonest dimension (the greater if tied) are left out, as are rows without vec_id; rows that repeat a vec_id are one, the least embedding; other columns don't matter. A lone vector has no neighbour; an empty table gives an empty one."""
    spark = vectors.sparkSession
    e = F.col("embedding").cast("array<double>")
    good = vectors.filter("vec_id is not null and embedding is not null and size(embedding) > 0").select(F.col("vec_id").cast("bigint").alias("vec_id"), e.alias("embedding")).filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    common = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], SCHEMA)
    dim, keep = common["d"], SLACK * k
    units = written(unit_vectors(good.filter(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), dim))
    n = units.count()
    bits = max(0, math.floor(math.log2(max(1, n) / BLOCK)))
    parts = max(partitions(spark), n * trees * (dim + 20) >> 26)
    blocks = written(sorted_blocks(hashed(units, dim, trees), bits, parts))
    asked = durable(hashed(units.filter(F.col("vec_id") % every == 0), dim, trees).select(F.col("vec_id").alias("q"), "v", "hashes"))
    each = trees * asked_type(dim).itemsize  # bytes of a query at one cell a tree

    def count(x: dict) -> Iterator[dict]:
        for hs, ids, rows in zip(x["hs"], x["ids"], x["asked"]):
            hs, ids, rows = np.frombuffer(hs, np.uint64), np.frombuffer(ids, np.int64), np.frombuffer(rows, asked_type(dim))
            under = np.zeros((len(rows), BITS + 2), np.int64)
            for level in range(bits, BITS + 1):
                lo, hi = ranges(hs, rows["h"], np.full(len(rows), level))
                under[:, level] = hi - lo
            under[:, bits : BITS + 1] -= np.isin(rows["q"], ids)[:, None]  # a query isn't its own neighbour
            exact = under[:, :-1] - under[:, 1:]
            i, level = np.nonzero(exact)
            yield {"q": rows["q"][i], "level": level.astype(np.int32), "n": exact[i, level]}

    start = F.lit(bits).alias("level")
    counts = arrow_map(meeting(blocks.select("tree", "cell", "hs", "ids"), asked_packs(asked.withColumns({"level": F.lit(bits), "old": F.lit(BITS + 1)}), bits, dim), asked.count() * each).select("hs", "ids", "asked"), count, "q bigint, level int, n bigint")
    # of each query at most 65 levels
    down = F.reverse(F.array_sort(F.collect_list(F.struct("level", "n"))))
    so_far = F.aggregate("down", F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-1).alias("level")), lambda a, x: F.when(a["sum"] >= first, a).otherwise(F.struct((a["sum"] + x["n"]).alias("sum"), x["level"].alias("level"))))
    met = counts.groupBy("q", "level").agg(F.sum("n").alias("n")).groupBy("q").agg(down.alias("down")).select("q", so_far.alias("a")).select("q", F.when(F.col("a.sum") >= first, F.col("a.level")).otherwise(bits).cast("int").alias("level"))
    state = durable(asked.select("q").join(met, "q", "left").select("q", F.coalesce("level", start).alias("level"), F.lit(BITS + 1).alias("old"), F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("cos")))

    def meet(x: dict) -> Iterator[dict]:
        for hs, ids, v8, rows in zip(x["hs"], x["ids"], x["v8"], x["asked"]):
            hs, ids, rows = np.frombuffer(hs, np.uint64), np.frombuffer(ids, np.int64), np.frombuffer(rows, asked_type(dim))
            lo, hi = ranges(hs, rows["h"], rows["level"])
            old_lo, old_hi = ranges(hs, rows["h"], rows["old"])
            use = np.flatnonzero(hi - lo > old_hi - old_lo)
            if not len(use):
                continue
            raw = np.frombuffer(v8, np.int8).reshape(len(ids), -1)
            a, z = lo[use].min(), hi[use].max()  # what none of them meets isn't compared
            s = rows["v"][use] @ raw[a:z, 4:].astype(np.float32).T * np.ascontiguousarray(raw[a:z, :4]).view(np.float32)[:, 0]
            at = np.arange(a, z)
            new = (at >= lo[use, None]) & (at < hi[use, None]) & ((at < old_lo[use, None]) | (at >= old_hi[use, None])) & (ids[a:z] != rows["q"][use, None])
            s = np.where(new, s.round(5), np.float32(-3))
            # the least of the best decides, so that all that tie with it are kept
            m = min(keep, z - a)
            i, j = np.nonzero((s >= np.partition(s, z - a - m, axis=1)[:, z - a - m, None]) & new)
            got = lists(*top(rows["q"][use][i], ids[a:z][j], s[i, j], keep))[0]
            yield {c: got.column(c) for c in ("q", "ids", "cos")}

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        for b in batches:
            ids = [np.frombuffer(x, np.int64) for x in b.column("ids").to_pylist()]
            if not ids:
                continue
            q = np.repeat(b.column("q").to_numpy(), [len(x) for x in ids])
            q, ids, cos = np.concatenate([held[0], q]), np.concatenate([held[1], *ids]), np.concatenate([held[2], np.frombuffer(b"".join(b.column("cos").to_pylist()), np.float32)])
            if not len(q):
                continue
            whole = q != q[-1]
            held = top(q[~whole], ids[~whole], cos[~whole], keep)
            if whole.any():
                yield lists(*top(q[whole], ids[whole], cos[whole], keep))[0]
        if len(held[0]):
            yield lists(*held)[0]

    def onward(x: dict) -> Iterator[dict]:
        levels = []
        for level, cos in zip(x["level"], x["cos"]):
            best = np.frombuffer(cos or b"", np.float32)[:k]
            levels.append(level_reached(best, level, trees, target) if len(best) == k else max(0, level - 1))
        yield {"q": x["q"], "level": levels, "old": x["level"], "ids": x["ids"], "cos": x["cos"]}

    state_schema = "q bigint, level int, old int, ids binary, cos binary"
    open_cells = F.sum(F.when(F.col("level") < F.col("old"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(F.lit(bits) - F.col("level"), F.lit(0)))))
    while cells := state.agg(open_cells).first()[0]:
        going = asked.join(state.select("q", "level", "old").filter("level < old"), "q")
        found = arrow_map(meeting(blocks, asked_packs(going, bits, dim), cells * each).select("hs", "ids", "v8", "asked"), meet, "q bigint, ids binary, cos binary").union(state.filter("ids is not null").select("q", "ids", "cos"))
        best = found.repartition("q").sortWithinPartitions("q").mapInArrow(merge, "q bigint, ids binary, cos binary")
        state = durable(arrow_map(state.select("q", "level").join(best, "q", "left"), onward, state_schema))

    def pairs(x: dict) -> Iterator[dict]:
        ids = [np.frombuffer(b, np.int64) for b in x["ids"]]
        yield {"q": np.repeat(np.array(x["q"], np.int64), [len(i) for i in ids]), "neighbour_id": np.concatenate(ids)}

    def exact(x: dict) -> Iterator[dict]:
        a, b = (np.frombuffer(b"".join(x[c]), np.float32).reshape(-1, dim).astype(np.float64) for c in ("v", "w"))
        yield {"vec_id": x["q"], "neighbour_id": x["neighbour_id"], "cosine": np.einsum("ij,ij->i", a, b).round(6)}

    near = arrow_map(state.filter("ids is not null").select("q", "ids"), pairs, "q bigint, neighbour_id bigint")
    full = near.join(units.select(F.col("vec_id").alias("neighbour_id"), F.col("v").alias("w")), "neighbour_id").join(asked.select("q", "v"), "q")
    scored = arrow_map(full.select("q", "neighbour_id", "v", "w"), exact, "vec_id bigint, neighbour_id bigint, cosine double")
    # of each query at most 3 k
    best = scored.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), F.col("neighbour_id").alias("id")))), 1, k).alias("best"))
    return best.select("vec_id", F.posexplode("best").alias("at", "x")).select("vec_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("neighbour_id"), (-F.col("x.c")).alias("cosine"))


SCHEMA = "vec_id bigint, rank int, neighbour_id bigint, cosine double"
