"""Cost-balanced packing of documents into training sequences."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm._common import durable, token_count

CAPACITY, LINEAR, QUADRATIC = 2048, 1.0, 1 / 12288
#: Tokens that are packed together in one task.
SHARD_TOKENS = 4_000_000


def assign(lengths: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[np.ndarray, np.ndarray]:
    """lengths, descending, to the sequence of each and each sequence's cost. Each goes to the sequence of lowest cost that has room, the first if tied; a new one opens if none has."""
    n = max(1, math.ceil(lengths.sum() / capacity))
    cost, room, to = np.zeros(n), np.full(n, capacity), np.zeros(len(lengths), np.int64)
    for k, x in enumerate(lengths.tolist()):
        masked = np.where(room >= x, cost, np.inf)
        j = int(masked.argmin())
        if masked[j] == np.inf:
            j = len(cost)
            cost, room = np.append(cost, 0.0), np.append(room, capacity)
        to[k] = j
        cost[j] += linear * x + quadratic * x * x
        room[j] -= x
    return to, cost


def pack(docs: DataFrame, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """docs (doc_id, text, ...) to (sequence_id, slot, doc_id, piece, start_token, n_tokens, sequence_tokens, sequence_cost), one row for each piece of a document in a sequence.

    A text has as many tokens as words, and one for its end. One over the capacity is cut into full pieces and a rest. A piece of n tokens costs linear n + quadratic n^2, as attention stays inside it. Pieces are dealt by a hash of doc_id (of text if that is null) and piece to shards of about shard_tokens, whose number grows with the corpus; in a shard they go, longest first, each to the sequence of lowest cost with room for it. Only ids and counts are shuffled.

    Null, empty and blank texts have no tokens and take no slot; a null doc_id stays null; repeated rows are each packed; ties go by doc_id and piece, then to the first sequence; other columns don't matter."""
    id_ = F.col("doc_id").cast("bigint")
    counted = durable(docs.select(id_.alias("doc_id"), F.when(id_.isNull(), F.xxhash64("text")).otherwise(id_).alias("of"), token_count("text").alias("n")).filter("n > 0"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, math.ceil(total / shard_tokens))
    pieces = counted.select("doc_id", "of", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / capacity).cast("bigint"))).alias("piece")).select("doc_id", "of", "piece", F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("piece") * capacity).alias("n_tokens"))

    def one(t: pa.Table) -> pa.Table:
        n, ids, piece = t["n_tokens"].to_numpy(), np.array([-1 if x is None else x for x in t["doc_id"].to_pylist()], np.int64), t["piece"].to_numpy()
        order = np.lexsort((piece, ids, -n))
        to, cost = assign(n[order], capacity, linear, quadratic)
        by = np.argsort(to, kind="stable")
        order, to = order[by], to[by]
        first = np.flatnonzero(np.diff(to, prepend=-1))
        slot = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
        full = np.bincount(to, n[order], len(cost)).astype(np.int64)
        shard = t["shard"][0].as_py()
        return pa.table({"sequence_id": (shard << 32) + to, "slot": slot.astype(np.int32), "doc_id": t["doc_id"].take(pa.array(order)), "piece": piece[order], "start_token": piece[order] * capacity, "n_tokens": n[order], "sequence_tokens": full[to], "sequence_cost": cost[to]})

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("of", "piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(one, "sequence_id bigint, slot int, doc_id bigint, piece bigint, start_token bigint, n_tokens bigint, sequence_tokens bigint, sequence_cost double")


#: pack over documents of at most 4 million tokens, which are one shard: the same greedy choice, a piece a step.
SQL = f"""
WITH RECURSIVE counted AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')) + 1 AS n FROM documents),
pieces AS (SELECT doc_id, n, unnest(range((n - 1) // {CAPACITY} + 1)) AS piece FROM counted WHERE n > 1),
queue AS (SELECT doc_id, piece, least({CAPACITY}, n - piece * {CAPACITY}) AS x, row_number() OVER (ORDER BY least({CAPACITY}, n - piece * {CAPACITY}) DESC, doc_id, piece) AS k FROM pieces),
step(k, cost, room, j) AS (
  SELECT CAST(0 AS BIGINT), list_transform(range(CAST(ceil(sum(x) / {CAPACITY}) AS BIGINT)), lambda i: CAST(0 AS DOUBLE)), list_transform(range(CAST(ceil(sum(x) / {CAPACITY}) AS BIGINT)), lambda i: CAST({CAPACITY} AS BIGINT)), CAST(0 AS BIGINT) FROM queue
  UNION ALL
  SELECT k, CASE WHEN j > len(cost) THEN list_append(cost, {LINEAR}::DOUBLE * x + {QUADRATIC!r}::DOUBLE * x * x) ELSE list_transform(cost, lambda c, i: CASE WHEN i = j THEN c + ({LINEAR}::DOUBLE * x + {QUADRATIC!r}::DOUBLE * x * x) ELSE c END) END,
    CASE WHEN j > len(room) THEN list_append(room, {CAPACITY} - x) ELSE list_transform(room, lambda r, i: CASE WHEN i = j THEN r - x ELSE r END) END, j
  FROM (SELECT q.k, q.x, cost, room, coalesce(list_position(list_transform(cost, lambda c, i: CASE WHEN room[i] >= q.x THEN c END), list_min(list_transform(cost, lambda c, i: CASE WHEN room[i] >= q.x THEN c END))), len(cost) + 1)::BIGINT AS j FROM step JOIN queue q ON q.k = step.k + 1)
),
packed AS (SELECT doc_id, piece, x, k, j FROM step JOIN queue USING (k) WHERE k > 0),
last AS (SELECT cost FROM step WHERE k = (SELECT max(k) FROM step))
SELECT j - 1 AS sequence_id, CAST(row_number() OVER (PARTITION BY j ORDER BY k) - 1 AS INTEGER) AS slot, doc_id, piece, piece * {CAPACITY} AS start_token, x AS n_tokens, CAST(sum(x) OVER (PARTITION BY j) AS BIGINT) AS sequence_tokens, cost[j] AS sequence_cost FROM packed, last"""
