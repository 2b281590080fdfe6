"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.llm._common import durable, token_count, unused

#: Without given targets, a source's weight is its share of tokens to this power, so that small sources are raised.
TEMPERATURE = 0.7
MOST_STEPS, TOLERANCE = 60, 1e-9
#: Up to so many cells (sources by margins' groups) go to every executor; more are joined by a shuffle.
BROADCAST_CELLS = 100_000
#: Weight, as a share of the tokens, of half the squared multipliers in the dual: so it has a least point even if no rates meet all constraints, which then are met as nearly as it allows.
RIDGE = 1e-8


def newton(cells: DataFrame, sizes: list[int], want: np.ndarray) -> tuple[np.ndarray, int]:
    """cells (mass, i0, i1, ...: the cell's index among each constraint's groups) to the multipliers that make the tilted mass of each group what want says.

    Minimises the dual sum mass exp(sum of multipliers) - want . multipliers, plus a slight ridge; each step sums gradient and Hessian over the partitions of cells and solves on the driver. Only groups' numbers bound the driver's part."""
    n, offsets = len(want), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)

    def value(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h, f = np.zeros((n, n)), 0.0
            for b in batches:
                at = np.stack([b.column(1 + k).to_numpy() + o for k, o in enumerate(offsets)], 1)
                w = b.column(0).to_numpy() * np.exp(np.minimum(x[at].sum(1), 500))
                f += w.sum()
                for j in range(at.shape[1]):
                    for k in range(at.shape[1]):
                        np.add.at(h, (at[:, j], at[:, k]), w)
            yield pa.RecordBatch.from_pydict({"f": [f], "h": [h.tobytes()]})

        got = cells.mapInArrow(part, "f double, h binary").collect()
        h = sum((np.frombuffer(r["h"]).reshape(n, n) for r in got), np.zeros((n, n)))
        return sum(r["f"] for r in got) - float(want @ x) + ridge * float(x @ x) / 2, np.diag(h) - want + ridge * x, h + ridge * np.eye(n)

    x, ridge = np.zeros(n), RIDGE * float(want.sum())
    f, g, h = value(x)
    for step in range(MOST_STEPS):
        if np.abs(g).max() <= TOLERANCE * max(1.0, want.sum()):
            return x, step
        d, size = np.linalg.solve(h, -g), 1.0
        while True:
            f2, g2, h2 = value(x + size * d)
            if f2 <= f + 1e-4 * size * float(g @ d) + 1e-9 * abs(f) or size < 1e-6:
                break
            size /= 2
        x, f, g, h = x + size * d, f2, g2, h2
    raise RuntimeError(f"the dual did not settle in {MOST_STEPS} steps: off by {np.abs(g).max():.4g} tokens of {want.sum():.4g}")


def rates(docs: DataFrame, targets: dict | None = None, margins: tuple[str, ...] = (), total: float | None = None) -> DataFrame:
    """docs to (source, *margins, rate), one row for each combination that stands in docs and has tokens.

    Rates are exp(multiplier of the source + of each margin's group): of all rates that give each source its target share of `total` tokens (by default as many as now) and leave the shares of each margin's groups as they are, those of least token-weighted relative entropy to 1."""
    by = ("source", *margins)
    cells = docs.groupBy(*[F.col(c).cast("string").alias(c) for c in by]).agg(F.sum(token_count("text")).cast("double").alias("mass")).filter("mass > 0")
    cells = durable(cells)
    groups = [{r[c]: r["mass"] for r in cells.groupBy(c).agg(F.sum("mass").alias("mass")).collect()} for c in by]
    have = sum(groups[0].values())
    if not have:
        return cells.select(*by, F.lit(1.0).alias("rate"))
    share = {s: (m / have) ** TEMPERATURE for s, m in groups[0].items()} if targets is None else {s: float(targets.get(s, 0)) for s in groups[0]}
    keep = {s for s, w in share.items() if w > 0}
    if not keep:
        raise ValueError("no source with tokens has a target weight")
    if len(keep) < len(share):
        cells = durable(cells.filter(F.coalesce(F.col("source").isin(sorted(s for s in keep if s is not None)), F.lit(None in keep))))
        groups = [{r[c]: r["mass"] for r in cells.groupBy(c).agg(F.sum("mass").alias("mass")).collect()} for c in by]
    total, left, scale = total or have, sum(groups[0].values()), sum(share[s] for s in keep)
    names = [sorted(g, key=lambda k: (k is not None, k or "")) for g in groups]
    want = np.array([total * share[s] / scale for s in names[0]] + [total * g[k] / left for g, own in zip(groups[1:], names[1:]) for k in own])

    def number(c: str, own: list) -> Column:
        known = {k: i for i, k in enumerate(own) if k is not None}
        found = F.create_map(*[F.lit(v) for k, i in known.items() for v in (k, i)])[F.col(c)] if known else F.lit(None).cast("int")
        return F.when(F.col(c).isNull(), F.lit(own.index(None) if None in own else 0)).otherwise(found).cast("int").alias(f"i_{c}")

    numbered = durable(cells.select("mass", *[number(c, own) for c, own in zip(by, names)], *by))
    x, _ = newton(numbered.select("mass", *[f"i_{c}" for c in by]), [len(own) for own in names], want)
    at = np.concatenate([[0], np.cumsum([len(own) for own in names])])
    tilt = sum((F.array(*[F.lit(float(v)) for v in x[at[k] : at[k + 1]]])[F.col(f"i_{c}")] for k, c in enumerate(by)), F.lit(0.0))
    return numbered.select(*by, F.exp(tilt).alias("rate"))


def copies(docs: DataFrame, targets: dict | None = None, margins: tuple[str, ...] = (), total: float | None = None) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names, which no column of docs has: its cell's rate (0 if that has no tokens), and its copies, the rate rounded up with the probability of its fraction, by a hash of doc_id (of text if that is null). Rows alike in doc_id, source and margins have as many copies each."""
    by = ("source", *margins)
    cell, rate, many = {c: unused(docs, f"mix_{c}") for c in by}, unused(docs, "mix_rate"), unused(docs, "mix_copies")
    found = rates(docs, targets, margins, total).select(*[F.col(c).alias(cell[c]) for c in by], F.col("rate").alias(rate))
    same = [F.col(c).cast("string").eqNullSafe(F.col(cell[c])) for c in by]
    # a hash that SQL engines share
    key = F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string")))
    chance = F.conv(F.substring(F.md5(F.concat(F.lit("7 "), key)), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    found = durable(found)
    if found.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        found = F.broadcast(found)
    joined = docs.join(found, functools.reduce(lambda a, b: a & b, same), "left").withColumn(rate, F.coalesce(rate, F.lit(0.0)))
    return joined.withColumn(many, (F.floor(rate) + (chance < F.col(rate) - F.floor(rate)).cast("int")).cast("int")).drop(*cell.values()), rate, many


def mix(docs: DataFrame, targets: dict | None = None, margins: tuple[str, ...] = (), total: float | None = None) -> DataFrame:
    """docs (doc_id, text, source, ...) to (doc_id, source, *margins, n_tokens, rate, copies), one row for each row of docs.

    targets maps sources to weights (None: tokens to the power of TEMPERATURE); sources it lacks get rate 0, and those without tokens in docs are left out and their weight dealt to the rest. A null source is a source of its own. Texts that are null, empty or blank have no tokens: they weigh nothing and take their source's rate, or 0 if no text of their cell has tokens. Repeated rows count each, and round alike. Columns may have any other names. An empty table gives an empty one. Margins that no rates can meet together with the targets are met as nearly as a slight ridge allows. Targets without a positive weight for any source with tokens raise ValueError."""
    out, rate, many = copies(docs, targets, margins, total)
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", *margins, token_count("text").alias("n_tokens"), F.col(rate).alias("rate"), F.col(many).alias("copies"))


def mixed(docs: DataFrame, targets: dict | None = None, margins: tuple[str, ...] = (), total: float | None = None) -> DataFrame:
    """docs with each row as often as mix says; columns as they are, whatever their names. Nulls, empty texts, repeated rows and empty tables as in mix: rows of rate 0 go."""
    out, _, many = copies(docs, targets, margins, total)
    return out.filter(F.col(many) > 0).withColumn(unused(out, "mix_copy"), F.explode(F.sequence(F.lit(1), F.col(many)))).select(*docs.columns)


#: mix over documents with languages' shares kept: rates by proportional fitting, 150 rounds of it, which has the same limit.
SQL = f"""
WITH RECURSIVE counted AS (SELECT doc_id, source, lang, CASE WHEN len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')) > 0 THEN len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')) + 1 ELSE 0 END AS n FROM documents),
cells AS (SELECT source, lang, CAST(sum(n) AS DOUBLE) AS mass FROM counted GROUP BY ALL HAVING sum(n) > 0),
share AS (SELECT source, pow(sum(mass) / (SELECT sum(mass) FROM cells), {TEMPERATURE}) AS w FROM cells GROUP BY 1),
want AS (SELECT source, lang, mass, (SELECT sum(mass) FROM cells) * w / (SELECT sum(w) FROM share) AS by_source, sum(mass) OVER (PARTITION BY lang) AS by_lang FROM cells JOIN share USING (source)),
fit(i, source, lang, mass, by_source, by_lang, rate) AS (
  SELECT 0, *, CAST(1 AS DOUBLE) FROM want
  UNION ALL
  SELECT i + 1, source, lang, mass, by_source, by_lang, rate * CASE WHEN i % 2 = 0 THEN by_source / sum(mass * rate) OVER (PARTITION BY source) ELSE by_lang / sum(mass * rate) OVER (PARTITION BY lang) END FROM fit WHERE i < 300
),
found AS (SELECT doc_id, c.source, c.lang, n, coalesce(rate, 0) AS rate, CAST('0x' || md5('7 ' || doc_id)[1:8] AS BIGINT) / 4294967296.0 AS u FROM counted c LEFT JOIN (SELECT * FROM fit WHERE i = 300) f ON f.source IS NOT DISTINCT FROM c.source AND f.lang IS NOT DISTINCT FROM c.lang)
SELECT doc_id, source, lang, n AS n_tokens, round(rate, 5) AS rate, CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies FROM found"""
