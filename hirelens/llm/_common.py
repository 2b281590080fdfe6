"""Helpers shared by the operators: cutting lineage, Arrow batches, vectorised word hashing, connected components."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Functions go to the workers by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])

ODD = 0x9E3779B97F4A7C15


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="hirelens-checkpoint-")
        sc.setCheckpointDir(folder)
        gone_at_end(spark, sc.getCheckpointDir())
    return sc.getCheckpointDir()


def gone_at_end(spark: SparkSession, folder: str) -> None:
    """Has the driver delete a folder of its own when it ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, of which later reads take only the columns they need; deleted when the driver ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4()}"
    df.write.parquet(folder)
    gone_at_end(spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that a lost executor takes nothing with it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def unused(df: DataFrame, name: str) -> str:
    """name, with as many lines before it as it takes to clash with no column of df, in capitals or not."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def token_count(text: str | Column) -> Column:
    """Words of a text, divided by white space, and one token for its end; 0 for a null, empty or blank one. An estimate that needs no tokenizer."""
    n = F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))
    return F.when(n > 0, n + 1).otherwise(0).cast("bigint")


def arrow_map(df: DataFrame, make: Callable[[dict], Iterator[dict]], schema: str) -> DataFrame:
    """make gets each Arrow batch as {column: list} and yields {column: list or array} in schema's order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for out in make(batch.to_pydict()):
                    yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in kinds], schema=kinds)

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: int = ODD) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    held = powers.__dict__.setdefault(f"held_{base}", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    while len(held[0]) <= n:
        k = len(held[0])
        for j, b in enumerate((base, pow(base, -1, 1 << 64))):
            held[j] = np.concatenate([held[j], held[j] * np.uint64(pow(b, k, 1 << 64))])
    return held[0][: n + 1], held[1][: n + 1]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = ODD) -> np.ndarray:
    """A 64-bit hash of values[s:e] for every s, e; equal ranges have equal hashes wherever they stand."""
    up, down = powers(len(values), base)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[:-1] if len(values) else values.astype(np.uint64), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of text, and start, end (byte offsets) and hash of each word; bytes up to 32 divide words."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    s, e = spans(b > 32)
    return b, s, e, range_hashes(b.astype(np.uint64) + np.uint64(1), s, e)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b: bigint) to (id, component): the smallest id that each id is joined to, by any chain of edges.

    Large-star and small-star rounds (Kiveris et al. 2014): each shuffles the edges twice; the number of rounds grows with the logarithm of the longest chain."""
    e = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    for _ in range(most_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = Window.partitionBy("u")
        large = both.withColumn("m", F.least("u", F.min("v").over(near))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.withColumn("m", F.min("v").over(near))
        small = least.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        new = durable(small)
        # done when every edge goes from a node to a root, and each node has one edge
        open_ = new.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() or new.select(F.col("v").alias("u")).join(new.select("u"), "u", "left_semi").limit(1).count()
        e = new
        if not open_:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
