"""State machines over operation logs. A read-once run ends with all of the log folded; the tables agree with the batch operators'."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: ST7: how long a dismissed notification stays.
REMOVE_AFTER_MS = 1_000_000
POOL = "id string, shortlisted boolean, addedAt timestamp, score double, alive boolean, version bigint"


def events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the events table, its time with a zone so that it can bear a watermark."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", path.rsplit("/", 1)[1]).parquet(path.rsplit("/", 1)[0]).withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append", timeouts: bool = False) -> None:
    """All that is there now. A stream with processing-time timeouts always has another batch to run, so it gets one only."""
    trigger = {"once": True} if timeouts else {"availableNow": True}
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(**trigger).start().awaitTermination()


def fold_pool(log: DataFrame) -> DataFrame:
    """ST6: a stream (id, ts, seq, op, score, shortlisted) to successive versions of each pool row (update mode). Of an id, take the greatest version; alive is false once it is removed. Operations are folded in order of (ts, seq) in each batch, and batches as they come."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flag, added, score, alive, version = state.get if state.exists else (False, None, None, False, 0)
        for op in pd.concat(batches).sort_values(["ts", "seq"]).itertuples():
            version += 1
            if op.op == "remove":
                flag, added, score, alive = False, None, None, False
            elif op.op == "toggle":
                flag = alive and not flag
            elif op.op == "add":
                flag, added, alive = (alive and flag) or bool(op.shortlisted), added if alive else op.ts.value // 1000, True
                score = None if pd.isna(op.score) else float(op.score)
        state.update((flag, added, score, alive, version))
        yield pd.DataFrame({"id": [key[0]], "shortlisted": [flag], "addedAt": pd.Series([None if added is None else pd.Timestamp(added, unit="us")], dtype="datetime64[ns]"), "score": pd.Series([score], dtype="float64"), "alive": [alive], "version": [version]})

    return log.groupBy("id").applyInPandasWithState(step, POOL, "flag boolean, added bigint, score double, alive boolean, version bigint", "update", GroupStateTimeout.NoTimeout)


def latest(versions: DataFrame) -> DataFrame:
    """The pool that the versions come to."""
    return versions.groupBy("id").agg(F.max_by(F.struct("shortlisted", "addedAt", "score", "alive"), "version").alias("s")).select("id", "s.*").filter("alive").drop("alive")


def notifications(actions: DataFrame, remove_after_ms: int = REMOVE_AFTER_MS) -> DataFrame:
    """ST5, W4, ST7: a stream of (channel, seq, action, id, title) to what each channel shows (update mode): add keeps the newest only; update changes the title of the one with the id; dismiss, of one id or all, closes it and starts the time to its removal; remove takes it away."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shown = tuple(state.get) if state.exists else (None, None, False)
        if state.hasTimedOut:
            shown = (None, None, False)
            state.remove()
        else:
            for a in pd.concat(batches).sort_values("seq").itertuples():
                all_or_own = a.id is None or pd.isna(a.id) or a.id == shown[0]
                if a.action == "add":
                    shown = (a.id, a.title, True)
                elif a.action == "update" and a.id == shown[0]:
                    shown = (shown[0], a.title, shown[2])
                elif a.action == "dismiss" and all_or_own:
                    shown = (shown[0], shown[1], False)
                elif a.action == "remove" and all_or_own:
                    shown = (None, None, False)
            state.update(shown)
            if shown[0] is not None and not shown[2]:
                state.setTimeoutDuration(remove_after_ms)
        yield pd.DataFrame({"channel": [key[0]], "id": pd.Series([shown[0]], dtype="object"), "title": pd.Series([shown[1]], dtype="object"), "open": [shown[2]]})

    return actions.groupBy("channel").applyInPandasWithState(step, "channel string, id string, title string, open boolean", "id string, title string, open boolean", "update", GroupStateTimeout.ProcessingTimeTimeout)


def snapshots(collection: DataFrame, by: str) -> DataFrame:
    """ST1: the whole result at each change (complete mode); here the count and latest time of each key."""
    return collection.groupBy(by).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


def one_document(stream: DataFrame, id_: object, key: str = "id") -> DataFrame:  # ST2
    return stream.filter(F.col(key) == F.lit(id_))


def sign_ins(stream: DataFrame) -> DataFrame:
    """ST3: whether each user is signed in, from a stream of (user, ts, kind), as of the latest event."""
    return stream.groupBy("user").agg(F.max_by(F.col("kind") == "login", "ts").alias("signed_in"))


class Emitter:
    """ST4: listeners by event, called in turn for each batch of a stream that has the event's rows."""

    def __init__(self) -> None:
        self.listeners: dict[str, list[Callable[[DataFrame, int], None]]] = {}

    def on(self, event: str, listener: Callable[[DataFrame, int], None]) -> None:
        self.listeners.setdefault(event, []).append(listener)

    def off(self, event: str, listener: Callable[[DataFrame, int], None]) -> None:
        self.listeners[event] = [x for x in self.listeners.get(event, []) if x is not listener]

    def emit(self, batch: DataFrame, n: int, event: str = "event") -> None:
        """For foreachBatch. The batch is kept while its listeners run."""
        batch.persist()
        for name, own in list(self.listeners.items()):
            for listener in list(own):
                listener(batch.filter(F.col(event) == name), n)
        batch.unpersist()


def in_order(batch: DataFrame) -> DataFrame:
    """ST8: files of a batch are worked on at once, and come out by pos."""
    return batch.orderBy("pos")
